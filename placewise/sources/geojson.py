"""Stores as GeoJSON features and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """
struct<id:bigint,geometry:struct<type:string,coordinates:array<double>>,
properties:struct<id:bigint,name:string,address:string,phone:string,email:string,category:bigint,
category_detail:struct<id:bigint,name:string,slug:string,icon:string>,rating_avg:double,rating_count:int,open_time:string,
close_time:string,state:string,describe:string,note:string,images:array<struct<id:bigint,image:string,describe:string>>>>
"""


def to_geojson(stores: DataFrame) -> DataFrame:
    """One GeoJSON feature text per store, with nested category and public images when the columns are there."""
    c = F.col
    have = set(stores.columns)
    detail = [c("category_id").alias("id"), c("category_name").alias("name")]
    detail += [c(n) for n in ("slug", "icon") if n in have]
    properties = [
        c(n) for n in (
            "name", "address", "phone", "email", "rating_avg", "rating_count", "open_time", "close_time", "state", "describe", "images"
        ) if n in have
    ]
    if "category_id" in have:
        properties.append(c("category_id").alias("category"))
        if "category_name" in have:
            properties.append(F.struct(*detail).alias("category_detail"))
    feature = F.struct(
        c("id"), F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return stores.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(stores: DataFrame, path: str) -> None:
    """One feature per line, so every task writes its own part."""
    to_geojson(stores).select("feature").write.mode("overwrite").text(path)


def from_features(features: DataFrame, column: str = "feature") -> DataFrame:
    """Feature texts back to store rows; the id comes from the feature or its properties."""
    parsed = features.select(F.from_json(column, _SCHEMA).alias("f"))
    p = F.col("f.properties")
    return parsed.select(
        F.coalesce("f.id", p["id"]).alias("id"), p["name"].alias("name"), p["category"].alias("category_id"),
        p["category_detail"]["name"].alias("category_name"), p["address"].alias("address"), p["images"].alias("images"),
        p["rating_avg"].alias("rating_avg"), p["rating_count"].alias("rating_count"), p["open_time"].alias("open_time"),
        p["close_time"].alias("close_time"), p["state"].alias("state"),
        F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
        p["describe"].alias("describe"), p["note"].alias("note"), p["phone"].alias("phone"), p["email"].alias("email"),
    )


def from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FeatureCollection documents (one per file) or of files with one feature per line."""
    documents = spark.read.text(path, wholetext=True)
    collection = F.from_json("value", f"struct<features:array<{_SCHEMA.strip()}>>")["features"]
    exploded = documents.select(F.explode(collection).alias("f")).select(F.to_json("f").alias("feature"))
    return from_features(exploded)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files written by ``write_geojson``; the files are split between tasks."""
    return from_features(spark.read.text(path), "value")
