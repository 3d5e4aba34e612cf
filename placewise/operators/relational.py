"""Joins and aggregates of the store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.operators.substring import contains_join
from placewise.tables import materialize


def with_category(stores: DataFrame, categories: DataFrame) -> DataFrame:
    """Inner join to the category dimension (the planner broadcasts it while it is small)."""
    return stores.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id")


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, target: str) -> DataFrame:
    """Look up ``label`` of the row ``key`` points at; a missing key keeps the row with null."""
    lookup = labels.select(F.col("id").alias(key), F.col(label).alias(target))
    return df.join(lookup, key, "left")


def first_category_containing(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Add ``category_id``: smallest id of a category whose name contains the text, case-insensitive."""
    asked = df.select(F.lower(column).alias("_asked")).where("_asked <> ''").distinct()
    names = categories.select(F.col("id").alias("category_id"), F.lower("name").alias("_name"))
    found = contains_join(asked, names, "_asked", "_name").groupBy("_asked").agg(F.min("category_id").alias("category_id"))
    return df.withColumn("_asked", F.lower(column)).join(found, "_asked", "left").drop("_asked")


def exclude_at(df: DataFrame, pins: DataFrame, reach: float = 1e-5) -> DataFrame:
    """Drop rows closer than ``reach`` degrees to a pin in both coordinates.

    Anti join on cells of ``reach``: a row looks at its own and the neighbouring cells.
    """
    cell = {n: F.floor(F.col(n) / reach).cast("long") for n in ("lng", "lat")}
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = pins.select(F.col("lng").alias("p_lng"), F.col("lat").alias("p_lat"), cell["lng"].alias("_x"), cell["lat"].alias("_y"))
    spread = spread.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).select(
        "p_lng", "p_lat", (F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y")
    )
    placed = df.withColumns({"_x": cell["lng"], "_y": cell["lat"]})
    near = (
        (placed["_x"] == spread["_x"]) & (placed["_y"] == spread["_y"])
        & (F.abs(placed["lng"] - spread["p_lng"]) < reach) & (F.abs(placed["lat"] - spread["p_lat"]) < reach)
    )
    return placed.join(spread, near, "left_anti").drop("_x", "_y")


def rating_summary(stores: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add rating_avg (0.0 without reviews) and rating_count."""
    stats = reviews.groupBy(F.col("store_id").alias("id")).agg(
        F.avg("rating").alias("rating_avg"), F.count("rating").cast("int").alias("rating_count")
    )
    base = stores.drop("rating_avg", "rating_count")
    return base.join(stats, "id", "left").withColumns({
        "rating_avg": F.coalesce("rating_avg", F.lit(0.0)), "rating_count": F.coalesce("rating_count", F.lit(0)),
    })


def image_counts(stores: DataFrame, images: DataFrame) -> DataFrame:
    counts = images.where("store_id is not null").groupBy(F.col("store_id").alias("id")).agg(F.count("*").alias("image_count"))
    return stores.select("id").join(counts, "id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def label_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "label")


def distinct_addresses(stores: DataFrame) -> DataFrame:
    """Every distinct address with its number of stores."""
    return stores.groupBy("address").agg(F.count("*").alias("stores"))


def recent_searches(history: DataFrame) -> DataFrame:
    """Latest entry per user and case-insensitive keyword (an aggregate, so no per-user sort is needed)."""
    latest = F.max_by(F.struct("id", "keyword", "created_at"), F.struct("created_at", "id"))
    picked = history.groupBy("user_id", F.lower("keyword").alias("_word")).agg(latest.alias("r"))
    return picked.select("user_id", "r.id", "r.keyword", "r.created_at")


def take_per_label(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """First ``n`` rows per label by any sortable ``order``, unique within a label; nulls come first.

    Rows are range-partitioned by (label, order) and counted per partition. Whole partitions are kept, and only the
    one with a label's n-th row is ranked, so a frequent label is never sorted in one task.
    """
    placed = materialize(df.repartitionByRange(F.col("label"), F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(F.col("label").alias("_label"), F.col("_part").alias("_p")).agg(F.count("*").alias("_size"))
    running = Window.partitionBy("_label").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_size").over(running)).where(F.col("_upto") - F.col("_size") < n)
    placed = placed.join(counts, placed["label"].eqNullSafe(counts["_label"]) & (placed["_part"] == counts["_p"]))
    whole = placed.where(F.col("_upto") <= n)
    cut = placed.where(F.col("_upto") > n)
    cut = cut.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(order)))
    cut = cut.where(F.col("_upto") - F.col("_size") + F.col("_n") <= n)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def evaluate_pairs(scored: DataFrame, threshold: float) -> DataFrame:
    """Recall on labelled duplicate pairs with a ``score``: detected, missed, total."""
    hit = F.col("score") >= threshold
    return scored.agg(F.count_if(hit).alias("detected"), F.count_if(~hit).alias("missed"), F.count("*").alias("total"))


def missed_pairs(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") < threshold)


def name_stops(stops: DataFrame, stores: DataFrame) -> DataFrame:
    """Add ``stop_name`` to (route_id, stop_no, last, lng, lat): the store on exactly that point with the
    smallest id, else a numbered stop or the destination."""
    named = stores.groupBy("lng", "lat").agg(F.min_by("name", "id").alias("_name"))
    fallback = F.when(F.col("last"), F.lit("đích")).otherwise(F.concat(F.lit("Điểm dừng "), F.col("stop_no").cast("string")))
    return stops.join(named, ["lng", "lat"], "left").withColumn("stop_name", F.coalesce("_name", fallback)).drop("_name")
