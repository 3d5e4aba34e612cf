"""Store table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.formats import store_code
from placewise.operators.relational import with_category


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table from files, or over JDBC with ``fmt='jdbc'`` (url, partitionColumn, bounds in ``options``)."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").option("dbtable", source).options(**options).load()
    return spark.read.format(fmt).options(**options).load(source)


def load_stores(stores: DataFrame, categories: DataFrame) -> DataFrame:
    """Stores with category name for the graph: rendered id, phone '' instead of null, empty services."""
    return with_category(stores, categories).select(
        "id", store_code(F.col("id")).alias("store_id"), F.col("name").alias("brand"), F.col("category_name").alias("category"),
        "address", F.coalesce("phone", F.lit("")).alias("phone"), "lat", F.col("lng").alias("lon"),
    )
