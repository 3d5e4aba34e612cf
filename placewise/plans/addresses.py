"""Address normalisation job over the store table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.address import postprocess_address, preprocess_address, strip


def normalized_addresses(stores: DataFrame, rewritten: str | None = None) -> DataFrame:
    """(id, address_raw, address_normalized). ``rewritten`` names a column with an externally rewritten
    address that stands in for the pre-processed one."""
    df = _with_source(stores, rewritten).select("id", F.col("address").alias("address_raw"), "_source")
    return postprocess_address(df, "_source", "address_normalized").drop("_source")


def _with_source(stores: DataFrame, rewritten: str | None) -> DataFrame:
    source = F.col(rewritten) if rewritten else preprocess_address(F.col("address"))
    unquoted = F.btrim(strip(source), F.lit("\"'"))
    cleaned = F.btrim(strip(F.regexp_replace(strip(unquoted), r"(?i)^output:\s*", "")), F.lit("\"'"))
    blank = strip(F.coalesce(F.col("address"), F.lit(""))) == ""
    return stores.withColumn("_source", F.when(~blank, strip(cleaned)))


def normalize_addresses(stores: DataFrame, rewritten: str | None = None) -> DataFrame:
    """Stores with their normalised address where that is not empty; one pass, no join."""
    kept = stores.columns
    df = postprocess_address(_with_source(stores, rewritten), "_source", "_normalized")
    new = F.coalesce(F.nullif("_normalized", F.lit("")), "address")
    return df.select(*[new.alias(c) if c == "address" else F.col(c) for c in kept])
