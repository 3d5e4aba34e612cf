"""Address dump reader, address backup writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_address_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """Values of a fixed-width text dump: no byte-order mark, header, rule, blank lines or row count.

    The header is a column name centred with blanks; values start after a single blank.
    """
    text = F.regexp_replace(column, "^﻿", "")
    rows = lines.select(text.alias("_t"))
    noise = F.col("_t").rlike(r"^-+(\+-+)*$|^\(\d+ rows?\)$|^\s*$|^\s{2,}[a-z_]+\s*$")
    return rows.where(~noise).select(F.trim("_t").alias("address"))


def read_address_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_address_dump(spark.read.text(path))


def write_backup(normalized: DataFrame, path: str) -> None:
    """JSON lines of (id, address_raw, address_normalized)."""
    normalized.select("id", "address_raw", "address_normalized").write.mode("overwrite").json(path)
