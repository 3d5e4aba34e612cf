"""Photo files: textual GPS metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Byte patterns and the bytes shown around a hit.
GPS_PATTERNS = ["GPSLatitude", "GPSLongitude", "gps:Latitude", "gps:Longitude"]
BEFORE, AFTER = 50, 100


def scan_gps_text(files: DataFrame) -> DataFrame:
    """(path, pattern, snippet) for every pattern found in ``content`` (binary)."""
    # ISO-8859-1 maps bytes to characters one to one, so character positions are byte positions. Positions are found
    # first, so that content is repeated for hits only.
    decoded = files.select("path", "content", F.decode("content", "ISO-8859-1").alias("_text"))
    hits = F.filter(F.array(*[F.struct(F.lit(p).alias("pattern"), F.instr(F.col("_text"), F.lit(p)).alias("at")) for p in GPS_PATTERNS]), lambda h: h["at"] > 0)
    located = decoded.select("path", "content", F.explode(hits).alias("_hit")).select("path", "content", "_hit.pattern", F.col("_hit.at").alias("_at"))
    start = F.greatest(F.col("_at") - BEFORE, F.lit(1))
    # Undecodable bytes, such as cut characters at the edges, are dropped.
    cut = F.substring(F.col("content"), start, F.col("_at") + AFTER - start)
    snippet = F.replace(F.make_valid_utf8(cut.cast("string")), F.lit("\ufffd"), F.lit(""))
    return located.select("path", "pattern", snippet.alias("snippet"))


def scan_photo_gps_text(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,heic}") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return scan_gps_text(files.select("path", "content"))
