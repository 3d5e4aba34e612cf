"""Structured Streaming counterparts of the store, review, search and approval flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from placewise.functions.columns import sealed
from placewise.functions.formats import round_exact
from placewise.functions.text import decide, normalize_text, similarity, weighted_score
from placewise.operators.relational import recent_searches
from placewise.operators.spatial import radius_join
from placewise.operators.workflow import merge_image_changes, merge_store_changes, newest_changes, note_changes

ADDED, UPDATED = "STORE_ADDED", "STORE_UPDATED"


def read_changes(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", glob).parquet(folder)


def store_updates(changes: DataFrame) -> DataFrame:
    """Messages about active stores from store rows with a ``created`` flag; works on streams and tables."""
    return changes.where(F.col("state") == "active").select(
        F.when(F.col("created"), ADDED).otherwise(UPDATED).alias("action"), F.col("id").alias("store_id"), "name", "lat", "lng"
    )


def running_ratings(reviews: DataFrame) -> DataFrame:
    """Rating of every reviewed store so far. State is one row per store, so no watermark is needed."""
    return reviews.groupBy("store_id").agg(
        F.avg("rating").alias("rating_avg"), F.count("rating").cast("int").alias("rating_count")
    )


def latest_searches(history: DataFrame) -> DataFrame:
    """Recent-search list kept current: one row per user and case-insensitive keyword."""
    return recent_searches(history)


def duplicate_alerts(arriving: DataFrame, stores: DataFrame, radius: float = 15.0) -> DataFrame:
    """Matches of arriving stores (candidate_id, name, lng, lat) with the known ones; a stream-static join.

    Emits warnings and rejects; ranking within a candidate is left to the reader, because a stream has no
    row order.
    """
    asked = arriving.select("candidate_id", "lng", "lat", normalize_text(F.col("name")).alias("norm")).where("norm <> ''")
    known = stores.select("id", "lng", "lat", normalize_text(F.col("name")).alias("norm"))
    pairs = radius_join(asked, known, radius).select("*", sealed(similarity(F.col("l_norm"), F.col("r_norm"))).alias("metrics"))
    scored = pairs.withColumn("score", weighted_score(F.col("metrics"))).withColumn("decision", decide(F.col("score")))
    return scored.where(F.col("decision") != "accept").select(
        F.col("l_candidate_id").alias("candidate_id"), F.col("r_id").alias("store_id"), round_exact(F.col("distance"), 2).alias("distance_m"),
        round_exact(F.col("score"), 4).alias("score"), "decision",
    )


def log_approvals(approvals: DataFrame, log: str, when: str = "date_up") -> DataStreamWriter:
    """Write what approved notes change to a change log, batch by batch; ``merged_state`` reads it.

    A batch writes its own changes only, one row per store or image and field, under its number: a batch repeated after a restart replaces itself, and no table is
    rewritten. Values are told apart by ``when``, so batches may come in any order, and an older decision in a later batch overwrites nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        note_changes(batch, when).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return approvals.writeStream.outputMode("append").foreachBatch(step)


def merged_state(stores: DataFrame, images: DataFrame, log: str) -> tuple[DataFrame, DataFrame]:
    """Stores and images after all changes in the log, merged while it is read."""
    changes = newest_changes(stores.sparkSession.read.parquet(log).drop("batch"))
    return merge_store_changes(stores, changes), merge_image_changes(images, changes)


def compact_log(spark: SparkSession, log: str, target: str) -> None:
    """The log reduced to the newest changes as a log of its own; ``log`` must not be written to meanwhile."""
    newest_changes(spark.read.parquet(log).drop("batch")).write.mode("overwrite").parquet(f"{target}/batch=-1")


def run_once(writer: DataStreamWriter, checkpoint: str):
    """Process everything available and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_once(stream: DataFrame, path: str) -> DataFrame:
    """Run an append-only stream into a table under ``path`` until nothing is left; the table."""
    run_once(stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows"), f"{path}/progress")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def update_once(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run an aggregated stream until nothing is left; the latest row of every key.

    Each batch writes its changed rows to a folder of its own, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run_once(stream.writeStream.outputMode("update").foreachBatch(write), f"{path}/progress")
    written = stream.sparkSession.read.parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in stream.columns])
