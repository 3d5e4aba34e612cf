"""Written intermediate tables for iterative jobs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master with nothing set gets a temporary folder: on a cluster a machine-local folder is
    lost with its machine, so there the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="placewise-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run inside as soon as it has ended.

    Else they stay until the driver happens to collect its garbage, and a long job holds those of all its steps at once.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner true sizes for its join choice. The step's shuffle files go when it has ended.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_split(df: DataFrame, column: str, values: list) -> dict:
    """Like ``materialize``, one table per value of ``column``, each with its own true size."""
    spark = df.sparkSession
    path = fresh_path(spark)
    with freed_shuffles(spark):
        df.write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    tables = {}
    for value in values:
        try:
            tables[value] = spark.read.schema(schema).parquet(f"{path}/{column}={value}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[value] = spark.createDataFrame([], schema)  # no row has this value
    return tables


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    The planner takes a table's size from its compressed files; rows that grow in memory could fill the driver.
    """
    return df.hint("merge")


def fresh_path(spark: SparkSession) -> str:
    """A new, empty place in the shared folder."""
    return f"{shared_folder(spark)}/placewise/{uuid.uuid4().hex}"
