"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: where the session checkpoints to.

    That is the folder named by ``spark.checkpoint.dir`` when it is set. Only a
    local session without it gets a folder of its own; on a cluster a folder on
    one machine would be lost with that machine, so there the setting is required.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="cohortry-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, and read from there from now on.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. Being a
    Parquet table, the copy has a known size, so Catalyst broadcasts it in a
    join only while it is below the session's threshold, and its readers take the
    columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote to the shared folder."""
    if not path.startswith(shared_folder(spark)):
        raise ValueError(f"not in the shared folder: {path}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a written table in buckets by ``keys``, each sorted by them.

    A join by the keys neither shuffles nor sorts it, and a filter by single values of one key reads
    the buckets of these values only. There are as many buckets as shuffle partitions. The files stay in the shared
    folder; the table's name is gone from the catalog when this returns.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out first, so that each bucket is one file
    return _in_buckets(df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys), df.sparkSession)


def grouped(df: DataFrame, *keys: str) -> DataFrame:
    """What an aggregate by ``keys`` has made, as a written table in buckets by them; grouping it by them again takes no shuffle.

    The aggregate has dealt the rows out by the keys, so writing takes no other shuffle, and its shuffle files are removed
    as soon as the table is there. Buckets are not sorted.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        return _in_buckets(df.write.bucketBy(count, *keys).option("compression", "zstd"), spark)


def _in_buckets(writer: DataFrameWriter, spark: SparkSession) -> DataFrame:
    name, path = f"bucketed_{uuid.uuid4().hex}", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer.option("path", path).format("parquet").saveAsTable(name)
    made = spark.table(name)
    made.schema  # resolved while the name is there
    spark.sql(f"drop table {name}")  # of an external table only the name goes
    return made


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: each write removes its own when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores when the scan has fewer tasks than there are cores.

    For costly work on each row of a few files that cannot be split. A scan of
    many files has enough tasks and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_frame(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A small driver-side table.

    It becomes a local relation, so Catalyst knows its size and decides by the
    session's own threshold whether a join may broadcast it.
    """
    schema = pa.schema([(name, types[name]) for name in columns])
    return spark.createDataFrame(pa.table(columns, schema=schema))


def rows_up_to(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows of a table that is expected to be small, or None when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
