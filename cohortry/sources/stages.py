"""Tables and stages that are built once and then reused."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def column_names(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table)]


def create_if_absent(
    spark: SparkSession, table: str, build: Callable[[], DataFrame], if_present: str | None = None
) -> bool:
    """Create ``table`` from ``build()`` and return True; when it exists run ``if_present`` and return False."""
    if table_exists(spark, table):
        if if_present:
            spark.sql(if_present)
        return False
    build().write.saveAsTable(table)
    return True


def publish(df: DataFrame, name: str) -> str:
    """Writes ``df`` as a new version and lets the view ``name`` show it; returns the version's table.

    The view changes in one step: readers see the version before or this one, never a half-written table.
    """
    spark, version = df.sparkSession, f"{name}__{uuid.uuid4().hex}"
    df.write.saveAsTable(version)
    spark.sql(f"create or replace view {name} as select * from {version}")
    return version


def versions(spark: SparkSession, name: str) -> list[str]:
    """The tables of all versions of ``name`` that are kept."""
    return sorted(t.name for t in spark.catalog.listTables() if re.fullmatch(rf"{re.escape(name)}__[0-9a-f]{{32}}", t.name))


def retire(spark: SparkSession, name: str, keep: str) -> None:
    """Drops the versions of ``name`` other than ``keep``."""
    for version in versions(spark, name):
        if version != keep.lower():
            spark.sql(f"drop table {version}")


def append_once(df: DataFrame, table: str, run: str) -> None:
    """Appends ``df`` to ``table`` as the rows of one run (column ``run_id``), the first time creating the table.

    The same run again replaces its own rows, so a run that is repeated or was stopped halfway adds no row twice; other
    runs' rows are not touched. A run's name has letters, digits, blanks and ``_ . : -`` only.
    """
    if not re.fullmatch(r"[\w .:-]+", run):
        raise ValueError(f"not a name of a run: {run!r}")
    spark = df.sparkSession
    if not table_exists(spark, table):
        df.limit(0).withColumn("run_id", F.lit(run)).write.partitionBy("run_id").saveAsTable(table)
    columns = [f"`{name}`" for name in column_names(spark, table) if name != "run_id"]
    view = f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        spark.sql(f"insert overwrite table {table} partition (run_id = '{run}') select {', '.join(columns)} from {view}")
    finally:
        spark.catalog.dropTempView(view)


def identity(df: DataFrame) -> str:
    """A digest of what a DataFrame is made of, the same in every session while the data are the same.

    It is that of the plan without Spark's running numbers, of the path, size and time of every file it reads,
    and, where rows come from elsewhere than files or ranges, of the rows, in any order.
    """
    spark = df.sparkSession
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().analyzed()
        shape = re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]", "", plan.canonicalized().toString())
    finally:
        spark.conf.set(name, before)
    parts = [shape, df.schema.simpleString()]
    if files := sorted(df.inputFiles()):
        listed = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        parts.append(str(_row_digest(listed)))
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if not kinds <= {"LogicalRelation", "HiveTableRelation", "Range", "OneRowRelation"}:
        parts.append(str(_row_digest(df)))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _row_digest(df: DataFrame) -> tuple:
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    sums = [F.sum(F.xxhash64(F.lit(salt), "row").cast("decimal(38,0)")) for salt in (1, 2)]
    return tuple(rows.agg(F.count("*"), *sums).first())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing ``path``: its commit leaves a ``_SUCCESS`` file."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def _marked(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the stage at ``path`` was written under ``mark``."""
    found = f"{path}.mark"
    return is_complete(spark, found) and spark.read.text(found).where(F.col("value") == mark).count() == 1


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], mark: str = "") -> DataFrame:
    """The stage stored at ``path``; built and written first when no complete copy is there.

    A half-written copy of a failed run has no commit marker and is overwritten. So is a
    copy written under another ``mark``: a text that says what the stage was made from.
    """
    if not (is_complete(spark, path) and _marked(spark, path, mark)):
        build().write.mode("overwrite").parquet(path)
        spark.range(1).select(F.lit(mark).alias("value")).write.mode("overwrite").text(f"{path}.mark")
    return spark.read.parquet(path)
