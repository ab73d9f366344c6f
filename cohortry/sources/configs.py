"""Module configuration files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_configs(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """``module, config``: one row per JSON file, the module named after the file."""
    files = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True)
    if recurse:
        files = files.option("recursiveFileLookup", True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return files.text(folder).select(name.alias("module"), F.col("value").alias("config"))
