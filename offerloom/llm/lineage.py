"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), a fresh temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="offerloom-checkpoint-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lost executors lose none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, like: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = like
    while name.lower() in taken:
        name = f"{name}_"
    return name


#: Rows of names and numbers up to which a table lies in one partition, so that steps on it need no shuffle.
ONE_TASK = 200_000


def gathered(df: DataFrame) -> DataFrame:
    """df, cut; a table of at most ONE_TASK rows in one partition, a larger one as it is."""
    df = cut(df)
    return df.coalesce(1) if df.count() <= ONE_TASK else df
