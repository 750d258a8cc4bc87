"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="offerloom-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Edges that one task takes; the steps are the same, without shuffles.
ONE_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the smallest node that each node reaches."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= ONE_TASK:
        e = e.coalesce(1)
    state = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state and now[0]:
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        stars = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        floor = stars.groupBy("u").agg(F.min("v").alias("m"))
        down = stars.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(down.union(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    leaves = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return leaves.union(leaves.select(F.col("label").alias("node"), "label").distinct())
