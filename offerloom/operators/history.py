"""Price history, run logs and source status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def price_changes(observations: DataFrame) -> DataFrame:
    """Observations (product_id, price, recorded_at) whose price differs from the product's one before; the first stays."""
    w = Window.partitionBy("product_id").orderBy("recorded_at", "price")
    before = F.lag("price").over(w)
    return observations.withColumn("before", before).withColumn("first", F.row_number().over(w) == 1).where(F.col("first") | ~F.col("price").eqNullSafe(F.col("before"))).drop("before", "first")


def recent_history(history: DataFrame, n: int = 100) -> DataFrame:
    """The n latest entries of each product, with their rank from the newest."""
    w = Window.partitionBy("product_id").orderBy(F.desc("recorded_at"), F.desc("price"))
    return history.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_log(logs: DataFrame) -> DataFrame:
    """The newest run of each source; of runs at one time the one with the larger status."""
    newest = F.max(F.struct("created_at", "status", "items_count", "error_message")).alias("l")
    return logs.groupBy("source").agg(newest).select("source", "l.*")


def source_status(listings: DataFrame, logs: DataFrame, now: Column, sources: DataFrame, stale_after: str = "2 hours") -> DataFrame:
    """source, status (stale, error or healthy), last run, number of listings and last error."""
    counts = listings.groupBy("source").agg(F.count("*").alias("product_count"))
    known = sources.select("source").join(latest_log(logs), "source", "left").join(counts, "source", "left")
    old = F.col("created_at") < now - F.expr(f"INTERVAL {stale_after}")
    status = F.when(F.col("created_at").isNull(), "stale").when(F.col("status") == "error", "error").when(old, "stale").otherwise("healthy")
    return known.select("source", status.alias("status"), F.col("created_at").alias("last_run"), F.coalesce("product_count", F.lit(0)).alias("product_count"), F.when(F.col("status") == "error", F.col("error_message")).alias("last_error"))
