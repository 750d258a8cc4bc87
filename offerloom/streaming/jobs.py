"""Structured Streaming jobs: ingest of batches, price changes, and liveness of sources."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from offerloom.operators.graph import cut
from offerloom.operators.groups import build_match_groups, refresh_match_groups
from offerloom.operators.ingest import process_batch, remove_all_stale, upsert
from offerloom.sources.tables import write_table


def stream_source_counts(stream: DataFrame, window: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Items of each source in each tumbling window of `ts`; rows later than `late` do not count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(F.count("*").alias("items")).select(F.col("window.start").alias("start"), "source", "items")


#: The store in which stateful streams keep what they know: on disk, so that state may outgrow an executor's memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "product_id long, price long, ts timestamp"


class LastPrice(StatefulProcessor):
    """The last price of a product and its time, forgotten once the product was idle for so many milliseconds."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("price", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        seen = pd.concat(list(rows)).sort_values(["at", "price"], kind="stable", ignore_index=True)
        at, last = self.last.get() if self.last.exists() else (None, None)
        if at is not None:
            seen = seen[seen["at"] >= at]
        if len(seen):
            price = seen["price"].astype("Int64")
            before = price.shift()
            before.iloc[0] = pd.NA if last is None else last
            same = ((price == before) | (price.isna() & before.isna())).fillna(False)
            if at is None:
                same.iloc[0] = False
            at, last = int(seen["at"].iloc[-1]), price.iloc[-1]
            self.last.update((at, None if pd.isna(last) else int(last)))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at // 1000 + self.idle_ms)
            yield pd.DataFrame({"product_id": key[0], "price": price, "ts": seen["ts"]})[~same.astype(bool)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame({"product_id": pd.Series(dtype="int64"), "price": pd.Series(dtype="Int64"), "ts": pd.Series(dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def stream_price_changes(stream: DataFrame, late: str = "1 hour", idle: timedelta = timedelta(days=365)) -> DataFrame:
    """(product_id, price, ts) when a product's price differs from its last one.

    The last price and its time are the state of each product.  Observations
    are taken in time order within a micro-batch; one that is older than the
    product's last, or later than the watermark, is ignored, as is one
    repeated within the watermark.  A product of which nothing came for `idle`,
    in event time, is forgotten: what comes then is its first price again, and
    the state holds only products seen within that time.  A null price is a
    price like any other.  Sets the session's state store to STATE_STORE.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    fresh = stream.select("product_id", "price", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["product_id", "price", "ts"])
    fresh = fresh.withColumn("at", F.unix_micros("ts"))
    return fresh.groupBy("product_id").transformWithStateInPandas(LastPrice(int(idle.total_seconds() * 1000)), CHANGES, "append", "eventtime")


#: The record of finished batches: for each source the version that holds its rows, and the version of the groups.
COMMITS = "batch_id long, versions map<string,string>, groups string, at timestamp"
HISTORY = "product_id string, price long, recorded_at timestamp"


def _shop(source: Column) -> Column:
    """The partition of a source: never taken for a number, and there for a null source too."""
    return F.concat(F.lit("of-"), F.coalesce(source, F.lit("")))


def _stored(spark: SparkSession, folder: str, name: str, versions: dict[str, str], schema: str | None = None) -> DataFrame:
    """The rows of a table at the versions of some shops; only the partitions of those are read."""
    reader = spark.read.option("basePath", f"{folder}/{name}")
    if schema:
        reader = reader.schema(f"{schema}, version string, shop string")
    rows = reader.parquet(*[f"{folder}/{name}/version={v}" for v in sorted(set(versions.values()))])
    current = F.create_map(*[F.lit(x) for pair in sorted(versions.items()) for x in pair])
    return rows.where(F.col("version") == F.try_element_at(current, F.col("shop"))).drop("version", "shop")


def committed(spark: SparkSession, folder: str, before: int | None = None, only: set[str] | None = None) -> dict[str, DataFrame] | None:
    """products, history and groups of the last finished batch (with a number below `before`), None where there is none.

    only: the shops whose products and history are wanted; without any of them there the two are None.
    """
    done = spark.read.schema(COMMITS).option("ignoreMissingFiles", "true").parquet(f"{folder}/commits")
    if before is not None:
        done = done.where(F.col("batch_id") < before)
    last = done.orderBy(F.desc("batch_id"), F.desc("at"), "groups").first()
    if last is None or not last.versions:
        return None
    versions = {s: v for s, v in last.versions.items() if only is None or s in only}
    tables = {"versions": last.versions, "groups": spark.read.parquet(f"{folder}/groups/version={last.groups}"), "at": last.groups}
    return tables | {"products": versions and _stored(spark, folder, "products", versions) or None, "history": versions and _stored(spark, folder, "history", versions, HISTORY) or None}


def ingest_batch(folder: str, clean: Callable[[DataFrame], DataFrame] = process_batch, finished: Callable[[str], None] = lambda step: None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: clean a batch, put it into the tables under folder, drop what it made stale, refresh the groups.

    Products and history lie in a partition for each version and source.  A
    batch reads and writes the partitions of its own sources alone; the others
    stay where they are (an id belongs to one source).  Groups are aggregated
    anew where they have a member of those sources.  At the end one row of
    `commits`, with the version that counts for each source, makes it all
    visible.  A batch starts from what was committed for a batch before it,
    never from its own: one that was cut off half-way leaves nothing that is
    read, and one that runs again, finished or not, gives the same tables.  A
    batch without rows is committed as well.  finished is told the name of
    each table when it is written.  The number of sources is that of shops:
    their names are read by the driver.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cleaned = cut(clean(batch))
        if batch_id == 0:
            spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{folder}/commits")
        touched = {r.shop for r in cleaned.select(_shop(F.col("source")).alias("shop")).distinct().collect()}
        before = committed(spark, folder, batch_id, touched)
        if not touched:
            versions, group_version = (before["versions"], before["at"]) if before else ({}, "")
        else:
            group_version = f"v{batch_id}-{uuid4().hex}"
            versions = (before["versions"] if before else {}) | dict.fromkeys(touched, group_version)
            current = before and before["products"]
            if current is None:
                current = cleaned.limit(0).withColumns({"match_group_id": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
            history = before and before["history"] or spark.createDataFrame([], HISTORY)
            now = F.lit(cleaned.agg(F.max("scraped_at")).first()[0]).cast("timestamp")
            products, changed = upsert(current, cleaned, now)
            history = history.unionByName(changed)
            _write(remove_all_stale(products, history, cleaned)[0], folder, "products", group_version)
            finished("products")
            # Read back, so that the products are not made again for their history.
            products = _stored(spark, folder, "products", dict.fromkeys(touched, group_version))
            of = products.select(F.col("id").alias("product_id"), "source")
            _write(history.join(of, "product_id"), folder, "history", group_version, "source")
            finished("history")
            everything = _stored(spark, folder, "products", versions)
            if before is None:
                made = build_match_groups(everything)
            else:
                ids = current.select("match_group_id").union(products.select("match_group_id"))
                made = refresh_match_groups(before["groups"], everything, ids)
            write_table(made, f"{folder}/groups/version={group_version}")
            finished("groups")
        row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), _map(versions).alias("versions"), F.lit(group_version).alias("groups"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")

    return run


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair]).cast("map<string,string>")


def _write(rows: DataFrame, folder: str, name: str, version: str, *drop: str) -> None:
    """Write a version of some shops' rows; the files of other versions are not touched."""
    rows.withColumn("shop", _shop(F.col("source"))).drop(*drop).write.mode("overwrite").partitionBy("shop").parquet(f"{folder}/{name}/version={version}")


def stream_ingest(stream: DataFrame, folder: str, checkpoint: str):
    """Start the ingest of all batches that have arrived."""
    return stream.writeStream.foreachBatch(ingest_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
