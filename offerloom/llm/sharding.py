"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0 .. N - 1 in an order that depends on their values
alone: by a hash range of (id, checksum, size), then by those values.  A
Feistel network over Z_a x Z_b, a * b the least such product with a = ceil(sqrt
N), permutes the numbers; a result of N or more walks on through the network
until it falls below N.  The permuted number p gives shard p mod S and slot
p div S, so shard sizes differ by one at most, slots have no gaps, and both
can be computed for any row number without looking at other rows.

Work, all in DataFrame functions: the texts are read for size and
checksum, once for the count, once for the numbers and once for the sizes of the
ranges, and go no further; equal rows are counted together before any
shuffle, so repeated rows cannot make a partition large; numbering is a window
inside hash ranges of about RANGE_ROWS rows plus an offset table with one row
for each range.

Defined cases: a null text has size 8 and checksum 0; null ids are ordinary
values; equal rows get different numbers and are interchangeable; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS, SEED, RANGE_ROWS, WALKS = 6, 20_240_229, 50_000, 64


def sides(n: int) -> tuple[int, int]:
    """a and b of the network for n numbers."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass through the Feistel network: a permutation of 0 .. a * b - 1."""

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).cast("long").alias("l"), F.when(even, s["r"]).otherwise(right).cast("long").alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """Where row number `row` of n goes.

    Fewer than a of the network's numbers lie beyond n - 1, so a walk is short:
    below 4,000 rows WALKS steps always do, and above each step leaves with a
    chance of 62 in 63 or better.  Running out of steps raises an error.
    """
    a, b = sides(n)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _network(row, a, b, seed), lambda x, _: F.when(x < n, x).otherwise(_network(x, a, b, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def row_numbers(rows: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """rows (of orderable columns) with a global number `row`, and their count."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    n = rows.count()
    ranges = max(1, ceil(n / range_rows))
    merged = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    merged = merged.withColumn("__range", F.pmod(F.xxhash64(*columns), F.lit(ranges)).cast("int"))
    order = Window.partitionBy("__range").orderBy(*columns)
    running = merged.withColumn("__stop", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = merged.groupBy("__range").agg(F.sum("__n").alias("__size"))  # one row for each range
    offsets = sizes.withColumn("__offset", F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    at = running.join(offsets.select("__range", F.coalesce("__offset", F.lit(0)).alias("__offset")), "__range")
    first = F.col("__offset") + F.col("__stop") - F.col("__n")
    each = F.when(F.col("__n") == 1, F.array(first)).otherwise(F.sequence(first, first + F.col("__n") - 1))
    return at.select(*columns, F.explode(each).alias("row")), n


def shards(docs: DataFrame, count: int = 24, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """id, size, crc32, row, shard and slot of every row of docs."""
    t = F.col(f"`{text}`")
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc32"),
    )
    numbered, n = row_numbers(narrow)
    placed = numbered.withColumn("__p", permuted(F.col("row"), max(n, 1), seed))
    return placed.select("id", "size", "crc32", "row", F.pmod("__p", F.lit(count)).cast("int").alias("shard"), F.floor(F.col("__p") / F.lit(count)).cast("long").alias("slot"))
