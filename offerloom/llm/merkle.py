"""Merkle manifest of a table: a tree for each source, one over their roots, and proofs climbed by a recursive query.

Every row is a leaf, the SHA-256 of its fields.  Leaves of one source stand in
the order of their ids; FANOUT consecutive nodes become the hash of their
hashes, level by level, until one is left, the source's subroot.  Subroots in
the order of the sources become the root in the same way.

Leaves get global numbers in the order of (source, id) by ranges: rows are
dealt by range, sorted inside a range, and numbered from the count of the
ranges before.  So the leaves under any node are an interval of numbers, and
its parent follows from the numbers alone.  Each level is written to the shared
folder as node rows that name their parent.

The proofs are climbed by a Spark recursive query: it starts from the leaves,
tampered where asked for, and each step joins the nodes of the level above,
appends the siblings found there, and folds the hash with them.  All leaves of
a source meet at its subroot, and all leaves at the root; so leaves form
buckets of BUCKET consecutive numbers, a node is repeated for each bucket under
it, and the join is by bucket and node: no key has more than BUCKET leaves.

Work: rows are read once for their hashes, texts go no further.  Rows of about
100 bytes are sorted once, and each level of the climb moves them once, with
up to FANOUT digests beside on the first ANCHORED levels.  Node rows are a fifteenth of the leaves, their repetitions one
for each bucket and level.  The offset table has one row for each range of
RANGE_ROWS leaves.

Defined cases: a null field is hashed as ``-``; leaves of one source with equal
ids stand in the order of their hashes, so equal rows are interchangeable and
each gets a row of the result; null ids come first and are not tampered with;
a null source is a source, the first one; a single leaf is its source's
subroot, a single subroot the root, with the hash of nothing as proof; an empty
table gives an empty result; a text of any length is hashed in its task;
columns that are not asked for are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.llm.lineage import cut, free_name, shared_folder

FANOUT, BUCKET, RANGE_ROWS = 16, 4096, 50_000
#: Height of the nodes under which leaves share the siblings above.
ANCHORED = 3
#: Heights of the tree over the subroots begin here; no tree of a source is as high.
TOP = 100
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ALL = 1 << 20
_FINE = 4096  # buckets that one row is repeated for at a time


def field(value: Column) -> Column:
    """A field as it is hashed: UTF-8 byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(of: Column) -> Column:
    return F.unhex(F.sha2(of, 256))


def numbered(rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """rows with their place `at` in an order, from 0, and their count; of equal rows any may come first."""
    rows = cut(rows)
    n = rows.count()
    tie = free_name(rows, "tie")
    by = [*order, F.col(tie)]
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = cut(tied.repartitionByRange(max(1, ceil(n / range_rows)), *by).sortWithinPartitions(*by).drop(tie))
    own = F.monotonically_increasing_id()  # range in the high bits, row of it in the low 33
    placed = dealt.select("*", F.shiftrightunsigned(own, 33).alias("range"), own.bitwiseAND((1 << 33) - 1).alias("row"))
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    offsets = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = placed.join(F.broadcast(offsets), "range")  # one row for each range
    return out.select(*rows.columns, (F.col("before") + F.col("row")).alias("at")), n


def spread(rows: DataFrame, first: str, last: str) -> DataFrame:
    """rows repeated for every bucket of the leaf numbers first to last; long intervals are dealt out before they are written out."""
    low, high = F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET)
    coarse = rows.withColumn("block", F.explode(F.sequence(F.floor(low / _FINE), F.floor(high / _FINE))))
    coarse = coarse.repartition("block", first)
    fine = F.explode(F.sequence(F.greatest(low, F.col("block") * _FINE), F.least(high, F.col("block") * _FINE + _FINE - 1)))
    return coarse.withColumn("bucket", fine).drop("block")


@dataclass
class Manifest:
    """leaves: id, leaf, changed, at, bucket, place, up_height, up_at, subroot; nodes: as written; root as hex, null for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def _parents(children: DataFrame, height: int, group: list[Column], at: Column, folder: str) -> DataFrame:
    """Node rows of a level, written and read again."""
    kids = F.array_sort(F.collect_list(F.struct("place", "hash")))
    made = children.groupBy(*group, at.alias("node")).agg(
        F.aggregate(kids, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["hash"])).alias("kids"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    made = made.withColumn("hash", _hash(F.lower(F.hex("kids"))))
    made.write.parquet(f"{folder}/height={height}")
    return children.sparkSession.read.parquet(f"{folder}/height={height}")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None) -> Manifest:
    """Build all levels over docs.

    tampered gives altered fields and when the rows that hold them; the hash
    of an altered row stands beside its leaf and in no node.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/merkle-{uuid4().hex}"
    col = lambda c: F.col(f"`{c}`")
    whole = _hash(F.concat(*[field(col(c)) for c in fields]))
    other = F.when(when, _hash(F.concat(*[field((tampered or {}).get(c, col(c))) for c in fields]))) if when is not None else F.lit(None).cast("binary")
    narrow = docs.select(col(doc_id).alias("id"), col(source).cast("string").alias("source"), whole.alias("leaf"), other.alias("changed"))
    rows, n = numbered(narrow, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("leaf")])
    rows = cut(rows.withColumn("bucket", F.floor(F.col("at") / BUCKET)))

    sources, count = numbered(rows.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("size")), [F.asc("first")])
    sources = cut(sources.select("source", "first", (F.col("first") + F.col("size") - 1).alias("last"), "size", F.col("at").alias("rank")))
    most = sources.agg(F.max("size")).first()[0] or 0
    over = spread(sources, "first", "last").withColumnsRenamed({"bucket": "b", "source": "s"})
    top_parent = {"up_height": F.lit(TOP + 1 if count > 1 else None).cast("int"), "up_at": F.when(F.lit(count > 1), F.floor(F.col("rank") / FANOUT)).cast("long")}

    def linked(level: DataFrame, height: int) -> DataFrame:
        """A level of the sources' trees with place and parent."""
        width = FANOUT**height
        i = F.floor((F.col("first") - F.col("start")) / width)
        alone = F.col("size") <= width
        up = F.col("start") + F.floor(i / FANOUT) * (width * FANOUT)
        return level.select(
            "*", F.when(alone, F.col("rank") % FANOUT).otherwise(i % FANOUT).cast("int").alias("place"), alone.alias("sub"),
            F.when(alone, top_parent["up_height"]).otherwise(height + 1).alias("up_height"), F.when(alone, top_parent["up_at"]).otherwise(up).cast("long").alias("up_at"),
        )

    joined = rows.join(over, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    leaves = joined.select("id", "leaf", "changed", "bucket", F.col("first").alias("start"), "size", "rank", F.col("at").alias("first"), F.col("at").alias("last"))
    leaves = cut(linked(leaves, 0))
    tree = ["start", "size", "rank"]
    level, height, levels = leaves.select(*tree, F.col("leaf").alias("hash"), "first", "last", "place", "sub", "up_height", "up_at"), 0, []
    subroots = [level.where("sub")]
    while FANOUT**height < most:
        height += 1
        level = linked(_parents(level.where("NOT sub"), height, [F.col(c) for c in tree], F.col("up_at"), folder), height)
        levels.append(level.withColumn("height", F.lit(height)))
        subroots.append(level.where("sub"))
    top = subroots[0].select("rank", "hash", "first", "last")
    for s in subroots[1:]:
        top = top.unionByName(s.select("rank", "hash", "first", "last"))
    top = cut(top)
    at, height, width = "rank", TOP, count
    while width > 1:
        height, width = height + 1, ceil(width / FANOUT)
        children = top.withColumn("place", (F.col(at) % FANOUT).cast("int"))
        top, at = _parents(children, height, [], F.floor(F.col(at) / FANOUT), folder), "node"
        up = (F.lit(height + 1), F.floor(F.col("node") / FANOUT)) if width > 1 else (F.lit(None), F.lit(None))
        levels.append(top.select("*", (F.col("node") % FANOUT).cast("int").alias("place"), F.lit(False).alias("sub"), up[0].cast("int").alias("up_height"), up[1].cast("long").alias("up_at"), F.lit(height).alias("height")))
    root = top.select(F.lower(F.hex("hash"))).first() if n else None
    shape = ["height", "node", "kids", "hash", "first", "last", "place", "sub", "up_height", "up_at"]
    nodes = spark.createDataFrame([], "height int, node long, kids binary, hash binary, first long, last long, place int, sub boolean, up_height int, up_at long")
    for x in levels:
        nodes = nodes.unionByName(x.select(*shape))
    return Manifest(leaves, nodes, root and root[0])


_CLIMB = """
WITH RECURSIVE climb(at, anchor, bucket, step, folded, spot, kids, place, up_height, up_at, subroot, above) AS (
  SELECT at, anchor, bucket, 0, coalesce(changed, leaf), -1, CAST(NULL AS BINARY), place, up_height, up_at, CASE WHEN sub THEN leaf END, sub FROM {leaves}
  UNION ALL
  SELECT c.at, c.anchor, c.bucket, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(p.kids, 1, 32 * c.place), c.folded, substring(p.kids, 32 * c.place + 33)))), 256)),
         c.place, CASE WHEN c.above = {above} THEN p.kids END, p.place, p.up_height, p.up_at, CASE WHEN p.sub THEN p.hash END, c.above OR p.sub OR p.height >= {anchored}
  FROM climb c JOIN {nodes} p ON p.bucket = c.bucket AND p.height = c.up_height AND p.node = c.up_at
)
SELECT at, anchor, step, folded, spot, kids, subroot FROM climb
"""
#: No row limit: the default stops at a million rows.
_LIMIT = "spark.sql.cteRecursionRowLimit"


def _met(steps: DataFrame, *keys: str) -> DataFrame:
    """For each leaf that climbed the subroot it passed, the hash it came to and the siblings appended on its way, as text."""
    text = lambda c: F.lower(F.hex(c))
    siblings = lambda x: F.concat(F.substring(x["kids"], F.lit(1), x["spot"] * 32), F.substring(x["kids"], x["spot"] * 32 + 33, F.lit(_ALL)))
    path = F.array_sort(F.collect_list(F.when(F.col("kids").isNotNull(), F.struct("step", "spot", "kids"))))
    found = steps.groupBy(*keys).agg(F.max("subroot").alias("subroot"), F.max_by("folded", "step").alias("folded"), path.alias("path"))
    return found.withColumn("siblings", F.aggregate("path", F.lit(""), lambda a, x: F.concat(a, text(siblings(x))))).drop("path")


def proofs(m: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf, all hashes as hex.

    The recursive query climbs with every leaf to the root.  Leaves under one
    anchor, the node of height ANCHORED above them or the subroot below that, have the same siblings
    from there on: these are appended on the climb of the anchor's first leaf
    alone, the ones below the anchor on each leaf's own.  So what a leaf
    carries does not grow with the table.
    """
    spark = m.leaves.sparkSession
    leaves = m.leaves.withColumns({"at": F.col("first"), "anchor": F.col("first") - (F.col("first") - F.col("start")) % FANOUT**ANCHORED})
    names = {k: f"merkle_{k}_{uuid4().hex}" for k in ("leaves", "firsts", "nodes")}
    leaves.createOrReplaceTempView(names["leaves"])
    leaves.where("at = anchor").createOrReplaceTempView(names["firsts"])
    cut(spread(m.nodes, "first", "last")).createOrReplaceTempView(names["nodes"])
    climb = lambda of, above: spark.sql(_CLIMB.format(leaves=names[of], nodes=names["nodes"], above=above, anchored=ANCHORED))
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, "-1")
    try:
        shared = cut(_met(climb("firsts", "true"), "anchor").select("anchor", F.col("siblings").alias("rest")))
        own = _met(climb("leaves", "false").repartition("anchor"), "anchor", "at")
        proof = F.unhex(F.sha2(F.concat("siblings", "rest"), 256))
        got = cut(own.join(shared, "anchor").select("at", proof.alias("proof"), "folded", "subroot"))
    finally:
        spark.conf.set(_LIMIT, before)
        for name in names.values():
            spark.catalog.dropTempView(name)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(m.root).cast("string")
    every = leaves.select("id", "leaf", "at").join(got, "at")
    return every.select("id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


def verified(docs: DataFrame, tampered: dict[str, Column] | None = None, when: Column | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The proofs of docs, of which the rows of `when` are tampered with after the tree was built."""
    return proofs(manifest(docs, fields, doc_id, source, tampered, when))


def tampering(doc_id: Column, text: Column, divisor: int = 5) -> tuple[dict[str, Column], Column]:
    """Lower-cased texts in the rows where the divisor divides the checksum of the decimal id."""
    return {"text": lowered(text)}, F.crc32(doc_id.cast("string").cast("binary")) % divisor == 0

