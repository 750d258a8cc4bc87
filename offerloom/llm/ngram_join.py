"""N-gram Jaccard self-join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set is its distinct word n-grams.  Two documents link when
``100 * |A & B| >= percent * |A | B|``, decided exactly.

*Small sets.*  Sizes a <= b can link only with an overlap of at least
``c = ceil(percent * (a + b) / (100 + percent))``.  A set of size n emits, for
every partner size that could link, the hash of each of its subsets of the
needed size; two sets with a common subset key are linked.  That is one key
where c = n, n keys where one element may be missing, n(n-1)/2 for two.

*Large sets.*  A large set goes through inverted lists.  A list of a single
n-gram would hold every document that shares a passage, so list keys are
blocks: linked sets of at most M elements differ in at most
``D = (100 - percent) * 2M / (100 + percent)`` elements, so if n-grams are
dealt by hash into D + 1 + e + s blocks, some e + s + 1 blocks agree entirely,
and s + 1 of those are not empty unless the set has more than e empty blocks
(then its empty blocks are listed too).  Sizes fall into overlapping ranges so
that every pair that could link lies in one range together, and a set is listed
in each range that holds its size.

*Common blocks.*  Linked sets share s + 1 keys of a range, so each set may leave
its s most common ones: of its long lists it leaves the longest, by powers of two of their
length, as long as those are s at most.  What remains shared is in both sets'
lists.  Blocks of a single n-gram that many texts hold go this way.

*Boundary.*  For each size the number of keys is known for both ways; sets up
to the largest size for which subsets are no dearer use subsets, and pairs
with a larger member use lists.  Sets just below the boundary do both.

*Verification.*  Lists only propose pairs; a link is what an exact intersection
confirms.  Equal sets are one node from the start.  A list of few sets proposes
all its pairs; a longer one proposes its smallest member, the hub, with each
other that has not left it.  Every set carries a sketch, the parities of its elements in buckets:
two sketches differ in no more buckets than the sets do in elements, so a pair
whose sketches differ too much goes without a look at the sets.  What is left
is verified hub by hub: the text of a hub and the texts of its sets meet in one
task, hubs of many sets in several, so that a text is sent once for the hub
with which it shares most keys and again only for pairs that would still join two components.

Where the sets of a long list do not end in one component, tasks compare the
sketches of those outside its largest component with all others, and propose
the nearest few of every other component; rounds with ever more follow until
no near one was left out.  Lists of more than ``SCANNED`` sets are dealt anew
first, by blocks with another salt within the list: linked sets agree in a
block under any salt, others seldom do again.  A list that ``RESALTED`` salts
leave as long is scanned by pairs of parts of it.

Work: passes over the texts (sizes and sketches, keys, and one for each round
of verification), one exchange of packed keys by key range, joins of pairs with
sketches, texts of verified pairs.  The number of key ranges and of groups
follows the total size of the sets.

Defined cases: a null, empty or blank text has the empty set and links with
nothing; a text with fewer words than the n-gram is one n-gram; a very long
text is one set like any other; repeated rows are one set; a row with a null
id links like any other, its id is never the smallest of a component that has
others, and a component without any has null; extra columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm import textbuf as tb
from offerloom.llm.components import components
from offerloom.llm.lineage import cut, free_name, gathered

#: Lists of at most this many sets propose all their pairs at once.
SHORT_LIST = 6
#: Keys that one task of the exchange takes, about.
KEYS_PER_RANGE = 800_000
#: Bytes of text whose keys are packed together.
PACK_BYTES = 8 << 20
#: Bytes of n-grams that one task of verification takes, about.
GROUP_BYTES = 6 << 20
#: Sets of a list whose sketches one task compares; lists beyond are dealt anew with other salts, so often at most.
SCANNED, RESALTED = 8192, 3
#: Near sets of another component that a scan proposes for a set, round by round; at last all.
NEAREST = (16, 1024, None)
#: Rows up to which a table of row keys and names is broadcast (64 bytes each); beyond, a shuffled join does it.
BROADCAST_ROWS = 300_000
#: Low bits of a key that name its size range.
TAG = tb.U64(0xFFF)


def ngram_sets(text: pa.Array, width: int):
    """For each text of a column, in order: the sorted distinct 64-bit hashes of its word n-grams."""
    for w in tb.words_of(text):
        grams = tb.ngram_hash(w.hash, width)
        for d in range(w.n_docs):
            lo, hi = w.at[d], w.at[d + 1]
            if hi - lo >= width:
                yield np.unique(grams[lo : hi - width + 1])
            else:
                yield tb.ngram_hash(w.hash[lo:hi], int(hi - lo)) if hi > lo else grams[:0]


def set_name(s: np.ndarray) -> bytes:
    """A 128-bit hash of a whole set."""
    n = tb.U64(len(s))
    sums = np.array([tb.mix(s).sum(dtype=tb.U64) + n, tb.mix(s ^ tb.U64(0xC2B2AE3D27D4EB4F)).sum(dtype=tb.U64) ^ n], dtype=tb.U64)
    return tb.mix(sums).astype(">u8").tobytes()


def sketch_bits(n: int) -> int:
    """Buckets of the sketch of n elements: a power of two, 64 at least and 1.5 to 3 times n."""
    return max(64, 1 << int(np.ceil(np.log2(1.5 * n))))


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of elements in each bucket; halves of a sketch added give that of half the buckets."""
    bits = sketch_bits(len(s))
    odd = np.bincount((tb.mix(s ^ tb.U64(0x165667B19E3779F9)) & tb.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, brought to fewer words."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def may_link(nx: np.ndarray, ny: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of nx and ny elements that differ in `apart` elements at least can link."""
    need = -(-percent * (nx + ny) // (100 + percent))
    return (need <= np.minimum(nx, ny)) & (apart <= nx + ny - 2 * need)


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


@lru_cache(maxsize=4096)
def partner_sizes(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(smaller size, larger size, needed overlap) of every pair of sizes with n in it that could link."""
    out = []
    for m in range(max(1, ceil(n * percent / 100)), n * 100 // percent + 1):
        a, b = min(n, m), max(n, m)
        if (c := needed(a, b, percent)) <= a:
            out.append((a, b, c))
    return tuple(out)


@lru_cache(maxsize=4096)
def ranges_of(n: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(range, blocks) for each size range that holds n; any two sizes that could link share one."""
    step = 100.0 / percent
    k = int(np.floor(np.log(n) / np.log(step)))
    out = []
    for r in range(max(0, k - 3), k + 2):
        low, high = step**r, step ** (r + 2)
        if low * (1 - 1e-9) <= n <= high * (1 + 1e-9):
            differ = differing(r, percent)
            out.append((r, differ + 1 + slack(differ) + spare(differ)))
    return tuple(out)


def differing(r: int, percent: int) -> int:
    """The most elements in which linked sets of a range differ."""
    return (100 - percent) * 2 * int((100.0 / percent) ** (r + 2) * (1 + 1e-9)) // (100 + percent)


def slack(differ: int) -> int:
    """Empty blocks that a set may have without listing them."""
    return 2 + differ // 64


def spare(differ: int) -> int:
    """Keys of a range that a set may leave: linked sets share one more at least."""
    return 2 + differ // 8


@lru_cache(maxsize=64)
def boundary(percent: int) -> int:
    """The largest size up to which subsets are no dearer than list keys, a list key costing four of a subset's."""
    n = 1
    while True:
        subsets = sum(comb(n + 1, c) for _, _, c in partner_sizes(n + 1, percent))
        if subsets > 4 * sum(k for _, k in ranges_of(n + 1, percent)):
            return n
        n += 1


def keys_of(s: np.ndarray, percent: int, salt: int = 0) -> np.ndarray:
    """All keys of a set, each with TAG in its low bits: 0 for subsets, else its range and one; another salt deals its elements to other blocks."""
    n, out = len(s), []
    limit = boundary(percent)
    if n <= limit:
        value = tb.mix(s)
        for a, b, c in partner_sizes(n, percent):
            if b > limit:
                continue
            # Sets of at most `limit` elements: a few hundred subsets at most.
            sums = np.array([value[list(x)].sum(dtype=tb.U64) for x in combinations(range(n), c)], dtype=tb.U64) if c < n else value.sum(dtype=tb.U64, keepdims=True)
            out.append(tb.mix(sums ^ tb.U64((a << 40) + (b << 8) + 1)) & ~TAG)
    if n * 100 // percent > limit:
        value = tb.mix(s ^ tb.U64(0x94D049BB133111EB))
        low, high = (value & tb.U64(0xFFFFFFFF)).astype(float), (value >> tb.U64(32)).astype(float)
        for r, blocks in ranges_of(n, percent):
            where = ((tb.mix(s + tb.U64(salt)) if salt else s) % tb.U64(blocks)).astype(np.int64)
            size = np.bincount(where, minlength=blocks)
            sums = np.bincount(where, low, blocks).astype(tb.U64) + (np.bincount(where, high, blocks).astype(tb.U64) << tb.U64(32))
            which = np.arange(blocks, dtype=tb.U64)
            if blocks - np.count_nonzero(size) <= slack(differing(r, percent)):
                full = size > 0
                sums, which = sums[full], which[full]
            out.append(tb.mix(sums ^ tb.mix(which + tb.U64((r + 1) << 32))) & ~TAG | tb.U64(r + 1))
    return np.concatenate(out) if out else s[:0]


def set_numbers(text: Column, width: int) -> Column:
    """struct(n, set, sketch): the size of a text's set, its name and its sketch; null both where n is 0."""

    def run(texts: pa.Array) -> pa.Array:
        sets = [(len(s), set_name(s), sketch(s)) if len(s) else (0, None, None) for s in ngram_sets(texts, width)]
        tb.released()
        return pa.StructArray.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.binary()), pa.array([x[2] for x in sets], pa.binary())], names=["n", "set", "sketch"])

    return arrow_udf(run, "struct<n:bigint,set:binary,sketch:binary>").asNondeterministic()(text)


def _packed_keys(width: int, percent: int, ranges: int, salt: int):
    def run(batches):
        """A row for each key range that a batch fills: the sets, how many keys each has there, and the keys.

        Columns of a batch: text, and the number of the list that the text's keys belong to (0: all texts)."""
        for batch in (p for b in batches for p in tb.parts(b, "text", PACK_BYTES)):
            names, keys, owner, done = [], [], [], set()
            for s, of in zip(ngram_sets(batch.column(0), width), batch.column(1).to_pylist(), strict=True):
                if len(s) and (k := (set_name(s), of)) not in done:
                    done.add(k)
                    own = keys_of(s, percent, salt)
                    keys.append(tb.mix(own ^ tb.U64(of % (1 << 64))) & ~TAG | own & TAG if of else own)
                    owner.append(np.full(len(own), len(names)))
                    names.append(k[0])
            if not names:
                continue
            key, who, name = np.concatenate(keys), np.concatenate(owner), np.array(names, dtype="S16").view("V16")
            part = ((key >> tb.U64(32)) * tb.U64(ranges) >> tb.U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, who, part = key[order], who[order], part[order]
            filled, cuts = np.unique(part, return_index=True)
            rows = []
            for r, lo, hi in zip(filled.tolist(), cuts, np.append(cuts[1:], len(part)), strict=True):
                first = np.flatnonzero(np.diff(who[lo:hi], prepend=-1))
                count = np.diff(np.append(first, hi - lo)).astype(np.uint32)
                rows.append((r, name[who[lo:hi][first]].tobytes(), count.tobytes(), key[lo:hi].tobytes()))
            del key, who, keys, owner
            tb.released()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "sets", "counts", "keys"])

    return run


def _proposals(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of sets that share k lists of one key range.

        Lists of at most SHORT_LIST sets give all their pairs (tag, level 0).  A longer one gives its smallest set
        with each of its sets, itself included, the tag of its key, the power of two in its length as level and
        how many keys of the tag a set may leave (-1: none)."""
        named = np.frombuffer(b"".join(table["sets"].to_pylist()), ">u8").reshape(-1, 2)
        count = np.concatenate([np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()])
        key = np.concatenate([np.frombuffer(k, tb.U64) for k in table["keys"].to_pylist()])
        # Names as ranks: equal names one number, in the order of their bytes.
        order = np.lexsort((named[:, 1], named[:, 0]))
        new = np.append(True, (named[order][1:] != named[order][:-1]).any(axis=1))
        rank = np.empty(len(named), np.int64)
        rank[order] = np.cumsum(new) - 1
        distinct, name = named[order][new], np.repeat(rank, count)
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[fresh], name[fresh]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        first, size = first[size > 1], size[size > 1]
        a, b, kind = [], [], []
        for m in range(2, SHORT_LIST + 1):
            at = first[size == m]
            for i, j in combinations(range(m), 2):
                a.append(name[at + i])
                b.append(name[at + j])
                kind.append(np.zeros(len(at), np.int64))
        at, m = first[size > SHORT_LIST], size[size > SHORT_LIST]
        a.append(np.repeat(name[at], m))
        b.append(name[np.repeat(at, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))])
        kind.append(np.repeat((key[at] & TAG).astype(np.int64) * 64 + np.log2(m).astype(np.int64), m))
        pair, kind = np.concatenate(a) * len(distinct) + np.concatenate(b), np.concatenate(kind)
        order = np.lexsort((kind, pair))
        pair, kind = pair[order], kind[order]
        at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1]))) if len(pair) else pair
        k = np.diff(np.append(at, len(pair)))
        pair, tag, level = pair[at], kind[at] // 64, kind[at] % 64
        tags, which = np.unique(tag, return_inverse=True)
        left = np.array([spare(differing(r - 1, percent)) if r else -1 for r in tags.tolist()], np.int64)[which]
        numbers = {"tag": tag, "level": level, "spare": left, "k": k}
        return pa.table({"a": _names(distinct[pair // len(distinct)]), "b": _names(distinct[pair % len(distinct)])} | {c: pa.array(x, pa.int32()) for c, x in numbers.items()})

    return run


def _names(x: np.ndarray) -> pa.Array:
    """Rows of two big-endian numbers as names of 16 bytes."""
    at = np.arange(0, 16 * len(x) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


class _Join:
    """The join of one table: rows (id, r, text), their sets, and the links found so far."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> None:
        i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
        self.width, self.percent = width, percent
        self.base = docs.select(row_key(i, t).alias("r"), t.alias("text"))
        numbered = docs.select(i.alias("id"), row_key(i, t).alias("r"), set_numbers(t, width).alias("s"))
        self.sized = cut(numbered.select("id", "r", "s.n", "s.set", "s.sketch"))
        #: One row for each distinct set: its size, sketch and a row that holds it.
        one = self.sized.where("n > 0").groupBy("set", "r").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("c"))
        self.sets = cut(one.groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("r", "c")).alias("at")).select("set", "n", "sketch", "at.r", "at.c"))
        total, self.repeated = self.sets.agg(F.sum("n"), F.max("c") > 1).first()
        self.total = total or 0
        self.label: DataFrame | None = None

    def _named(self, rows: DataFrame) -> DataFrame:
        """rows, sent to every task if they are few."""
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def proposed(self, texts: DataFrame, total: int, salt: int) -> DataFrame:
        """(b, first, hubs): the sets that share a list with a smaller one, with those (a, long) and the one of most keys; at most as many as b has keys, times SHORT_LIST.  texts: text, of."""
        ranges = max(1, ceil(0.5 * total / KEYS_PER_RANGE))
        packed = texts.mapInArrow(_packed_keys(self.width, self.percent, ranges, salt), "part int, sets binary, counts binary, keys binary")
        listed = packed.groupBy("part").applyInArrow(tb.tidy(_proposals(self.percent)), "a binary, b binary, tag int, level int, spare int, k int")
        # All steps are by b, so one exchange does.
        as_common = F.sum("k").over(Window.partitionBy("b", "tag").orderBy(F.desc("level")))
        kept = listed.repartition("b").withColumn("common", as_common).where("common > spare and a <> b")
        pairs = kept.groupBy("b", "a").agg(F.max(F.col("level") > 0).alias("long"), F.sum("k").alias("k"))
        return gathered(pairs.groupBy("b").agg(F.max(F.struct("k", "a"))["a"].alias("first"), F.collect_list(F.struct("a", "long")).alias("hubs")))

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches do not forbid a link."""
        of = self.sets.select("set", "n", "sketch")
        x = of.select(F.col("set").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
        y = of.select(F.col("set").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
        return pairs.join(y, "b").join(x, "a").where(_near(self.percent)("nx", "ny", "x", "y")).select("a", "b", F.col("ny").alias("n"))

    def verify(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b, n) that link; n: elements of b.  Each a is a hub; its sets go to one task or, if large, to several."""
        pairs = gathered(pairs)
        parts = pairs.groupBy("a").agg(F.ceil(F.sum("n") * 8 / GROUP_BYTES).cast("int").alias("parts"))
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
        rows = dealt.select("a", "part", F.col("b").alias("set")).union(dealt.select("a", "part", F.col("a").alias("set")).distinct())
        rows = cut(rows.join(self.sets.select("set", "n", "r"), "set"))
        total = rows.agg(F.sum("n")).first()[0] or 0
        if not total:
            return
        groups = ceil(total * 8 / GROUP_BYTES)
        asked = rows.select("r", "set", "a", F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("g"))
        texts = self.base.join(self._named(asked), "r")
        if self.repeated:
            texts = texts.dropDuplicates(["g", "a", "set"])
        found = cut(texts.groupBy("g").applyInArrow(tb.tidy(_links(self.width, self.percent)), "a binary, b binary"))
        if found.isEmpty():
            return
        known = [] if self.label is None else [self.label.select(F.col("node").alias("a"), F.col("label").alias("b"))]
        self.label = gathered(components(reduce(DataFrame.union, known, found)))

    def labelled(self, rows: DataFrame, node: str, into: str) -> DataFrame:
        """rows with the component of a set; a set without links is its own."""
        if self.label is None:
            return rows.withColumn(into, F.col(node))
        return rows.join(self.label.select(F.col("node").alias(node), F.col("label").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))

    def spread(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, long, b, lb): all proposed pairs; (a, la, long): the hubs whose sets do not all lie in the hub's component."""
        pairs = self.labelled(found, "b", "lb").select("b", "lb", F.explode("hubs").alias("h")).select("h.a", "h.long", "b", "lb")
        hubs = pairs.groupBy("a").agg(F.min("lb").alias("l"), F.max("lb").alias("h"), F.max("long").alias("long"))
        return pairs, gathered(self.labelled(hubs, "a", "la").where((F.col("l") != F.col("la")) | (F.col("h") != F.col("la"))).select("a", "la", "long"))

    def settle(self, found: DataFrame) -> None:
        """Verify proposed pairs: first each set with its smallest hub, then what would join components."""
        self.verify(self.close(found.select(F.col("first").alias("a"), "b")))
        pairs, open_ = self.spread(found)
        self.verify(self.close(pairs.join(open_.select("a", "la"), "a").where("lb <> la").select("a", "b")))

    def mixed(self, found: DataFrame) -> DataFrame:
        """(kind, g, b, c, label, m, n, sketch): the sets of long lists that do not lie in one component.

        Sets that share their smallest hub c are one group (kind 0); sets of one
        list with different smallest hubs are a group by list (kind 1)."""
        pairs, open_ = self.spread(found)
        hubs = open_.where("long").select("a", "la")
        split = pairs.where("long").join(hubs, "a").select("a", "b", F.col("lb").alias("label"))
        split = gathered(split.union(hubs.select("a", F.col("a").alias("b"), F.col("la").alias("label"))))
        own = split.groupBy("b").agg(F.min("a").alias("c"), F.first("label").alias("label"))
        by_hub = own.select(F.lit(0).alias("kind"), F.col("c").alias("g"), "b", F.col("b").alias("c"), "label")
        listed = split.join(own.select("b", "c"), "b")
        spread = listed.groupBy("a").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l <> h").select("a")
        by_list = listed.join(spread, "a", "left_semi").select(F.lit(1).alias("kind"), F.col("a").alias("g"), "b", "c", "label")
        rows = by_hub.union(by_list)
        size = rows.groupBy("kind", "g").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("kind", "g", "m")
        return cut(rows.join(size, ["kind", "g"]).join(self.sets.select(F.col("set").alias("b"), "n", "sketch"), "b"))

    def scan(self, groups: DataFrame) -> None:
        """Link the components that meet in groups, nearest sketches first."""
        for most in NEAREST:
            if groups.isEmpty():
                return
            dealt = groups.withColumn("blocks", F.ceil(F.col("m") / SCANNED).cast("int")).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            near = cut(dealt.select("kind", "g", "i", "j", "block", "b", "c", "label", "n", "sketch").groupBy("kind", "g", "i", "j").applyInArrow(tb.tidy(_scan(self.percent, most)), "a binary, b binary, n long, more boolean"))
            before = self.label
            self.verify(near.where("not more").groupBy("a", "b").agg(F.max("n").alias("n")))
            if near.where("more").isEmpty():
                return
            if self.label is not before:
                named = self.labelled(groups.drop("label"), "b", "label")
                several = named.groupBy("kind", "g").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("kind", "g")
                groups = cut(named.join(several, ["kind", "g"], "left_semi"))

    def run(self) -> None:
        texts, total, salt = self.base.select("text", F.lit(0).cast("long").alias("of")), self.total, 0
        while total:
            found = self.proposed(texts, total, salt)
            self.settle(found)
            groups = self.mixed(found)
            large = groups.where(F.col("m") > SCANNED) if salt < RESALTED else groups.limit(0)
            self.scan(groups.where(F.col("m") <= SCANNED) if salt < RESALTED else groups)
            salt += 1
            again = cut(large.join(self.sets.select(F.col("set").alias("b"), "r"), "b").select("r", F.xxhash64("kind", "g").alias("of"), "n"))
            total = again.agg(F.sum("n")).first()[0] or 0
            texts = self.base.join(self._named(again), "r").select("text", "of")


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes by which the text of a row is found again; the text found is held against the set's name."""
    row = (doc_id.isNull(), doc_id.cast("string"), text.isNull(), text)
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(k), *row)), 16, "0") for k in (0, 1)]
    return F.unhex(F.concat(*halves))


def _near(percent: int):
    def run(nx: pa.Array, ny: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        apart = np.zeros(len(x), np.int64)
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = (np.frombuffer(v.as_buffer(), tb.U64)[None, :] for v in (p, q))
            words = min(p.shape[1], q.shape[1])
            apart[k] = np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()
        return pa.array(may_link(nx.to_numpy(), ny.to_numpy(), apart, percent))

    return arrow_udf(run, "boolean")


def _links(width: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Of the sets of some hubs, those that link with their hub."""
        asked, hub = t["set"].to_pylist(), t["a"].to_pylist()
        sets: dict[bytes, np.ndarray] = {}
        for name, s in zip(asked, ngram_sets(t["text"].combine_chunks(), width), strict=True):
            if len(s) and name not in sets and set_name(s) == name:
                sets[name] = s
        a, b = [], []
        for h, name in set(zip(hub, asked, strict=True)):
            if h != name and h in sets and name in sets:
                p, q = sets[h], sets[name]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(h)
                    b.append(name)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _scan(percent: int, most: int | None):
    def run(t: pa.Table) -> pa.Table:
        """Compare the sketches of a group's sets; for each set outside the main component the nearest of each other one."""
        block, n = t["block"].to_numpy(), t["n"].to_numpy()
        name, c = t["b"].to_pylist(), np.unique(np.array(t["c"].to_pylist(), dtype="S16"), return_inverse=True)[1]
        _, label, count = np.unique(np.array(t["label"].to_pylist(), dtype="S16"), return_inverse=True, return_counts=True)
        outside = label != count.argmax()
        sketches = [np.frombuffer(x.as_buffer(), tb.U64) for x in t["sketch"]]
        words = np.array([len(x) for x in sketches])
        held = {w: (at := np.flatnonzero(words == w), np.stack([sketches[k] for k in at])) for w in np.unique(words)}
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        a, b, m, more = [], [], [], False
        for w, (xs, x) in held.items():
            for v, (ys, y) in held.items():
                # Of sketches of two lengths the longer is folded; beyond twice, no two such sets link.
                if max(w, v) > 2 * min(w, v):
                    continue
                p, q = folded(x, min(w, v)), folded(y, min(w, v))
                step = max(1, (1 << 20) // q.size)
                asks = np.flatnonzero(outside[xs])
                for at in range(0, len(asks), step):
                    some = asks[at : at + step]
                    apart = np.bitwise_count(p[some][:, None, :] ^ q[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok = may_link(n[xs[some]][:, None], n[ys][None, :], apart, percent)
                    ok &= (label[xs[some]][:, None] != label[ys][None, :]) & (c[xs[some]][:, None] != c[ys][None, :])
                    if i != j:
                        ok &= block[xs[some]][:, None] != block[ys][None, :]
                    for k in np.flatnonzero(ok.any(axis=1)):
                        near = np.flatnonzero(ok[k])
                        near = near[np.lexsort((apart[k, near], label[ys[near]]))]
                        of = label[ys[near]]
                        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        rank = np.arange(len(near)) - np.repeat(first, np.diff(np.append(first, len(near))))
                        if most is not None:
                            more |= bool((rank >= most).any())
                            near = near[rank < most]
                        for z in ys[near]:
                            (h, _), (o, size) = sorted(((name[y], int(n[y])) for y in (xs[some[k]], z)))
                            a.append(h)
                            b.append(o)
                            m.append(size)
        if more:
            a, b, m = ([*x, None] for x in (a, b, m))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(m, pa.int64()), "more": pa.array([x is None for x in a], pa.bool_())})

    return run


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): id, r, n and set of every row; set, class and component (smallest id) of every set."""
    join = _Join(docs, text, doc_id, width, percent)
    join.run()
    least = join.sized.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    if join.label is None:
        return join.sized, cut(least.select("set", F.col("set").alias("class"), F.col("least").alias("component")))
    classed = least.join(join.label.withColumnRenamed("node", "set"), "set", "left").withColumn("class", F.coalesce("label", "set"))
    # A class may hold a third of all sets: its smallest id comes from partial minima and goes out to SALTS tasks.
    salts = 16
    of = classed.where("label is not null").groupBy("class").agg(F.min("least").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    several = classed.where("label is not null").withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(salts)).cast("int")).join(of, ["class", "salt"])
    single = classed.where("label is null")
    return join.sized, cut(several.select("set", "class", "component").union(single.select("set", "class", F.col("least").alias("component"))))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85) -> DataFrame:
    """id, n and component (smallest id reachable by links) of every row of docs."""
    sized, sets = links(docs, text, doc_id, width, percent)
    full = sized.where("n > 0").join(sets, "set").select("id", "n", "component")
    return full.union(sized.where("n = 0").select("id", "n", F.col("id").alias("component")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that of the smallest id (null last), set and row key.

    Rows without words are no one's copies and all stay; of repeated rows one stays.
    """
    sized, sets = links(docs, text, doc_id, width, percent)
    ranked = sized.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("row"), F.count("*").alias("c"))
    first = ranked.join(sets.select("set", "class"), "set").groupBy("class").agg(F.min(F.struct("row.none", "row.id", "set", "row.r")).alias("row"), F.max("c").alias("c"))
    key = free_name(docs, "r")
    kept = cut(first.select(F.col("row.r").alias(key), "c").union(sized.where("n = 0").select("r", F.lit(0)).distinct()))
    keyed = docs.withColumn(key, row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    found = keyed.join(F.broadcast(kept.select(key)) if kept.count() <= BROADCAST_ROWS else kept.select(key), key, "left_semi")
    # Only rows that occur several times can bring a second row of one key.
    twice = kept.where("c > 1").select(key).join(sized.groupBy(F.col("r").alias(key)).count().where("count > 1").select(key), key, "left_semi")
    if not twice.isEmpty():
        many = F.broadcast(cut(twice)) if twice.count() <= BROADCAST_ROWS else cut(twice)
        found = found.join(many, key, "left_anti").unionByName(found.join(many, key, "left_semi").dropDuplicates([key]))
    return found.drop(key)
