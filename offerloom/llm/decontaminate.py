"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are brought to letters, digits, non-ASCII bytes and
single spaces, A-Z lower-cased.  A document is contaminated by an item if it
holds some window of ``min(item length, WINDOW)`` bytes of the item within an
edit distance of ``k = floor(RATE * window length)``; windows begin at every
byte of the item.  Windows of under 80 bytes may have an edit or two fewer
(``budget``), so that the lemma still asks for a q-gram.

*Filter.*  A window that aligns within k edits shares at least
``length + 1 - q (k + 1)`` of its q-grams with the text, all within k
diagonals (text offset minus item offset).  Diagonals are cut into bands of
twice the largest k (rounded up) that overlap by half, so some band holds them
all; shared q-grams are counted by (document, item, band) and bands below the
bound are dropped.  With q = 8 a q-gram is one 64-bit number, no hash.

*Verification.*  In each retained region every window of the item that the
hits within it allow is looked for: exactly where all its q-grams are hits,
then by dynamic programming inside the band, until one is within its budget.
Windows one byte apart differ by one edit at most, so a window that is ``x``
edits beyond its budget settles the next ``x - 1`` too.

Work: one pass over the texts for each block of benchmark items
(``BLOCK_CHARS`` characters, fixed, so what is sent to the executors is
bounded); no shuffle, so neither hot sources nor copies matter.

Defined cases: a null or empty text holds nothing; null items, and items of
fewer than ``LEAST`` bytes after normalisation, are not looked for; equal
items are all reported; an empty table on either side gives no match; a
column of the input with the name of the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm import textbuf as tb
from offerloom.llm.lineage import free_name

Q, WINDOW, RATE, LEAST, BLOCK_CHARS = 8, 120, 0.1, 24, 1_000_000
_TYPE = "array<struct<item:bigint,edits:int,start:bigint,stop:bigint>>"
#: Half a band: more than the edits that any window may have.
STRIDE = 16
#: Size of the first, coarse membership test, in bits.
_BITS = 22

_KEEP = np.zeros(256, dtype=bool)
for _lo, _hi in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KEEP[ord(_lo) : ord(_hi) + 1] = True
_KEEP[128:] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, the original offset of each, and the n + 1 offsets of texts in them."""
    data = tb.lowered(data)
    blank = _BLANK[data]
    keep = _KEEP[data] | blank
    where = np.flatnonzero(keep)
    out = np.where(blank[where], np.uint8(32), data[where])
    double = np.zeros(len(out), dtype=bool)
    double[1:] = (out[1:] == 32) & (out[:-1] == 32)
    out, where = out[~double], where[~double]
    return out, where, np.searchsorted(where, at)


def qgrams(data: np.ndarray) -> np.ndarray:
    """Every Q consecutive bytes as one number; len(data) - Q + 1 of them."""
    n = len(data) - Q + 1
    out = np.zeros(max(n, 0), dtype=tb.U64)
    for k in range(Q):
        out = (out << tb.U64(8)) | data[k : k + len(out)]
    return out


def _coarse(value: np.ndarray) -> np.ndarray:
    return (value * tb.U64(0x9E3779B97F4A7C15) >> tb.U64(64 - _BITS)).astype(np.int64)


@dataclass
class Index:
    """A block of benchmark items, ready to be looked for."""

    ids: list[int]
    texts: list[bytes]
    start: np.ndarray  # of each item in the joined bytes
    grams: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where each begins in places, one more at the end
    places: np.ndarray  # offsets in the joined bytes
    item: np.ndarray  # of each place
    coarse: np.ndarray
    bound: np.ndarray  # least q-grams shared in a band, of each item

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        ids, texts = [], []
        for i, t in items:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            clean = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(clean) >= LEAST:
                ids.append(i)
                texts.append(clean)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        start = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        value = qgrams(joined)
        place = np.arange(len(value))
        item = np.searchsorted(start, place, side="right") - 1
        whole = place + Q <= start[item + 1] if len(place) else np.zeros(0, bool)
        value, place, item = value[whole], place[whole], item[whole]
        order = np.argsort(value, kind="stable")
        grams, first = np.unique(value[order], return_index=True)
        coarse = np.zeros(1 << _BITS, dtype=bool)
        coarse[_coarse(grams)] = True
        length = np.minimum([len(t) for t in texts], WINDOW).astype(np.int64) if texts else np.zeros(0, np.int64)
        bound = np.array([shared(int(m)) for m in length], dtype=np.int64)
        return cls(ids, texts, start, grams, np.append(first, len(order)), place[order], item[order], coarse, bound)


def budget(m: int) -> int:
    """Edits that a window of m bytes may have: RATE of it, and few enough for the lemma to ask for a q-gram."""
    return max(0, min(int(RATE * m), (m + 1) // Q - 2, STRIDE - 1))


def shared(m: int) -> int:
    """The least number of q-grams that a window of m bytes shares with a text that holds it within budget."""
    return max(1, m + 1 - Q * (budget(m) + 1))


@lru_cache(maxsize=2048)
def _masks(pattern: bytes) -> dict[int, int]:
    """For each byte of a pattern, the bits of its places."""
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def banded(pattern: bytes, text: bytes, most: int) -> int | None:
    """An edit distance of at most `most` of pattern to a substring of text, None if there is none.

    text is the stretch that the band reaches; a column of the alignment
    matrix is two numbers of len(pattern) bits, the rises and falls of the
    distance down the column (Myers 1999).
    """
    masks, m = _masks(pattern), len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, distance = full, 0, m
    rest = len(text)
    if m <= most:
        return m
    for c in text:
        eq = masks.get(c, 0)
        x = (((eq & rise) + rise) ^ rise) | eq | fall
        up = fall | ~(x | rise) & full
        down = rise & x
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        rest -= 1
        if distance <= most:
            return distance
        if distance - rest > most:
            return None
        up = up << 1 & full
        down = down << 1 & full
        rise = down | ~((eq | fall) | up) & full
        fall = up & (eq | fall)
    return None


def nearest(pattern: bytes, text: bytes, most: int) -> int:
    """The least edit distance of pattern to a substring of text, or the first found that is within `most`."""
    masks, m = _masks(pattern), len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, distance, least = full, 0, m, m
    rest = len(text)
    for c in text:
        if least <= most or distance - rest >= least:
            break
        eq = masks.get(c, 0)
        x = (((eq & rise) + rise) ^ rise) | eq | fall
        up = fall | ~(x | rise) & full
        down = rise & x
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        rest -= 1
        least = min(least, distance)
        up = up << 1 & full
        down = down << 1 & full
        rise = down | ~((eq | fall) | up) & full
        fall = up & (eq | fall)
    return least


def _regions(index: Index, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(document, item, lowest and highest diagonal in the document and item, item offsets of the hits)."""
    if not len(index.grams) or len(data) < Q:
        return
    value = qgrams(data)
    maybe = np.flatnonzero(index.coarse[_coarse(value)])
    slot = np.minimum(np.searchsorted(index.grams, value[maybe]), len(index.grams) - 1)
    hit = index.grams[slot] == value[maybe]
    maybe, slot = maybe[hit], slot[hit]
    doc = np.searchsorted(at, maybe, side="right") - 1
    inside = maybe + Q <= at[doc + 1]
    maybe, slot, doc = maybe[inside], slot[inside], doc[inside]
    times = index.first[slot + 1] - index.first[slot]
    total = int(times.sum())
    if not total:
        return
    text_at, doc = np.repeat(maybe, times), np.repeat(doc, times)
    place = np.repeat(index.first[slot] - (np.cumsum(times) - times), times) + np.arange(total)
    item_at, item = index.places[place], index.item[place]
    diagonal = (text_at - at[doc]) - (item_at - index.start[item])
    band = (diagonal + (1 << 32)) // STRIDE
    pair = (doc * len(index.ids) + item) * (1 << 34)
    # Band b is the strides b and b + 1: each hit counts in two bands.  Counts by a hash
    # of the stride are too high at most; only hits of bands that pass them are sorted.
    here, below, above = (_coarse((pair + band + d).astype(tb.U64)) for d in (0, -1, 1))
    count = np.bincount(here, minlength=1 << _BITS)
    least = index.bound[item]
    keys, of = [], []
    for key, other in ((pair + band, above), (pair + band - 1, below)):
        busy = np.flatnonzero(count[here] + count[other] >= least)
        keys.append(key[busy])
        of.append(busy)
    key, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    stop = np.append(first[1:], len(key))[: len(first)]
    enough = (stop - first) >= index.bound[(key[first] >> 34) % len(index.ids)]
    for lo, hi in zip(first[enough], stop[enough], strict=True):
        hits = of[lo:hi]
        d, it = int(doc[hits[0]]), int(item[hits[0]])
        yield d, it, int(diagonal[hits].min()), int(diagonal[hits].max()), item_at[hits] - index.start[it]


def _verified(index: Index, it: int, text: bytes, low: int, high: int, hits: np.ndarray) -> tuple[int, int, int] | None:
    """(edits, start, stop) of a window of the item in the text."""
    whole = index.texts[it]
    m = min(len(whole), WINDOW)
    most, grams = budget(m), m - Q + 1
    base = max(0, int(hits.min()) - grams + 1)
    last = min(len(whole) - m, int(hits.max()))
    if last < base:
        return None
    hit = np.zeros(last - base + grams, dtype=bool)
    hit[hits[hits < base + len(hit)] - base] = True
    upto = np.concatenate(([0], np.cumsum(hit)))
    touched = upto[grams:] - upto[:-grams]  # of the windows from base to last

    def piece(s: int) -> tuple[int, bytes]:
        begin = max(0, s + low - most)
        return begin, text[begin : max(0, s + m + high + most)]

    for s in np.flatnonzero(touched == grams) + base:
        begin, part = piece(int(s))
        if (exact := part.find(whole[s : s + m])) >= 0:
            return 0, begin + exact, begin + exact + m
    free = 0
    for s in np.flatnonzero(touched >= shared(m)) + base:
        if s < free:
            continue
        begin, part = piece(int(s))
        edits = nearest(whole[s : s + m], part, most)
        if edits <= most:
            return edits, begin, begin + len(part)
        free = s + edits - most  # a window that starts one byte later is one edit nearer at most
    return None


def matches(text: Column, index: Index) -> Column:
    """For each text the items of a block that it holds: item, edits, start and stop (UTF-8 byte offsets)."""

    def run(texts: pa.Array) -> pa.Array:
        found: list[dict[int, tuple]] = [{} for _ in range(len(texts))]
        raw, offsets = tb.buffer_of(texts)
        for i, j in tb.slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            data, where, clean_at = normalised(raw[offsets[i] : offsets[j]], at)
            for d, it, low, high, hits in _regions(index, data, clean_at):
                if index.ids[it] in found[i + d]:
                    continue
                own = data[clean_at[d] : clean_at[d + 1]].tobytes()
                if (hit := _verified(index, it, own, low, high, hits)) is not None:
                    edits, a, b = hit
                    back = where[clean_at[d] : clean_at[d + 1]] - at[d]
                    found[i + d][index.ids[it]] = (index.ids[it], edits, int(back[a]), int(back[b - 1]) + 1)
        rows = [[dict(zip(("item", "edits", "start", "stop"), x, strict=True)) for x in f.values()] for f in found]
        kind = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(rows, kind)

    return arrow_udf(tb.tidy(run), _TYPE).asNondeterministic()(text)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The benchmark in blocks of at most chars characters (one longer item is a block alone)."""
    some, size = [], 0
    for row in benchmark.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        if some and size + len(row[1]) > chars:
            yield Index.of(some)
            some, size = [], 0
        some.append((row[0], row[1]))
        size += len(row[1])
    if some:
        yield Index.of(some)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks") -> DataFrame:
    """docs with an array column of all items that each text holds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    parts = [matches(F.col(f"`{text}`"), index) for index in blocks(benchmark)]
    return docs.select(*rest, (F.flatten(F.array(*parts)) if parts else F.array().cast(_TYPE)).alias(into))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, item, edits, start, stop: a row for each document and item that it holds."""
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return contamination(base, benchmark).select("id", F.inline("leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs."""
    into = free_name(docs, "leaks")
    return contamination(docs, benchmark, text, into).where(F.size(into) == 0).drop(into)
