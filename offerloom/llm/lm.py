"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, order by order:

    P1(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    Pk(w | h) = (c(h w) + K P(k-1)(w | h')) / (c(h) + K)      h' = h without its first word

As an automaton, every history seen in training is a state, every seen n-gram
an arc with weight log10 Pk to the state of its longest suffix that is one, and
each state has a failure arc of weight log10(K / (c(h) + K)) to the state of
h'.  The empty state has an arc for every word.  A text is read once from left
to right: the state is carried, failure arcs are followed until an arc of the
token is there, and all weights passed add up to the score.  A block's texts
are read side by side; a long text is read in pieces of PIECE tokens, each
after the few tokens before it that fix its state.

Nobody holds the whole automaton.  Documents are packed into blocks of about
BLOCK_BYTES where they lie; a block sends the hashes of the n-grams it holds,
with their counts in its training documents, to the key range of each hash; a
key range adds the counts of all blocks and answers each block with totals in
the order of its keys; from them a block builds the states and arcs that its
texts can pass.  What is gathered grows with the distinct n-grams of the
blocks; a word that makes up a third of all tokens is one entry per block.

Tokens are whole words, A-Z lower-cased, and one end for each text.

Defined cases: a null, empty or blank text is one end token; words not seen in
training have count 0 and keep their share of the smoothed mass; without any
training text N = V = 0 and every score is finite; a null id is a training
document; repeated rows count as often as they occur; a text longer than a
block is a block alone; extra columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm import textbuf as tb
from offerloom.llm.lineage import cut

BLOCK_BYTES = 8 << 20
#: N-grams that one task of the exchange takes, about.
KEYS_PER_RANGE = 2_000_000
ORDER, PULL, PIECE = 2, 4.0, 512
_END = tb.mix(np.array([0xE0D], dtype=tb.U64))[0]


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column and the n + 1 offsets of its texts."""
    values, offsets, before = [], [np.zeros(1, np.int64)], 0
    for w in tb.words_of(text):
        value = np.empty(len(w.hash) + w.n_docs, dtype=tb.U64)
        value[np.arange(len(w.hash)) + w.doc] = w.hash
        value[w.at[1:] + np.arange(w.n_docs)] = _END
        values.append(value)
        offsets.append(before + w.at[1:] + np.arange(1, w.n_docs + 1))
        before += len(value)
    return np.concatenate(values) if values else np.zeros(0, tb.U64), np.concatenate(offsets)


def _ngrams(value: np.ndarray, at: np.ndarray, order: int):
    """For each k: the distinct k-gram hashes, sorted; the last token of each occurrence; its index in the former."""
    for k in range(1, order + 1):
        first, _ = tb.windows_inside(at, k)
        grams = tb.ngram_hash(value, k)[first] if len(first) else value[:0]
        distinct, which = np.unique(grams, return_inverse=True)
        yield k, distinct, first + k - 1, which


def _range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys; ranges split the hashes evenly."""
    bounds = (np.arange(1, ranges, dtype=object) * (1 << 64)) // ranges
    return np.concatenate(([0], np.searchsorted(keys, bounds.astype(tb.U64)), [len(keys)])).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """64-bit counts, byte plane by byte plane: planes of zeros vanish."""
    planes = np.ascontiguousarray(x.astype(tb.U64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(tb.U64).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane: their high bytes are zeros and vanish."""
    planes = np.diff(keys, prepend=tb.U64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_sorted(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(tb.U64).ravel(), dtype=tb.U64)


def _blocks(block_bytes: int):
    def run(batches):
        """Rows (block, payload): runs of documents of about block_bytes, compressed; a name for each."""
        part, number = TaskContext.get().partitionId(), 0
        some, size = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number, some, size
            out = pa.BufferOutputStream()
            table = pa.concat_tables(some).combine_chunks()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            number, some, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            length = tb.buffer_of(batch["text"])[1]
            for i, j in tb.slices(length, max(1, block_bytes // 4)):
                some.append(pa.Table.from_batches([batch.slice(i, j - i)]))
                size += int(length[j] - length[i])
                if size >= block_bytes:
                    yield packed()
        if some:
            yield packed()

    return run


def _opened(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as r:
        return r.read_all()


def _send(order: int, ranges: int):
    def run(batches):
        for batch in batches:
            for b, payload in zip(batch["block"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                block = _opened(payload)
                value, at = tokens(block["text"].combine_chunks())
                train = np.repeat(block["train"].to_numpy(), np.diff(at))
                rows = []
                for k, distinct, last, which in _ngrams(value, at, order):
                    count = np.bincount(which[train[last]], minlength=len(distinct))
                    cuts = _range_cuts(distinct, ranges)
                    for r in np.flatnonzero(np.diff(cuts)):
                        lo, hi = cuts[r], cuts[r + 1]
                        rows.append((b, int(r), k, _pack_sorted(distinct[lo:hi]), _pack(count[lo:hi])))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(types)], names=["block", "part", "k", "keys", "counts"])

    return run


def _answer(sent: pa.Table) -> pa.Table:
    """Totals for each block in the order of its keys; tokens and types of single words beside them, once."""
    out = {"block": [], "part": [], "k": [], "counts": [], "tokens": [], "types": []}
    kinds = sent["k"].to_numpy()
    for k in np.unique(kinds):
        some = sent.filter(pa.array(kinds == k))
        keys = [_unpack_sorted(x.as_py()) for x in some["keys"]]
        counts = np.concatenate([_unpack(x.as_py()) for x in some["counts"]])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, counts.astype(np.int64))
        mine = total[which]
        ends = np.cumsum([len(x) for x in keys])
        first = [k == 1] + [False] * (len(keys) - 1)
        out["block"] += some["block"].to_pylist()
        out["part"] += some["part"].to_pylist()
        out["k"] += some["k"].to_pylist()
        out["counts"] += [_pack(x) for x in np.split(mine, ends[:-1])]
        out["tokens"] += [int(total.sum()) if f else 0 for f in first]
        out["types"] += [int((total > 0).sum()) if f else 0 for f in first]
    types = {"block": pa.int64(), "part": pa.int32(), "k": pa.int32(), "counts": pa.binary(), "tokens": pa.int64(), "types": pa.int64()}
    return pa.table({c: pa.array(out[c], t) for c, t in types.items()})


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block."""

    def __init__(self, value: np.ndarray, at: np.ndarray, order: int, pull: float, n: int, v: int, totals: dict[int, np.ndarray]) -> None:
        size = len(value)
        fail, fail_weight, arcs = [np.zeros(1, np.int64)], [np.zeros(1)], []
        before = prob = seen = None  # of the order below: the n-gram that ends at each place, its probability, its count
        states, state = 1, np.zeros(1, np.int64)  # all so far; of the n-grams below, -1 where it is none
        for k, distinct, last, which in _ngrams(value, at, order):
            count = totals.get(k, np.zeros(0)).astype(float)
            if len(count) != len(distinct):
                raise RuntimeError(f"block has {len(distinct)} {k}-grams and {len(count)} answers")
            here = np.full(size, -1)
            here[last] = which
            place = np.zeros(len(distinct), np.int64)
            place[which] = last  # some place where the n-gram ends
            if k == 1:
                self.token, self.known = here, count[here] > 0 if size else np.zeros(0, bool)
                prob = (count + 0.5) / (n + 0.5 * (v + 1))
                self.base = np.log10(prob)
                source, suffix, arc = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.arange(len(distinct))
            else:
                history, tail = before[place - 1], before[place]
                arc = np.flatnonzero(count > 0)  # then its history and its tail were seen too
                p = np.zeros(len(distinct))
                p[arc] = (count[arc] + pull * prob[tail[arc]]) / (seen[history[arc]] + pull)
                prob, source, suffix = p, state[history], state[tail]
            state = np.full(len(distinct), -1)
            if k < order:
                kept = np.flatnonzero(count > 0)
                state[kept] = states + np.arange(len(kept))
                states += len(kept)
                fail.append(suffix[kept])
                fail_weight.append(np.log10(pull / (count[kept] + pull)))
            target = np.where(state >= 0, state, suffix)
            arcs.append((source[arc] * max(1, self.base.size) + self.token[place[arc]], np.log10(prob[arc]), target[arc]))
            before, seen = here, count
        key = np.concatenate([a[0] for a in arcs])
        order_ = np.argsort(key)
        self.arc, self.weight, self.target = key[order_], np.concatenate([a[1] for a in arcs])[order_], np.concatenate([a[2] for a in arcs])[order_]
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        self.at, self.order = at, order

    def scores(self) -> np.ndarray:
        """For each text the sum of the weights that reading it passes."""
        at, warm = self.at, self.order - 1
        n = np.diff(at)
        pieces = -(-n // PIECE)
        doc = np.repeat(np.arange(len(n)), pieces)
        first = at[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(first + PIECE, at[doc + 1])
        begin = np.maximum(first - warm, at[doc])
        longest = np.argsort(begin - stop, kind="stable")  # the pieces still read are the first ones
        doc, first, stop, begin = doc[longest], first[longest], stop[longest], begin[longest]
        total, state = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
        length = stop - begin
        words = max(1, self.base.size)
        for step in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -step, side="left"))
            place = begin[:m] + step
            token, s = self.token[place], state[:m]
            passed = np.zeros(m)
            open_ = np.arange(m)
            while len(open_):
                key = s[open_] * words + token[open_]
                i = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                found = self.arc[i] == key
                go, i = open_[found], i[found]
                passed[go] += self.weight[i]
                s[go] = self.target[i]
                open_ = open_[~found]
                passed[open_] += self.fail_weight[s[open_]]
                s[open_] = self.fail[s[open_]]
            total[:m] += np.where(place >= first[:m], passed, 0.0)
        return np.bincount(doc, total, len(n))


def _read(order: int, pull: float, n: int, v: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """The scores of a block's texts."""
        block = _opened(rows["payload"][0].as_py())
        value, at = tokens(block["text"].combine_chunks())
        by: dict[int, list] = {}
        for k, _, counts in sorted(zip(answers["k"].to_pylist(), answers["part"].to_pylist(), answers["counts"].to_pylist(), strict=True), key=lambda x: x[:2]):
            by.setdefault(k, []).append(_unpack(counts))
        a = Automaton(value, at, order, pull, n, v, {k: np.concatenate(x) for k, x in by.items()})
        base = np.add.reduceat(a.base[a.token], at[:-1])
        return pa.table({
            "id": block["id"], "train": block["train"], "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(tb.per_document(a.known, at)),
            "base_score": pa.array(base), "score": pa.array(a.scores()),
        })

    return run


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, pull: float = PULL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, ceil(size * order / 6 / KEYS_PER_RANGE))
    kind = base.schema["id"].dataType.simpleString()
    blocks = cut(base.mapInArrow(_blocks(block_bytes), "block long, payload binary"))
    sent = blocks.mapInArrow(_send(order, ranges), "block long, part int, k int, keys binary, counts binary")
    answers = cut(sent.groupBy("part").applyInArrow(_answer, "block long, part int, k int, counts binary, tokens long, types long"))
    n, v = answers.agg(F.sum("tokens"), F.sum("types")).first()
    replies = answers.select("block", "part", "k", "counts")
    read = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_read(order, pull, n or 0, v or 0), f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return read.withColumn("train_tokens", F.lit(n or 0).cast("long"))
