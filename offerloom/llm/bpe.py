"""BPE encoding and decoding by a pair occurrence index.

The vocabulary file is one of the public tokenizers' JSON files for a BPE with
word ends: texts are normalised (NFC, lower case), cut into words by a pattern,
each word becomes its bytes' symbols, the last with the end-of-word mark, and
merges apply in the order of their ranks.

Merging works on all new words of a batch at once.  Their symbols stand in one
sequence; an index maps each pair of neighbouring symbols to the list of its
places.  The lowest active rank is taken, all its places are merged from left
to right, and the pairs that this removes or makes are updated in the index.
A pair with a merged symbol has a higher rank than the merge that made the
symbol, so ranks are taken in ascending order and each is taken once.

Words seen before by the same Python worker come from a bounded table, so the
merging work follows the distinct words.  Ids of a text are the ids of its
words in a row; decoding joins the tokens of the ids by single spaces, as
these files name no decoder.

Work: one Arrow pass over the texts, no shuffle.

Defined cases: a null text is the empty text: no ids, empty decoded text; a
text without spaces is as many words as the pattern makes of it; special
tokens written in a text become their ids, as the library does by default;
equal rows get equal results; an empty table gives an empty result; a column
of the input with the name of the result column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from offerloom.llm import textbuf as tb

#: Words whose ids a worker keeps; beyond, those of the generation before go.
KEPT_WORDS = 80_000
#: Lists of at least so many places are merged as arrays.
LONG_LIST = 40
_models: dict[str, Model] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Model:
    """Merges and vocabulary of a tokenizer file, with the ids of words seen lately."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbol = np.array([vocab[c] for c in byte_symbols()])
        self.last_symbol = np.array([vocab[c + self.suffix] for c in byte_symbols()])
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The file's normaliser and splitter alone: its model stays empty.
        self.library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {**{k: v for k, v in model.items() if k not in ("vocab", "merges")}, "unk_token": None, "vocab": {}, "merges": []}}))
        self.checked: set[str] = set()  # characters met so far, and those that the library's edition of Unicode knows otherwise
        self.strange: set[str] = set()
        self.known: dict[str | int, tuple[int, ...]] = {}
        self.older: dict[str | int, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str | int]:
        """Words of a text in order; special tokens as their ids."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.words_in(text)
        out: list[str | int] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += self.words_in(piece)
        return out

    def words_in(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Each character is once held against the library's normaliser and
        splitter; texts with one that it treats otherwise are split by them.
        """
        if not text.isascii():
            if new := set(text) - self.checked:
                self.checked |= new
                self.strange |= set(filter(self.is_strange, new))
            if self.strange and not self.strange.isdisjoint(text):
                return self.library_words(text)
        return self.words.findall(self.normal(text))

    def is_strange(self, c: str) -> bool:
        """Does the library treat a character otherwise, alone or, if it is a combining mark, beside marks that NFC orders before or behind it?"""
        text = f"a{c}b 1{c} .{c}."
        if unicodedata.category(c) == "Cn" or self.words.findall(self.normal(text)) != self.library_words(text):
            return True
        return unicodedata.combining(c) > 0 and any(self.normal(t) != self.library.normalizer.normalize_str(t) for t in (f"x{c}\u0338", f"x\u0345{c}"))

    def library_words(self, text: str) -> list[str]:
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case character by character (a capital sigma is never a final one)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the table, all in one sequence."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum([0, *map(len, raw)])
        symbols = self.symbol[data]
        symbols[starts[1:] - 1] = self.last_symbol[data[starts[1:] - 1]]
        merged = merge_all(symbols, starts, self.merges)
        whole = merged >= 0
        ids = merged[whole].tolist()
        cuts = np.concatenate(([0], np.cumsum(whole)))[starts].tolist()
        for k, w in enumerate(words):
            self.known[w] = tuple(ids[cuts[k] : cuts[k + 1]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        distinct: set[str | int] = set()
        for words in split:
            distinct.update(words)
        new = []
        for w in distinct:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                elif isinstance(w, int):
                    known[w] = (w,)
                else:
                    new.append(w)
        if new:
            self.learn(sorted(new))
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, words)), dtype="<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        token = self.token
        return " ".join([token[i] for i in ids.tolist()])


def merge_all(symbols: np.ndarray, starts: np.ndarray, table: Merges) -> np.ndarray:
    """Apply merges to a sequence of words; a place whose symbol was taken up by its left neighbour holds -1.

    places is the pair occurrence index: for each active rank, the places at
    which its pair begins.  Early ranks have long lists, which are merged as
    arrays; from the first rank on whose list is short, plain lists are faster.
    """
    n = len(symbols)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    before[starts[:-1]] = -1
    after[starts[1:] - 1] = -1
    places: dict[int, list] = defaultdict(list)
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these places into the index."""
        rank = table.ranks(symbols[at], symbols[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
        for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=False):
            if r not in places:
                heapq.heappush(active, r)
            places[r].append(part)

    enter(np.flatnonzero(after >= 0))
    short = 0
    while active and short < 64:
        rank = heapq.heappop(active)
        left, right, into = table.by_rank[rank]
        i = np.unique(np.concatenate(places.pop(rank)))
        j = after[i]
        ok = (symbols[i] == left) & (j >= 0) & (symbols[j] == right)
        i, j = i[ok], j[ok]
        short = short + 1 if len(i) < LONG_LIST else 0
        if left == right and len(i):  # of overlapping places every other one merges, from the left
            run = np.flatnonzero(np.append(True, i[1:] != j[:-1]))
            place = np.arange(len(i)) - np.repeat(run, np.diff(np.append(run, len(i))))
            i, j = i[place % 2 == 0], j[place % 2 == 0]
        k = after[j]
        symbols[i], symbols[j], after[i] = into, -1, k
        before[k[k >= 0]] = i[k >= 0]
        h = before[i]
        enter(np.concatenate([i[k >= 0], h[h >= 0]]))
    return _merge_rest(symbols.tolist(), before.tolist(), after.tolist(), {r: np.concatenate(p).tolist() for r, p in places.items()}, table)


def _merge_rest(symbols: list[int], before: list[int], after: list[int], places: dict[int, list[int]], table: Merges) -> np.ndarray:
    """The same, place by place."""
    get = table.merge.get
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, into = table.by_rank[rank]
        for i in sorted(places.pop(rank)):
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # a merge since then has taken one of the two
            symbols[i], symbols[j] = into, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(into << 32 | symbols[k])) is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        heapq.heappush(active, r)
                        places[r] = [i]
            if (h := before[i]) >= 0 and (r := get(symbols[h] << 32 | into)) is not None:
                if r in places:
                    places[r].append(h)
                else:
                    heapq.heappush(active, r)
                    places[r] = [h]
    return np.array(symbols, dtype=np.int64)


class Merges:
    """Merges by rank and ranks by pair."""

    def __init__(self, triples: list[tuple[int, int, int]]) -> None:
        self.by_rank = triples
        self.merge = {a << 32 | b: r for r, (a, b, _) in enumerate(triples)}
        key = np.array([a << 32 | b for a, b, _ in triples], dtype=np.int64)
        self.order = np.argsort(key)
        self.key = key[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.order[at], -1)


def model(path: str) -> Model:
    """The model of a file, read once in each Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _pieces(texts: pa.Array, chars: int = 1 << 20):
    """Runs of texts of about so many characters."""
    some, size = [], 0
    for t in texts:
        v = t.as_py() or ""
        some.append(v)
        size += len(v)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(text: Column, path: str) -> Column:
    """array<int>: the ids of each text."""

    def run(texts: pa.Array) -> pa.Array:
        found = [ids for some in _pieces(texts) for ids in model(path).encode(some)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        del found
        tb.released()
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return arrow_udf(run, "array<int>").asNondeterministic()(text)


def decode(ids: Column, path: str) -> Column:
    """string: the text of each array of ids."""

    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        out = pa.array([m.decode(np.array(x.as_py() or [], dtype="<u4")) for x in column], pa.string())
        tb.released()
        return out

    return arrow_udf(run, "string").asNondeterministic()(ids)


def digests(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) without moving ids or decoded texts out of the task."""

    def run(texts: pa.Array) -> pa.Array:
        m = model(path)
        n, a, b = [], [], []
        for some in _pieces(texts):
            for ids in m.encode(some):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        tb.released()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>").asNondeterministic()(text)


def trips(text: Column, path: str) -> Column:
    """struct(ids, decoded_sha256): the ids of a text and the digest of what they decode to, in one pass."""

    def run(texts: pa.Array) -> pa.Array:
        m, found, digest = model(path), [], []
        for some in _pieces(texts):
            for ids in m.encode(some):
                found.append(ids)
                digest.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(digest, pa.string())], names=["ids", "decoded_sha256"])

    return arrow_udf(tb.tidy(run), "struct<ids:array<int>,decoded_sha256:string>").asNondeterministic()(text)


def _with(docs: DataFrame, into: str, column: Column) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], column.alias(into))


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of each text."""
    return _with(docs, into, encode(F.col(f"`{text}`"), path))


def decoded(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids."""
    return _with(docs, into, decode(F.col(f"`{ids}`"), path))
