"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

The model file of a BPE with byte fallback is read as it is: pieces with their
scores, and the compiled character map, a trie from character sequences to what
they are replaced by.

A text is normalised from left to right.  Where characters begin a key of the
map, the longest key that is a prefix of the rest is taken and its replacement
written; all other characters are copied.  For each byte written the place in
the original text is kept (the alignment), through the removal of repeated
blanks, the blank put in front and the blanks' mark as well.  The normalised
text is cut before each run of blanks, which no merge can cross as no piece
holds a blank after another character, and each word is looked up among words
seen before.  The new words of a batch are merged together: an index leads from
each piece to the places of the pairs that make it, the piece with the best
score is taken first, and its places from left to right.  A character without a piece becomes the pieces of its bytes.  The
lengths of the pieces give their places in the normalised text, and the
alignment projects these to byte spans of the original: spans follow each other
without gaps, the last byte of a character that fell apart spans all of it and
the others nothing.

Work: one Arrow pass over the texts, no shuffle.  Merging follows the distinct
words; the words a Python worker keeps are bounded.

Defined cases: a null text is the empty text, which has the begin and end ids
only; a text of any length is one task's work, n log n in its length; equal rows get equal results; an empty table gives an empty
result; a column of the input with the name of a result column is replaced;
ids outside the vocabulary raise an error when decoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm import textbuf as tb

#: Words whose pieces a worker keeps; beyond, those of the generation before go.
KEPT_WORDS = 250_000
#: Text characters that are encoded at a time.
RUN_CHARS = 1 << 20
#: Lists of at least LONG_LIST places are merged as arrays, until PATIENCE lists in a row were shorter.
LONG_LIST, PATIENCE = 40, 64
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

_models: dict[str, Model] = {}


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a message in the protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        #: First characters of all keys.
        self.starts = frozenset(self.heads())
        self.start = re.compile("[" + "".join(map(re.escape, sorted(self.starts))) + "]") if self.starts else None

    def step(self, node: int, byte: int) -> int | None:
        """The node below a node by one byte."""
        unit = self.units[node]
        child = node ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def value(self, node: int) -> bytes | None:
        """The replacement at a node, None where no key ends."""
        unit = self.units[node]
        if not unit >> 8 & 1:
            return None
        leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))]
        at = leaf & 0x7FFFFFFF
        return self.texts[at : self.texts.index(0, at)]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key at a place."""
        if not self.units:
            return None
        node, found = 0, None
        for i in range(at, len(data)):
            node = self.step(node, data[i])
            if node is None:
                break
            if (text := self.value(node)) is not None:
                found = text, i + 1 - at
        return found

    def heads(self) -> Iterator[str]:
        """The first characters of all keys: below every node of a trie ends some key."""
        open_nodes = [(0, b"")] if self.units else []
        while open_nodes:
            node, head = open_nodes.pop()
            if head and len(head) == (1 if head[0] < 0x80 else 2 if head[0] < 0xE0 else 3 if head[0] < 0xF0 else 4):
                yield head.decode()
            else:
                open_nodes += [(child, head + bytes([b])) for b in range(1, 256) if (child := self.step(node, b)) is not None]


@dataclass
class Normal:
    """A normalised text and, for each of its bytes and its end, the byte of the original text that it comes from."""

    text: str
    align: np.ndarray


class Normaliser:
    """The normaliser of a model file."""

    def __init__(self, chars: CharMap, dummy: bool, squeeze: bool, escape: bool, suffix: bool, kept: tuple[str, ...] = ()) -> None:
        self.chars, self.dummy, self.squeeze, self.suffix = chars, dummy, squeeze, suffix
        self.blank = MARK if escape else " "
        self.kept = re.compile("|".join(map(re.escape, sorted(kept, key=len, reverse=True)))) if kept else None

    def __call__(self, text: str) -> Normal:
        if not text:
            return Normal("", np.zeros(1, np.int64))
        data = text.encode()
        if self.squeeze or self.kept or (self.chars.start is not None and not self.chars.starts.isdisjoint(text)):
            raw, align, fixed = self._mapped(text, data)
        else:
            raw, align, fixed = np.frombuffer(data, np.uint8), np.arange(len(data)), None
        blank = raw == 32
        end = len(data)
        if self.squeeze:
            after = np.concatenate(([True], blank[:-1]))
            stay = ~(blank & after & ~fixed)
            if not stay.any():
                return Normal("", np.zeros(1, np.int64))
            raw, align, blank = raw[stay], align[stay], blank[stay]
        text = raw.tobytes().decode().replace(" ", self.blank)
        width = len(self.blank.encode())
        align = np.repeat(align, np.where(blank, width, 1))
        if self.dummy and not self.suffix:
            text, align = self.blank + text, np.concatenate((np.full(width, align[0] if len(align) else end), align))
        if self.squeeze and text.endswith(self.blank):  # a mark that stood in the text goes as well
            text = text.rstrip(self.blank)
            n = len(text.encode())
            end, align = int(align[n]), align[:n]
        if self.dummy and self.suffix:
            text, align = text + self.blank, np.concatenate((align, np.full(width, end)))
        return Normal(text, np.append(align, end))

    def _mapped(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the map, the original place of each, and whether it is a blank inside a replacement."""
        out, align, fixed = bytearray(), [], []
        at = place = 0  # characters and bytes of the text passed so far
        next_kept = self.kept.search(text) if self.kept else None
        while at < len(text):
            m = self.chars.start.search(text, at) if self.chars.start else None
            upto = min(m.start() if m else len(text), next_kept.start() if next_kept else len(text))
            if upto > at:
                plain = text[at:upto].encode()
                out += plain
                align.append(np.arange(place, place + len(plain)))
                fixed.append(np.zeros(len(plain), bool))
                at, place = upto, place + len(plain)
                continue
            if next_kept and next_kept.start() == at:
                new = used = next_kept[0].encode()
                next_kept = self.kept.search(text, next_kept.end())
            else:
                new, n = self.chars.longest(data, place) or (text[at].encode(), len(text[at].encode()))
                used = data[place : place + n]
            out += new
            align.append(np.full(len(new), place))
            fixed.append(np.arange(len(new)) > len(new) - len(new.lstrip(b" ")))
            at, place = at + len(used.decode()), place + len(used)
            while next_kept and next_kept.start() < at:
                next_kept = self.kept.search(text, at)
        both = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((align, np.int64), (fixed, bool))]
        return np.frombuffer(bytes(out), np.uint8), both[0], both[1]


@dataclass
class Encoded:
    """Ids of a text and the span of original bytes of each; begin and end ids span nothing."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Model:
    """Pieces, scores and normaliser of a model file, with the pieces of words seen lately."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        if self.pieces and (trainer.get(3, 1) != BPE or UNUSED in self.kinds):
            raise ValueError("not a BPE model, or one with unused pieces")
        kept = tuple(p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED)
        self.normal = Normaliser(CharMap(norm.get(2, b"")), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), bool(trainer.get(24, 0)), kept)
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown, self.fallback = trainer.get(40, 0), bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self._tables(kept)

    def _tables(self, kept: tuple[str, ...]) -> None:
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.id_byte = np.full(len(self.pieces), -1)
        for b, i in self.byte_id.items():
            self.id_byte[i] = b
        self.control = np.array([k == CONTROL for k in self.kinds])
        #: Normalised bytes of a piece; of the piece of a byte, one.
        self.size = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.size[[self.bos, self.eos]] = 0
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.table, self.raw_size = pa.array(self.raw, pa.binary()), np.array(list(map(len, self.raw)))
        order = sorted(self.rank, key=self.rank.__getitem__)
        times = Counter(r for r, _ in self.rank.values())
        # Words with pieces of equal score, whose order is by place alone, and with user-defined pieces are merged one by one.
        alone = [p for p in order if len(p) > 1 and (times[self.rank[p][0]] > 1 or p in kept)]
        self.alone = re.compile("|".join(map(re.escape, alone))) if alone else None
        number = {p: i for p, (_, i) in self.rank.items()}
        self.merges = Merges([(number[p], [(number[p[:k]], number[p[k:]]) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]) for p in order])
        #: The first symbol of each character: its piece, or a number beyond the vocabulary.
        self.first_symbol = np.arange(0x110000) + len(self.pieces)
        for p, i in number.items():
            if len(p) == 1:
                self.first_symbol[ord(p)] = i
        self.kept = re.compile("(" + "|".join(map(re.escape, sorted(kept, key=len, reverse=True))) + ")") if kept else None
        # A cut before each run of marks is sound if no piece holds a mark after another character.
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if not kept and all(MARK not in p.lstrip(MARK) for p in self.rank) else re.compile(".+", re.S)
        #: Ids of words in a row, as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Enter the ids of words of normalised texts."""
        together = []
        for w in words:
            if self.alone is not None and self.alone.search(w):
                self.known[w] = self.slowly(w)
            else:
                together.append(w)
        points = np.frombuffer("".join(together).encode("utf-32-le"), "<u4")
        starts = np.cumsum([0, *map(len, together)])
        symbols = merge_all(self.first_symbol[points], starts, self.merges)
        whole = symbols >= 0
        ids = symbols[whole]
        raw = ids.astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(whole)))[starts].tolist()
        strange = np.append(np.add.reduceat(np.append(symbols >= len(self.pieces), False), starts[:-1]) > 0, False).tolist() if len(together) else []
        for k, w in enumerate(together):
            if strange[k]:
                own = ids[cuts[k] : cuts[k + 1]].tolist()
                self.known[w] = _packed([x for i in own for x in ([i] if i < len(self.pieces) else self.spelled(chr(i - len(self.pieces))))])
            else:
                self.known[w] = raw[4 * cuts[k] : 4 * cuts[k + 1]]

    def spelled(self, character: str) -> list[int]:
        """The pieces of a character's bytes."""
        if not self.fallback:
            raise ValueError("a character without a piece needs a model with byte fallback")
        return [self.byte_id[b] for b in character.encode()]

    def slowly(self, word: str) -> bytes:
        """Ids of one word, merge by merge."""
        out: list[int] = []
        for k, part in enumerate(self.kept.split(word) if self.kept else (word,)):
            for piece in [part] if k % 2 else self.merged(part):
                out += [self.rank[piece][1]] if piece in self.rank else self.spelled(piece)
        return _packed(out)

    def merged(self, text: str) -> list[str]:
        """The pieces into which a stretch of text merges."""
        n, rank = len(text), self.rank
        if n < 2 or text in rank and n == 2:
            return [text] if n else []
        symbol: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str, str]] = []

        def enter(i: int) -> None:
            j = right[i]
            if (r := rank.get(symbol[i] + symbol[j])) is not None:
                heapq.heappush(heap, (r[0], i, symbol[i], symbol[j]))

        for i in range(n - 1):
            enter(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                enter(i)
            if left[i] >= 0:
                enter(left[i])
        return [s for s in symbol if s is not None]

    def encode(self, texts: list[str]) -> list[Encoded]:
        """Ids and spans of each text, begin and end ids included."""
        normal = [self.normal(t) for t in texts]
        split = [self.words.findall(x.text) for x in normal]
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for w in set(chain.from_iterable(split)).difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        if new:
            self.learn(new)
        out, first, last = [], _packed([self.bos]), _packed([self.eos])
        for x, words in zip(normal, split, strict=True):
            ids = np.frombuffer(b"".join([first, *map(known.__getitem__, words), last]), dtype="<u4")
            out.append(Encoded(ids, *self.spans(ids, x.align)))
        return out

    def spans(self, ids: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans of pieces by their lengths and the alignment."""
        size, byte = self.size[ids], self.id_byte[ids]
        stop = np.cumsum(size)
        start = stop - size
        if (loose := byte >= 0).any():  # bytes of one character: all begin at its first, only the last reaches its end
            inner = loose & (byte & 0xC0 == 0x80)
            start = np.maximum.accumulate(np.where(inner, 0, start))
            more = loose & np.append(inner[1:], False)
            stop = np.where(more, start, stop)
        return align[start], align[stop]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become blanks, one blank at the beginning goes, bytes become characters."""
        ids = np.asarray(ids, dtype=np.int64)
        stretches = [ids]
        if self.control[ids[1:-1]].any():  # bytes on both sides of a control id make no character together
            stretches = np.split(ids, np.flatnonzero(self.control[ids]))
        data = [self._joined(x) if len(x) > 32 else b"".join([self.raw[i] for i in x.tolist()]) for x in stretches]
        shown = np.flatnonzero(self.raw_size[ids[:8]]) if len(ids) > 8 else np.flatnonzero(self.raw_size[ids])
        head = int(ids[shown[0]]) if len(shown) else next((i for i in ids.tolist() if self.raw[i]), None)
        if head is not None and (self.normal.dummy or self.normal.squeeze) and self.pieces[head].startswith(MARK):
            k = next(k for k, d in enumerate(data) if d)
            data[k] = data[k][1:]
        return "".join(map(_characters, data))

    def _joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces in a row: the data of an array of them."""
        taken = self.table.take(pa.array(ids))
        return taken.buffers()[2].to_pybytes()[: int(self.raw_size[ids].sum())]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _characters(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that begins no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append(data[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Merges:
    """The piece that each rank makes and the rank of each pair that makes one; a piece may be made from several pairs."""

    def __init__(self, rows: list[tuple[int, list[tuple[int, int]]]]) -> None:
        self.into = [piece for piece, _ in rows]
        self.rank = {a << 32 | b: r for r, (_, pairs) in enumerate(rows) for a, b in pairs}
        key = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.value = np.append(np.fromiter(self.rank.values(), np.int64, len(self.rank))[order], -1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it makes nothing."""
        pair = left << 32 | right
        at = np.searchsorted(self.key, pair)
        return np.where(self.key[at] == pair, self.value[at], -1)


def merge_all(symbols: np.ndarray, starts: np.ndarray, table: Merges) -> np.ndarray:
    """Merge a sequence of words; a place whose symbol was taken up by its left neighbour holds -1.

    Words do not meet, so that all places of the best piece in all words merge
    at once.  Of two places that share a symbol the left one merges.  Long lists of places are worked
    off as arrays, and when these have become rare, the rest place by place.
    """
    symbols = symbols.astype(np.int64)
    n = len(symbols)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    first = starts[:-1][np.diff(starts) > 0]
    before[first] = -1
    after[starts[1:][np.diff(starts) > 0] - 1] = -1
    places: dict[int, list[np.ndarray]] = {}
    open_ranks: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = table.ranks(symbols[at], symbols[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        heads = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        for r, part in zip(rank[heads].tolist(), np.split(at, heads[1:]), strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(open_ranks, r)
            places[r].append(part)

    enter(np.flatnonzero(after >= 0))
    short = 0
    while open_ranks and short < PATIENCE:
        r = heapq.heappop(open_ranks)
        i = np.unique(np.concatenate(places.pop(r)))
        i = i[(symbols[i] >= 0) & (after[i] >= 0)]
        i = i[table.ranks(symbols[i], symbols[after[i]]) == r]
        short = short + 1 if len(i) < LONG_LIST else 0
        if not len(i):
            continue
        j = after[i]
        run = np.flatnonzero(np.append(True, i[1:] != j[:-1]))
        odd = (np.arange(len(i)) - np.repeat(run, np.diff(np.append(run, len(i))))) % 2
        i, j = i[odd == 0], j[odd == 0]
        k = after[j]
        symbols[i], symbols[j], after[i] = table.into[r], -1, k
        before[k[k >= 0]] = i[k >= 0]
        h = before[i]
        enter(np.concatenate([i[k >= 0], h[h >= 0]]))
    if not open_ranks:
        return symbols
    return _by_place(symbols.tolist(), before.tolist(), after.tolist(), {r: np.concatenate(p).tolist() for r, p in places.items()}, table)


def _by_place(symbols: list[int], before: list[int], after: list[int], places: dict[int, list[int]], table: Merges) -> np.ndarray:
    rank = table.rank.get
    open_ranks = list(places)
    heapq.heapify(open_ranks)
    while open_ranks:
        r = heapq.heappop(open_ranks)
        into = table.into[r]
        for i in sorted(places.pop(r)):
            j = after[i]
            if symbols[i] < 0 or j < 0 or rank(symbols[i] << 32 | symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = into, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            h = before[i]
            for at, new in ((i, rank(into << 32 | symbols[k]) if k >= 0 else None), (h, rank(symbols[h] << 32 | into) if h >= 0 else None)):
                if new is not None:
                    if new in places:
                        places[new].append(at)
                    else:
                        places[new] = [at]
                        heapq.heappush(open_ranks, new)
    return np.array(symbols, dtype=np.int64)


def model(path: str) -> Model:
    """The model of a file, read once in each Python worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        v = t.as_py() or ""
        some.append(v)
        size += len(v)
        if size >= RUN_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(text: Column, path: str) -> Column:
    """array<struct(id, begin, end)>: ids of each text with their spans of UTF-8 bytes in it."""

    def run(texts: pa.Array) -> pa.Array:
        found = [e for some in _runs(texts) for e in model(path).encode(some)]
        ends = pa.array(np.cumsum([0, *(len(e.ids) for e in found)]).astype(np.int32))
        flat = [pa.array(np.concatenate([getattr(e, k) for e in found] or [np.zeros(0)]).astype(np.int32)) for k in ("ids", "begin", "end")]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["id", "begin", "end"]))

    return arrow_udf(tb.tidy(run), "array<struct<id:int,begin:int,end:int>>").asNondeterministic()(text)


def decode(ids: Column, path: str) -> Column:
    """string: the text of each array of ids; null for null."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else model(path).decode(np.array(x.as_py(), dtype=np.int64)) for x in column], pa.string())

    return arrow_udf(tb.tidy(run), "string").asNondeterministic()(ids)


DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>"


def digests(text: Column, path: str) -> Column:
    """struct of the count of ids and digests of ids, decoded text and spans, which stay in the task.

    spans_sha256 is taken over begin and end of each id in a row, as
    little-endian unsigned 32-bit integers.
    """

    def run(texts: pa.Array) -> pa.Array:
        m, rows = model(path), []
        for some in _runs(texts):
            for e in m.encode(some):
                spans = np.stack((e.begin, e.end), axis=1).astype("<u4")
                rows.append((len(e.ids), *(hashlib.sha256(x).hexdigest() for x in (e.ids.tobytes(), m.decode(e.ids).encode(), spans.tobytes()))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return arrow_udf(tb.tidy(run), DIGESTS).asNondeterministic()(text)


def _with(docs: DataFrame, into: str, column: Column) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], column.alias(into))


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """docs with the pieces of each text: id, begin and end."""
    return _with(docs, into, encode(F.col(f"`{text}`"), path))


def decoded(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of each array of ids."""
    return _with(docs, into, decode(F.col(f"`{ids}`"), path))
