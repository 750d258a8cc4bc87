"""Token counts with overlap resynchronisation.

Counts are those of a byte-level BPE vocabulary.  A text of at most ``chunk``
characters is encoded at once.  A longer one is encoded in overlapping chunks:
each chunk's tokens give the byte offsets at which tokens begin, and two
neighbouring chunks are spliced at an offset in their overlap where both begin
a token and the text goes from a printed character, of whatever script, to
white space.  No piece of the splitting pattern reaches across such a place,
nor does a special token hold one, so on either side the tokens are those of
the whole text: a common boundary of this kind is stable.  If an overlap holds
none, it is widened, doubling up to the whole left chunk; a left chunk without
any goes on by its own length, so that a text without blanks is encoded in
chunks of doubling size, under three times its length in all.

The tokens come from the rank file of the same vocabulary as the JSON file
(the two are published side by side and give equal tokens, which the tests and
``python -m pytest`` check on whole tables); special tokens written in a text
count as one token, as they do by default with the JSON file.

Work: one Arrow pass, no shuffle; memory follows the chunk, and one document.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a text without
white space is one growing chunk; equal rows get equal results; an empty table
gives an empty result; a column of the input with the name of the result
column is replaced.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm.lineage import free_name

CHUNK, OVERLAP = 64_000, 512
#: Characters that a stable place keeps from the end of the left chunk, so that blanks behind it are whole or go on alike.
MARGIN = 16
#: Read backwards: a blank, then a printed character before it.
_BLANK_AFTER = re.compile(r"[ \n\t](?=\S)")
_encodings: dict[tuple, Encoder] = {}


class Encoder:
    """A byte-level BPE with the length of every token."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.marks = [s for s, _ in special]
        self.size = np.zeros(max([*ranks.values(), *(i for _, i in special)]) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        for token, i in special:
            self.size[i] = len(token.encode())

    def ids(self, text: str) -> list[int]:
        if any(m in text for m in self.marks):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def starts(self, ids: list[int]) -> np.ndarray:
        """The byte offset of each token, and the length of all."""
        return np.concatenate(([0], np.cumsum(self.size[ids])))

    def all_ids(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of a text of any length, by overlapping chunks."""
        if len(text) <= chunk:
            return self.ids(text)
        out: list[int] = []
        begin = 0  # the text from here on is not yet in out
        stop = chunk
        left = self.ids(text[:stop])
        while stop < len(text):
            width, after = overlap, min(len(text), stop + chunk)
            while True:
                # The right chunk takes in the overlap and goes on by a chunk; a wider overlap reaches back further.
                at = max(begin, stop - width)
                if (place := self._stable(text, at, stop)) is not None:
                    right = self.ids(text[at:after])
                    if (cut := self._common(text, begin, at, place, left, right)) is not None:
                        out += left[: cut[0]]
                        left, begin, stop = right[cut[1] :], place, after
                        break
                if at == begin:  # the left chunk has no stable place: it goes on by as much as it is long, so each doubling is encoded once
                    stop = min(len(text), stop + max(chunk, stop - begin))
                    left = self.ids(text[begin:stop])
                    break
                width *= 2
        return out + left

    def _stable(self, text: str, at: int, stop: int) -> int | None:
        """The last place in text[at:stop] between a printed character and a blank behind it, away from the ends."""
        for m in _BLANK_AFTER.finditer(text[at + 1 : stop - MARGIN][::-1]):
            return stop - MARGIN - m.start() - 1
        return None

    def _common(self, text: str, begin: int, at: int, place: int, left: list[int], right: list[int]) -> tuple[int, int] | None:
        """Indexes of the tokens of both chunks that begin at a place of the text; None unless both have one."""
        a, b = self.starts(left), self.starts(right)
        x, y = len(text[begin:place].encode()), len(text[at:place].encode())
        i, j = int(np.searchsorted(a, x)), int(np.searchsorted(b, y))
        return (i, j) if i < len(left) and j < len(right) and a[i] == x and b[j] == y else None


def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Encoder:
    """Read once in each Python worker."""
    if (key := (path, pattern, special)) not in _encodings:
        _encodings[key] = Encoder(*key)
    return _encodings[key]


def counts(text: Column, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """bigint: the number of tokens of each text."""

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(path, pattern, special)
        return pa.array([len(e.all_ids(t.as_py() or "", chunk, overlap)) for t in texts], pa.int64())

    return arrow_udf(run, "bigint").asNondeterministic()(text)


def with_counts(docs: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), limit: int = 512, text: str = "text", into: str = "tokens", **options) -> DataFrame:
    """docs with a struct column: n_bytes, n_tokens and over_limit."""
    t = F.col(f"`{text}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    own = free_name(docs, into)
    n = docs.select(*rest, F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias(free_name(docs, "n_bytes")), counts(t, path, pattern, special, **options).alias(own))
    *_, b, k = n.columns
    made = F.struct(F.col(f"`{b}`").alias("n_bytes"), F.col(f"`{k}`").alias("n_tokens"), (F.col(f"`{k}`") > limit).alias("over_limit"))
    return n.select(*rest, made.alias(into))
