"""Quality rules by weak supervision.

Each rule looks at a few numbers of a text and votes *bad*, votes *good* or
abstains.  No rule decides alone: a two-class model with one hit rate and one
clearance rate for each rule is fitted by expectation-maximisation to the
counts of vote patterns over all documents, and a document is kept when its
posterior probability of being good is at least a half (a parameter).

Work: an Arrow pass over the texts for the fit and one for the verdicts give the numbers, a ``groupBy`` on the
vote pattern with map-side sums gives at most ``3 ** len(rules)`` rows, the
fit runs on those rows alone, and its result is a sum of literals.  Nothing is
shuffled but the pattern counts, so neither skew nor very long texts matter.

Defined cases: a null or empty text has no words and fails the base rules; a
text that is one endless word is one word; equal rows get equal results; an
empty table gives an empty result; columns of the input are kept, except that
one with the name of the result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm import textbuf as tb
from offerloom.llm.lineage import free_name

#: The fixed numbers of a text that the base rules read, then those only votes read.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NUMBERS = (*BASE, "n_lines", "n_upper", "n_letters", "n_bangs", "n_marked_words", "n_bars")
_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in NUMBERS) + ">"

#: The share of bad texts that the fit starts from and is drawn to; the most bad texts on which one rule votes bad.
SHARE_BAD, MOST_HITS = 0.2, 0.75

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_UPPER = _LETTER.copy()
_LETTER[ord("a") : ord("z") + 1] = True


def _numbers(w: tb.Words) -> list[np.ndarray]:
    """The NUMBERS of each document of a slice."""
    data, starts = w.data, w.doc_start
    word_size = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))).astype(np.int64)[np.stack([w.start, w.end])], axis=0)[0]
    # Lines: cut at \n and at the ends of texts; a line counts if it holds a word.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(starts[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    line_end = np.concatenate((line_start[1:], [len(data)])) if len(line_start) else line_start
    ends_in_break = data[np.maximum(line_end - 1, 0)] == 10 if len(line_end) else np.zeros(0, bool)
    line_end = line_end - ends_in_break
    first_word = np.searchsorted(w.start, line_start)
    holds = (np.searchsorted(w.start, line_end) - first_word) > 0
    line_start, line_end = line_start[holds], line_end[holds]
    line_doc = np.searchsorted(starts, line_start, side="right") - 1
    key = tb.in_document(tb.span_hash(data, line_start, line_end), line_doc)
    _, seen_first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=np.int64)
    again[seen_first] = 0
    n_dup = np.bincount(line_doc, weights=again, minlength=w.n_docs).astype(np.int64)
    n_lines = np.bincount(line_doc, minlength=w.n_docs).astype(np.int64)
    # Words inside three-word windows that the text holds twice or more.
    opens, _ = tb.windows_inside(w.at, 3)
    covered = np.zeros(len(w.start) + 3, dtype=np.int64)
    if len(opens):
        three = tb.in_document(tb.ngram_hash(w.hash, 3)[opens], w.doc[opens])
        order = np.argsort(three)
        s = three[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = opens[order[twice]]
        for k in range(3):
            covered[at + k] = 1
    sizes = w.end - w.start
    symbol = _SYMBOL[data]
    marks = np.concatenate(([0], np.cumsum(symbol)))
    marked = (marks[w.end] - marks[w.start] > 0) & (sizes > 1)
    return [
        np.diff(w.at),
        tb.per_document(word_size, w.at),
        tb.per_document(symbol, starts),
        n_dup,
        tb.per_document(covered[: len(w.start)], w.at),
        n_lines,
        tb.per_document(_UPPER[data], starts),
        tb.per_document(_LETTER[data], starts),
        tb.per_document(data == ord("!"), starts),
        tb.per_document(marked, w.at),
        tb.per_document(data == ord("|"), starts),
    ]


def _text_numbers(text: pa.Array) -> pa.Array:
    parts = [_numbers(w) for w in tb.words_of(text, lower=False)]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(NUMBERS))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(NUMBERS))


def text_numbers(text: Column) -> Column:
    """The NUMBERS of a text as a struct; evaluated once a row, however often the plan refers to it."""
    return arrow_udf(_text_numbers, _TYPE).asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """A voter: SQL conditions over NUMBERS for a bad and for a good vote; neither holds: it abstains."""

    name: str
    bad: str
    good: str


#: Votes compare whole numbers, so that every engine gives the same vote.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("marked_words", "10 * n_marked_words > n_words", "50 * n_marked_words <= n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 0"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
    Rule("capitals", "10 * n_upper > 4 * n_letters", "10 * n_upper <= n_letters"),
    Rule("shouting", "10 * n_bangs > n_words", "50 * n_bangs <= n_words"),
    Rule("tables", "20 * n_bars > n_words", "n_bars = 0"),
)


def pattern(rules: tuple[Rule, ...], numbers: str) -> Column:
    """All votes as one number: digit k in base 3 is 2 for bad, 1 for good, 0 for abstaining."""
    out = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        vote = F.expr(f"CASE WHEN {_qualified(r.bad, numbers)} THEN 2 WHEN {_qualified(r.good, numbers)} THEN 1 ELSE 0 END")
        out = out + vote * F.lit(3**k)
    return out


def _qualified(condition: str, numbers: str) -> str:
    return " ".join(f"`{numbers}`.{t}" if t in NUMBERS else t for t in condition.split(" "))


@dataclass(frozen=True)
class Fit:
    """prior of bad; for each rule P(bad vote | bad text, it votes) and P(good vote | good text, it votes)."""

    prior_bad: float
    hit: tuple[float, ...]
    clear: tuple[float, ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of good: a constant, then what a bad and a good vote of each rule add."""
        each = [(float(np.log((1 - c) / h)), float(np.log(c / (1 - h)))) for h, c in zip(self.hit, self.clear, strict=True)]
        return float(np.log((1 - self.prior_bad) / self.prior_bad)), each


def fit_votes(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 100) -> Fit:
    """Expectation-maximisation over counts of vote patterns.

    The classes keep their meaning because a rule's bad vote is held to be at
    least three times as likely on a bad text as on a good one, because no
    rule may vote bad on more than MOST_HITS of the bad texts (else one rule
    becomes the class), and because the share of bad texts is drawn to
    SHARE_BAD by a Beta prior that weighs a tenth of the texts, and is one in
    two at most.  Each rate starts from pseudo-counts, so rules that never
    vote keep their starting values.
    """
    votes = (patterns[:, None] // 3 ** np.arange(n_rules)) % 3
    bad, good = votes == 2, votes == 1
    prior, hit, clear = SHARE_BAD, np.full(n_rules, 0.4), np.full(n_rules, 0.99)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + bad @ np.log(hit / (1 - clear)) + good @ np.log((1 - hit) / clear)
        p = counts / (1 + np.exp(-odds))
        q = counts - p
        before = (prior, hit, clear)
        held = 10 + 0.1 * counts.sum()
        prior = float(np.clip((p.sum() + SHARE_BAD * held) / (counts.sum() + held), 1e-4, 0.5))
        hit = (p @ bad + 4) / (p @ (bad | good) + 10)
        clear = (q @ good + 19.8) / (q @ (bad | good) + 20)
        clear = np.clip(clear, 0.9, 0.9995)
        hit = np.clip(hit, 3 * (1 - clear), MOST_HITS)
        if max(abs(prior - before[0]), np.abs(hit - before[1]).max(), np.abs(clear - before[2]).max()) < 1e-9:
            break
    return Fit(prior, tuple(hit), tuple(clear))


def base_failed(numbers: str) -> Column:
    n, r = F.col(f"{numbers}.n_words"), F.col(f"{numbers}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def quality_rules(
    docs: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES, least: float = 0.5, fit: Fit | None = None
) -> DataFrame:
    """docs with a struct column: NUMBERS, pattern, p_good, base_failed and kept.

    kept is false where base_failed holds, else p_good >= least.  Without fit,
    the model is fitted to all documents first, in a pass of its own.
    """
    rest = [c for c in docs.columns if c.lower() != into.lower()]
    numbers = docs.select(*[F.col(f"`{c}`") for c in rest], text_numbers(F.col(f"`{text}`")).alias(into))
    votes = pattern(rules, into)
    if fit is None:
        rows = docs.select(text_numbers(F.col(f"`{text}`")).alias(into)).groupBy(votes.alias("p")).count().collect()  # 3 ** len(rules) rows at most
        fit = fit_votes(np.array([r["p"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=float), len(rules))
    constant, each = fit.weights()
    odds = F.lit(constant)
    for r, (b, g) in zip(rules, each, strict=True):
        odds = odds + F.when(F.expr(_qualified(r.bad, into)), b).when(F.expr(_qualified(r.good, into)), g).otherwise(0.0)
    # Each step is a projection of its own, so that no long expression is repeated in the next.
    own = [free_name(numbers, c) for c in ("pattern", "p_good", "failed")]
    judged = numbers.withColumn(own[0], votes).withColumn(own[1], 1 / (1 + F.exp(-odds))).withColumn(own[2], base_failed(into))
    voted, p_good, failed = map(F.col, own)
    fields = [F.col(f"{into}.{c}").alias(c) for c in NUMBERS]
    fields += [voted.alias("pattern"), p_good.alias("p_good"), failed.alias("base_failed"), (~failed & (p_good >= least)).alias("kept")]
    return judged.withColumn(into, F.struct(*fields)).drop(*own)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs."""
    into = free_name(docs, "quality_")
    return quality_rules(docs, into=into, **options).where(F.col(f"{into}.kept")).drop(into)
