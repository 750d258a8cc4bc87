"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one over *target* texts
(a bounded sample of rows labelled good and not toxic) and one over *all*
texts.  A document's log weight is the sum over its n-grams of the log ratio
of the two, and a sample without replacement with those weights is drawn by
Gumbel top-k: noise is added to each log weight and the k largest stay.

N-grams are one and two tokens long; a token is a run of letters, digits and
non-ASCII bytes, or a run of other printable characters, lower-cased.  Each
n-gram falls into a bucket of each of two hashes, and the milder of its two
ratios counts, so that an n-gram that shares one bucket with a frequent one
keeps a ratio of its own.  A bucket's ratio is shrunk towards one with a Dirichlet prior whose base is the
raw model; ratios are centred on the typical n-gram, and those that are small
or within the sampling error of their counts are taken as one.  Where the
labelled rows, good and bad together, hold fewer of an n-gram than all texts
suggest (a group of thousands of copies that nobody labelled), the raw count
is lowered to what they bear out: absence of labels is no evidence.  The log weight is put on the
scale of log odds by a one-variable logistic fit on the labelled sample, and
k is the expected number of target documents: the sum of all odds as
probabilities.  Only the labelled sample is bounded (``labelled_rows``); raw
counts, weights, k and the cut cover every document.

Work: a pass over the texts counts buckets (partial sums in each batch, then
one ``groupBy`` on the bucket); a second pass weighs every document into a
narrow checkpointed table; the cut at k is found by counting ever finer bins
of that table.  The driver holds ``buckets`` counts and a few numbers.

Defined cases: a null or empty text has no n-grams and log weight 0 before
calibration; a text of one endless token has one n-gram; a label row with a
null label or id is no example, of several rows for one id the worst counts;
equal rows get equal results, and rows that tie at the cut all stay; an empty
table gives an empty result; with no example of one of the classes everything
is kept; extra columns of any name stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from offerloom.llm import textbuf as tb
from offerloom.llm.lineage import cut, free_name

#: Hash buckets of n-grams for each of two hashes; labelled rows that are looked at, at most.
BUCKETS, LABELLED_ROWS = 1 << 18, 40_000
#: Weight of the raw model in a bucket, in counts; standard errors within which a ratio is taken as one.
PRIOR, ERRORS = 8.0, 5.0
#: Smaller log ratios count as zero: copies and shared passages move counts by more than their sampling error.
LEAST_RATIO = 1.0

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_lo) : ord(_hi) + 1] = 1
_KIND[128:] = 1


def _ngrams(text: pa.Array, buckets: int):
    """Slice by slice: the first document, both buckets of every n-gram, and the n + 1 offsets of documents in single tokens and in pairs."""
    raw, offsets = tb.buffer_of(text)
    for i, j in tb.slices(offsets):
        data, at = tb.lowered(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        kind = _KIND[data]
        n = len(kind)
        changes = np.ones(n + 1, dtype=bool)
        changes[1:n] = kind[1:] != kind[:-1]
        changes[at] = True
        edge = np.flatnonzero(changes)
        start, end = edge[:-1], edge[1:]
        keep = kind[start] > 0 if n else np.zeros(0, bool)
        start, end = start[keep], end[keep]
        one = tb.span_hash(data, start, end)
        token_at = np.searchsorted(start, at)
        opens, two_n = tb.windows_inside(token_at, 2)
        two = tb.ngram_hash(one, 2)[opens] if len(opens) else one[:0]
        value = np.concatenate([one, two])
        bucket = np.stack([value % tb.U64(buckets), tb.mix(value ^ tb.U64(0x5851F42D4C957F2D)) % tb.U64(buckets) + tb.U64(buckets)]).astype(np.int64)
        yield i, bucket, token_at, np.concatenate(([0], np.cumsum(two_n)))


def _count(buckets: int):
    def run(batches):
        """One row for each bucket that a batch fills: counts in all, in target and in labelled texts."""
        for b in batches:
            total, target, known = (np.zeros(2 * buckets, np.int64) for _ in range(3))
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            has = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, bucket, one_at, two_at in _ngrams(b.column(0), buckets):
                total += np.bincount(bucket.ravel(), minlength=2 * buckets)
                for of, into in ((good, target), (has, known)):
                    f = of[i : i + len(one_at) - 1]
                    mask = np.concatenate([np.repeat(f, np.diff(one_at)), np.repeat(f, np.diff(two_at))])
                    if mask.any():
                        into += np.bincount(bucket[:, mask].ravel(), minlength=2 * buckets)
            at = np.flatnonzero(total)
            tb.released()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, total[at], target[at], known[at])], names=["bucket", "raw", "target", "known"])

    return run


def log_ratios(raw: np.ndarray, target: np.ndarray, known: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each bucket: shrunk, centred, and zero within the error of the counts."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    expected = np.minimum(raw * (target.sum() / raw.sum()), known * (target.sum() / known.sum()))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    order = np.argsort(ratio)
    mass = np.cumsum(target[order])
    centre = ratio[order][np.searchsorted(mass, mass[-1] / 2)]
    ratio = np.where(expected > 0, ratio - centre, 0.0)
    error = np.sqrt(1 / (target + PRIOR) + 1 / (expected + PRIOR))
    return np.where(np.abs(ratio) > np.maximum(LEAST_RATIO, ERRORS * error), ratio, 0.0)


def fit_scale(weight: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope >= 0 and intercept of P(good | log weight): logistic, by Newton steps with a small ridge."""
    if not len(good) or good.all() or not good.any():
        return 0.0, 6.0
    scale = 10.0  # log weights beyond 30 say no more than 30 does
    x = np.stack([np.clip(weight / scale, -3, 3), np.ones(len(weight))], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (good - p) - 1e-2 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0) / scale, float(beta[1])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by counting ever finer bins; -inf where df has k rows or fewer."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    rest = k  # the k-th largest of all is the rest-th largest of those in [low, high]
    while low < high:
        width = (high - low) / bins
        if low + width == low or width == 0.0:
            break
        part = df.where(F.col(column).between(low, high))
        of = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int")
        rows = part.groupBy(of.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()  # bins rows at most
        for r in rows:
            if rest <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            rest -= r["n"]
        if len(rows) == 1 and rows[0]["n"] == rest:
            return float(low)
    return float(low)


def gumbel(*columns: Column) -> Column:
    """Standard Gumbel noise that depends on the values of the columns alone."""
    u = (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(9)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


@dataclass(frozen=True)
class Sampler:
    """What a fit leaves: ratios of buckets, the scale of log weights, k, and the cut that k documents reach."""

    ratios: np.ndarray
    slope: float
    intercept: float
    k: int
    cut: float

    def log_weight(self, text: Column) -> Column:
        ratios = self.ratios

        def weigh(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts))
            for i, bucket, one_at, two_at in _ngrams(texts, len(ratios) // 2):
                a, b = ratios[bucket]  # a ratio that one hash alone shows is another n-gram's
                r = np.concatenate(([0.0], np.cumsum(np.where(np.abs(a) < np.abs(b), a, b))))
                n = one_at[-1]
                out[i : i + len(one_at) - 1] = r[one_at[1:]] - r[one_at[:-1]] + r[n + two_at[1:]] - r[n + two_at[:-1]]
            tb.released()
            return pa.array(np.round(out, 6))

        return arrow_udf(weigh, "double").asNondeterministic()(text)

    def key(self, weight: Column, *noise: Column) -> Column:
        return weight * self.slope + self.intercept + gumbel(*noise)


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id and good of at most rows labelled documents, picked by a hash of the id."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_sampler(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, rows: int = LABELLED_ROWS) -> tuple[Sampler, DataFrame]:
    """The sampler and the table (id, log_weight, key, good) it was cut from."""
    known = cut(labelled(labels, rows).withColumnRenamed("doc_id", "id"))
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marked = base.join(F.broadcast(known), "id", "left")  # known has `rows` rows at most
    counts = marked.select("text", "good").mapInArrow(_count(buckets), "bucket long, raw long, target long, known long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "target", "known")]).toArrow()  # 2 * buckets rows at most
    seen = np.zeros((3, 2 * buckets))
    for row, c in zip(seen, ("raw", "target", "known"), strict=True):
        row[counts["bucket"].to_numpy()] = counts[c].to_numpy()
    del counts
    first = Sampler(log_ratios(*seen), 0.0, 0.0, 0, 0.0)
    weights = cut(marked.select("id", "good", first.log_weight(F.col("text")).alias("log_weight"), gumbel(F.col("id"), F.col("text")).alias("noise")))
    sample = weights.where("good is not null").limit(2 * rows).select("log_weight", "good").toArrow()
    good = sample["good"].to_numpy()
    slope, intercept = fit_scale(sample["log_weight"].to_numpy(), good)
    odds = F.col("log_weight") * slope + intercept
    whole = not len(good) or good.all() or not good.any()  # one class says nothing of the other
    k = weights.agg(F.count("*") if whole else F.round(F.sum(1 / (1 + F.exp(-odds))))).first()[0]
    keyed = weights.select("id", "good", "log_weight", (odds + F.col("noise")).alias("key"))
    k = int(k or 0)
    return Sampler(first.ratios, slope, intercept, k, kth_largest(keyed, "key", k)), keyed


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """id, log_weight, key and kept of every document."""
    sampler, keyed = fit_sampler(docs, labels, **options)
    return keyed.select("id", "log_weight", "key", (F.col("key") >= sampler.cut).alias("kept"))


def keep_target_like(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that the sampler draws, with the columns of docs."""
    sampler, _ = fit_sampler(docs, labels, doc_id, text, **options)
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    own = free_name(docs, "log_weight")
    weighed = docs.withColumn(own, sampler.log_weight(t))
    return weighed.where(sampler.key(F.col(own), i, t) >= sampler.cut).drop(own)
