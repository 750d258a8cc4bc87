"""URL filters mined as association rules.

Labelled pages become baskets: the tokens of a URL and its label.  Spark's
FP-growth finds the frequent token combinations; rules *tokens -> bad* stay
when their support, confidence and lift are high enough and no rule with fewer
tokens is as confident.  A page is blocked when its tokens hold all tokens of
some rule.  Rules are found by an inverted index: each rule is listed under
its rarest token, the token sets of pages are looked up by token, and the
other tokens are then checked.

Fixed host and path rules come first: a rule fits its host and all
subdomains if the path starts with the rule's, and the longest rule wins.

A URL's tokens cover all of it: scheme, top domain, domain, every host label,
every path part, ending, every query key and value and the fragment, and the
words of labels, parts, values and fragment; runs of digits count as ``0``.
Before FP-growth, tokens are dropped that fewer bad baskets hold than a rule
needs, or that all baskets hold (lift one), and tokens of the same baskets are
taken as one class: no rule is lost, as a rule with two of a class is implied
by one with fewer tokens, and a page holds a class if it holds any of it.

Work: mining runs on the labelled rows; the driver holds counts of frequent
items and the rules (both limited by the least support; the number of frequent
combinations of classes has no other limit).  Pages are looked up by distinct
token set, so a hot host is one row in the look-up, and joined back to their
verdict.

Defined cases: a null URL, or one without ``://``, has empty host and path and
no tokens, and is allowed; label rows with null quality are no examples; with
no labels or no rules nothing is blocked; repeated rows are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of baskets, least number of baskets, confidence and lift of a mined rule.
SUPPORT, LEAST_ROWS, CONFIDENCE, LIFT = 0.001, 10, 0.8, 1.5
#: Rules up to which the index is broadcast; beyond, it is joined by shuffle.
BROADCAST_RULES = 20_000
BAD = "label=bad"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for a null URL or one without."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host_: Column, path_: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _shape(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[0-9]+", "0")


def _each(kind: str, values: Column) -> Column:
    """kind=value of the values that are not empty."""
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))


def _words(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda x: F.split(_shape(x), r"[^\p{L}\p{M}\p{N}]+")))


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL; empty where it has no ://."""
    h, p, rest = host(url), path(url), _rest(url)
    label = F.split(h, r"\.")
    n = F.size(label)
    part = F.filter(F.split(p, "/"), lambda x: x != "")
    pair = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "[&;]")
    value = F.transform(pair, lambda x: F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(F.lit("")))
    fragment = F.array(F.regexp_extract(rest, r"#([\s\S]*)$", 1))
    made = [
        F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)),
        F.concat(F.lit("top="), F.try_element_at(label, F.lit(-1))),
        F.when(n >= 2, F.concat(F.lit("domain="), F.concat_ws(".", F.slice(label, -2, 2)))),
        F.when(n >= 3, F.concat(F.lit("name="), F.try_element_at(label, F.lit(-3)))),
        F.when(n >= 4, F.concat(F.lit("sub="), label[0])),
        F.concat(F.lit("first="), _shape(F.try_element_at(part, F.lit(1)))),
        F.concat(F.lit("second="), _shape(F.try_element_at(part, F.lit(2)))),
        F.when(p.rlike(r"\.[A-Za-z]{1,5}$"), F.concat(F.lit("ending="), F.lower(F.substring_index(p, ".", -1)))),
        F.when(F.instr(rest, "?") > 0, F.lit("has=query")),
        F.when(F.instr(rest, "#") > 0, F.lit("has=fragment")),
    ]
    every = [
        _each("host", F.transform(label, _shape)), _each("hostword", _words(label)),
        _each("part", F.transform(part, _shape)), _each("word", _words(part)),
        _each("key", F.transform(pair, lambda x: _shape(F.substring_index(x, "=", 1)))), _each("query", F.transform(pair, _shape)), _each("queryword", _words(value)),
        _each("fragment", F.transform(fragment, _shape)), _each("fragmentword", _words(fragment)),
    ]
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*made)), *every)))).otherwise(F.array().cast("array<string>"))


def classes(known: DataFrame, n: int, least: int, lift: float) -> DataFrame:
    """(item, token): the tokens that a rule can hold, each with the one that stands for all of the same baskets.  known: b, t, bad."""
    spread = known.select("b", "bad", F.explode("t").alias("item"))
    held = spread.groupBy("item").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor(F.xxhash64("b")).alias("x"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("y"))
    useful = held.where((F.col("bad") >= least) & ((F.col("n") < n) | F.lit(lift <= 1)))
    return useful.groupBy("n", "x", "y").agg(F.min("item").alias("token"), F.collect_list("item").alias("items")).select(F.explode("items").alias("item"), "token")


def mine(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, least_rows: int = LEAST_ROWS, confidence: float = CONFIDENCE, lift: float = LIFT) -> tuple[DataFrame, DataFrame]:
    """(items, key, confidence, support): the rules, each with its rarest token as key; and the classes of their tokens.  urls: id, url; labels: id, bad."""
    one = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    known = cut(urls.join(one, "id").select(tokens(F.col("url")).alias("t"), "bad").where(F.size("t") > 0).select(F.monotonically_increasing_id().alias("b"), "t", "bad"))
    spark = urls.sparkSession
    n = known.count()
    if n < least_rows:
        return spark.createDataFrame([], "items array<string>, key string, confidence double, support double"), spark.createDataFrame([], "item string, token string")
    least = min(1.0, max(support, least_rows / n))
    stand = cut(classes(known, n, math.ceil(least * n), lift))
    spread = known.select("b", "bad", F.explode("t").alias("item")).join(F.broadcast(stand), "item", "left")  # tokens of a basket / support rows at most
    baskets = spread.groupBy("b").agg(F.concat(F.collect_set("token"), F.when(F.first("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= lift)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    # A rule goes if one with fewer tokens is as confident.
    shorter = found.select(F.col("items").alias("s"), F.col("confidence").alias("c"))
    implied = found.join(shorter, (F.size("s") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("s", "items")) == 0) & F.arrays_overlap("s", "items"), "left_anti") if found.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else found
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    parts = implied.select("*", F.explode("items").alias("item")).join(single, "item")
    rules = cut(parts.groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("key"), F.first("confidence").alias("confidence"), F.first("support").alias("support")))
    return rules, stand.join(rules.select(F.explode("items").alias("token")).distinct(), "token")


def matched(sets: DataFrame, rules: DataFrame, stand: DataFrame) -> DataFrame:
    """(tokens, confidence, mined): for each token set that holds a rule, its most confident one, in tokens of the set."""
    index = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    spread = sets.select("tokens", F.explode("tokens").alias("item")).join(F.broadcast(stand), "item")
    held = spread.groupBy("tokens").agg(F.collect_list(F.struct("token", "item")).alias("own"))
    keyed = held.select("tokens", "own", F.explode(F.array_distinct("own.token")).alias("key"))
    hits = keyed.join(index, "key").where(F.size(F.array_except("items", "own.token")) == 0)
    names = F.array_sort(F.transform("items", lambda t: F.array_min(F.filter("own", lambda o: o.token == t)).item))
    best = F.max(F.struct("confidence", F.array_join(names, " ").alias("mined")))
    return hits.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.confidence", "b.mined")


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[HostRule, ...] = HOST_RULES, **options) -> DataFrame:
    """id, host, path, rule, verdict, mined and confidence of every row of pages; labels: doc_id, quality, toxic."""
    base = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"))
    bad = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    found, stand = mine(base, bad, **options)
    read = base.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    hits = matched(read.select("tokens").distinct(), found, stand)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return read.join(hits, "tokens", "left").select("id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined", "confidence")


def allowed(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """The ids of pages that are not blocked."""
    return judge(pages, labels, page_id, url, **options).where("verdict = 'allow'").select("id")
