"""Monitor model keys and the catalogue that fills what names do not say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import extract, let, replace

UNLABELLED = "未標示"
FACETS = ("panel", "refreshTier", "resolution")
LEAST_PREFIX, LEAST_CONFIDENCE = 6, 0.8

# Shapes of model numbers, in the order in which they are tried: (pattern, group, least length).
MODEL_SHAPES = (
    (r"\b(S\d{2}[A-Z]{1,3}\d{2,4}[A-Z0-9]*)\b", 1, 0),
    (r"\b(AW\d{4}[A-Z0-9]*)\b", 1, 0),
    (r"\b(?:MAG|MPG|XG|PG|VG|XV|PA|SW|CS|PD|FO|MO|GO|EV|MP|MD|LC|GW|BL|EK|KA|VA|VX|VS|VP|VY|VZ|SA|SB|KG|ED|CB|XL|EX|NS|PH|SE|HC|AW|Q)\s*[-]?\s*(\d{2,4}[A-Z0-9.-]{0,16})\b", 0, 5),
    (r"\b([A-Z](?:\d{2,4}[A-Z][A-Z0-9-]{0,14}))\b", 1, 5),
    (r"\b(\d{2}[A-Z]\d{2,4}[A-Z0-9]*)\b", 1, 5),
    (r"\b(\d{2}[A-Z]\d{3,4}[A-Z0-9-]*)\b", 1, 6),
)
#: What is scrubbed before a model number is looked for.
SCRUBBED = (r"【[^】]*】", r"〈[^〉]*〉", r"\([^)]*\)", r"<[^>]+>", r"\$[\d,]+", ",")


def monitor_model_key(raw: Column) -> Column:
    """A model number as lower-case letters and digits, 32 at most; null where a name holds none."""
    clean = raw
    for p in SCRUBBED:
        clean = replace(clean, p)

    def found(s: Column) -> Column:
        tries = []
        for k, (p, group, least) in enumerate(MODEL_SHAPES):
            hit = extract(s, p, group)
            # The third shape counts letters and digits alone.
            size = F.length(F.regexp_replace(hit, "[^A-Za-z0-9]", "")) if k == 2 else F.length(hit)
            tries.append(F.when(size >= least, hit))
        return F.substring(F.regexp_replace(F.lower(F.coalesce(*tries)), "[^a-z0-9]+", ""), 1, 32)

    return let(clean, found)


def lookup_catalogue(df: DataFrame, catalogue: DataFrame, key: str = "model_key") -> DataFrame:
    """df with catalogue_key: the entry of its model key, null where there is none that can be trusted.

    In order: the key itself; the key without a white suffix; the longest
    entry key that begins the key; the shortest entry key that the key begins
    (of equally short ones the first in order).  Entries below
    LEAST_CONFIDENCE are passed over, but a prefix search ends with the entry
    it has chosen, trusted or not.  Prefixes are joined by equality: the keys'
    own for one search, the entries' for the other.
    """
    entry = catalogue.select(F.col("model_key").alias("e"), (F.coalesce("confidence", F.lit(1.0)) >= LEAST_CONFIDENCE).alias("ok")).where("e is not null").dropDuplicates(["e"])
    keys = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    stripped = F.regexp_replace(F.regexp_replace("k", "(?i)-?w(hite)?$", ""), "w$", "")
    trusted = entry.where("ok").select("e")
    exact = keys.join(trusted, F.col("k") == F.col("e")).select("k", F.lit(0).alias("tier"), "e", F.lit(True).alias("ok"))
    white = keys.withColumn("s", stripped).where("s <> k").join(trusted, F.col("s") == F.col("e")).select("k", F.lit(1).alias("tier"), "e", F.lit(True).alias("ok"))
    prefixes = lambda c: F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    long = F.length("k") >= LEAST_PREFIX
    begins = keys.where(long).select("k", F.explode(prefixes(F.col("k"))).alias("p")).join(entry, F.col("p") == F.col("e"))
    begins = begins.groupBy("k").agg(F.max_by(F.struct("e", "ok"), F.length("e")).alias("b")).select("k", F.lit(2).alias("tier"), "b.e", "b.ok")
    extended = entry.where(F.length("e") >= LEAST_PREFIX).select("e", "ok", F.explode(prefixes(F.col("e"))).alias("p")).join(keys.where(long), F.col("p") == F.col("k"))
    extended = extended.groupBy("k").agg(F.min(F.struct(F.length("e").alias("n"), "e", "ok")).alias("b")).select("k", F.lit(3).alias("tier"), "b.e", "b.ok")
    all_ = exact.union(white).union(begins).union(extended)
    first = all_.groupBy("k").agg(F.min(F.struct("tier", "e", "ok")).alias("f")).select(F.col("k").alias(key), F.when(F.col("f.ok"), F.col("f.e")).alias("catalogue_key"))
    return df.join(first, key, "left")


def fill_unlabelled(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """df (specs, catalogue_key) with facets from the catalogue where specs say nothing."""
    named = catalogue.select(F.col("model_key").alias("catalogue_key"), *[F.col(f).alias(f"__{f}") for f in FACETS]).dropDuplicates(["catalogue_key"])
    joined = df.join(named, "catalogue_key", "left")
    said = lambda f: F.nullif(F.try_element_at("specs", F.lit(f)), F.lit(UNLABELLED))
    new = F.create_map(*[x for f in FACETS for x in (F.lit(f), F.coalesce(said(f), F.nullif(F.col(f"__{f}"), F.lit(UNLABELLED)), F.try_element_at("specs", F.lit(f))))])
    kept = F.map_filter("specs", lambda k, _: ~k.isin(*FACETS))
    return joined.withColumn("specs", F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))).drop(*[f"__{f}" for f in FACETS])


def catalogue_gaps(df: DataFrame, catalogue: DataFrame, n: int = 80) -> DataFrame:
    """Model keys of listings without a labelled resolution: count, a sample name, brand, and whether the catalogue has them; the n most frequent."""
    open_ = df.where(F.coalesce(F.try_element_at("specs", F.lit("resolution")), F.lit(UNLABELLED)) == UNLABELLED).where("model_key is not null")
    counted = open_.groupBy("model_key").agg(F.count("*").alias("n"), F.min(F.struct("raw_name", "brand")).alias("s"))
    known = catalogue.select("model_key", F.lit(True).alias("known")).distinct()
    return counted.join(known, "model_key", "left").select("model_key", "n", F.substring("s.raw_name", 1, 90).alias("sample"), F.col("s.brand").alias("brand"), F.coalesce("known", F.lit(False)).alias("in_catalogue")).orderBy(F.desc("n"), "model_key").limit(n)
