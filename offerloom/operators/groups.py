"""One row for each linked product, and counts over those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions import rules as R
from offerloom.functions.order import subcategory_sort_key
from offerloom.functions.text import SEPARATOR

#: (column, aggregate) of a group that is the largest of its members'.
_MAXIMA = ("brand", "model", "category", "subcategory", "updated_at")


def build_match_groups(listings: DataFrame) -> DataFrame:
    """id, name, the maxima, lowest_price, highest_price (of the sources' lowest prices) and has_multiple_sources.

    One shuffle: rows are dealt by group, and both aggregations follow that.
    """
    columns = [c for c in _MAXIMA if c in listings.columns]
    dealt = listings.repartition("match_group_id")
    per_source = dealt.groupBy("match_group_id", "source").agg(F.min("price").alias("low"), F.min(F.struct(F.length("name").alias("n"), F.col("name").alias("name"))).alias("short"), *[F.max(c).alias(c) for c in columns])
    return per_source.groupBy(F.col("match_group_id").alias("id")).agg(
        F.min("short")["name"].alias("name"), *[F.max(c).alias(c) for c in columns],
        F.min("low").alias("lowest_price"), F.max("low").alias("highest_price"), (F.count("*") > 1).cast("int").alias("has_multiple_sources"),
    )


def refresh_match_groups(stored: DataFrame, listings: DataFrame, touched: DataFrame) -> DataFrame:
    """build_match_groups(listings), from its stored result and the groups that changed since.

    stored: the groups as they were; listings: all listings as they are;
    touched: match_group_id of every listing that came, went or changed, once
    for each group that it was or is in (repeated rows and null ids do no
    harm).  Only members of those groups are aggregated; a group without
    members is gone.  The ids of the touched groups are what is joined, so the
    work beside one scan of each table follows the change.
    """
    ids = touched.select("match_group_id").distinct()
    again = build_match_groups(listings.join(ids, listings["match_group_id"].eqNullSafe(ids["match_group_id"]), "left_semi"))
    same = stored.join(ids, stored["id"].eqNullSafe(ids["match_group_id"]), "left_anti")
    return same.unionByName(again)


def group_records(listings: DataFrame) -> DataFrame:
    """Lowest and highest price over all members, their difference, member count and the first shortest name."""
    return listings.groupBy(F.col("match_group_id").alias("id")).agg(
        F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), (F.max("price") - F.min("price")).alias("price_diff"),
        F.count("*").alias("members"), F.min(F.struct(F.length("name"), "id", "name"))["name"].alias("name"),
    )


def category_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def group_count(groups: DataFrame, category: str | None = None) -> DataFrame:
    return (groups.where(F.col("category") == category) if category else groups).agg(F.count("*").alias("n"))


def subcategory_counts(groups: DataFrame, category: str) -> DataFrame:
    return groups.where((F.col("category") == category) & (F.col("subcategory") != "")).groupBy("subcategory").agg(F.count("*").alias("n"))


def ordered_subcategories(groups: DataFrame) -> DataFrame:
    """Groups at each path of each category, and the place of the path in the order in which its category shows them."""
    counts = groups.where(F.col("subcategory") != "").groupBy("category", "subcategory").agg(F.count("*").alias("n"))
    shown = Window.partitionBy("category").orderBy(subcategory_sort_key(F.col("category"), F.col("subcategory")))
    return counts.withColumn("position", F.row_number().over(shown))


def subcategory_tree(groups: DataFrame, category: str | None = None) -> DataFrame:
    """node, depth, own and total: the groups at every prefix of a path, and at it or below."""
    one = groups.where(F.col("subcategory") != "")
    if category:
        one = one.where(F.col("category") == category)
    paths = one.groupBy("category", "subcategory").agg(F.count("*").alias("n"))
    levels = F.split("subcategory", SEPARATOR)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(levels, F.lit(1), k), SEPARATOR).alias("node"), (k == F.size(levels)).alias("leaf")))
    each = paths.select("category", "n", F.explode(prefixes).alias("p"))
    return each.groupBy("category", F.col("p.node").alias("node"), F.col("p.depth").alias("depth")).agg(F.sum(F.when(F.col("p.leaf"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("total"))


def brand_counts(groups: DataFrame, category: str | None = None, subcategory: str | None = None) -> DataFrame:
    out = groups.where(F.col("brand") != "")
    for column, value in (("category", category), ("subcategory", subcategory)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand")


def cross_store_rate(groups: DataFrame, n: int = 15) -> DataFrame:
    """For each category the groups with several sources, all groups and their rate in percent; the n largest."""
    multi = F.sum("has_multiple_sources")
    rate = groups.groupBy("category").agg(multi.cast("long").alias("multi"), F.count("*").alias("total"), F.round(100.0 * multi / F.count("*"), 1).alias("rate"))
    return rate.where("multi > 0").orderBy(F.desc("multi"), "category").limit(n)


def distribution(listings: DataFrame, category: str | None = None, n: int = 15) -> DataFrame:
    """Rows for each category, or the n most frequent subcategories of one."""
    if category is None:
        return listings.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("n"))
    one = listings.where(F.col("category") == category)
    return one.groupBy(F.col("subcategory").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def comparison_cards(groups: DataFrame, listings: DataFrame, sources: list[str]) -> DataFrame:
    """For each group the lowest price in every source, lowest and highest of those, the saving and the number of sources."""
    low = listings.select(F.col("match_group_id").alias("id"), "source", "price").join(groups.select("id", "name"), "id")
    wide = low.groupBy("id", "name").agg(*[F.min(F.when(F.col("source") == s, F.col("price"))).alias(f"price_{s}") for s in sources], F.count_distinct("source").alias("n_sources"))
    prices = [F.col(f"price_{s}") for s in sources]
    lowest, highest = (F.least(*prices), F.greatest(*prices)) if len(prices) > 1 else (prices[0], prices[0])
    return wide.withColumns({"lowest": lowest, "highest": highest, "saving": highest - lowest})


def health_summary(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows for each source, and the numbers of all listings and groups beside them."""
    counts = listings.groupBy("source").agg(F.count("*").alias("products"))
    totals = listings.agg(F.count("*").alias("total_products")).crossJoin(groups.agg(F.count("*").alias("total_groups")))  # one row by one row
    return counts.join(F.broadcast(totals))


def with_category_meta(df: DataFrame) -> DataFrame:
    """df with label and display order of its category; an unknown category keeps its name and comes last but one."""
    spark = df.sparkSession
    table = spark.createDataFrame([(c, label, order) for c, (label, order) in R.CATEGORIES.items()], "category string, label string, display_order int")
    joined = df.join(F.broadcast(table), "category", "left")
    return joined.withColumns({"label": F.coalesce("label", "category"), "display_order": F.coalesce("display_order", F.lit(R.UNKNOWN_ORDER))})


def singletons_with_twin(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """Listings alone in their group although another source has the same brand, model and category in another group."""
    single = groups.where("has_multiple_sources = 0").select(F.col("id").alias("match_group_id"))
    key = ["category", "brand", "model"]
    known = listings.where("brand <> '' and model <> ''")
    mine = known.join(single, "match_group_id", "left_semi")
    other = known.select(*key, F.col("source").alias("source_b"), F.col("match_group_id").alias("group_b")).distinct()
    return mine.alias("m").join(other.alias("o"), [F.col(f"m.{c}") == F.col(f"o.{c}") for c in key] + [F.col("source") != F.col("source_b"), F.col("match_group_id") != F.col("group_b")], "left_semi").select("id", "source", *key)
