"""Maintaining the listing table batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions import detect, gear, parts, storage
from offerloom.functions import rules as R
from offerloom.functions.facets import finalize_specs
from offerloom.functions.names import choose_brand, clean_name, extract_brand, extract_cpu_model
from offerloom.operators.graph import cut
from offerloom.operators.once import once, package_reason

#: Bundle reasons of complete systems of parts.
COMPLETE = ("prebuilt-os", "slash-build", "complete-spec", "ai-workstation")
#: First level of the path of a part that is sold under a condition.
OFFERED = "搭購價單品"
PART_PATHS = {"cpu": parts.cpu_path, "motherboard": parts.motherboard_path, "gpu": parts.gpu_path, "ram": storage.ram_path, "ssd": storage.ssd_path, "hdd": storage.hdd_path, "psu": storage.psu_path, **gear.PATHS}


def free_name(df: DataFrame, like: str) -> str:
    while like in df.columns:
        like += "_"
    return like


def price_condition(c: Column) -> Column:
    """The condition under which a price holds, by the first kind of words found."""
    # Words of each condition, in order.
    words = (
        ("限組裝", ("限組裝", "限整機")), ("組裝價", ("組裝價",)), ("搭板價", ("搭板", "搭版", "任搭主機板", "任搭板", "任搭CPU", "板U價", "搭機價")),
        ("搭購價", ("搭購價", "搭購優惠", "套裝搭購", "U版專案")), ("加購價", ("加購優惠", "限加購", "加購價")),
    )
    return F.coalesce(*[F.when(c.rlike("|".join(w)), label) for label, w in words])


def normalize_listings(df: DataFrame) -> DataFrame:
    """name, brand and model from raw_name; a model that is there already stays."""

    def find(titles: DataFrame) -> DataFrame:
        named = titles.withColumn("name", clean_name(F.col("raw_name"), F.col("category")))
        found = named.withColumn("__brand", extract_brand(F.col("name")))
        return found.withColumns({"brand": choose_brand(F.col("brand"), F.col("__brand"), F.col("category")), "model": F.coalesce("model", extract_cpu_model(F.col("name")))})

    return once(df, ("raw_name", "category", "brand", "model"), find, ("name", "brand", "model"))


def drop_junk_prices(df: DataFrame, least: int = R.MIN_PRICE) -> DataFrame:
    return df.where(F.col("price") >= least)


def retain_listings(df: DataFrame, retained: tuple[str, ...] = R.RETAINED) -> DataFrame:
    """Listings of retained categories; packages only with a bundle reason or a price condition."""
    if "bundle_reason" not in df.columns:
        return retain_listings(package_reason(df), retained).drop("bundle_reason")
    bundle = F.col("bundle_reason").isNotNull()
    return df.where(F.col("category").isin(*retained) & ((F.col("category") != "package") | bundle | price_condition(F.col("raw_name")).isNotNull()))


def with_price_condition(df: DataFrame) -> DataFrame:
    """df with the price condition that raw_name states in specs; one that is there already stays where it states none."""
    found = price_condition(F.col("raw_name"))
    named = F.create_map(F.lit("priceCondition"), found)
    if "specs" not in df.columns:
        return df.withColumn("specs", F.when(found.isNotNull(), named))
    kept = F.map_filter("specs", lambda k, _: k != "priceCondition")
    return df.withColumn("specs", F.when(found.isNull(), F.col("specs")).when(F.col("specs").isNull(), named).otherwise(F.map_concat(kept, named)))


def part_path(category: Column, raw: Column, brand: Column | None = None) -> Column:
    """The path of a part in its category, null for categories without one; a brand found before saves looking again."""
    found = lambda c, path: path(raw, brand) if c in gear.BRANDED else path(raw)
    return F.coalesce(*[F.when(category == c, found(c, path)) for c, path in PART_PATHS.items()])


def categorize_listings(df: DataFrame, paths: bool = True) -> DataFrame:
    """df with category, subcategory and bundle_reason from raw_name, and facets and the price condition in specs.

    Complete systems and bundles are packages.  A category is found anew where
    it is not kept, is package, or where the title says otherwise.  A part
    with a price condition is a package too, with the label of its category
    and the condition as its path; other packages have that of package_path.
    """
    made = ("category", "bundle_reason", "subcategory") if paths else ("category", "bundle_reason")
    return with_price_condition(finalize_specs(once(df, ("raw_name", "category"), lambda titles: _judged(titles, paths), made)))


def _judged(df: DataFrame, paths: bool) -> DataFrame:
    t = detect.Titles("exempt", "laptop_like", *[r for _, r in detect.BUNDLE + detect.CATEGORY + detect.DOUBT], into=free_name(df, "seen"))
    read, c = t.see(df, F.col("raw_name")), F.col("category")
    doubtful = F.coalesce(~c.isin(*R.RETAINED) | (c == "package") | F.coalesce(*[F.when(c == k, t.holds(r)) for k, r in detect.DOUBT], F.lit(False)), F.lit(True))
    own, said, maker = free_name(read, "found"), free_name(read, "condition"), free_name(read, "maker")
    read = read.withColumns({maker: extract_brand(F.col("raw_name")), "bundle_reason": t.bundle_reason(), own: F.when(doubtful, t.category()).otherwise(c), said: price_condition(F.col("raw_name"))})
    offer = F.col(said).isNotNull() & (F.col(own) != "other")
    label = F.create_map(*[F.lit(x) for k, (name, _) in R.CATEGORIES.items() for x in (k, name)])
    steps = {"category": F.when(F.col("bundle_reason").isNotNull() | offer, "package").otherwise(F.col(own))}
    if paths:
        in_package = F.when(offer, F.concat_ws(" > ", F.lit(OFFERED), F.try_element_at(label, F.col(own)), F.col(said)))
        raw, complete = F.col("raw_name"), F.greatest(*[t.holds(f"bundle:{r}") for r in COMPLETE])
        bundled = gear.package_path(raw, detect.neutral_plus(raw), t.holds("bundle:server-workstation"), t.holds("laptop_like"), complete)
        in_package = F.when(F.col("bundle_reason").isNull() & offer, in_package).otherwise(bundled)
        steps["subcategory"] = F.when(steps["category"] == "package", in_package).otherwise(part_path(F.col(own), raw, F.col(maker)))
    return read.withColumns(steps)


def process_batch(df: DataFrame) -> DataFrame:
    """N10, C2, F6 and F7: names, categories, prices, retention."""
    return retain_listings(drop_junk_prices(cut(categorize_listings(normalize_listings(df)))))


def upsert(current: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(products, history rows) after a batch; of several rows for an id in the batch the newest counts.

    One join by id gives both: ids of the batch take its fields but keep their
    group, new ids get a group of their own, and a price that is new or
    differs is a row of history.
    """
    newest = batch.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("scraped_at"), "price"))).where("__r = 1").drop("__r")
    old = current.select(*[F.col(c).alias(f"old_{c}") for c in current.columns])
    both = newest.join(old, newest["id"] == old["old_id"], "full_outer")
    fresh = F.col("id").isNotNull()
    fields = []
    for c in current.columns:
        if c == "match_group_id":
            value = F.coalesce("old_match_group_id", F.concat(F.lit("mg-"), F.col("id")))
        elif c == "updated_at":
            value = F.when(fresh, now).otherwise(F.col("old_updated_at"))
        elif c in batch.columns:
            value = F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}"))
        else:
            value = F.col(f"old_{c}")
        fields.append(value.alias(c))
    changed = both.where(fresh & ~F.col("price").eqNullSafe(F.col("old_price")))
    return both.select(*fields), changed.select(F.col("id").alias("product_id"), "price", now.alias("recorded_at"))


def remove_stale(products: DataFrame, history: DataFrame, source: str, batch_time: Column) -> tuple[DataFrame, DataFrame]:
    """Products without those of the source that a batch did not refresh, and the history of what is left."""
    left = products.where((F.col("source") != source) | (F.col("scraped_at") >= batch_time))
    return left, history.join(left.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def remove_all_stale(products: DataFrame, history: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """remove_stale for every source of a batch at once: by one join on the newest time that the batch has for each."""
    newest = batch.groupBy(F.col("source").alias("of")).agg(F.max("scraped_at").alias("newest"))
    dated = products.join(newest, F.col("source") == F.col("of"), "left")
    left = dated.where(F.col("newest").isNull() | (F.col("scraped_at") >= F.col("newest"))).drop("of", "newest")
    return left, history.join(left.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def drop_source(products: DataFrame, source: str) -> DataFrame:
    return products.where(F.col("source") != source)


#: Fields by which rebuild tells whether a row changed.
COMPARED = ("name", "brand", "model", "category", "subcategory", "specs")


def rebuild(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products after cleaning anew, and one row with the number of rows that changed or went."""
    again = process_batch(products)
    is_map = lambda c: products.schema[c].dataType.simpleString().startswith("map")
    columns = [F.array_sort(F.map_entries(c)).alias(c) if is_map(c) else F.col(c) for c in COMPARED if c in products.columns]
    state = lambda df, name: df.select("id", F.struct(*columns).alias(name))
    both = state(products, "before").join(state(again, "after"), "id", "left")
    return again, both.agg(F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
