"""Listings from JSON feeds, listing ids, and the union of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a feed wraps its items, and item fields in order of preference.
WRAPPERS = ("data", "products", "items")
NAME_FIELDS, PRICE_FIELDS = ("name", "prod_name", "title"), ("price", "prod_price", "sale_price")
SPEC_FIELDS = ("spec", "specs", "description", "barcode", "prod_no")


def explode_json_feed(df: DataFrame, json: str = "json") -> DataFrame:
    """df with feed_key and item (a variant), a row for each item object.

    The text may be an array of items, an object with an array under one of
    WRAPPERS (the first found), or an object of arrays by category.
    """
    text = F.trim(F.col(json))
    whole = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<variant>"))
    by_key = F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,variant>"))
    array_of = lambda v: F.try_variant_get(v, "$", "array<variant>")
    wrapped = F.coalesce(*[array_of(F.try_element_at(by_key, F.lit(w))) for w in WRAPPERS])
    no_key = F.lit(None).cast("string")
    plain = F.transform(F.coalesce(whole, wrapped), lambda x: F.struct(no_key.alias("feed_key"), x.alias("item")))
    keyed = F.flatten(F.transform(F.map_entries(by_key), lambda e: F.coalesce(F.transform(array_of(e["value"]), lambda x: F.struct(e["key"].alias("feed_key"), x.alias("item"))), F.array().cast("array<struct<feed_key:string,item:variant>>"))))
    rows = df.withColumn("__i", F.explode(F.coalesce(plain, keyed)))
    return rows.select(*df.columns, F.col("__i.feed_key").alias("feed_key"), F.col("__i.item").alias("item")).where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def _text(item: Column, field: str) -> Column:
    return F.nullif(F.try_variant_get(item, f"$.{field}", "string"), F.lit(""))


def feed_to_listings(items: DataFrame, categories: dict[str, str] | None = None, url_prefix: str = "") -> DataFrame:
    """name, price, in_stock, brand, model, source_url, category_id and specs of feed items; those without name or price go."""
    item = F.col("item")
    name = F.trim(F.coalesce(*[_text(item, f) for f in NAME_FIELDS]))
    price = F.coalesce(*[F.regexp_replace(F.regexp_replace(_text(item, f), r"\.0+$", ""), "[^0-9]", "").try_cast("long") for f in PRICE_FIELDS])
    sold = (F.lower(_text(item, "in_stock")) == "false") | (_text(item, "stock") == "0") | (_text(item, "status") == "out_of_stock")
    specs = F.map_filter(F.create_map(*[x for f in SPEC_FIELDS for x in (F.lit(f), F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{f}", "variant")) == "STRING", _text(item, f)))]), lambda _, v: v.isNotNull())
    url = _text(item, "url")
    out = items.select(
        *[c for c in items.columns if c != "item"], name.alias("name"), price.alias("price"), F.coalesce(~sold, F.lit(True)).alias("in_stock"),
        _text(item, "brand").alias("brand"), _text(item, "model").alias("model"), F.when(url.startswith("/"), F.concat(F.lit(url_prefix), url)).otherwise(url).alias("source_url"),
        _text(item, "diy_id").alias("category_id"), specs.alias("specs"),
    )
    if categories:
        table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
        out = out.withColumn("category", F.try_element_at(table, F.col("category_id")))
    return out.where("name <> '' and price > 0")


def grouped_feed_to_listings(df: DataFrame, json: str = "json", categories: dict[str, str] | None = None, group: str = "group_id") -> DataFrame:
    """prod_id, name, price and price_change of feeds that answer by group with ErrCode 1; other answers give no rows."""
    shape = "ErrCode int, ErrMessage string, ProductsData array<struct<ProdId:string,ProdName:string,Price:string,IsNew:int>>"
    answer = df.withColumn("__a", F.from_json(json, shape)).where("__a.ErrCode = 1").withColumn("__p", F.explode("__a.ProductsData"))
    price = F.regexp_extract("__p.Price", r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    out = answer.select(*[c for c in df.columns if c != json], F.col("__p.ProdId").alias("prod_id"), F.trim(F.regexp_replace("__p.ProdName", r"[☆★][0-9,]*元?\s*$", "")).alias("name"), price.alias("price"), F.when(F.col("__p.IsNew") == 1, "new").alias("price_change"))
    if categories:
        table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
        out = out.withColumn("category", F.coalesce(F.try_element_at(table, F.col(group).cast("string")), F.lit("other")))
    return out.where("prod_id <> '' and name <> '' and price > 0")


def listing_id(source: Column, *values: Column) -> Column:
    """source- and the first 12 digits of the MD5 of the values joined by hyphens."""
    return F.concat(source, F.lit("-"), F.substring(F.md5(F.concat_ws("-", *[v.cast("string") for v in values])), 1, 12))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_run_log(logs: DataFrame, source: str, status: str, items: int, duration_ms: int, error: str | None, at: Column) -> DataFrame:
    """logs and one more run."""
    row = logs.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(status).alias("status"), F.lit(items).cast("int").alias("items_count"), F.lit(duration_ms).cast("long").alias("duration_ms"), F.lit(error).cast("string").alias("error_message"), at.alias("created_at"))
    return logs.unionByName(row)
