"""Filtered, sorted and paged views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT, DEFAULT_LIMIT = 200, 50


@dataclass(frozen=True)
class Filters:
    """Conditions of a view; those left at None do not apply."""

    source: str | None = None
    category: str | None = None
    brand: str | None = None
    subcategory: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    in_stock: bool | None = None
    search: str | None = None
    has_multiple_sources: bool | None = None
    facets: dict[str, str] = field(default_factory=dict)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _common(f: Filters) -> list[Column]:
    out = [F.col(c) == v for c, v in (("category", f.category), ("brand", f.brand)) if v is not None]
    if f.subcategory is not None:
        out.append((F.col("subcategory") == f.subcategory) | F.col("subcategory").startswith(f.subcategory + " > "))
    return out


def _search(text: str, *columns: str) -> Column:
    """Does any of the columns hold the text, whatever the case?  % and _ in the text are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def filter_listings(df: DataFrame, f: Filters) -> DataFrame:
    c = _common(f)
    if f.source is not None:
        c.append(F.col("source") == f.source)
    if f.min_price is not None:
        c.append(F.col("price") >= f.min_price)
    if f.max_price is not None:
        c.append(F.col("price") <= f.max_price)
    if f.in_stock is not None:
        c.append(F.col("in_stock") == f.in_stock)
    if f.search:
        c.append(_search(f.search, "name", "brand", "raw_name"))
    c += [F.try_element_at("specs", F.lit(k)) == v for k, v in f.facets.items()]
    return df.where(_all(c))


def filter_groups(groups: DataFrame, listings: DataFrame, f: Filters) -> DataFrame:
    """The same over groups: prices bound the lowest price; source, stock and each facet ask for some member that has it."""
    c = _common(f)
    if f.min_price is not None:
        c.append(F.col("lowest_price") >= f.min_price)
    if f.max_price is not None:
        c.append(F.col("lowest_price") <= f.max_price)
    if f.has_multiple_sources is not None:
        c.append(F.col("has_multiple_sources") == int(f.has_multiple_sources))
    if f.search:
        c.append(_search(f.search, "name", "brand"))
    out = groups.where(_all(c))
    asked = [] if f.source is None else [F.col("source") == f.source]
    asked += [] if f.in_stock is None else [F.col("in_stock") == f.in_stock]
    asked += [F.try_element_at("specs", F.lit(k)) == v for k, v in f.facets.items()]
    if not asked:
        return out
    # One pass over the members: a flag for each condition, any of them per group.
    flags = listings.groupBy(F.col("match_group_id").alias("id")).agg(*[F.max(F.coalesce(x, F.lit(False))).alias(f"f{k}") for k, x in enumerate(asked)])
    return out.join(flags.where(_all([F.col(f"f{k}") for k in range(len(asked))])).select("id"), "id", "left_semi")


def _page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    page, limit = max(1, page), min(max(1, limit), MAX_LIMIT)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_listings(df: DataFrame, sort: str = "updated", page: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
    orders = {"price_asc": [F.asc("price")], "price_desc": [F.desc("price")], "name": [F.asc("name")]}
    return _page(df, [*orders.get(sort, [F.desc("updated_at")]), F.asc("id")], page, limit)


def page_groups(groups: DataFrame, sort: str = "default", page: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
    orders = {"price_asc": [F.asc("lowest_price")], "price_desc": [F.desc("highest_price")], "name": [F.asc("name")]}
    return _page(groups, [*orders.get(sort, [F.desc("has_multiple_sources"), F.desc("updated_at")]), F.asc("id")], page, limit)


def total(df: DataFrame) -> DataFrame:
    """One row with the number of all rows of which a page shows some."""
    return df.agg(F.count("*").alias("total"))


def groups_with_members(groups: DataFrame, listings: DataFrame) -> DataFrame:
    """Each group with its members, cheapest first; groups without members are left out."""
    member = F.struct("price", "id", "source", "name")
    members = listings.join(groups.select(F.col("id").alias("match_group_id")), "match_group_id", "left_semi").groupBy(F.col("match_group_id").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return groups.join(members, "id")
