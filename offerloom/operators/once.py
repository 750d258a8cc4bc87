"""Costly work on titles, done once for each distinct title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions import detect
from offerloom.operators.graph import cut
from offerloom.sources.tables import spread


def once(df: DataFrame, by: tuple[str, ...], find: Callable[[DataFrame], DataFrame], made: tuple[str, ...]) -> DataFrame:
    """df with the columns `made`, which find adds to (or replaces in) rows that hold the columns `by` alone.

    Offers of several runs and shops repeat their titles, and hundreds of
    regular expressions cost far more than a row's way through a join: find
    sees each distinct combination of `by` once, nulls included.
    """
    own = {c: _free(df, f"by_{c}") for c in by}
    seen = spread(df.select(*by).distinct(), *by)
    found = find(seen.select(*by, *[F.col(c).alias(k) for c, k in own.items()]))
    new = {c: _free(df, f"made_{c}") for c in made}
    found = cut(found.select(*own.values(), *[F.col(c).alias(k) for c, k in new.items()]))
    same = [df[c].eqNullSafe(found[k]) for c, k in own.items()]
    joined = df.join(found, same, "left")
    return joined.select(*[F.col(new.get(c, c)).alias(c) for c in df.columns], *[F.col(k).alias(c) for c, k in new.items() if c not in df.columns])


def package_reason(df: DataFrame) -> DataFrame:
    """df with the bundle_reason of packages; null for other categories, whose titles nobody asks about."""
    title = _free(df, "package_title")
    asked = df.withColumn(title, F.when(F.col("category") == "package", F.col("raw_name")))
    return once(asked, (title,), lambda t: detect.bundle_reason(t, title), ("bundle_reason",)).drop(title)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
