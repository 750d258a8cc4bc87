"""Regular expressions that mean the same on every engine, rule tables and category paths as Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: ASCII, no-break, ideographic and the other Unicode spaces.
SPACE = r"\s   -     　﻿"
#: An edge between ASCII word characters and anything else; Java's \b takes CJK letters for word characters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SEPARATOR = " > "


def pattern(text: str, ignore_case: bool = False) -> str:
    r"""A pattern with ASCII \b and wide \s (inside and outside of brackets) for Spark."""
    out, inside, i = [], False, 0
    while i < len(text):
        two = text[i : i + 2]
        if two == r"\b" and not inside:
            out.append(EDGE)
            i += 2
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif text[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = text[i] == "[" or (inside and text[i] != "]")
            out.append(text[i])
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def has(c: Column, text: str, ignore_case: bool = True) -> Column:
    """Does c hold a match?  Null counts as no."""
    return F.coalesce(c.rlike(pattern(text, ignore_case)), F.lit(False))


def replace(c: Column, text: str, by: str = " ", ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, pattern(text, ignore_case), by)


def extract(c: Column, text: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The group of the first match, null where there is none."""
    p = pattern(text, ignore_case)
    return F.try_element_at(F.regexp_extract_all(c, F.lit(p), group), F.lit(1))


def quoted(text: str) -> str:
    """A text as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(rows: Sequence[dict[str, str | bool]]) -> Column:
    """An array of structs of literals, made in one call however long it is."""

    def literal(v: str | bool) -> str:
        return str(v).lower() if isinstance(v, bool) else quoted(v)

    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in row.items()) + ")" for row in rows) + ")")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def compact(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(replace(c, r"\s+", " "))


def first_label(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first (pattern, label) rule that c matches, else null; one expression, made in one call."""
    cases = " ".join(f"WHEN x RLIKE {quoted(pattern(p, True))} THEN {quoted(label)}" for p, label in rules)
    return F.call_function("transform", F.array(c), F.expr(f"x -> CASE {cases} END"))[0]


def path(*levels: Column) -> Column:
    """'A > B > C', cut at the first null level; null where the first is null.

    Every level is written down once: levels are long expressions, and the
    optimiser would copy each to wherever it is named.
    """

    def joined(each: Column) -> Column:
        first_null = F.array_position(F.transform(each, lambda x: x.isNull()), True)
        open_ = F.when(first_null == 0, each).otherwise(F.slice(each, F.lit(1), F.greatest(first_null - 1, F.lit(0)).cast("int")))
        return F.when(F.size(open_) > 0, F.array_join(open_, SEPARATOR))

    return let(F.array(*levels), joined)


def path_skip(*levels: Column) -> Column:
    """'A > C': null levels are left out."""
    return F.nullif(F.concat_ws(SEPARATOR, *levels), F.lit(""))
