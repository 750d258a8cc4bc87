"""Tables of labels, the first that holds counts: as Columns, and as SQL of another engine.

An entry is a label and clauses, any of which suffices; a clause is a pattern or
a tuple of patterns that must all hold, whatever the case.  ``!`` negates a
pattern, ``~`` looks at a second text, ``#`` asks for a number: ``#27,30-32``.
"""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import pattern, quoted

_CONDITION = re.compile(r"^(!?)([~#]?)(.*)$", re.S)


def _numbers(text: str) -> list[int]:
    out: list[int] = []
    for part in text.split(","):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    return out


def _clauses(clauses: list | tuple) -> list[tuple[str, ...]]:
    return [c if isinstance(c, tuple) else (c,) for c in clauses]


#: What the SQL text of a table calls the text, the second text and the number.
_NAMES = ("c", "second", "number")


def _holds(clauses: list | tuple) -> str:
    """Does any clause hold, as text of Spark's SQL.  Never null."""

    def one(condition: str) -> str:
        no, kind, text = _CONDITION.match(condition).groups()
        found = f"coalesce(x.number IN ({', '.join(map(str, _numbers(text)))}), false)" if kind == "#" else f"coalesce(x.{'second' if kind == '~' else 'c'} RLIKE {quoted(pattern(text, True))}, false)"
        return f"NOT {found}" if no else found

    return "(" + " OR ".join("(" + " AND ".join(map(one, clause)) + ")" for clause in _clauses(clauses)) + ")"


def _choose(table: tuple, otherwise: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(clauses)} THEN {quoted(label)}" for label, *clauses in table) + f" ELSE {'NULL' if otherwise is None else quoted(otherwise)} END"


def _over(sql: str, c: Column, second: Column | None = None, number: Column | None = None) -> Column:
    """A SQL text about x over these columns: a table is one expression, made in one call, however many rows it has."""
    made = F.struct(*[(F.lit(None) if v is None else v).alias(n) for n, v in zip(_NAMES, (c, second, number), strict=True)])
    return F.call_function("transform", F.array(made), F.expr(f"x -> {sql}"))[0]


def holds(c: Column, clauses: list | tuple, second: Column | None = None, number: Column | None = None) -> Column:
    """Does any clause hold?  Never null."""
    return _over(_holds(clauses), c, second, number)


def choose(c: Column, table: tuple, otherwise: str | None = None, second: Column | None = None, number: Column | None = None) -> Column:
    """The label of the first entry that holds."""
    return _over(_choose(table, otherwise), c, second, number)


def tree(c: Column, table: tuple, otherwise: str) -> Column:
    """'A > B': entries are (A, clauses, table of B, otherwise of B)."""
    return _over("CASE " + " ".join(f"WHEN {_holds(clauses)} THEN concat({quoted(label + ' > ')}, {_choose(leaves, rest)})" for label, clauses, leaves, rest in table) + f" ELSE {quoted(otherwise)} END", c)


def _quoted(text: str, ignore_case: bool = False) -> str:
    return "'" + ("(?i)" if ignore_case else "") + text.replace("'", "''") + "'"


def holds_sql(x: str, clauses: list | tuple, second: str = "", number: str = "") -> str:
    def one(condition: str) -> str:
        no, kind, text = _CONDITION.match(condition).groups()
        found = f"coalesce({number} IN ({', '.join(map(str, _numbers(text)))}), false)" if kind == "#" else f"regexp_matches({second if kind == '~' else x}, {_quoted(text, True)})"
        return f"NOT {found}" if no else found

    return "(" + " OR ".join("(" + " AND ".join(map(one, clause)) + ")" for clause in _clauses(clauses)) + ")"


def choose_sql(x: str, table: tuple, otherwise: str | None = None, second: str = "", number: str = "") -> str:
    rest = "NULL" if otherwise is None else _quoted(otherwise)
    return "CASE " + " ".join(f"WHEN {holds_sql(x, clauses, second, number)} THEN {_quoted(label)}" for label, *clauses in table) + f" ELSE {rest} END"


def tree_sql(x: str, table: tuple, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {holds_sql(x, clauses)} THEN {_quoted(label + ' > ')} || {choose_sql(x, leaves, rest)}" for label, clauses, leaves, rest in table) + f" ELSE {_quoted(otherwise)} END"
