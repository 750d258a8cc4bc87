"""Categories, contamination and bundles of free titles, from the tables of detect_rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import detect_rules as D
from offerloom.functions.names import brand_needles, is_short
from offerloom.functions.text import pattern, quoted, replace

#: A text that holds some spelling of a brand.
BRAND = "|".join(re.escape(n).replace("\\ ", " ") for n, _ in brand_needles() if not is_short(n)) + "|(?:^|[^A-Z0-9])(?:" + "|".join(n for n, _ in brand_needles() if is_short(n)) + ")(?:[^A-Z0-9]|$)"
_PREFIX = re.compile(r"^(!?)(\^(?=\^)|usb|[~=@]?)(.*)$", re.S)


def _split(condition: str) -> tuple[bool, str, str]:
    """(negated, kind, pattern or rule) of a condition."""
    no, kind, text = _PREFIX.match(condition).groups()
    return bool(no), kind, text


def _clauses(rule: list) -> list[tuple[str, ...]]:
    return [c if isinstance(c, tuple) else (c,) for c in rule]


def _word(w: str) -> str:
    return re.escape(w).replace("\\ ", " ").replace("\\-", "-")


def keyword_rule(category: str, words: tuple[str, ...]) -> list:
    """The words of a category, and nothing that says otherwise."""
    guards = [f"!@{D.GUARDS[category]}"] if category in D.GUARDS else []
    guards += ["!@furniture"] if category in D.FURNITURE_IN else []
    return [("|".join(map(_word, words)), *guards)]


#: All rules by name: those of the tables, one for each bundle reason and each way to find a category.
ALL: dict[str, list] = {
    **D.RULES, "exempt": D.EXEMPT, **{f"bundle:{r}": c for r, c in D.BUNDLES},
    **{f"implicit:{k}": c for k, (_, c) in enumerate(D.IMPLICIT)}, **{f"keyword:{c}": keyword_rule(c, w) for c, w in D.KEYWORDS},
    **{f"doubt:{c}": D.DOUBTS.get(c, []) + ([f"@{D.GUARDS[c]}"] if c in D.GUARDS and c not in D.UNDOUBTED else []) + (["@furniture"] if c in D.FURNITURE_IN else []) for c in dict(D.KEYWORDS)},
}
CATEGORY = [(category, f"implicit:{k}") for k, (category, _) in enumerate(D.IMPLICIT)] + [(c, f"keyword:{c}") for c, _ in D.KEYWORDS]
BUNDLE = [(r, f"bundle:{r}") for r, _ in D.BUNDLES]
DOUBT = [(c, f"doubt:{c}") for c in dict(D.KEYWORDS) if ALL[f"doubt:{c}"]]


def needed(*rules: str) -> list[str]:
    """These rules and all that they name, those that are named first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name == "plus_brand":
            return
        for clause in _clauses(ALL[name]):
            for _, kind, text in map(_split, clause):
                if kind == "@":
                    visit(text)
        out.append(name)

    for r in rules:
        visit(r)
    return out


def _kept(values: list[str]) -> Column:
    """An array of conditions, each SQL text, whose elements the optimiser does not copy to each place that asks for one."""
    return F.expr(f"concat(array({', '.join(values)}), CAST(array() AS array<boolean>))")


def levels(rules: list[str]) -> list[list[str]]:
    """The rules, each behind those that it names."""
    level: dict[str, int] = {}
    for name in rules:
        below = [level[text] for c in _clauses(ALL[name]) for _, kind, text in map(_split, c) if kind == "@" and text != "plus_brand"]
        level[name] = 1 + max(below, default=-1)
    return [[r for r in rules if level[r] == k] for k in range(1 + max(level.values()))]


class Titles:
    """Reads titles once for some rules: every pattern is tried once a title, rules then combine what was found, level by level."""

    def __init__(self, *rules: str, into: str = "seen") -> None:
        self.into, self.leaves, self.columns = into, {}, {}
        self.levels = levels(needed(*rules))
        for name in (n for level in self.levels for n in level):
            for clause in _clauses(ALL[name]):
                for _, kind, text in map(_split, clause):
                    if kind != "@" or text == "plus_brand":
                        self.leaves.setdefault((kind, text), len(self.leaves))
        for k, level in enumerate(self.levels):
            self.columns |= {name: f"{into}_{k}[{i}]" for i, name in enumerate(level)}

    def see(self, df: DataFrame, raw: Column) -> DataFrame:
        """df with arrays of what each title holds and which rules hold for it."""
        texts = {"": "raw", "^": "trimmed", "~": "cleaned", "=": "bare", "usb": "tied"}
        at = f"{self.into}_texts"
        title = F.coalesce(raw, F.lit(""))
        cleaned = title
        for p, by in D.FALSE_PLUS:
            cleaned = replace(cleaned, p, by, True)
        step = df.withColumn(f"{at}_c", cleaned) if any(k in "~=" or t == "plus_brand" for k, t in self.leaves if k) else df.withColumn(f"{at}_c", title)
        cleaned = F.col(f"{at}_c")
        made = {"raw": title, "trimmed": F.trim(title), "cleaned": cleaned, "bare": replace(cleaned, D.BUILT_IN, " "), "tied": replace(title, r"USB\s?(\d)", "USB_$1", True)}
        step = step.withColumn(at, F.struct(*[v.alias(k) for k, v in made.items()]))
        found = []
        for kind, text in self.leaves:
            if text == "plus_brand":
                found.append(f"exists(regexp_extract_all({at}.cleaned, {quoted(pattern(D.PLUS, True))}, 1), x -> upper(x) RLIKE {quoted(pattern(BRAND))})")
            else:
                found.append(f"{at}.{texts[kind]} RLIKE {quoted(pattern(text, True))}")
        step = step.withColumn(self.into, _kept(found)).drop(at, f"{at}_c")
        for k, level in enumerate(self.levels):
            step = step.withColumn(f"{self.into}_{k}", _kept([self._any(ALL[name]) for name in level]))
        return step

    def forget(self, df: DataFrame) -> DataFrame:
        """df without what see added."""
        return df.drop(self.into, *[f"{self.into}_{k}" for k in range(len(self.levels))])

    def _one(self, condition: str) -> str:
        no, kind, text = _split(condition)
        c = self.columns[text] if kind == "@" and text != "plus_brand" else f"{self.into}[{self.leaves[kind, text]}]"
        return f"NOT {c}" if no else c

    def _any(self, rule: list) -> str:
        return "(" + (" OR ".join("(" + " AND ".join(map(self._one, clause)) + ")" for clause in _clauses(rule)) or "false") + ")"

    def holds(self, rule: str) -> Column:
        return F.expr(self.columns[rule])

    def first(self, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
        """The label of the first rule that holds."""
        return F.expr("CASE " + " ".join(f"WHEN {self.columns[r]} THEN {quoted(label)}" for label, r in rules) + (f" ELSE {quoted(otherwise)}" if otherwise else "") + " END")

    def category(self) -> Column:
        return self.first(CATEGORY, "other")

    def bundle_reason(self) -> Column:
        return F.when(~self.holds("exempt"), self.first(BUNDLE))


def detect_category(df: DataFrame, raw: str = "raw_name", into: str = "category") -> DataFrame:
    """df with the category that its titles show: by what they show without naming it, then by words; else other."""
    t = Titles(*[r for _, r in CATEGORY], into=_free(df, "seen"))
    return t.forget(t.see(df, F.col(raw)).withColumn(into, t.category()))


def bundle_reason(df: DataFrame, raw: str = "raw_name", into: str = "bundle_reason") -> DataFrame:
    """df with the first rule by which a title is a complete system or a bundle, else null."""
    t = Titles("exempt", *[r for _, r in BUNDLE], into=_free(df, "seen"))
    return t.forget(t.see(df, F.col(raw)).withColumn(into, t.bundle_reason()))


def flagged(df: DataFrame, rules: list[str], raw: str = "raw_name") -> DataFrame:
    """df with a boolean column for each rule of detect_rules.RULES."""
    t = Titles(*rules, into=_free(df, "seen"))
    return t.forget(t.see(df, F.col(raw)).withColumns({r: t.holds(r) for r in rules}))


def neutral_plus(c: Column) -> Column:
    """A title without plus signs that join nothing."""
    for p, by in D.FALSE_PLUS:
        c = replace(c, p, by, True)
    return c


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


# The same rules as SQL of another engine, from their plain patterns.


def _quoted(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


def rules_sql(source: str, rules: list[str], raw: str = "title") -> str:
    """A query over `source` with all its columns and one named after each rule."""
    cleaned = f"coalesce({raw}, '')"
    for p, by in D.FALSE_PLUS:
        cleaned = f"regexp_replace({cleaned}, {_quoted(p)}, '{by.replace('$', chr(92))}', 'g')"
    sql = f"SELECT *, coalesce({raw}, '') AS t_raw, {cleaned} AS t_cleaned FROM {source}"
    brand = f"len(list_filter(regexp_extract_all(t_cleaned, {_quoted(D.PLUS)}, 1), lambda x: regexp_matches(upper(x), '{BRAND.replace(chr(39), chr(39) * 2)}'))) > 0"
    sql = f"SELECT *, trim(t_raw) AS t_trimmed, regexp_replace(t_cleaned, '{D.BUILT_IN}', ' ', 'g') AS t_bare, regexp_replace(t_raw, '(?i)USB\\s?(\\d)', 'USB_\\1', 'g') AS t_tied, {brand} AS plus_brand FROM ({sql}) x"
    texts = {"": "t_raw", "^": "t_trimmed", "~": "t_cleaned", "=": "t_bare", "usb": "t_tied"}

    def one(condition: str) -> str:
        no, kind, text = _split(condition)
        return ("NOT " if no else "") + (f'"{text}"' if kind == "@" else f"regexp_matches({texts[kind]}, {_quoted(text)})")

    for level in levels(needed(*rules)):
        new = [f"({' OR '.join('(' + ' AND '.join(map(one, c)) + ')' for c in _clauses(ALL[n]))}) AS \"{n}\"" for n in level]
        sql = f"SELECT *, {', '.join(new)} FROM ({sql}) x"
    return sql


def first_sql(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN \"{r}\" THEN '{label}'" for label, r in rules) + f" ELSE {otherwise} END"
