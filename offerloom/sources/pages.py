"""Listings from landed option pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.names import in_stock_flag, price_change_marker
from offerloom.functions.text import compact, replace

_OPTIONS = "page_id string, select_name string, label string, option string"
#: Prefixes of selects that hold no offers, and the text of an empty choice.
SKIPPED_PREFIXES, CHOOSE = ("n_", "q_"), "請選擇"


class _Options(HTMLParser):
    """Collects (select, optgroup label, text) of the options of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str | None, str]] = []
        self.select = self.label = self.text = None

    def _close(self) -> None:
        if self.text is not None:
            text = "".join(self.text).strip()
            direct = self.label is None
            if text and not text.startswith("=") and not (direct and CHOOSE in text):
                self.rows.append((self.select, self.label, text))
            self.text = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("select", "optgroup", "option"):
            self._close()
        if tag == "select":
            name = a.get("name") or ""
            self.select = None if not name or name.startswith(SKIPPED_PREFIXES) else name
            self.label = None
        elif tag == "optgroup":
            self.label = a.get("label") or ""
        elif tag == "option" and self.select is not None and a.get("value"):
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("select", "optgroup", "option"):
            self._close()
        if tag == "select":
            self.select = self.label = None
        elif tag == "optgroup":
            self.label = None

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)


def _parse(encoding: str):
    def run(batches):
        for b in batches:
            rows = []
            for page, content in zip(b["page_id"], b["content"], strict=True):
                p = _Options()
                p.feed(bytes(content).decode(encoding, "replace"))
                p.close()
                p._close()
                rows += [(str(page), *r) for r in p.rows]
            yield pd.DataFrame(rows, columns=["page_id", "select_name", "label", "option"])

    return run


def parse_option_pages(pages: DataFrame, categories: dict[str, str] | None = None, encoding: str = "big5") -> DataFrame:
    """A row for each offer option of pages (page_id, content binary), with its category where a map names the select."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "content").where("content is not null").mapInPandas(_parse(encoding), _OPTIONS)
    if not categories:
        return rows.withColumn("category", F.lit("other"))
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    return rows.withColumn("category", F.coalesce(F.try_element_at(table, F.col("select_name")), F.lit("other")))


def option_price(text: Column) -> Column:
    """The first $digits,commas as a number; null if there is none or it is not above zero."""
    digits = F.replace(F.regexp_extract(text, r"\$([0-9][0-9,]*)", 1), F.lit(","), F.lit(""))
    price = digits.try_cast("long")
    return F.when(price > 0, price)


def option_name(text: Column) -> Column:
    """An option's text without prices and arrows."""
    return compact(replace(replace(text, r"\$\s*[\d,]+"), "[↘↗↓↑]"))


def parse_option_text(df: DataFrame, text: str = "option") -> DataFrame:
    """df with raw_name, name, price, price_change and in_stock; options without a price are left out."""
    t = F.col(text)
    out = df.withColumns({"raw_name": t, "name": option_name(t), "price": option_price(t), "price_change": price_change_marker(t), "in_stock": in_stock_flag(t)})
    return out.where("price is not null")
