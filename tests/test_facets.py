"""Facets of boards and monitors, with answers worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import facets

BOARDS = {
    "華碩 B760M-K D4 M-ATX 2DIMM 2.5G LAN": ("M-ATX", "2 槽", "未標示", "DDR4", "2.5GbE"), "ROG STRIX Z890-I GAMING WIFI7": ("Mini-ITX", "2 槽", "Wi-Fi 7", "DDR5", "未標示"), "X870E AORUS 8+4相 Realtek 5Gb": ("未標示", "未標示", "無 Wi-Fi", "DDR5", "5GbE"),
    "技嘉 B760M H V2": ("M-ATX", "未標示", "未標示", "DDR4", "未標示"), "H610M COMBO II 支援D4&D5": ("M-ATX", "未標示", "未標示", "DDR4/DDR5", "未標示"), "B860M MAX GAMING AX": ("M-ATX", "未標示", "Wi-Fi 6", "DDR5", "未標示"),
    "Z790 E-ATX 4DIMM WIFI6E Intel 10G": ("E-ATX", "4 槽", "Wi-Fi 6E", "DDR5", "10GbE"), "A520M WIFI 1Gb": ("M-ATX", "未標示", "有 Wi-Fi", "DDR4", "1GbE"), "": ("未標示",) * 5,
}
MONITORS = {
    "AW2725Q QD-OLED 4K-240Hz": ("QD-OLED", "170–240Hz", "4K / UHD"), "LG 27吋 IPS 180Hz": ("IPS", "170–240Hz", "FHD"), "AOC 24吋 VA 75Hz": ("VA", "100Hz 以下", "FHD"), "MSI MAG 275CQRF 360Hz": ("未標示", "240Hz 以上", "2K / QHD"),
    "Samsung 49型 量子點": ("量子點", "未標示", "帶魚 (DQHD)"), "34吋 WOLED": ("OLED", "未標示", "超寬 (UWQHD)"), "BenQ PD3205U Mini LED": ("Mini-LED", "未標示", "未標示"), "ASUS VA27AQSE TN 144Hz": ("TN", "120–165Hz", "2K / QHD"),
    "28吋 20Hz": ("未標示", "未標示", "未標示"), "M27U": ("未標示", "未標示", "4K / UHD"),
}


def _seen(spark, titles, of):
    df = spark.createDataFrame([(t,) for t in titles], "raw string")
    return {r.raw: tuple(r.f) for r in df.select("raw", of(F.col("raw")).alias("f")).collect()}


def test_boards(spark):
    assert _seen(spark, BOARDS, facets.motherboard_facets) == BOARDS


def test_monitors(spark):
    assert _seen(spark, MONITORS, facets.monitor_facets) == MONITORS


def test_finalize_specs(spark):
    rows = [(1, "gpu", "x", {"panel": "IPS", "a": "b"}), (2, "monitor", "LG 27吋 IPS 180Hz", None), (3, "motherboard", "B650M", {"mbForm": "old", "a": "b"}), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, category string, raw_name string, specs map<string,string>")
    got = {r.id: r.specs for r in facets.finalize_specs(df).collect()}
    assert got[1] == {"a": "b"} and got[4] is None and got[2] == {"panel": "IPS", "refreshTier": "170–240Hz", "resolution": "FHD"}
    assert got[3] == {"a": "b", "mbForm": "M-ATX", "mbDimm": "未標示", "mbWifi": "未標示", "mbDdr": "DDR5", "mbLan": "未標示"}
