"""Categories, contamination and bundles of titles, with answers worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerloom.functions import detect
from offerloom.operators import audit, ingest

CATEGORIES = {
    "MSI RTX 5070 VENTUS 2X 12G": "gpu", "RTX 5060 顯卡支撐架": "other", "GT 1030 2G 靜音": "gpu", "B760M DDR5 M-ATX 2.5G LAN": "motherboard", "主機板 24Pin ARGB 延長線 30cm": "cable",
    "海韻 FOCUS 850W 80+金牌 全模組": "psu", "FSP UD750GM 金牌 全模組": "psu", "那嘶狼 8TB 7200轉": "hdd", "東芝 外接硬碟 2TB": "hdd", "Razer Barracuda 耳機": "headset", "T700 1TB Gen5 PCIe 讀14500 TLC": "ssd",
    "M.2 SSD 外接盒 USB 10G": "other", "Noctua 120 PWM 1500 RPM": "fan", "機殼 顯卡長 400mm CPU高 165mm": "case", "掌機 收納包 TRAVEL CASE": "other", "塔散 雙塔 CPU散熱器": "cooler", "LG 27吋 螢幕 IPS 180Hz": "monitor",
    "螢幕掛燈 SCREENBAR": "other", "SMART M7 智慧 32型 含喇叭": "monitor", "HDMI 2.1 公-公 2米": "cable", "CAT.6A 扁線 3米": "cable", "TP-Link 路由器 Wi-Fi 7": "network", "印表機 無線": "other", "Windows 11 Home 隨機版 含DVD": "os",
    "機械鍵盤 青軸": "keyboard", "升降桌 滑鼠墊": "other", "ASRock B760M 主機板 M.2 E-Key WiFi": "motherboard", "華碩 Z890 主機板 PCI-E to M.2 插槽": "motherboard", "技嘉 B760 主機板 轉接板": "other", "Intel Core i5-14400 處理器": "cpu", "CPU 防彎扣具": "other", "DDR5 6000 16G*2": "ram", "超值組 滑鼠": "package", "": "other", None: "other",
}
REASONS = {
    "筆電 15.6吋 512G SSD": "laptop", "筆電 散熱墊": None, "ROG ALLY 掌機 512G": "handheld", "DeskMini B760 準系統": "barebone", "DeskMini 專用 WiFi 模組": None, "捷元 品牌電腦": "retail-system", "MINI PCIE 無線網卡": None,
    "i3-12100 8G 256G SSD WIN11": "prebuilt-os", "W5-3423 伺服器 /64G/1T SSD/ 700W": "server-workstation", "ASUS ASCENT GX10 / 128G / 1TB": "ai-workstation", "i5-12400 / H610 / 8G DDR4 / 512G SSD": "complete-spec",
    "i5-12400 500W 電源 機殼": "slash-build", "超值組 滑鼠": "bundle-keyword", "編織線 組合包": None, "【加購優惠】組合包": None, "群暉 DS225+ 2Bay 組合包": None, "微星 B760 主機板 + 金士頓 記憶體 16G": "plus-part",
    "AOC 螢幕 + AULA 鍵盤": "plus-part", "24型 螢幕 + 有線 鍵盤": "plus-monitor-peripheral", "主板 +RTX 5060": "plus-gpu", "R5-7600 + B650M": "plus-cpu-chipset", "散熱 + 650W 銅牌": "plus-psu-rated",
    "網狀版 白 + GX-850": "case-plus-psu", "機殼(內含 SFX 850W+120mm 水冷)": None, "全景玻璃 黑 + 水冷 360": "case-plus-cooler", "18+3+3相供電 WIFI": None, "M.2+ WIFI": None, "": None,
}


def test_categories(spark):
    df = spark.createDataFrame([(t,) for t in CATEGORIES], "raw_name string")
    assert {r.raw_name: r.category for r in detect.detect_category(df).collect()} == CATEGORIES


def test_bundle_reasons(spark):
    df = spark.createDataFrame([(t, "x") for t in REASONS], "raw_name string, seen string")
    found = detect.bundle_reason(df)
    assert found.columns == ["raw_name", "seen", "bundle_reason"]
    assert {r.raw_name: r.bundle_reason for r in found.collect()} == REASONS


@pytest.mark.parametrize(("text", "want"), [("18+3+3相供電", " 相供電 "), ("80+ 金牌", "80  金牌"), ("8G+8G", "8G 8G"), ("1+2+3 x", "1 2 3 x"), ("A+B", "A+B"), ("塔散172mm", " mm"), ("顯卡支撐架", " ")])
def test_neutral_plus(spark, text, want):
    assert spark.range(1).select(detect.neutral_plus(F.lit(text)).alias("x")).first().x == want


def test_categorize_and_process(spark):
    rows = [
        (1, "Intel Core i5-14400 處理器 搭板價", "cpu", 5000), (2, "Intel Core i5-14400 處理器", "cpu", 5000), (3, "CPU 防彎扣具", "cpu", 300), (4, "超值組 滑鼠", "mouse", 500), (5, "LG 27吋 螢幕", "other", 5000),
        (6, "燒錄機", "optical_drive", 900), (7, "海韻 850W 金牌 全模組", "psu", 5), (8, "Type-C 集線器", "cable", 700), (9, None, None, 100),
    ]
    df = spark.createDataFrame(rows, "id long, raw_name string, category string, price long").withColumns({"brand": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "specs": F.create_map().cast("map<string,string>")})
    got = {r.id: (r.category, r.subcategory, r.bundle_reason, r.specs.get("priceCondition")) for r in ingest.categorize_listings(df).collect()}
    assert got[1] == ("package", "搭購價單品 > CPU 處理器 > 搭板價", None, "搭板價")
    assert got[2][:2] == ("cpu", "Intel > 第 14 代 > Core i5")
    assert got[3][0] == got[6][0] == got[9][0] == "other" and got[4] == ("package", "零件組合 > 周邊套裝", "bundle-keyword", None)
    assert got[5][:2] == ("monitor", "27吋 > LG") and got[8][0] == "cable"
    assert sorted(r.id for r in ingest.process_batch(df).collect()) == [1, 2, 4, 5, 8]


def test_audit_counts(spark):
    rows = [("gpu", "RTX 支撐架", None), ("fan", "集線器", None), ("fan", "內含風扇集線器 120", None), ("cpu", "Z890 board", "x"), ("cpu", "ok", "Intel > 第 9 代"), ("cooler", "c", "空冷 > 155mm > RGB"), ("hdd", "燒錄機", None), ("package", "單品", "p")]
    df = spark.createDataFrame(rows, "category string, raw_name string, subcategory string").withColumn("name", F.col("raw_name"))
    got = {r.check: r["count"] for r in audit.count_listings(df, [*audit.sql_checks(), "non_bundles"]).collect() if r["count"]}
    assert got == {"gpu_brackets": 1, "non_fans": 1, "boards_in_cpu": 1, "old_cpu_generations": 1, "split_cooler_heights": 1, "optical_drives": 1, "non_bundles": 1}
