"""Paths of coolers, cases, monitors, peripherals, network gear, cables, software and packages, with answers worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerloom.functions import detect, gear
from offerloom.operators import ingest

PATHS = {
    "cooler": {
        "華碩 TUF GAMING LC 360 ARGB": "一體式水冷 (AIO) > 360mm > ARGB", "MasterLiquid 水冷": "一體式水冷 (AIO) > 未標尺寸 > 無光", "水冷液 紅 1L": "散熱膏/配件 > 分體水冷配件", "M.2 散熱片 2280": "散熱膏/配件 > M.2 散熱",
        "散熱膏 4g": "散熱膏/配件", "雙塔 六導管 高15.7 RGB": "雙塔空冷 > 151–160mm > RGB", "塔散 高度：165mm": "單塔空冷 > 161mm 以上 > 無光", "下吹式 高 4.7cm": "下吹式空冷 > 100mm 以下（低矮型） > 無光", "利民 AX120": "單塔空冷 > 未標尺寸 > 無光",
        "液態金屬 1g": "散熱膏/配件", "喬思伯 TH-240": "一體式水冷 (AIO) > 240mm > 無光", "CPU 水冷頭 (透明)": "散熱膏/配件 > 分體水冷配件", "飛龍 360": "一體式水冷 (AIO) > 360mm > 無光", "": "單塔空冷 > 未標尺寸 > 無光",
    },
    "case": {"聯力 O11 E-ATX 白": "E-ATX > Lian Li > O11", "華碩 AP201 網狀": "M-ATX > ASUS > Prime", "4U 工業機殼": "機架式 / 工業", "NZXT H5 Flow ATX": "ATX > NZXT > H 系列", "喬思伯 N3 ITX": "Mini-ITX > JONSBO > N 系列 (NAS)", "無名": "未標板型"},
    "monitor": {
        "LG 27吋 IPS": "27吋 > LG", "MSI MAG 275CQRF X24": "27吋 > MSI", "BenQ PD3205U": "32吋 > BenQ", "三星 49型 曲面": "49吋帶魚 > Samsung", "Acer 15.6吋 可攜": "可攜 / 小尺寸 > 16吋 > Acer", "飛利浦 55吋": "大型顯示器 > 55吋",
        "AOC 螢幕 180Hz E14": "其他尺寸 > 未標吋數 > AOC", "ASUS 28吋": "其他尺寸 > 28吋 > ASUS", "【34 型】 弧面": "34吋超寬",
    },
    "keyboard": {"i-Rocks 機械 紅軸 三模": "機械式鍵盤 > 紅軸 > 無線 > i-Rocks", "羅技 薄膜 鍵盤": "薄膜鍵盤 > 有線 > Logitech", "熱插拔 鍵盤": "機械式鍵盤 > 未標軸 > 有線"},
    "mouse": {"羅技 LIGHTSPEED": "電競滑鼠 > 無線 > Logitech", "垂直 滑鼠": "垂直滑鼠 > 有線", "滑鼠 2.4G": "一般滑鼠 > 無線"},
    "headset": {"USB 麥克風 HyperX": "USB 麥克風 > HyperX", "電容 麥克風": "專業麥克風", "無線 麥克風 USB": "無線麥克風", "耳麥 麥克風": "有線耳機", "藍牙 耳機 Sony": "無線耳機 > Sony", "麥克風": "麥克風"},
    "speaker": {"聲霸 2.1": "聲霸", "Edifier 2.0 藍牙 喇叭": "2.0 桌面／書架 > Edifier", "超低音 喇叭": "重低音（單顆）", "2.1 喇叭": "2.1／多件式", "JBL 藍牙 喇叭": "便攜藍牙 > JBL", "喇叭 四聲道": "2.0 桌面／書架", "喇叭": "其他喇叭"},
    "fan": {"TL120": "12cm 風扇", "14CM": "14cm 風扇", "92mm": "8/9cm 小風扇", "1200轉 1204": "其他尺寸風扇", "200mm": "其他尺寸風扇"},
    "network": {"ARCHER AX55": "無線路由器", "Archer TX55E": "網路卡 / 接收器", "TP-Link DECO X50": "無線路由器 > Mesh 網狀 > TP-Link", "8埠 TL-SG108": "交換器", "RE315 延伸": "Wi-Fi 延伸器", "EAP610 吸頂": "無線基地台 / AP", "群暉 NAS": "NAS 網路儲存 > Synology", "WEBCAM": "網路攝影機", "x": "其他網通設備"},
    "cable": {
        "KVM 2進": "切換器 / 分配器 > KVM 切換器", "HDMI 分配器": "切換器 / 分配器 > 訊號分配器", "CAT.6A 扁線": "網路線 > CAT.6A", "24Pin ARGB 延長線": "機內排線 / 延長線 > 24Pin 電源延長", "12V-2X6 電源線": "機內排線 / 延長線 > 12VHPWR 電源延長",
        "SATA 排線": "機內排線 / 延長線 > SATA 排線", "6座 延長線 防雷": "電源延長線 / 插座 > 延長線插座", "HDMI 轉接器": "轉接頭 / 轉接線 > HDMI 轉接", "HDMI 2.1 線": "影音線 > HDMI", "Type-C to HDMI": "USB / 傳輸線 > 其他 USB", "Type-C to C": "USB / 傳輸線 > Type-C to C",
        "USB-A to Type-C": "USB / 傳輸線 > Type-A to C", "TB4 線": "USB / 傳輸線 > Thunderbolt", "線": "其他線材",
    },
    "os": {"Office 2021 WIN10": "應用軟體 > 辦公軟體", "Windows 11 Home": "作業系統 > Windows 11", "PC-cillin": "應用軟體 > 防毒軟體", "Windows Server 2022": "作業系統 > Windows Server", "Linux": "作業系統 > 其他作業系統", "x": "應用軟體 > 其他軟體"},
}


@pytest.mark.parametrize("category", PATHS)
def test_paths(spark, category):
    df = spark.createDataFrame([(t,) for t in PATHS[category]], "raw string")
    assert {r.raw: r.p for r in df.select("raw", gear.PATHS[category](F.col("raw")).alias("p")).collect()} == PATHS[category]


def test_packages(spark):
    want = {
        "【限量】ASUS Vivobook 筆電 15.6吋 i5 512G": "筆電 > ASUS", "酷碼SNEAKER X 迷你主機 i7 RTX 4070": "準系統 / 迷你 PC > Cooler Master", "DeskMini B760 準系統": "準系統 / 迷你 PC > ASRock", "捷元 品牌電腦 Intel": "整機電腦 > 捷元",
        "聯力 機殼 + 海韻 750W": "零件組合 > 機殼 + 電源", "ROG ALLY 掌機 512G": "掌機", "螢幕 + 滑鼠 合購": "零件組合 > 螢幕 + 周邊", "超值組": "零件組合 > 其他組合", "7800X3D Ryzen 7 + B650M": "零件組合 > CPU + 主機板", "18+3+3相供電": "零件組合 > 其他組合",
    }
    df = spark.createDataFrame([(t,) for t in want], "raw string")
    no = F.lit(False)
    got = df.select("raw", gear.package_path(F.col("raw"), detect.neutral_plus(F.col("raw")), no, F.col("raw").contains("吋"), no).alias("p")).collect()
    assert {r.raw: r.p for r in got} == want


def test_part_path_of_null(spark):
    df = spark.createDataFrame([(c, None) for c in ingest.PART_PATHS], "category string, raw string")
    assert all(r.p is None or " > None" not in r.p for r in df.select(ingest.part_path(F.col("category"), F.col("raw")).alias("p")).collect())
