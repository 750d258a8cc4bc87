"""The order in which category paths and their nodes are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions import gear
from offerloom.functions import rules as R
from offerloom.functions.text import extract, has, pattern

#: The rank of what no table names.
LAST = 9007199254740991

# Labels in the order in which they are shown; a node has the rank of the first label that it holds.
SOCKETS = ("Intel LGA1851", "Intel LGA1700", "Intel LGA1200", "Intel LGA1151", "Intel LGA1150", "Intel LGA4677", "AMD AM5", "AMD AM4", "AMD sTR5", "AMD sWRX8")
CHIPSETS = (
    "Z890", "W890", "W880", "B860", "H810", "Z790", "B760", "H610", "W680", "B660", "H510", "H310", "H110", "H81", "W790",
    "X870E", "X870", "WRX90", "TRX50", "WRX80", "B850", "B840", "X670E", "X670", "B650E", "B650", "A620", "B550", "A520",
)
MAKERS = ("ASUS", "MSI", "GIGABYTE", "ASRock", "BIOSTAR", "Sapphire", "PowerColor", "XFX", "ZOTAC", "PNY", "Leadtek", "Inno3D", "Palit", "Gainward", "GALAX", "COLORFUL", "Maxsun")
GPU_SERIES = (
    "NVIDIA RTX 50系列", "NVIDIA RTX 40系列", "NVIDIA RTX 30系列", "NVIDIA GT 10系列", "NVIDIA GT 700系列", "NVIDIA GT 200系列", "AMD RX 9000系列", "AMD RX 8000系列", "AMD RX 7000系列", "AMD RX 6000系列", "AMD Radeon R7 系列",
    "Intel Arc 系列", "NVIDIA 專業繪圖卡", "AMD 專業繪圖卡",
)
THREADRIPPERS = ("Threadripper 9000", "Threadripper 7000", "Threadripper 5000", "Threadripper 3000", "Threadripper TR4", "Threadripper")
CASE_FORMS = ("Mini-ITX", "M-ATX", "ATX", "E-ATX", "機架式 / 工業", gear.NO_FORM)
LINKS = ("有線", "無線")
CABLE_LEAVES = (
    "CAT.8", "CAT.7", "CAT.6A", "CAT.6", "CAT.5E", "其他網路線", "HDMI", "DisplayPort", "DVI", "VGA", "音源 / 光纖", "其他影音", "Thunderbolt", "Type-C to C", "Type-A to C", "多接頭充電線", "Lightning", "充電線", "其他 USB",
    "HDMI 轉接", "DP 轉接", "USB 轉接", "網路口轉接", "其他轉接", "延長線插座", "電源線", "12VHPWR 電源延長", "24Pin 電源延長", "8Pin 電源延長", "ARGB 延長線", "PCIe 延長線", "SATA 排線", "其他機內線", "KVM 切換器", "訊號切換器", "訊號分配器",
)
PACKAGES = ("整機電腦", "伺服器 / 工作站", "筆電", "準系統 / 迷你 PC", "掌機", "零件組合", "搭購價單品")
COMBOS = ("機殼 + 電源", "散熱器 + 電源", "散熱器 + 機殼", "CPU + 主機板", "主機板 + 記憶體/儲存", "顯卡搭購組", "螢幕 + 周邊", "周邊套裝", "其他組合")
#: Categories whose rank is that of one table.
ONE = {
    "hdd": ("桌上型硬碟", "NAS 專用碟", "監控碟", "企業級硬碟", "行動外接硬碟"), "headset": ("有線耳機", "無線耳機", "USB 麥克風", "專業麥克風", "無線麥克風", "麥克風"),
    "network": ("無線路由器", "Wi-Fi 延伸器", "無線基地台 / AP", "網路卡 / 接收器", "交換器", "NAS 網路儲存", "網路攝影機", "其他網通設備"),
    "speaker": ("2.0 桌面／書架", "2.1／多件式", "聲霸", "重低音（單顆）", "便攜藍牙", "其他喇叭"), "fan": ("12cm 風扇", "14cm 風扇", "8/9cm 小風扇", "其他尺寸風扇"),
}
#: Categories with a table for each level.
LAYERS = {
    "keyboard": (("機械式鍵盤", "薄膜鍵盤"), (*R.KEYBOARD_SWITCHES.split("|"), "未標軸"), LINKS), "mouse": (("電競滑鼠", "垂直滑鼠", "一般滑鼠"), LINKS),
    "ram": (("桌上型 UDIMM", "筆電用 SO-DIMM", "伺服器記憶體"), ("DDR5", "DDR4", "D5", "D4")), "ssd": (("M.2 NVMe SSD", "SATA 2.5吋", "行動外接式"), ("PCIe 5.0", "PCIe 4.0", "PCIe 3.0")),
    "psu": (("ATX 電源", "SFX 電源", "SFX-L 電源", "TFX 電源", "Flex 電源"), ("1000W 以上", "750W~1000W", "600W~750W", "600W 以下", "未標瓦數"),
            ("80+ 鈦金牌", "80+ 白金牌", "80+ 金牌", "80+ 銀牌", "80+ 銅牌", "80+ 白牌"), ("全模組", "半模組", "直出非模組")),
    "cooler": (("一體式水冷 (AIO)", "雙塔空冷", "單塔空冷", "下吹式空冷", gear.PASTE), ("420mm", "360mm", "280mm", "240mm", "120mm", "100mm 以下（低矮型）", "101–150mm", "151–160mm", "161mm 以上", "M.2 散熱", gear.NO_SIZE), ("ARGB", "RGB", gear.NO_LIGHT)),
    "monitor": (("可攜 / 小尺寸", "22吋", "24吋", "25吋", "27吋", "32吋", "34吋超寬", "49吋帶魚", "57吋帶魚", "大型顯示器", "其他尺寸", "未標吋數"),),
}
#: Categories with a table of first levels and one of second levels.
TWO = {
    "cable": (("網路線", "影音線", "USB / 傳輸線", "轉接頭 / 轉接線", "電源延長線 / 插座", "機內排線 / 延長線", "切換器 / 分配器", gear.OTHER_CABLE), CABLE_LEAVES),
    "os": (("作業系統", "應用軟體"), ("Windows 11", "Windows 10", "Windows Server", "其他作業系統", "防毒軟體", "辦公軟體", "其他軟體")),
}
GPU_BONUS = {"XTX": 4, "TI": 3, "SUPER": 2, "XT": 2, "GRE": 1}
BY_CAPACITY = ("ram", "ssd", "hdd")


def _rank(c: Column, labels: tuple[str, ...]) -> Column:
    """Position of the first label that c holds in any case, null where there is none."""
    return F.coalesce(*[F.when(F.contains(F.upper(c), F.lit(x.upper())), F.lit(k)) for k, x in enumerate(labels)]).cast("double")


def _or(c: Column, otherwise: int) -> Column:
    return F.coalesce(c, F.lit(float(otherwise)))


def _layered(c: Column, layers: tuple) -> Column:
    """Ranks of all levels as one number, those that start at a later level behind."""
    ranks = [_rank(c, x) for x in layers]
    first = F.coalesce(*[F.when(r.isNotNull(), F.lit(float(k))) for k, r in enumerate(ranks)])
    return first * 1e12 + reduce(lambda a, r: a * 1000 + _or(r, 0), ranks[1:], _or(ranks[0], 0))


def _two(c: Column, top: tuple, leaves: tuple) -> Column:
    leaf = _rank(c, leaves)
    return F.coalesce(_rank(c, top) * 100 + _or(leaf, 0), leaf)


def _maker(c: Column) -> Column:
    """Rank of the last level among the makers."""
    last = F.upper(F.trim(F.element_at(F.split(c, ">"), -1)))
    return F.coalesce(*[F.when(last == x.upper(), F.lit(float(k))) for k, x in enumerate(MAKERS)])


def _board(c: Column) -> Column:
    socket, chipset, maker = _rank(c, SOCKETS), _rank(c, CHIPSETS), _maker(c)
    return F.when(F.coalesce(socket, chipset, maker).isNotNull(), _or(socket, 99) * 100000 + _or(chipset, 999) * 100 + _or(maker, 99))


def _cpu(c: Column) -> Column:
    lines = [F.when(has(c, rf"CORE I{n}|ULTRA {n}|RYZEN {n}"), F.lit(500.0 + 10 * k)) for k, n in enumerate("9753")]
    generation, ryzen = extract(c, r"第\s*(\d{1,2})\s*代", 1).cast("double"), extract(c, r"RYZEN\s*(\d{4})", 1).cast("double")
    return F.coalesce(F.when(has(c, "CORE ULTRA 200S"), F.lit(10.0)), 100 - generation, 300 - ryzen / 100, 400 + _rank(c, THREADRIPPERS), *lines)


def _package(c: Column) -> Column:
    base = tuple(label for label, _ in sorted(R.CATEGORIES.values(), key=lambda x: x[1]))
    top, combo, part = _rank(c, PACKAGES), _rank(c, COMBOS), _rank(c, base)
    return F.coalesce(top * 10000 + _or(combo, 0) * 100 + _or(part, 0), combo * 100, part)


def _case(c: Column) -> Column:
    """Only the first level, as a whole: ATX is part of other labels."""
    top = F.trim(F.split(c, ">")[0])
    return F.coalesce(*[F.when(top == x, F.lit(float(k))) for k, x in enumerate(CASE_FORMS)])


def semantic_rank(category: Column, node: Column) -> Column:
    ways = {
        "cpu": _cpu(node), "motherboard": _board(node), "gpu": F.coalesce(_rank(node, GPU_SERIES), 100 + _maker(node)), "case": _case(node), "package": _package(node),
        **{c: _rank(node, x) for c, x in ONE.items()}, **{c: _layered(node, x) for c, x in LAYERS.items()}, **{c: _two(node, *x) for c, x in TWO.items()},
    }
    return _or(F.coalesce(*[F.when(category == c, r) for c, r in ways.items()]), LAST)


def subcategory_sort_key(category: Column, node: Column) -> Column:
    """A struct by which nodes, bare or whole paths, are ordered within a category; null counts as the empty node.

    Makers of processors, the tables, newer graphics chips, larger capacities,
    kits, larger numbers, then the node itself in binary order.
    """
    c = F.coalesce(node, F.lit(""))
    exact = F.when(F.trim(c) == "", F.lit(float(LAST))).when((category == "cpu") & F.trim(c).isin("Intel", "AMD"), F.when(F.trim(c) == "Intel", 0.0).otherwise(1.0)).otherwise(1000.0)
    chip = r"\b(?:RTX|GTX|GT|RX)\s*(\d{3,4})(?:\s*(TI|SUPER|XTX|XT|GRE))?"
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GPU_BONUS.items() for x in kv]), F.upper(extract(c, chip, 2))), F.lit(0))
    model = F.when(category == "gpu", _or(-(extract(c, chip, 1).cast("double") * 10 + bonus), LAST)).otherwise(0.0)
    size = r"(?:^|>\s*|\s)(\d+)\s*(TB|GB|T|G|MB)(?:\s|$|\(|>)"
    unit = F.upper(extract(c, size, 2))
    capacity = extract(c, size, 1).cast("double") * F.when(unit.startswith("T"), 1048576).when(unit.startswith("G"), 1024).otherwise(1)
    kit = F.when(has(c, r"[*xX]\s*\d|\(\d+G[*xX]\d+\)", False), 0).otherwise(1)
    largest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit(pattern(r"(\d+)")), 1), lambda x: x.cast("double")))
    return F.struct(
        exact.alias("exact"), F.when(c == "", F.lit(float(LAST))).otherwise(semantic_rank(category, c)).alias("rank"), model.alias("model"),
        F.when(category.isin(*BY_CAPACITY), -_or(capacity, 0)).otherwise(0.0).alias("capacity"), kit.alias("kit"), (-_or(largest, 0)).alias("largest"), c.alias("node"),
    )
