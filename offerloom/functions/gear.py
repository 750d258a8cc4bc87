"""Category paths of coolers, cases, monitors, peripherals, network gear, cables, software and packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions import detect_rules as D
from offerloom.functions.names import extract_brand, keyboard_switch
from offerloom.functions.pick import choose, holds, tree
from offerloom.functions.text import extract, first_label, has, let, path, path_skip, pattern, replace

# All patterns, labels, sizes and bounds of this module, in the order in which they are tried.
RADIATOR = r"(?:^|\D)(?:120|240|280|360|420)(?:\D|$)"
WHOLE_LOOP = r"MasterLiquid|CoreLiquid|一體式|預裝風扇|HydroShift|Panorama|\bAIO\b|LC\s|Frozen|HyperFlow|LIQMAX|TH[-\s]?\d{3}"
LOOP_PARTS = r"水冷液|\bT1000\b.*水冷|\bP1000\b.*水冷|G1\/4|延伸管|硬管\s*水冷|水冷管接頭|洩壓閥|止水環|水道板|水箱\s*幫浦|幫浦組|水溫\s*水流|水冷管發光|發光套件A1|電競水冷管|水冷排風扇|SWAFAN|水冷頭風扇|IMF70"
TOWER = r"雙塔|導管|塔散|下吹式|Peerless\s*Assassin|NH-[UD]\d"
WET = r"水冷|冷頭|冷排|MasterLiquid|CoreLiquid|\bAIO\b|\bLC\b|HydroShift|Panorama"
ALL_IN_ONE = (
    r"一體式水冷|\bAIO\b|水冷|MasterLiquid|CoreLiquid|LIQMAX|HyperFlow|NANCOOL|HydroShift|Panorama|Frozen\s*Warframe|Trofeo\s*Vision|Wonder\s*Vision|Grand\s*Vision|\b(?:RYUO|RYUJIN|Atmos|Asetek)\b",
    ("飛龍|白龍|龍王|龍神|WATERFORCE|鷹魂", RADIATOR + "|冷頭|冷排|水冷"), r"(?:Prime|TUF|ROG|GAMING|AYW)\s+(?:Gaming\s+)?LC\b|\bLC\s*(?:III|II|I)\b", ("冷頭", RADIATOR), ("冷排|裸排", "!顯卡長|CPU高|U高|全景玻璃"),
    ("(?:預裝|預先安裝|預安裝).{0,8}風扇", r"(?:^|\D)(?:240|280|360|420)(?:\D|$)", "!雙塔|導管|塔散"), r"\bTH[-\s]?(?:120|240|280|360|420)\b",
)
PASTE = "散熱膏/配件"
COOLER_TYPES = (
    (PASTE + " > M.2 散熱", (r"M\.2|2280|SSD\s*固態|固態硬碟散熱|硬碟散熱片|SSD\s*散熱", r"!水冷|\bAIO\b|塔散|下吹|雙塔|空冷")),
    (PASTE + " > 分體水冷配件", (LOOP_PARTS, "!" + RADIATOR), (LOOP_PARTS, "!" + WHOLE_LOOP), ("!" + RADIATOR, r"Pacific\s+(?:MX|SW|SF|TF|DP|PR)|CPU\s*水冷頭|水冷頭\s*[\(（]"),
     ("!" + RADIATOR, "水冷頭", r"!MasterLiquid|CoreLiquid|\bAIO\b|一體式|預裝|LC\s|RYUO|龍王")),
    (PASTE, "散熱膏|導熱膏|涼膏|熱膏|針筒|導熱貼", (r"液態金屬|Thermal\s*Pad|導熱片|導熱係數", r"!散熱器|水冷|\bAIO\b|塔散|雙塔|空冷|冷頭|冷排|導管")),
    ("一體式水冷 (AIO)", *[(*(c if isinstance(c, tuple) else (c,)), side) for c in ALL_IN_ONE for side in ("!" + TOWER, WET)]),
    ("下吹式空冷", "下吹"), ("雙塔空冷", "雙塔"),
)
LIGHTS = (("ARGB", "ARGB"), ("RGB", "RGB"))
NO_LIGHT, ONE_TOWER, NO_SIZE = "無光", "單塔空冷", "未標尺寸"
#: Upper bounds of millimetres and the label up to each.
HEIGHT_TIERS = ((100, "100mm 以下（低矮型）"), (150, "101–150mm"), (160, "151–160mm"))

CASE_FORMS = (
    ("機架式 / 工業", r"\b[2-5]U\b|工業機殼|機架式|機架式伺服器|\bSST-?RM\b|\bRM\d{2}|\bTI-U\d{3}"), ("E-ATX", r"\bE-?ATX\b|\bEEB\b|EATX"), ("M-ATX", r"\bM-?ATX\b|MATX|MICRO-?ATX"),
    ("Mini-ITX", r"\bMINI-?ITX\b|MINI\s*ITX|\bITX\b"), ("ATX", r"\bATX\b"),
    ("M-ATX", r"\bAP20[123]\b|\bAP303\b|PRO\s*FORGE\s*M051"), ("Mini-ITX", r"MOTI\s*Mini"), ("ATX", r"\bC5\s*Curve\b|\bGT502\b"),
)
NO_FORM = "未標板型"
CASE_SERIES = {
    "Thermaltake": ((r"The Tower|\bTower\s?\d", "The Tower"), (r"\bView\b", "View"), (r"\bCeres\b", "Ceres"), (r"\bDivider\b", "Divider"), (r"\bVersa\b", "Versa"), (r"\bS\d{3}\b", "S 系列"), (r"\bH\d{3}\b", "H 系列"), (r"\bCore\b", "Core")),
    "Lian Li": (("O11", "O11"), ("Lancool", "Lancool"), (r"\bA3\b", "A3"), (r"\bA4\b", "A4"), (r"\bV\d{3}\b", "V 系列"), (r"\bDAN\b", "DAN")),
    "Fractal Design": ((r"\bNorth\b", "North"), ("Meshify", "Meshify"), ("Define", "Define"), (r"\bPop\b", "Pop"), ("Torrent", "Torrent"), (r"\bRidge\b", "Ridge"), (r"\bTerra\b", "Terra"), (r"\bFocus\b", "Focus"), (r"\bNode\b", "Node")),
    "Corsair": ((r"\biCUE\b", "iCUE"), (r"\bFrame\b", "Frame"), (r"\b\d{4}[DX]\b", "xxxxD 系列"), ("Crystal", "Crystal"), ("Obsidian", "Obsidian"), ("Carbide", "Carbide")),
    "Cooler Master": (("MasterBox", "MasterBox"), ("MasterFrame", "MasterFrame"), (r"\bHAF\b", "HAF"), (r"\bNR\d{3}\b", "NR 系列"), ("Cosmos", "Cosmos"), (r"\bQube\b", "Qube"), (r"\bTD\d{3}\b", "TD 系列"), (r"\bElite\b", "Elite")),
    "NZXT": ((r"\bH\d{1,3}\b", "H 系列"), (r"\bFlow\b", "Flow")),
    "be quiet!": tuple((f"{x} Base", f"{x} Base") for x in ("Pure", "Silent", "Dark", "Shadow", "Light")),
    "Phanteks": (("Eclipse", "Eclipse"), ("Enthoo", "Enthoo"), (r"\bNV\d{1,3}\b", "NV 系列"), (r"\bG\d{3}\b", "G 系列"), (r"\bD30\b", "D30"), (r"\bXT\b", "XT")),
    "MSI": tuple((rf"\b{x}\b", x) for x in ("MEG", "MPG", "MAG", "PANO", "FORGE", "VELOX", "GUNGNIR")),
    "ASUS": ((r"\bROG\b", "ROG"), (r"\bTUF\b", "TUF"), (r"\bPrime\b|\bAP\d{3}\b", "Prime")),
    "Montech": tuple((rf"\b{x}\b", x) for x in ("KING", "SKY", "TITAN", "AIR", "XR", "HS")),
    "In Win": (("Chopin", "Chopin"), ("Dubili", "Dubili"), ("ModFree", "ModFree"), (r"\bA1\b", "A1"), (r"\bF\d\b", "F 系列")),
    "SilverStone": ((r"\bFARA\b", "FARA"), (r"\bSETA\b", "SETA"), (r"\bSUGO\b", "SUGO"), ("Precision", "Precision"), ("Grandia", "Grandia"), (r"\bAlta\b", "Alta"), ("Fujin", "Fujin"), ("Raven", "Raven")),
    "DeepCool": ((r"\bCH\d{3}\b", "CH 系列"), (r"\bCK\d{3}\b", "CK 系列"), (r"\bCG\d{3}\b", "CG 系列"), ("Macube", "Macube"), ("Morpheus", "Morpheus"), ("MATREXX", "MATREXX"), (r"\bCC\d{3}\b", "CC 系列")),
    "Antec": ((r"\bDF\d{3}\b", "DF 系列"), (r"\bDP\d{3}\b", "DP 系列"), (r"\bNX\d{3}\b", "NX 系列"), (r"\bP\d{2,3}\b", "P 系列"), (r"\bFlux\b", "Flux"), ("Constellation", "Constellation"), ("Performance", "Performance")),
    "JONSBO": ((r"\bD\d{2}\b", "D 系列"), (r"\bTK-?\d", "TK 系列"), (r"\bZ\d{2}\b", "Z 系列"), (r"\bVR\d", "VR 系列"), (r"\bN\d\b", "N 系列 (NAS)"), (r"\bU\d\b", "U 系列"), (r"\bC\d\b", "C 系列")),
    "darkFlash": ((r"\bDLX\b", "DLX"), (r"\bDLM\b", "DLM"), (r"\bDRX\b", "DRX"), ("Blitz", "Blitz"), (r"\bDK\b", "DK")),
    "XPG": tuple((x, x) for x in ("Valor", "Invader", "Starker", "Battlecruiser", "Cruiser", "Defender")),
    "幾何未來": (("Model", "Model"), ("Hako", "Hako")),
}

MONITOR_INCHES = (14, 15, 16, 17, 19, 20, 21, 22, 23, 24, 25, 27, 28, 29, 30, 31, 32, 34, 35, 37, 38, 39, 40, 42, 43, 45, 48, 49, 50, 55, 57, 65, 70, 75, 77, 85, 86)
MAINSTREAM_INCHES = (22, 24, 25, 27, 32, 34, 49)
WIDE_INCHES = {34: "34吋超寬", 49: "49吋帶魚", 57: "57吋帶魚"}
#: What looks like the number of a model in a monitor's title, in order.
MONITOR_NOISE = (
    r"\$[\d,]+", r"[〈<][^〉>]*[〉>]", r"\b\d{2,4}\s*Hz\b", r"\bHDR\s*\d+\b", r"\bHDMI\s*[\d.]+\b", r"\b\d{3,4}\s*R\b", r"\bUSB\s*[\d.]+", r"\b(?:PD|TYPE-?C)\s*\d+\s*W\b", r"\bThunderbolt\s*\d+\b", r"\b\d+\s*ms\b", r"\b\d+K\b",
    r"\b(?:FHD|QHD|UHD|WQHD|UWQHD|DQHD)\b",
)

MECHANICAL = (("!薄膜", r"機械|熱插拔|紅軸|茶軸|青軸|銀軸|黑軸|白軸|黃軸|綠軸|紫軸|Gateron|Cherry\s*MX|Kaihl|Kailh|Outemu|TTC\b|Akko|Jwick|G\s*Pro\s*軸"),)
WIRELESS = r"三模|雙模|2\.4\s*G|LIGHTSPEED|UNIFYING|無線|WIRELESS|藍牙|藍芽|BLUETOOTH"
MICE = (("垂直滑鼠", "垂直"), ("電競滑鼠", r"電競|GAMING|\bDPI\b|LIGHTSPEED|AIMPOINT|SUPERLIGHT|VIPER|DEATHADDER|GLADIUS|HARPE|PULSEFIRE|BASILISK"))
_MIC = ("麥克風|MIC(?:ROPHONE)?", "!耳機|耳麥|HEADSET|HEADPHONE|EARBUD|EARPHONE|入耳|耳罩")
HEADSETS = (
    ("無線麥克風", (*_MIC, WIRELESS)), ("USB 麥克風", (*_MIC, r"\bUSB\b|TYPE-?C")), ("專業麥克風", (*_MIC, "電容|動圈|XLR|直播|錄音|PODCAST|指向")), ("麥克風", _MIC), ("無線耳機", WIRELESS),
)
SPEAKERS = (
    ("聲霸", r"聲霸|SOUNDBAR|SOUND\s*BAR|利維坦|LEVIATHAN|\bX-?BAR\b"),
    ("重低音（單顆）", (r"!2\s*\.\s*[01]|5\s*\.\s*1|7\s*\.\s*1|三件式|二件式|兩件式|多件式", r"主動式\s*(超)?重低音|(超)?重低音\s*喇叭|SUB\s*WOOFER|超低音\s*喇叭|\bSW\d{1,2}\b", r"!NOMM|天狼星|聲霸|SOUNDBAR|電競\s*喇叭")),
    ("2.1／多件式", r"2\s*\.\s*1|5\s*\.\s*1|7\s*\.\s*1|三件式|多件式"),
    ("2.0 桌面／書架", r"2\s*\.\s*0|二件式|兩件式|書架|BOOKSHELF|主動式\s*喇叭|電競\s*喇叭|多媒體喇叭|電腦喇叭|三音路|二音路|NOMM|天狼星", (r"\bUSB\b", "喇叭|SPEAKER")),
    ("便攜藍牙", "便攜|隨身|串流喇叭|手提|BST-|藍牙串流|藍芽串流", (r"藍牙|藍芽|BLUETOOTH|\bBT\b|WIRELESS|無線", r"!2\s*\.\s*[01]|主動式|二件|三件|聲霸|電競|光纖|RCA|聲道|木質|木紋|Hi-?Res|高音|中低音")),
    ("2.0 桌面／書架", "聲道"),
)
FANS = (("12cm 風扇", r"12\s*CM|120(?:\D|$)"), ("14cm 風扇", r"14\s*CM|140(?:\D|$)"), ("8/9cm 小風扇", r"(?:^|\D)[89]\s*CM\b|(?:^|\D)(?:80|92)\s*MM\b"))
NETWORK = (
    ("網路攝影機", "攝影機|WEBCAM|視訊鏡頭"), ("無線路由器 > Mesh 網狀", r"MESH|ZENWIFI|VELOP|\bDECO\b"),
    ("網路卡 / 接收器", r"PCE-|PCI-?E\s*網|網路卡|網卡|LAN\s*CARD|藍牙接收|藍芽接收|USB.{0,10}(藍牙|藍芽|WI-?FI|無線)|Archer\s*T[XBE]{1,2}|MW\d+US|\bUB\d{3}\b|微型\s*USB\s*接收|\bBE\d{4}E\b", (r"\bPCI-?E\b", r"WI-?FI|無線|AX\d|BE\d")),
    ("交換器", r"交換器|SWITCH|\bHUB\b|\d+\s*埠|SFP\+|XGS\d|TL-S[XG]|SG\d{3,4}|MS\d{3,4}"), ("Wi-Fi 延伸器", r"延伸器|訊號延伸|Range\s*Extender|Wi-?Fi\s*擴充|\bRE\d{3}\b|AC1200.*延伸|AX\d+.*延伸"),
    ("無線基地台 / AP", r"\bEAP\d|吸頂式|吸頂|Omada|無線基地台|Access\s*Point|企業級.*AP"), ("無線路由器", r"路由器|分享器|ROUTER|\bARCHER\b\s*(?:[^\sT]|T[^X]|T?$)"),
    ("NAS 網路儲存", "NAS|SYNOLOGY|群暉|QNAP|威聯通|華芸|ASUSTOR|DISKSTATION"),
)
_USB = r"TYPE-?[AC]|USB|THUNDERBOLT|\bTB[34]\b|充電線|傳輸線"
#: (first level, when, second levels, second level where none holds)
CABLES = (
    ("切換器 / 分配器", ("切換器|分配器|KVM|[一二三四]進[一二三四]出",), (("KVM 切換器", r"\bKVM\b"), ("訊號分配器", r"分配|一分|一進[二三四五]出|1\s*進")), "訊號切換器"),
    ("網路線", (r"網路線|\bCAT\.?\s?[5-8]",), (("CAT.8", r"CAT\.?\s*8"), ("CAT.7", r"CAT\.?\s*7"), ("CAT.6A", r"CAT\.?\s*6A"), ("CAT.6", r"CAT\.?\s*6"), ("CAT.5E", r"CAT\.?\s*5")), "其他網路線"),
    ("機內排線 / 延長線", (r"排線|SFF\d*|SAS|\bIDE\b|(PCI-?E|\d+\s?-?\s?PIN|12VHPWR|12V-2X6|ARGB|EPS12V|STRIMER).{0,24}延長", (r"12VHPWR|12V-2X6|12\+4", "電源線|延長|Equalizer")), (
        ("12VHPWR 電源延長", r"12VHPWR|12V-2X6|12\+4|PW16"), ("24Pin 電源延長", r"24\s*-?\s*PIN|PW24"), ("8Pin 電源延長", (r"2\s*[xX*×]\s*8|2\*8|8\s*-?\s*PIN|PW8", "延長|電源|STRIMER|ARGB")),
        ("ARGB 延長線", "ARGB|STRIMER|發光"), ("PCIe 延長線", "PCI-?E|顯卡延長"), ("SATA 排線", "SATA")), "其他機內線"),
    ("電源延長線 / 插座", (r"插座|排插|防雷|過載|延長座|\d+插|電源.{0,4}延長線|延長.{0,3}電源線",), (("延長線插座", r"插座|排插|防雷|過載|延長座|\d+\s*切|\d+\s*座"),), "電源線"),
    ("轉接頭 / 轉接線", ("轉接頭|轉接器|轉接線",), (("HDMI 轉接", "HDMI"), ("DP 轉接", r"DISPLAY\s*PORT|\bDP\b"), ("網路口轉接", r"RJ-?45|\bLAN\b|乙太|網路"), ("USB 轉接", "TYPE-?[AC]|USB")), "其他轉接"),
    ("影音線", (("!" + _USB, r"HDMI|DISPLAY\s*PORT|\bDP\b|\bDVI|\bVGA\b|D-?SUB|音源|光纖|TOSLINK"),), (
        ("HDMI", "HDMI"), ("DisplayPort", r"DISPLAY\s*PORT|\bDP\b"), ("DVI", r"\bDVI"), ("VGA", r"\bVGA\b|D-?SUB"), ("音源 / 光纖", r"音源|光纖|TOSLINK|3\.5\s*MM")), "其他影音"),
    ("USB / 傳輸線", (_USB,), (
        ("Thunderbolt", r"THUNDERBOLT|\bTB[34]\b"), ("多接頭充電線", ("LIGHTNING", r"TYPE-?\s*C|四合一|多合一")),
        ("Type-C to C", r"TYPE-?\s*C.{0,16}(?:TO|轉|對).{0,12}(?:TYPE-?\s*)?C|C\s*(?:TO|轉|對)\s*(?:TYPE-?\s*)?C"), ("Type-A to C", r"TYPE-?\s*A.{0,16}(?:TO|轉|對).{0,12}(?:TYPE-?\s*)?C|A\s*(?:TO|轉|對)\s*(?:TYPE-?\s*)?C"),
        ("Lightning", "LIGHTNING"), ("充電線", "充電線")), "其他 USB"),
)
OTHER_CABLE = "其他線材"
SOFTWARE = (
    ("應用軟體 > 防毒軟體", "防毒|防護|資安|ANTIVIRUS|NORTON|MCAFEE|KASPERSKY|卡巴斯基|諾頓|趨勢|PC-?CILLIN"),
    ("應用軟體 > 辦公軟體", (r"OFFICE|MICROSOFT\s*365|文書|WORD|EXCEL|POWERPOINT|OUTLOOK", r"!WINDOWS\s*11|WIN\s*11|WINDOWS\s*10\s*(?:家用|專業)|WIN\s*10\s*(?:家用|專業)")),
    ("作業系統 > Windows 11", r"WIN\s?11|WINDOWS\s?11"), ("作業系統 > Windows 10", r"WIN\s?10|WINDOWS\s?10"), ("作業系統 > Windows Server", r"WINDOWS\s*SERVER|SERVER\s*20\d\d"),
    ("作業系統 > 其他作業系統", r"作業系統|WINDOWS|LINUX|CHROME\s*OS"),
)

VENDORS = (("原價屋 酷!PC", r"酷\s*[!！]\s*PC"), ("欣亞PC", "欣亞PC"), ("欣亞精選主機", "精選遊戲主機|精選主機|JOHN選|限定主機"), ("捷元", "捷元|Genuine"), ("ASRock", "DeskMini|DeskMeet"), ("MSI", r"PRO\s*DP21|\bCUBI\b"))
HANDHELD = r"掌機|ROG\s*(?:XBOX\s*)?ALLY|CLAW\s*A\d|STEAM\s*DECK|LEGION\s*GO"
SMALL_PC = r"準系統|迷你主機|迷你電腦|MINI\s*PC(?:[^I]|I[^E]|I?$)|\bNUC\b|\bCUBI\b|\bBRIX\b|DeskMini|DeskMeet|PRO\s*DP21|CPU\.RAM\.DISK選購"
FULL_PC = "品牌電腦|品牌機|套裝電腦|套裝主機|桌上型主機|桌上型電腦|電競電腦|欣亞PC|整機電腦|整機主機"
_PSU = r"~電源|電供|\d{3,4}\s?W\b|全模組|半模組|" + "|".join(D.RULES["psu_model"])
_COOLER = r"水冷|散熱器|塔散|\bAIO\b|龍王|龍神|WATERFORCE|飛鷹|鷹魂|\bLC\s*\d{3}\b|\bNX\d{3}\b"
_CASE = r"機殼|透側|玻璃側|全景玻璃|進氣孔|網狀|MESH|CPU高|顯卡長|\bM-?ATX\b|\bE?-?ATX\b|\bITX\b"
#: What goes together in a bundle of parts; ``~`` is the title without plus signs that join nothing.
COMBOS = (
    ("散熱器 + 電源", (_PSU, _COOLER)), ("機殼 + 電源", (_PSU, _CASE)), ("散熱器 + 機殼", (_COOLER, _CASE)), ("CPU + 主機板", (D.CPU_NAME, D.CHIPSET + "|主機板")),
    ("主機板 + 記憶體/儲存", (D.CHIPSET, r"DDR[45]|記憶體|SSD|NVMe|\d+\s?TB")), ("螢幕 + 周邊", "螢幕|顯示器|MONITOR"), ("周邊套裝", "鍵盤|滑鼠|耳機|鼠墊|鍵鼠|光鍵|靈刃"), ("顯卡搭購組", D.GPU_NAME),
)
OTHER_COMBO = "其他組合"


def _brand(name: Column, known: Column | None) -> Column:
    return extract_brand(name) if known is None else known


def _tier(name: Column) -> Column:
    """Millimetres of a tower by what stands behind the word for height; small bare numbers are centimetres."""
    ways = (r"高\s*(\d+(?:\.\d+)?)\s*(cm|mm)?", r"(?:高度|Height)\s*[：:]?\s*(\d+(?:\.\d+)?)\s*(cm|mm)?")
    number = F.coalesce(*[extract(name, p, 1) for p in ways]).cast("double")
    unit = F.lower(F.coalesce(*[extract(name, p, 2) for p in ways]))
    mm = F.when((unit == "cm") | ((unit == "") & (number < 30)), number * 10).otherwise(number)
    return let(mm, lambda x: F.coalesce(*[F.when(x <= most, label) for most, label in HEIGHT_TIERS], F.when(x.isNotNull(), "161mm 以上"), F.lit(NO_SIZE)))


def cooler_path(name: Column) -> Column:
    """Accessories; water: type > radiator > light; air: type > height tier > light."""
    light = F.coalesce(first_label(name, LIGHTS), F.lit(NO_LIGHT))
    radiator = F.coalesce(F.concat(extract(name, r"(?:^|\D)(120|240|280|360|420)(?:\D|$)", 1), F.lit("mm")), F.lit(NO_SIZE))
    shown = lambda kind: F.when(kind.startswith(PASTE), kind).when(kind == "一體式水冷 (AIO)", path(kind, radiator, light)).otherwise(path(kind, _tier(name), light))
    return let(choose(name, COOLER_TYPES, ONE_TOWER), shown)


def case_path(name: Column, brand: Column | None = None) -> Column:
    """Largest board > brand > series of the brand."""
    series = lambda b: F.coalesce(*[F.when(b == maker, first_label(name, table)) for maker, table in CASE_SERIES.items()])
    return let(_brand(name, brand), lambda b: path(choose(name, CASE_FORMS, NO_FORM), b, series(b)))


def monitor_inch(name: Column) -> Column:
    """Inches as written, else by the numbers of models: mainstream sizes first, then the first one."""
    said = lambda p: F.floor(extract(name, p, 1).cast("double") + 0.5).cast("int")
    sane = lambda n: F.when(n.between(10, 120), n)
    explicit = F.coalesce(sane(said(r"【\s*(\d{2}(?:\.\d)?)\s*型\s*】")), sane(said(r"(\d{2}(?:\.\d)?)\s*(?:吋|型|inch|\"|″)")))
    text = name
    for p in MONITOR_NOISE:
        text = replace(text, p, " ", True)
    lines = F.regexp_extract_all(name, F.lit(pattern(r"\b(?:MAG|MPG)\s+(\d{2})", True)), 1)
    tokens = F.regexp_extract_all(text, F.lit(pattern(r"\b[A-Z]*\d{2,4}[A-Z0-9]*\b", True)), 0)
    models = F.filter(tokens, lambda t: t.rlike("(?i)[A-Z]") & ~t.rlike(r"(?i)^(?:E\d{1,2}|X1\d|X2[0-5])$"))
    numbers = F.transform(F.concat(lines, F.transform(models, lambda t: F.regexp_extract(t, r"(\d{2})", 1))), lambda x: x.cast("int"))
    known = F.filter(numbers, lambda n: n.isin(*MONITOR_INCHES))
    best = let(known, lambda k: F.coalesce(F.try_element_at(F.filter(k, lambda n: n.isin(*MAINSTREAM_INCHES)), F.lit(1)), F.try_element_at(k, F.lit(1))))
    return F.coalesce(explicit, best)


def monitor_path(name: Column, brand: Column | None = None) -> Column:
    """Size [> inches] > brand."""

    def size(n: Column) -> Column:
        inches = F.concat(n.cast("string"), F.lit("吋"))
        wide = F.coalesce(*[F.when(n == k, label) for k, label in WIDE_INCHES.items()])
        under = lambda label: F.concat(F.lit(f"{label} > "), inches)
        return F.coalesce(wide, F.when(n.isin(*MAINSTREAM_INCHES), inches).when(n <= 21, under("可攜 / 小尺寸")).when(n >= 43, under("大型顯示器")).when(n.isNotNull(), under("其他尺寸")), F.lit("其他尺寸 > 未標吋數"))

    return path_skip(let(monitor_inch(name), size), _brand(name, brand))


def _link(name: Column) -> Column:
    return F.when(has(name, WIRELESS), "無線").otherwise("有線")


def keyboard_path(name: Column, brand: Column | None = None) -> Column:
    """Mechanism > [switch] > wired or wireless > brand."""
    kind = F.when(holds(name, MECHANICAL), F.concat(F.lit("機械式鍵盤 > "), F.coalesce(keyboard_switch(name), F.lit("未標軸")))).otherwise("薄膜鍵盤")
    return path(kind, _link(name), _brand(name, brand))


def mouse_path(name: Column, brand: Column | None = None) -> Column:
    """Use > wired or wireless > brand."""
    return path(choose(name, MICE, "一般滑鼠"), _link(name), _brand(name, brand))


def headset_path(name: Column, brand: Column | None = None) -> Column:
    return path(choose(name, HEADSETS, "有線耳機"), _brand(name, brand))


def speaker_path(name: Column, brand: Column | None = None) -> Column:
    return path(choose(name, SPEAKERS, "其他喇叭"), _brand(name, brand))


def fan_path(name: Column) -> Column:
    return choose(name, FANS, "其他尺寸風扇")


def network_path(name: Column, brand: Column | None = None) -> Column:
    return path(choose(name, NETWORK, "其他網通設備"), _brand(name, brand))


def cable_path(name: Column) -> Column:
    return tree(name, CABLES, OTHER_CABLE)


def os_path(name: Column) -> Column:
    return choose(name, SOFTWARE, "應用軟體 > 其他軟體")


def system_brand(name: Column) -> Column:
    """The brand in the earliest of the first four words, else in the first twelve characters: parts are named later."""
    head = F.trim(replace(name, r"【[^】]*】|\([^)]*\)|\[[^\]]*\]", " "))
    words = F.slice(F.filter(F.split(F.substring(head, 1, 32), pattern(r"[\s/,|]+")), lambda w: w != ""), 1, 4)
    found = F.filter(F.transform(words, extract_brand), lambda b: b.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), extract_brand(F.substring(head, 1, 12)))


def package_vendor(name: Column) -> Column:
    return F.coalesce(choose(name, VENDORS), system_brand(name))


def combo_type(name: Column, neutral: Column) -> Column:
    """What a bundle joins; neutral is its title without plus signs that join nothing."""
    return choose(name, COMBOS, OTHER_COMBO, neutral)


def package_path(name: Column, neutral: Column, server: Column, laptop_like: Column, complete: Column) -> Column:
    """Server, handheld, laptop, small and complete systems with their brand or vendor, else the kind of bundle."""
    kind = (
        F.when(server, "伺服器 / 工作站").when(has(name, HANDHELD), "掌機").when(laptop_like & has(name, D.STORAGE), "筆電").when(has(name, SMALL_PC), "準系統 / 迷你 PC").when(complete | has(name, FULL_PC), "整機電腦")
        .otherwise("零件組合")
    )
    vendor = lambda k: F.when(k.isin("準系統 / 迷你 PC", "整機電腦"), choose(name, VENDORS))
    return let(kind, lambda k: path(k, F.when(k == "零件組合", combo_type(name, neutral)).otherwise(F.coalesce(vendor(k), system_brand(name)))))


PATHS = {
    "cooler": cooler_path, "case": case_path, "monitor": monitor_path, "keyboard": keyboard_path, "mouse": mouse_path, "headset": headset_path, "speaker": speaker_path, "fan": fan_path,
    "network": network_path, "cable": cable_path, "os": os_path,
}
#: Categories whose path names the brand.
BRANDED = ("case", "monitor", "keyboard", "mouse", "headset", "speaker", "network")
