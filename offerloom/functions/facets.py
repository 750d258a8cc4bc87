"""Facets of boards and monitors from their titles, kept in the specs of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import parts
from offerloom.functions.gear import monitor_inch
from offerloom.functions.pick import choose
from offerloom.functions.text import extract, let

UNSTATED = "未標示"
# Labels and patterns of all facets, in the order in which they are tried.
BOARD_FORMS = (
    ("E-ATX", r"\bE-?ATX\b|\bEEB\b|\bEATX\b"), ("M-ATX", r"\bM-?ATX\b|\bMATX\b|MICRO-?ATX"), ("Mini-ITX", r"\bMINI-?ITX\b|MINI\s*ITX|\bITX\b"), ("ATX", r"\bATX\b"),
    ("M-ATX", r"\b(?:Z|B|H|X|A|W)\d{3}E?M\b"), ("Mini-ITX", r"\b(?:Z|B|H|X|A|W)\d{3}E?I\b|-(?:I)\s+(?:GAMING|WIFI)"),
)
BOARD_SLOTS = (("8 槽", r"8\s*[xX×*]?\s*DIMM|8DIMM|八槽"), ("4 槽", r"4\s*[xX×*]?\s*DIMM|4DIMM|4\s*槽|四槽"), ("2 槽", r"2\s*[xX×*]?\s*DIMM|2DIMM|2\s*槽|兩槽|雙槽"))
BOARD_WIFI = (
    ("Wi-Fi 7", r"WI-?FI\s*7"), ("Wi-Fi 6E", r"WI-?FI\s*6E"), ("Wi-Fi 6", r"WI-?FI\s*6", (r"\bAX\b", "!ARGB")), ("有 Wi-Fi", r"\bWI-?FI\b|無線"),
    ("無 Wi-Fi", (r"(?:Realtek|Intel)\s*[\d.]+\s*Gb|LAN\s*[\d.]+G|[\d.]+\s*Gb(?:E)?\b", "相")),
)
BOARD_MEMORY = (
    ("DDR4/DDR5", (r"D4\s*[&＆+/／]\s*D5|D5\s*[&＆+/／]\s*D4|支援\s*D4\s*[&＆].*D5|DDR4\s*[/／]\s*DDR5|COMBO\s*II", "D4|D5|DDR"), (r"COMBO\s*II", "H610")), ("DDR4", r"DDR4|\bD4\b"), ("DDR5", r"DDR5|\bD5\b"),
)
#: Memory of sockets that take one kind, and of sockets that a title spells out.
SOCKET_MEMORY = {
    "DDR5": ("AMD AM5", "Intel LGA1851", "AMD sTR5", "AMD sWRX8", "Intel LGA4677"), "DDR4": ("AMD AM4", "Intel LGA1200", "Intel LGA1151", "Intel LGA1150"),
}
SPELLED_MEMORY = (("DDR5", r"\bAM5\b|LGA\s?1851"), ("DDR4", r"\bAM4\b|LGA\s?12\d{2}"))
#: Boards of the socket that takes both kinds: cheap ones that are DDR4 without saying so; the rest are DDR5.
BOTH_MEMORY = r"LGA\s?1700|\b(?:Z790|B760|H610|W680|B660|Z690|H670|B760M|Z790M)\b"
SILENT_DDR4 = r"\bB760M\s*H(?:[^A-Z0-9]|V2(?:[^A-Z0-9]|$)|$)|\bH610M-H2\b|\bH610M-(?:HDV|HVS)(?:\/M\.2)?\b"
BOARD_LAN = (
    ("10GbE", r"10\s*G(?:b|be)?|LAN\s*10"), ("2.5GbE", r"2\.5\s*G"), ("5GbE", r"LAN\s*5G|5G\s*LAN|(?:^|[^.\d])5\s*Gb|Realtek\s*5Gb|5G\+Wi"), ("1GbE", r"\b1\s*G(?:b)?\s*(?:LAN)?|LAN\s*1G|Realtek\s*1Gb"),
)

PANELS = (
    ("QD-OLED", "QD-?OLED"), ("OLED", r"\bOLED\b|WOLED"), ("Mini-LED", r"MINI-?\s*LED"), ("IPS", r"\bIPS\b|FAST\s*IPS|NANO\s*IPS|AHVA"), ("VA", r"\bVA\b|FAST\s*VA"), ("TN", r"\bTN\b"), ("量子點", r"量子點|\bQLED\b"),
)
#: Where a title states refresh rates; those beside a resolution first.
RATES = (*(rf"{x}\s*[-–]?\s*(\d{{2,3}})\s*Hz" for x in ("4K", "UHD", "QHD", "2K")), r"(\d{2,3})\s*Hz")
RATE_TIERS = ((100, "100Hz 以下"), (165, "120–165Hz"), (240, "170–240Hz"))
SHARP = "|".join((
    r"\b(?:4K|UHD|2K|QHD|WQHD|UWQHD|DQHD|5K|8K|6K)\b|3840|2160|2560\s*[x×]\s*1440|3440|5120", r"\b(?:MAG|MPG|XG|PG|VG|XV|PA|SW|CS|MP|M|G|X)\s*\d{2,3}U[A-Z0-9]*", r"\b(?:MAG|MPG|XG|PG|VG|XV|PA|SW|CS|MP|M|G)\s*\d{2,3}Q[A-Z0-9]*",
    r"\b(?:VG|XG|PG|VA|PA|XV)\s*\d{2}AQ|\bMAG\s*\d{0,3}CQ", r"\bQ2[47]\d|\bAW\d{4}|\bMP\d{3}[QU]|\bM\d{2}[QU]\b",
))
_4K, _2K, _BAND, _WIDE = "4K / UHD", "2K / QHD", "帶魚 (DQHD)", "超寬 (UWQHD)"
_OFFICE = ("#27", "!" + SHARP, r"!\b(?:ROG|Swift|Strix|Odyssey|Predator\s*X|QD-?OLED|WOLED)\b")
RESOLUTIONS = (
    (_BAND, r"5120\s*[x×]\s*1440|DQHD|5K2K"), (_WIDE, r"3440\s*[x×]\s*1440|UWQHD|21\s*:\s*9.{0,20}3440|3440.{0,12}21\s*:\s*9"), ("超寬 (UWFHD)", r"2560\s*[x×]\s*1080|UWFHD"), ("8K", r"7680\s*[x×]\s*4320|\b8K\b"), ("5K", r"5120\s*[x×]\s*2880|\b5K\b"),
    (_4K, r"3840\s*[x×]\s*2160|\bUHD\b|\b4K\b|2160P"), (_2K, r"2560\s*[x×]\s*1440|\bQHD\+?\b|\bWQHD\b|\b2K\b|1440P"), ("FHD", r"1920\s*[x×]\s*1080|\bFHD\b|FULL\s*HD|1080P"),
    (_BAND, "#49,57"), (_WIDE, "#34"), (_BAND, r"\bPD\s*49\b"), (_4K, r"\b\d{2}U\d{3}[A-Z0-9-]*|\b\d{3}UP[A-Z0-9]*|\bRD\d{3}U\b|\bPE\d{3}QK", (r"\bX32\b", r"\bOLED\b")), (_BAND, ("#39,45", r"\bOLED\b")), ("FHD", ("#14", "!" + SHARP)),
    (_4K, r"\bAW\d{4}Q\b"), (_2K, r"\bAW\d{4}[A-Z]*|\bAlienware\b"), (_4K, r"\bMAG\s*\d{0,3}CUP[A-Z0-9]*|\b\d{3}CUP[A-Z0-9]*"), (_2K, r"\bMAG\s*\d{0,3}CQ[A-Z0-9]*|\b\d{2,3}CQ[FP]|\b(?:VG|XG|PG|VA|PA|XV)\s*\d{2}AQ[A-Z0-9]*|\bQ2[47]\d[A-Z0-9]*|\bQ32[A-Z0-9]*|\bXG\s*\d{2}(?:AC|WC)[A-Z0-9]*"),
    (_4K, r"\bPA\d{2}U[A-Z0-9]*|\bSW\d{3}U[A-Z0-9]*|\b(?:MAG|MPG|XG|PG|VG|XV|PA|SW|CS|PD|FO|MO|GO|EV)\s*\d{2,3}U[A-Z0-9]*\b|\bM\d{2}U[A-Z0-9]*\b|\bG\d{2,3}U[A-Z0-9]*\b|\bX\d{2}U[A-Z0-9]*\b|\bMP\d{3}U"),
    ("FHD", r"\bMAG\s*2[457]\d[A-PR-Z]*F\b|\bG24\d[A-Z]*\b"), (_2K, r"\b(?:MAG|MPG|XG|PG|VG|XV|PA|SW|CS|FO|MO|GO|EV|MP)\s*\d{2,3}Q[A-Z0-9]*\b|\bM\d{2}Q[A-Z0-9]*\b|\bG\d{2,3}Q[A-Z0-9]*\b|\bMP\d{3}Q"),
    (_2K, r"\b(?:KG|XB|XV|VG|ED|GA|SG)\d{3}U[A-Z0-9]*|\bEX\d{3}[QU][A-Z0-9]*"), ("FHD", r"\bED27\d(?:[^QU]|$)|\bS\d{2}CG\d"), (_2K, r"\bS\d{2}(?:DG|FG8|HG8|FG6)\d"), ("FHD", ("#15-25", "!" + SHARP)),
    ("FHD", (*_OFFICE, r"\b(?:PRO\s*)?MP\d{3}(?:[^QU]|$)|\b(?:MD|GW|BL|EK|KA|SA|SB|VY|VZ|VP|VS)\s*\d{3}|\b(?:DELL\s*)?(?:P|SE)\d{4}"), (*_OFFICE, r"\bVA\d{3}", r"!\bVA\d{3}[A-Z]*Q|\bVA\d{2}AQ", r"!\b(?:TUF|Gaming|ROG)\b"),
     (*_OFFICE, r"\b(?:IPS|VA|TN)\b", r"!\b(?:MAG|MPG|XG|PG|TUF|ROG|Nitro|Odyssey|AGON|Predator)\b")),
    ("超寬 (UWFHD)", ("#29", "!" + SHARP)), ("FHD", ("#32", "!" + SHARP, r"\b(?:IPS|VA|TN)\b", r"!\b(?:MAG|MPG|XG|PG|ROG|Odyssey|Predator|OLED)\b")),
)
BOARD_KEYS, MONITOR_KEYS = ("mbForm", "mbDimm", "mbWifi", "mbDdr", "mbLan"), ("panel", "refreshTier", "resolution")


def board_memory(name: Column) -> Column:
    """DDR5, DDR4 or both as written, else by the socket of the chipset or the one spelled out."""
    sockets = F.create_map(*[F.lit(x) for s, names in parts.CHIPSETS for c in names for x in (c, s)])

    def of(socket: Column) -> Column:
        one = F.coalesce(*[F.when(socket.isin(*names), ddr) for ddr, names in SOCKET_MEMORY.items()], choose(name, SPELLED_MEMORY))
        both = F.when((socket == "Intel LGA1700") | name.rlike("(?i)" + BOTH_MEMORY), choose(name, (("DDR4", SILENT_DDR4),), "DDR5"))
        return F.coalesce(choose(name, BOARD_MEMORY), one, both, F.lit(UNSTATED))

    return let(F.try_element_at(sockets, parts.motherboard_chipset(name)), of)


def motherboard_facets(name: Column) -> Column:
    """Struct of form, memory slots, wireless, memory and wired network; what is not stated is said so."""
    form = choose(name, BOARD_FORMS, UNSTATED)
    slots = F.coalesce(choose(name, BOARD_SLOTS), F.when(form == "Mini-ITX", "2 槽"), F.lit(UNSTATED))
    values = (form, slots, choose(name, BOARD_WIFI, UNSTATED), board_memory(name), choose(name, BOARD_LAN, UNSTATED))
    return F.struct(*[v.alias(k) for k, v in zip(BOARD_KEYS, values, strict=True)])


def monitor_facets(name: Column) -> Column:
    """Struct of panel, refresh tier and resolution from a title."""
    rate = F.coalesce(*[extract(name, p, 1) for p in RATES]).cast("int")
    tier = F.coalesce(*[F.when(rate.between(30, most), label) for most, label in RATE_TIERS], F.when(rate.between(241, 1000), "240Hz 以上"), F.lit(UNSTATED))
    resolution = let(monitor_inch(name), lambda n: choose(name, RESOLUTIONS, UNSTATED, number=n))
    return F.struct(*[v.alias(k) for k, v in zip(MONITOR_KEYS, (choose(name, PANELS, UNSTATED), tier, resolution), strict=True)])


def finalize_specs(df: DataFrame, raw: str = "raw_name") -> DataFrame:
    """df without facets of other categories in specs, and with those of its own."""
    c, name = F.col("category"), F.col(raw)
    specs = F.col("specs") if "specs" in df.columns else F.lit(None).cast("map<string,string>")
    pairs = lambda s, keys: F.create_map(*[x for k in keys for x in (F.lit(k), s[k])])
    own = F.when(c == "monitor", let(monitor_facets(name), lambda s: pairs(s, MONITOR_KEYS))).when(c == "motherboard", let(motherboard_facets(name), lambda s: pairs(s, BOARD_KEYS)))
    kept = F.map_filter(specs, lambda k, _: ~k.isin(*BOARD_KEYS, *MONITOR_KEYS))
    return df.withColumn("specs", F.when(own.isNull(), kept).otherwise(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), own)))
