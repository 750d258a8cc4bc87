"""Data-quality checks, each a count that should be zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import rules as R
from offerloom.functions.detect import bundle_reason
from offerloom.operators.match import exact_match_key, unconditioned
from offerloom.operators.once import package_reason

MAX_SPREAD = 1.8


# What a title must not hold in a category: (check, categories, LIKE patterns of raw_name, any of which counts).
# A tuple of patterns must all match; a pattern after NOT must not.
TITLE_CHECKS: tuple[tuple[str, tuple[str, ...], tuple], ...] = (
    ("gpu_brackets", ("gpu",), ("%支撐架%", "%延長線%", "%橋接%")),
    ("cases_in_cpu", ("cpu",), ("%機殼%", "%case%")),
    ("boards_in_cpu", ("cpu",), tuple(f"%{c}%" for c in ("Z890", "W890", "Z790", "W790", "B860", "B760", "H810", "H610", "X870", "WRX90", "TRX50", "B850", "B840", "B650", "A620", "B550", "A520"))),
    ("non_monitors", ("monitor",), tuple(f"%{w}%" for w in ("投影機", "螢幕掛燈", "螢幕架", "升降桌", "水冷", "電源供應", "鍵盤", "ScreenBar", "ERGO ARM", "萬用螢幕", "擴充螢幕", "洞洞板"))),
    ("parts_in_gpu", ("gpu",), (("%風扇%", "%PWM%"), ("%風扇%", "%RPM%"), ("%風扇%", "%軸承%"), ("%80+%", "%全模組%"), ("%80+%", "%半模組%"), ("%80+%", "%ATX3.%"))),
    ("accessories_in_motherboard", ("motherboard",), ("%延長線%", "%【PCI-E%】%USB%", "%【PCI-E%】%Type-C%")),
    ("gpu_bundles", ("gpu",), ("%【AI TOP%/%RTX%", "%【AI TOP%/%RX%", "%】+%RTX%", "%】+%RX%")),
    ("gpu_systems", ("gpu",), ("%欣亞PC%", "%品牌電腦%", "%電競電腦%", "%套裝電腦%", "%Windows 11 Home%", "%/Win11/%", "%ZEUS 15G%/%RTX%")),
    ("portable_power_in_psu", ("psu",), tuple(f"%{w}%" for w in ("行動電源", "mAh", "快充", "GaN", "音響", "喇叭"))),
    ("accessories_in_case", ("case",), tuple(f"%{w}%" for w in ("TRAVEL CASE", "ALLY", "掌機", "收納", "保護包", "保護套"))),
    ("external_disks_in_ssd", ("ssd",), tuple(f"%{w}%" for w in ("外接硬碟", "行動硬碟", "My Book", "Expansion Desktop", "新黑鑽", "雙硬碟"))),
    ("systems_in_parts", ("ssd", "cooler"), tuple(f"%{w}%" for w in ("ASUS Ascent GX10", "GB10", "DGX Spark", "GM700TZ", "AI TOP ATOM"))),
    ("monitors_in_speaker", ("speaker",), ("%螢幕%", "%顯示器%", "%含喇叭%HDR%", "%含喇叭%HDMI%", "%含喇叭%VA%", "%Smart M7%")),
    ("non_disks_in_hdd", ("hdd",), tuple(f"%{w}%" for w in ("耳機", "耳麥", "HDMI", "RPM", "PWM", "風扇", "燈效", "3Pin"))),
    ("non_fans", ("fan",), (*(f"%{w}%" for w in ("RTX", "GTX", "水冷", "一體式", "全模組")), ("%集線器%", "NOT %內含風扇集線器%"), "%支撐架%", "%千斤頂%", "%燈條%")),
    ("non_network", ("network",), tuple(f"%{w}%" for w in ("印表機", "複合機", "連續供墨", "充電座", "行動電源", "耳麥", "耳機", "鍵鼠", "掌機", "ALLY", "HDMI"))),
    ("furniture", ("keyboard", "mouse", "speaker", "cooler"), tuple(f"%{w}%" for w in ("電競椅", "電競桌", "升降桌", "辦公椅", "工學椅"))),
    ("non_cables", ("cable",), tuple(f"%{w}%" for w in ("電競螢幕", "液晶螢幕", "集線器", "立架", "外接盒", "讀卡機"))),
)
#: The name, not the title, is looked at by these.
ON_NAME = ("gpu_brackets", "cases_in_cpu")
# Conditions on paths and categories, as SQL over category, raw_name and subcategory.
PATH_CHECKS = {
    "split_cooler_heights": "category = 'cooler' AND subcategory LIKE '%空冷 > %mm >%' AND subcategory NOT LIKE '%以下%' AND subcategory NOT LIKE '%以上%' AND subcategory NOT LIKE '%–%'",
    "gpu_wrong_series": "category = 'gpu' AND (((lower(raw_name) LIKE '%rx9070%' OR lower(raw_name) LIKE '%rx 9070%') AND subcategory NOT LIKE 'AMD RX 9000系列%') OR (lower(raw_name) LIKE '%rtx pro 6000%' AND subcategory NOT LIKE 'NVIDIA 專業繪圖卡%'))",
    "old_cpu_generations": "category = 'cpu' AND (" + " OR ".join(f"subcategory LIKE '%第 {k} 代%'" for k in range(1, 10)) + ")",
    "optical_drives": "category <> 'package' AND (raw_name LIKE '%燒錄機%' OR raw_name LIKE '%燒錄器%')",
}


def title_check_sql(name: str, categories: tuple[str, ...], words: tuple) -> str:
    """A check of TITLE_CHECKS as a condition; ASCII letters match in either case, as LIKE does in the tables' first home."""
    column = "name" if name in ON_NAME else "raw_name"
    one = lambda w: f"lower({column}) NOT LIKE '{w[4:].lower()}'" if w.startswith("NOT ") else f"lower({column}) LIKE '{w.lower()}'"
    any_ = " OR ".join("(" + " AND ".join(map(one, w)) + ")" if isinstance(w, tuple) else one(w) for w in words)
    return f"category IN ({', '.join(repr(c) for c in categories)}) AND ({any_})"


def sql_checks() -> dict[str, str]:
    """All checks that are plain conditions on a listing, by name."""
    return {n: title_check_sql(n, c, w) for n, c, w in TITLE_CHECKS} | PATH_CHECKS


def _condition(df: DataFrame) -> Column:
    return F.coalesce(F.try_element_at("specs", F.lit("priceCondition")), F.lit("")) != "" if "specs" in df.columns else F.lit(False)


def listing_checks(df: DataFrame) -> dict[str, Column]:
    """Conditions that no listing should meet."""
    no_path = F.coalesce(F.col("subcategory"), F.lit("")) == ""
    return {
        "category_other": F.col("category") == "other",
        "category_removed": ~F.col("category").isin(*R.CATEGORIES),
        "package_without_subcategory": (F.col("category") == "package") & no_path,
        "cable_without_subcategory": (F.col("category") == "cable") & no_path,
        "condition_outside_package": (F.col("category") != "package") & _condition(df),
        **{n: F.coalesce(F.expr(c), F.lit(False)) for n, c in sql_checks().items()},
        "non_bundles": (F.col("category") == "package") & F.col("bundle_reason").isNull() & ~_condition(df),
    }


def price_spread(groups: DataFrame) -> Column:
    return (F.col("has_multiple_sources") == 1) & (F.col("highest_price") > F.col("lowest_price") * MAX_SPREAD)


def _rows(df: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("count")) for n in names])
    return df.select(F.inline(pairs))


def count_listings(listings: DataFrame, names: list[str]) -> DataFrame:
    """check and count of some checks on rows, in one scan."""
    listings = listings if "bundle_reason" in listings.columns else package_reason(listings) if "non_bundles" in names else listings.withColumn("bundle_reason", F.lit(None).cast("string"))
    checks = listing_checks(listings)
    return _rows(listings.agg(*[F.count_if(checks[n]).alias(n) for n in names]), names)


def run_audit(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """check, count and passed: one scan of the listings for all conditions on rows, one of the groups, two groupings."""
    per_row = count_listings(listings, list(listing_checks(listings.withColumn("bundle_reason", F.lit(None).cast("string")))))
    spread = _rows(groups.agg(F.count_if(price_spread(groups)).alias("price_spread")), ["price_spread"])
    keyed = unconditioned(listings).select(exact_match_key(listings).alias("key"), "match_group_id").where("key is not null")
    split = lambda df, name, *by: _rows(df.groupBy(*by).agg(F.min("match_group_id").alias("l"), F.max("match_group_id").alias("h")).agg(F.count_if(F.col("l") != F.col("h")).alias(name)), [name])
    cpus = unconditioned(listings).where("category = 'cpu' and brand <> '' and model <> ''")
    found = per_row.union(spread).union(split(keyed, "key_split", "key")).union(split(cpus, "model_split", "brand", "model"))
    return found.withColumn("passed", F.col("count") == 0)


def audit_samples(listings: DataFrame, groups: DataFrame, check: str, n: int = 5) -> DataFrame:
    """Rows that a check counts, n at most."""
    if check == "price_spread":
        return groups.where(price_spread(groups)).orderBy(F.desc(F.col("highest_price") / F.col("lowest_price")), "id").limit(n)
    listings = listings if "bundle_reason" in listings.columns else bundle_reason(listings)
    return listings.where(listing_checks(listings)[check]).orderBy("id").limit(n)
