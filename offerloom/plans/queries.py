"""The registered queries of the catalogue library and the SQL they are held against.

Every query reads listings made from the star-schema tables, price
observations or run logs made from the event stream, or those tables
themselves; the SQL says the same independently, over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import detect, detect_rules, facets, gear, names, parts, storage
from offerloom.functions import rules as R
from offerloom.functions.pick import choose_sql, holds_sql, tree_sql
from offerloom.operators import audit, catalogue, groups, history, ingest, match, serve
from offerloom.operators.graph import cut, shared_folder
from offerloom.operators.once import once
from offerloom.plans.titles import GEAR_SQL, NODES, NODES_SQL, TITLES_SQL
from offerloom.sources import feeds, pages, tables
from offerloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
SOURCES = ["s0", "s1", "s2"]


# Derived inputs ------------------------------------------------------------


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with the columns that matching and serving read; names are cleaned by the generic steps, once."""
    raw = tables.listings(spark, folder)
    return cut(raw.withColumns({"name": names.generic_clean(F.col("raw_name")), "model": F.lit(None).cast("string"), "in_stock": F.col("price") % 5 != 0, "updated_at": F.col("scraped_at"), "specs": F.create_map(F.lit("size"), F.regexp_extract("raw_name", "([0-9]+)GB?", 1))}))


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Offers with one group for each part that two sources or more have, and their own for the rest."""
    o = offers(spark, folder)
    return cut(match.assign_group_ids(o, match.exact_groups(o)))


_CLEAN = "trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_name, '<[^>]+>', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '\\$\\s*[\\d,]+', ' ', 'g'), '\\s+', ' ', 'g')), '^[\\s,\\-、]+|[\\s,\\-、]+$', '', 'g'))"
_KEY = "upper('NAME-' || category || '-' || brand || '-' || list_aggregate(list_sort(list_distinct(regexp_extract_all(replace(upper(name), upper(brand), ' '), '[A-Za-z0-9]+'))), 'string_agg', ''))"
_OFFERS = f"""l AS ({tables.LISTINGS_SQL}),
o AS (SELECT *, {_CLEAN} AS name, price % 5 <> 0 AS in_stock, regexp_extract(raw_name, '([0-9]+)GB?', 1) AS size FROM l),
k AS (SELECT *, replace({_KEY}, ' ', '') AS key FROM o),
x AS (SELECT key FROM k WHERE length(name) >= 8 GROUP BY key HAVING count(DISTINCT source) > 1),
g AS (SELECT k.*, coalesce('match-' || substr(md5(x.key), 1, 12), 'mg-' || id) AS gid FROM k LEFT JOIN x ON k.key = x.key AND length(name) >= 8)"""
_GROUPS = f"""{_OFFERS},
p AS (SELECT gid, source, min(price) AS low FROM g GROUP BY gid, source),
m AS (SELECT gid AS id, min(low) AS lowest_price, max(low) AS highest_price, CAST(count(*) > 1 AS INT) AS has_multiple_sources FROM p GROUP BY gid),
n AS (SELECT gid AS id, min(struct_pack(n := length(name), name := name)).name AS name, max(brand) AS brand, max(category) AS category, max(subcategory) AS subcategory, max(scraped_at) AS updated_at FROM g GROUP BY gid),
grp AS (SELECT * FROM m JOIN n USING (id))"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.build_match_groups(grouped(spark, folder))


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Sources -------------------------------------------------------------------


@query(f"WITH l AS ({tables.LISTINGS_SQL}) SELECT id, source, raw_name, price, brand, category FROM l")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    all_ = tables.listings(spark, folder).select("id", "source", "raw_name", "price", "brand", "category")
    return feeds.union_sources(*[all_.where(F.col("source") == s) for s in SOURCES])


@query(f"WITH l AS ({tables.LISTINGS_SQL}) SELECT id, source || '-' || substr(md5(raw_name || '-' || CAST(price AS VARCHAR)), 1, 12) AS listing_id FROM l")
def listing_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tables.listings(spark, folder).select("id", feeds.listing_id(F.col("source"), F.col("raw_name"), F.col("price")).alias("listing_id"))


_OPTION = "p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' ↘' WHEN 1 THEN ' 漲' WHEN 2 THEN ' NEW' ELSE '' END || CASE p_partkey % 7 WHEN 0 THEN ' 缺貨' ELSE '' END || CASE p_partkey % 11 WHEN 0 THEN '' ELSE ' $' || CAST(p_size AS STRING) || ',' || CAST(100 + p_size AS STRING) END"


@query(f"""WITH o AS (SELECT p_partkey, {_OPTION} AS t FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\$\\s*[\\d,]+', ' ', 'g'), '[↘↗↓↑]', ' ', 'g'), '\\s+', ' ', 'g')) AS name,
       CAST(replace(regexp_extract(t, '\\$([0-9][0-9,]*)', 1), ',', '') AS BIGINT) AS price,
       CASE WHEN t LIKE '%↘%' OR t LIKE '%降%' THEN 'down' WHEN t LIKE '%↗%' OR t LIKE '%漲%' THEN 'up' WHEN t LIKE '%新品%' OR t LIKE '%NEW%' THEN 'new' END AS price_change,
       NOT regexp_matches(t, '缺貨|停售|售完') AS in_stock
FROM o WHERE t LIKE '%$%'""")
def parse_option_text(spark: SparkSession, folder: str) -> DataFrame:
    o = tables.view(spark, folder, f"SELECT p_partkey, {_OPTION} AS option FROM part", "part")
    return pages.parse_option_text(o).select("p_partkey", "name", "price", "price_change", "in_stock")


@query(f"""WITH o AS (SELECT p_partkey, {_OPTION} AS t FROM part)
SELECT CAST(p_partkey % 50 AS STRING) AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'n4' ELSE 'n5' END AS select_name, trim(t) AS option,
       CASE WHEN p_partkey % 4 = 0 THEN 'cpu' ELSE 'other' END AS category FROM o WHERE p_partkey % 4 <> 3""")
def parse_option_pages(spark: SparkSession, folder: str) -> DataFrame:
    # Each page: options of two selects, one of them in a group, and a select that is skipped.
    o = tables.view(spark, folder, f"SELECT p_partkey, {_OPTION} AS t FROM part", "part")
    tag = F.concat(F.lit("<option value='1'>"), F.col("t"), F.lit("</option>"))
    lists = o.groupBy((F.col("p_partkey") % 50).cast("string").alias("page_id")).agg(*[F.array_join(F.collect_list(F.when(F.col("p_partkey") % 4 == k, tag)), "").alias(f"k{k}") for k in range(4)])
    html = F.concat(F.lit("<html><select name='n4'><optgroup label='x'>"), "k0", F.lit("</optgroup></select><select name='n5'>"), "k1", "k2", F.lit("</select><select name='q_1'>"), "k3", F.lit("</select></html>"))
    made = lists.select("page_id", html.cast("binary").alias("content"))
    return pages.parse_option_pages(made, {"n4": "cpu"}, encoding="utf-8").select("page_id", "select_name", "option", "category")


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_size FROM part)
SELECT k AS feed_id, p_name AS name, CAST(p_size * 10 AS BIGINT) AS price, k % 3 <> 0 AS in_stock, p_brand AS brand, CASE WHEN k % 3 = 2 THEN 'c' || CAST(k % 2 AS STRING) END AS feed_key FROM p WHERE p_size > 0""")
def json_feeds(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.read_table(spark, folder, "part")
    item = F.concat(F.lit('{"prod_name":"'), "p_name", F.lit('","price":"'), (F.col("p_size") * 10).cast("string"), F.lit(' TWD","brand":"'), "p_brand", F.lit('","stock":"'), F.when(F.col("p_partkey") % 3 == 0, "0").otherwise("5"), F.lit('"}'))
    shape = F.col("p_partkey") % 3
    text = F.when(shape == 0, F.concat(F.lit("["), item, F.lit(",7]"))).when(shape == 1, F.concat(F.lit('{"ok":true,"products":['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"c'), (F.col("p_partkey") % 2).cast("string"), F.lit('":['), item, F.lit(',null],"note":"x"}')))
    items = feeds.explode_json_feed(p.select(F.col("p_partkey").alias("feed_id"), text.alias("json")))
    return feeds.feed_to_listings(items).select("feed_id", "name", "price", "in_stock", "brand", "feed_key")


@query("SELECT p_partkey AS group_id, CAST(p_partkey AS STRING) AS prod_id, p_name AS name, CAST(p_size AS BIGINT) AS price, CASE WHEN p_partkey % 4 = 1 THEN 'new' END AS price_change FROM part WHERE p_partkey % 10 <> 0 AND p_size > 0")
def grouped_feeds(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.read_table(spark, folder, "part")
    k = F.col("p_partkey")
    text = F.concat(F.lit('{"ErrCode":'), F.when(k % 10 == 0, "9").otherwise("1"), F.lit(',"ProductsData":[{"ProdId":"'), k.cast("string"), F.lit('","ProdName":"'), "p_name", F.lit(' ☆99元","Price":"'), F.col("p_size").cast("string"), F.lit('.50","IsNew":'), F.when(k % 4 == 1, "1").otherwise("0"), F.lit("}]}"))
    return feeds.grouped_feed_to_listings(p.select(k.alias("group_id"), text.alias("json"))).select("group_id", "prod_id", "name", "price", "price_change")


# Names ---------------------------------------------------------------------

_TITLE = """concat(element, ' ', CASE p_partkey % 6 WHEN 0 THEN 'Core i5-14400F' WHEN 1 THEN 'Ryzen 7 9800X3D' WHEN 2 THEN 'Core Ultra 9 285K' WHEN 3 THEN 'R5 7600' WHEN 4 THEN 'i3 ' ELSE 'B760M' END, ' ', p_name)"""
_MAKERS = ["華碩", "ASUS TUF", "msi mag", "Western Digital", "WD", "LGX", "LG ", "T-FORCE", "Micron", "hp-", "Cooler Master", "nobody"]
_TITLES = f"SELECT p_partkey, {_TITLE.replace('element', 'CASE p_partkey % 12 ' + ' '.join(f'WHEN {k} THEN {chr(39)}{m}{chr(39)}' for k, m in enumerate(_MAKERS)) + ' END')} AS title FROM part"
_NEEDLES = ", ".join(f"({k}, '{n}', {str(names.is_short(n)).lower()}, '{b}')" for k, (n, b) in enumerate(names.brand_needles()))


@query(f"""WITH t AS ({_TITLES}), n(rank, needle, short, brand) AS (VALUES {_NEEDLES}),
h AS (SELECT p_partkey, min(struct_pack(r := rank, b := brand)).b AS brand FROM t JOIN n
      ON CASE WHEN short THEN regexp_matches(upper(title), '(^|[^A-Z0-9])' || needle || '([^A-Z0-9]|$)') ELSE contains(upper(title), needle) END GROUP BY p_partkey)
SELECT p_partkey, h.brand FROM t LEFT JOIN h USING (p_partkey)""")
def extract_brand(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.view(spark, folder, _TITLES, "part")
    return t.select("p_partkey", names.extract_brand(F.col("title")).alias("brand"))


@query(f"""WITH t AS ({_TITLES}) SELECT p_partkey, CASE
  WHEN regexp_matches(title, '(?i)\\b(?:Core\\s*)?i([3579])[\\s-]?(\\d{{4,5}})([A-Z]{{0,2}})\\b') THEN upper(regexp_replace(regexp_extract(title, '(?i)\\b(?:Core\\s*)?i([3579])[\\s-]?(\\d{{4,5}})([A-Z]{{0,2}})\\b'), '(?i)^(?:Core\\s*)?i([3579])[\\s-]?', 'I\\1-'))
  WHEN regexp_matches(title, '(?i)\\bUltra\\s*[3579]\\s*\\d{{3}}[A-Z]{{0,2}}\\b') THEN upper(regexp_replace(regexp_extract(title, '(?i)\\bUltra\\s*[3579]\\s*\\d{{3}}[A-Z]{{0,2}}\\b'), '(?i)^Ultra\\s*([3579])\\s*', 'ULTRA\\1-'))
  WHEN regexp_matches(title, '(?i)\\b(?:Ryzen|R)\\s*[3579]\\s*[-\\s]?\\d{{4}}[A-Z0-9]{{0,3}}\\b') THEN upper(regexp_replace(regexp_extract(title, '(?i)\\b(?:Ryzen|R)\\s*[3579]\\s*[-\\s]?\\d{{4}}[A-Z0-9]{{0,3}}\\b'), '(?i)^(?:Ryzen|R)\\s*([3579])\\s*[-\\s]?', 'RYZEN\\1-'))
  END AS model FROM t""")
def extract_cpu_model(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.view(spark, folder, _TITLES, "part")
    return t.select("p_partkey", names.extract_cpu_model(F.col("title")).alias("model"))


@query(f"WITH {_OFFERS} SELECT id, name FROM o")
def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    return offers(spark, folder).select("id", "name")


_COLOURED = "SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' (黑色) ' WHEN 1 THEN ' White版 ' WHEN 2 THEN ' PINK ' ELSE ' 靜音紅軸 ' END, p_type) AS raw_name, CASE WHEN p_partkey % 3 = 0 THEN 'keyboard' ELSE 'ram' END AS category FROM part"


@query(f"""WITH c AS ({_COLOURED}), s AS (SELECT *, trim(regexp_replace(regexp_replace(raw_name, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM c),
k AS (SELECT *, CASE WHEN raw_name LIKE '%桃色%' OR raw_name ILIKE '%pink%' THEN '粉色' WHEN raw_name ILIKE '%black%' OR raw_name LIKE '%黑色%' THEN '黑色' WHEN raw_name ILIKE '%white%' THEN '白色'
  WHEN raw_name ILIKE '%blue%' THEN '藍色' WHEN raw_name ILIKE '%red%' THEN '紅色' WHEN raw_name ILIKE '%green%' THEN '綠色' END AS colour FROM s)
SELECT p_partkey, CASE WHEN category = 'ram' THEN s ELSE
  trim(regexp_replace(CASE WHEN colour = '黑色' THEN regexp_replace(s, '(?i)\\bBLACK\\b', ' ', 'g') WHEN colour = '白色' THEN regexp_replace(s, '(?i)\\bWHITE\\b', ' ', 'g') ELSE s END, '\\s+', ' ', 'g'))
  || CASE WHEN colour IS NULL THEN '' ELSE ' ' || colour END END AS name FROM k""")
def variant_names(spark: SparkSession, folder: str) -> DataFrame:
    c = tables.view(spark, folder, _COLOURED, "part")
    return c.select("p_partkey", names.clean_name(F.col("raw_name"), F.col("category")).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '限組裝' WHEN 1 THEN '組裝價' WHEN 2 THEN '搭板價' WHEN 3 THEN '搭購價' WHEN 4 THEN '加購價' END AS condition FROM part""")
def price_conditions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (" 限整機", " 組裝價", " 任搭CPU", " 套裝搭購", " 限加購", " 單賣")]), (F.col("p_partkey") % 6 + 1).cast("int")))
    return tables.read_table(spark, folder, "part").select("p_partkey", ingest.price_condition(text).alias("condition"))


@query(f"WITH {_OFFERS} SELECT id, price FROM o WHERE price >= 1000")
def drop_junk_prices(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.drop_junk_prices(offers(spark, folder), 1000).select("id", "price")


@query(f"WITH {_OFFERS} SELECT id, category FROM o WHERE category IN ('economy', 'small')")
def retain_listings(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.retain_listings(offers(spark, folder), ("economy", "small")).select("id", "category")


_PARTS = """SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'MSI ' WHEN 1 THEN '華碩 ' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 'RTX 5070 VENTUS' WHEN 1 THEN 'RX7600 PULSE' WHEN 2 THEN 'B650M' WHEN 3 THEN 'Core i5-14400' ELSE 'Ryzen 7 7700' END, ' ', CAST(p_size % 3 * 4 + 4 AS STRING), 'G OC') AS name FROM part"""


@query(f"""WITH x AS ({_PARTS}), b AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ' > MSI' WHEN 1 THEN ' > ASUS' ELSE '' END AS brand, regexp_extract(name, '([0-9]+G) OC', 1) AS size FROM x)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NVIDIA RTX 50系列 > RTX 5070' || brand WHEN 1 THEN 'AMD RX 7000系列 > RX 7600' || brand END AS gpu,
  CASE p_partkey % 5 WHEN 0 THEN 'RTX5070-VENTUS-' || size || '-OC' WHEN 1 THEN 'RX7600-PULSE-' || size || '-OC' END AS sku,
  CASE p_partkey % 5 WHEN 2 THEN 'AMD AM5 > B650' || brand END AS board, CASE p_partkey % 5 WHEN 3 THEN 'Intel > 第 14 代 > Core i5' WHEN 4 THEN 'AMD > Ryzen 7000 (Zen4) > Ryzen 7' END AS cpu FROM b""")
def part_paths(spark: SparkSession, folder: str) -> DataFrame:
    x = tables.view(spark, folder, _PARTS, "part")
    n = F.col("name")
    made = {"gpu": parts.gpu_path(n), "sku": parts.gpu_sku_key(n), "board": parts.motherboard_path(n), "cpu": parts.cpu_path(n)}
    return once(x, ("name",), lambda t: t.withColumns(made), tuple(made)).drop("name")


_STORES = "SELECT p_partkey, concat(p_name, ' ', CAST(p_size AS STRING), CASE p_partkey % 3 WHEN 0 THEN 'TB' ELSE 'GB' END, CASE p_partkey % 4 WHEN 0 THEN ' DDR4 3200' WHEN 1 THEN ' EXOS' WHEN 2 THEN ' SATA' ELSE ' 金牌 850W' END) AS name FROM part"


@query(f"""WITH x AS ({_STORES}), c AS (SELECT *, regexp_extract(name, '([0-9]+)[TG]B', 1) AS n, CASE p_partkey % 3 WHEN 0 THEN 'TB' ELSE 'GB' END AS u, p_partkey % 4 AS k FROM x)
SELECT p_partkey, '桌上型 UDIMM > ' || CASE k WHEN 0 THEN 'DDR4' ELSE 'DDR5' END || CASE WHEN u = 'GB' THEN ' > ' || n || 'G' || CASE k WHEN 0 THEN ' > 3200MHz' ELSE '' END ELSE '' END AS ram,
  CASE k WHEN 2 THEN 'SATA 2.5吋 > ' || n || u ELSE 'M.2 NVMe SSD > PCIe 4.0 > ' || n || u END AS ssd,
  CASE WHEN regexp_matches(name, '(?i)(^| )RED( |$)') THEN 'NAS 專用碟 > 3.5 吋 > ' || n || u WHEN k = 1 THEN '企業級硬碟 > 3.5 吋 > ' || n || u || ' > 7200轉' ELSE '桌上型硬碟 > 3.5 吋 > ' || n || u END AS hdd,
  CASE k WHEN 3 THEN 'ATX 電源 > 750W~1000W > 80+ 金牌' WHEN 0 THEN 'ATX 電源 > 未標瓦數' ELSE 'ATX 電源 > 未標瓦數' END AS psu FROM c""")
def storage_paths(spark: SparkSession, folder: str) -> DataFrame:
    x = tables.view(spark, folder, _STORES, "part")
    n = F.col("name")
    made = {"ram": storage.ram_path(n), "ssd": storage.ssd_path(n), "hdd": storage.hdd_path(n), "psu": storage.psu_path(n)}
    return once(x, ("name",), lambda t: t.withColumns(made), tuple(made)).drop("name")


# Categories ----------------------------------------------------------------

_T = f"({TITLES_SQL}) t"


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return tables.spread(tables.view(spark, folder, TITLES_SQL, "part"), "p_partkey").withColumnRenamed("title", "raw_name")


@query(f"SELECT p_partkey, {detect.first_sql(detect.CATEGORY, chr(39) + 'other' + chr(39))} AS category FROM ({detect.rules_sql(_T, [r for _, r in detect.CATEGORY])}) x")
def detect_category(spark: SparkSession, folder: str) -> DataFrame:
    return detect.detect_category(_titles(spark, folder)).select("p_partkey", "category")


@query(f"SELECT p_partkey, CASE WHEN NOT exempt THEN {detect.first_sql(detect.BUNDLE)} END AS bundle_reason FROM ({detect.rules_sql(_T, ['exempt'] + [r for _, r in detect.BUNDLE])}) x")
def bundle_reason(spark: SparkSession, folder: str) -> DataFrame:
    return detect.bundle_reason(_titles(spark, folder)).select("p_partkey", "bundle_reason")


_NOT = [*(r for r in detect_rules.RULES if r.startswith("not_")), "furniture", "laptop_like"]
_LOOKS = [*(r for r in detect_rules.RULES if r.startswith("looks_")), "psu_model"]


@query(f"SELECT p_partkey, {', '.join(_NOT)} FROM ({detect.rules_sql(_T, _NOT)}) x")
def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    return detect.flagged(_titles(spark, folder), _NOT).select("p_partkey", *_NOT)


@query(f"SELECT p_partkey, {', '.join(_LOOKS)} FROM ({detect.rules_sql(_T, _LOOKS)}) x")
def looks_like(spark: SparkSession, folder: str) -> DataFrame:
    return detect.flagged(_titles(spark, folder), _LOOKS).select("p_partkey", *_LOOKS)


@query(f"SELECT p_partkey, t_cleaned AS title FROM ({detect.rules_sql(_T, ['exempt'])}) x")
def neutralize_plus(spark: SparkSession, folder: str) -> DataFrame:
    return _titles(spark, folder).select("p_partkey", detect.neutral_plus(F.col("raw_name")).alias("title"))


_GIVEN = "CASE p_partkey % 23 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(R.CATEGORIES)) + " ELSE 'optical_drive' END"
_CONDITION = "CASE WHEN regexp_matches(title, '限組裝|限整機') THEN '限組裝' WHEN regexp_matches(title, '組裝價') THEN '組裝價' WHEN regexp_matches(title, '搭板|搭版|任搭主機板|任搭板|任搭CPU|板U價|搭機價') THEN '搭板價' WHEN regexp_matches(title, '搭購價|搭購優惠|套裝搭購|U版專案') THEN '搭購價' WHEN regexp_matches(title, '加購優惠|限加購|加購價') THEN '加購價' END"
_CATEGORIZED = f"""f AS (SELECT *, {_GIVEN} AS given, {_CONDITION} AS condition, CASE WHEN NOT exempt THEN {detect.first_sql(detect.BUNDLE)} END AS bundle_reason,
  {detect.first_sql(detect.CATEGORY, chr(39) + 'other' + chr(39))} AS found FROM ({detect.rules_sql(_T, ['exempt'] + [r for _, r in detect.BUNDLE + detect.CATEGORY + detect.DOUBT])}) x),
o AS (SELECT *, CASE WHEN given IN ('other', 'optical_drive', 'package') OR {' OR '.join(f"(given = '{c}' AND {chr(34)}{r}{chr(34)})" for c, r in detect.DOUBT)} THEN found ELSE given END AS own FROM f),
c AS (SELECT *, CASE WHEN bundle_reason IS NOT NULL OR (condition IS NOT NULL AND own <> 'other') THEN 'package' ELSE own END AS category FROM o)"""


def _categorized(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.categorize_listings(_titles(spark, folder).withColumn("category", F.expr(_GIVEN)))


@query(f"""WITH {_CATEGORIZED} SELECT p_partkey, category, bundle_reason, condition, CASE WHEN bundle_reason IS NULL AND condition IS NOT NULL AND own <> 'other' THEN '搭購價單品 > ' || {"CASE own " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.CATEGORIES.items()) + " END"} || ' > ' || condition END AS offer_path FROM c""")
def categorize_listings(spark: SparkSession, folder: str) -> DataFrame:
    found = _categorized(spark, folder)
    offer = F.when((F.col("category") == "package") & F.col("subcategory").startswith(ingest.OFFERED), F.col("subcategory"))
    return found.select("p_partkey", "category", "bundle_reason", F.try_element_at("specs", F.lit("priceCondition")).alias("condition"), offer.alias("offer_path"))


_GEAR_BRAND = "CASE " + " ".join("WHEN " + (f"regexp_matches(upper(title), '(^|[^A-Z0-9]){n}([^A-Z0-9]|$)')" if names.is_short(n) else f"contains(upper(title), '{n}')") + f" THEN '{b}'" for n, b in names.brand_needles()) + " END"
_SERIES_SQL = "CASE brand " + " ".join(f"WHEN '{b}' THEN {choose_sql('title', tuple((label, p) for p, label in series))}" for b, series in gear.CASE_SERIES.items()) + " END"
_LINK_SQL = f"CASE WHEN {holds_sql('title', (gear.WIRELESS,))} THEN '無線' ELSE '有線' END"
_HIGH = ("(?i)高\\s*(\\d+(?:\\.\\d+)?)\\s*(cm|mm)?", "(?i)(?:高度|Height)\\s*[：:]?\\s*(\\d+(?:\\.\\d+)?)\\s*(cm|mm)?")
_MM = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN CAST(regexp_extract(title, '{p}', 1) AS DOUBLE) * CASE WHEN lower(regexp_extract(title, '{p}', 2)) = 'cm' OR (regexp_extract(title, '{p}', 2) = '' AND CAST(regexp_extract(title, '{p}', 1) AS DOUBLE) < 30) THEN 10 ELSE 1 END" for p in _HIGH) + " END"


@query(f"""WITH t AS ({GEAR_SQL}), b AS (SELECT *, {_GEAR_BRAND} AS brand, {choose_sql('title', gear.COOLER_TYPES, gear.ONE_TOWER)} AS kind, {choose_sql('title', gear.LIGHTS, gear.NO_LIGHT)} AS light, {_MM} AS mm, {_LINK_SQL} AS link FROM t)
SELECT p_partkey, CASE WHEN kind LIKE '{gear.PASTE}%' THEN kind WHEN kind LIKE '一體式%' THEN kind || ' > ' || coalesce(nullif(regexp_extract(title, '(?:^|\\D)(120|240|280|360|420)(?:\\D|$)', 1), '') || 'mm', '{gear.NO_SIZE}') || ' > ' || light
  ELSE kind || ' > ' || CASE WHEN mm IS NULL THEN '{gear.NO_SIZE}' {" ".join(f"WHEN mm <= {m} THEN '{x}'" for m, x in gear.HEIGHT_TIERS)} ELSE '161mm 以上' END || ' > ' || light END AS cooler,
  concat_ws(' > ', {choose_sql('title', gear.CASE_FORMS, gear.NO_FORM)}, brand, {_SERIES_SQL}) AS "case",
  concat_ws(' > ', CASE WHEN {holds_sql('title', gear.MECHANICAL)} THEN '機械式鍵盤 > ' || coalesce(nullif(regexp_extract(title, '{R.KEYBOARD_SWITCHES}'), ''), '未標軸') ELSE '薄膜鍵盤' END, link, brand) AS keyboard,
  concat_ws(' > ', {choose_sql('title', gear.MICE, '一般滑鼠')}, link, brand) AS mouse, concat_ws(' > ', {choose_sql('title', gear.HEADSETS, '有線耳機')}, brand) AS headset, concat_ws(' > ', {choose_sql('title', gear.SPEAKERS, '其他喇叭')}, brand) AS speaker,
  {choose_sql('title', gear.FANS, '其他尺寸風扇')} AS fan, concat_ws(' > ', {choose_sql('title', gear.NETWORK, '其他網通設備')}, brand) AS network, {tree_sql('title', gear.CABLES, gear.OTHER_CABLE)} AS cable, {choose_sql('title', gear.SOFTWARE, '應用軟體 > 其他軟體')} AS os FROM b""")
def gear_paths(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.spread(tables.view(spark, folder, GEAR_SQL, "part"), "p_partkey").withColumn("maker", names.extract_brand(F.col("title")))
    found = {c: path(F.col("title"), F.col("maker")) if c in gear.BRANDED else path(F.col("title")) for c, path in gear.PATHS.items() if c != "monitor"}
    return t.select("p_partkey", *[p.alias(c) for c, p in found.items()])


@query(f"WITH t AS (SELECT p_partkey, t_raw AS title, t_cleaned AS neutral FROM ({detect.rules_sql(f'({GEAR_SQL}) t', ['exempt'])}) x) SELECT p_partkey, {choose_sql('title', gear.COMBOS, gear.OTHER_COMBO, 'neutral')} AS combo, {choose_sql('title', gear.VENDORS)} AS vendor FROM t")
def combo_types(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.view(spark, folder, GEAR_SQL, "part").withColumn("neutral", detect.neutral_plus(F.col("title")))
    return t.select("p_partkey", gear.combo_type(F.col("title"), F.col("neutral")).alias("combo"), gear.choose(F.col("title"), gear.VENDORS).alias("vendor"))


_RATE_SQL = "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(title, '(?i){p}', 1), '')" for p in facets.RATES) + ") AS INT)"


@query(f"""WITH t AS ({TITLES_SQL}), f AS (SELECT *, {choose_sql('title', facets.BOARD_FORMS, facets.UNSTATED)} AS form, {_RATE_SQL} AS rate FROM t)
SELECT p_partkey, {choose_sql('title', facets.PANELS, facets.UNSTATED)} AS panel, CASE WHEN rate BETWEEN 30 AND 100 THEN '100Hz 以下' WHEN rate BETWEEN 30 AND 165 THEN '120–165Hz' WHEN rate BETWEEN 30 AND 240 THEN '170–240Hz' WHEN rate BETWEEN 30 AND 1000 THEN '240Hz 以上' ELSE '{facets.UNSTATED}' END AS "refreshTier",
  form AS "mbForm", coalesce({choose_sql('title', facets.BOARD_SLOTS)}, CASE WHEN form = 'Mini-ITX' THEN '2 槽' ELSE '{facets.UNSTATED}' END) AS "mbDimm", {choose_sql('title', facets.BOARD_WIFI, facets.UNSTATED)} AS "mbWifi", {choose_sql('title', facets.BOARD_LAN, facets.UNSTATED)} AS "mbLan" FROM f""")
def title_facets(spark: SparkSession, folder: str) -> DataFrame:
    t = _titles(spark, folder).select("p_partkey", facets.monitor_facets(F.col("raw_name")).alias("m"), facets.motherboard_facets(F.col("raw_name")).alias("b"))
    return t.select("p_partkey", "m.panel", "m.refreshTier", "b.mbForm", "b.mbDimm", "b.mbWifi", "b.mbLan")


_SHOWN = ", ".join(f"({k}, '{c}', '{n}')" for k, (c, n) in enumerate(NODES))


@query(f"""WITH o(k, category, subcategory) AS (VALUES {_SHOWN}), c AS (SELECT category, subcategory, count(*) AS n FROM ({NODES_SQL}) v GROUP BY category, subcategory)
SELECT category, subcategory, n, CAST(row_number() OVER (PARTITION BY category ORDER BY k) AS INT) AS position FROM c JOIN o USING (category, subcategory)""")
def ordered_subcategories(spark: SparkSession, folder: str) -> DataFrame:
    return groups.ordered_subcategories(tables.view(spark, folder, NODES_SQL, "part"))


_AUDITED = f"""given AS (SELECT p_partkey, title AS raw_name, title AS name, {_GIVEN} AS category, CASE p_partkey % 3 WHEN 0 THEN '空冷 > 155mm > x' WHEN 1 THEN '第 ' || CAST(p_partkey % 12 AS VARCHAR) || ' 代' END AS subcategory FROM {_T})"""


@query(f"WITH {_AUDITED} " + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS count FROM given WHERE {c}" for n, c in audit.sql_checks().items()) + f""" UNION ALL
SELECT 'non_bundles', count(*) FROM ({detect.rules_sql(_T, ['exempt'] + [r for _, r in detect.BUNDLE])}) x WHERE {_GIVEN} = 'package' AND (CASE WHEN NOT exempt THEN {detect.first_sql(detect.BUNDLE)} END) IS NULL""")
def audit_titles(spark: SparkSession, folder: str) -> DataFrame:
    given = _titles(spark, folder).withColumns({"category": F.expr(_GIVEN), "name": F.col("raw_name"), "subcategory": F.expr("CASE p_partkey % 3 WHEN 0 THEN '空冷 > 155mm > x' WHEN 1 THEN concat('第 ', CAST(p_partkey % 12 AS STRING), ' 代') END")})
    return audit.count_listings(given, [*audit.sql_checks(), "non_bundles"])


# Matching ------------------------------------------------------------------


@query(f"WITH {_OFFERS} SELECT id, CASE WHEN length(name) >= 8 THEN key END AS key FROM k")
def exact_match_keys(spark: SparkSession, folder: str) -> DataFrame:
    o = offers(spark, folder)
    return o.select("id", match.exact_match_key(o).alias("key"))


@query(f"WITH {_OFFERS} SELECT id, gid AS match_group_id FROM g")
def assign_group_ids(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(spark, folder).select("id", "match_group_id")


_DISK = "SELECT p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN concat(' ST', CAST(4000 + p_size AS STRING), 'DM', '004') WHEN 1 THEN ' 梭魚 ' ELSE ' WD Red ' END, CASE p_partkey % 2 WHEN 0 THEN ' 4TB 7200轉' ELSE ' 8T' END) AS raw FROM part"


@query(f"""WITH d AS ({_DISK}) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(regexp_extract(raw, 'ST[0-9]{{4}}DM004')) END AS part_number,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'HDD-SPEC-SEAGATE-' || CASE WHEN p_partkey % 3 = 1 THEN 'BARRACUDA' ELSE 'RED' END || '-4T-7200' END AS spec_key FROM d""")
def hdd_keys(spark: SparkSession, folder: str) -> DataFrame:
    d = tables.view(spark, folder, _DISK, "part")
    return d.select("p_partkey", match.hdd_part_number(F.col("raw")).alias("part_number"), match.hdd_spec_key(F.col("raw"), F.lit("Seagate")).alias("spec_key"))


#: Prices near each other for most parts, so that token matching finds pairs and the price guard drops some.
_NEAR = f"""SELECT id, source, raw_name, CAST(floor(p_retailprice * (1 + 0.1 * CAST(substr(source, 2) AS INT)) * CASE WHEN p_partkey % 7 = 0 AND source = 's2' THEN 2 ELSE 1 END) AS BIGINT) AS price, brand, category, pk
FROM ({tables.LISTINGS_SQL}) listing JOIN part ON p_partkey = pk"""


def _near(spark: SparkSession, folder: str) -> DataFrame:
    near = tables.spread(tables.view(spark, folder, _NEAR, "lineitem", "part"), "id")
    # The part number keeps parts apart: a name has about six tokens, one of them its own.
    near = once(near, ("raw_name",), lambda t: t.withColumn("name", names.generic_clean(F.col("raw_name"))), ("name",))
    name = F.concat_ws(" ", "name", F.concat(F.lit("PN"), F.col("pk").cast("string")), F.concat(F.lit("MK"), F.col("pk").cast("string")), F.concat(F.lit("QX"), F.col("pk").cast("string")))
    return cut(near.withColumns({"name": name, "model": F.lit(None).cast("string")}))


_PAIRS = f"""t AS (SELECT id, source, category, price, pk, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(upper({_CLEAN} || ' PN' || pk || ' MK' || pk || ' QX' || pk), '[^A-Z0-9]+', ' ', 'g'), ' +'), lambda w: length(w) > 1))) AS w FROM ({_NEAR}) near),
c AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON a.category = b.category AND a.pk = b.pk AND a.id < b.id AND a.source <> b.source WHERE greatest(a.price, b.price) <= 1.6 * least(a.price, b.price)),
pairs AS (SELECT a, b, i / (n - i) AS similarity FROM c WHERE i / (n - i) >= 0.7)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return match.candidate_pairs(_near(spark, folder)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_PAIRS}, p AS (SELECT pk, max(price) AS h, min(price) AS l FROM t GROUP BY pk),
e AS (SELECT x.pk, bool_or(x.source = 's0' AND y.source = 's1') AS e01, bool_or(x.source = 's0' AND y.source = 's2') AS e02 FROM pairs JOIN t x ON x.id = a JOIN t y ON y.id = b GROUP BY x.pk)
SELECT count(*) AS groups, CAST(sum(CASE WHEN e01 AND e02 AND h <= 1.6 * l THEN 3 ELSE 2 END) AS BIGINT) AS members FROM e JOIN p USING (pk)""")
def fuzzy_groups(spark: SparkSession, folder: str) -> DataFrame:
    near = _near(spark, folder)
    found = match.similar_groups(near)
    return found.groupBy("group_key").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("members"))


def _greedy_sql(nodes: str, pairs: str) -> str:
    """grown(k, members): the greedy groups over nodes(id, source, price) in the order of ids, one node after the other."""
    return f"""ordered AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM {nodes} WHERE id IN (SELECT a FROM {pairs} UNION SELECT b FROM {pairs})),
later AS (SELECT x.r, list(struct_pack(r := [y.r], s := [y.source], lo := y.price, hi := y.price) ORDER BY y.r) AS them FROM {pairs} p JOIN ordered x ON x.id = p.a JOIN ordered y ON y.id = p.b GROUP BY x.r),
steps AS (SELECT o.r, struct_pack(r := [o.r], s := [o.source], lo := o.price, hi := o.price) AS me, coalesce(them, []) AS them FROM ordered o LEFT JOIN later USING (r)),
grown(k, taken, members) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL SELECT k + 1, CASE WHEN len(g) > 1 THEN list_concat(taken, g) ELSE taken END, g FROM (
    SELECT k, taken, CASE WHEN list_contains(taken, k + 1) THEN CAST([] AS BIGINT[]) ELSE list_reduce(list_concat([me], list_filter(them, lambda c: NOT list_contains(taken, c.r[1]))),
      lambda x, y: CASE WHEN list_contains(x.s, y.s[1]) OR (least(x.lo, y.lo) > 0 AND greatest(x.hi, y.hi) > 1.6 * least(x.lo, y.lo)) THEN x
        ELSE struct_pack(r := list_concat(x.r, y.r), s := list_concat(x.s, y.s), lo := least(x.lo, y.lo), hi := greatest(x.hi, y.hi)) END).r END AS g
    FROM grown JOIN steps ON steps.r = k + 1) step),
found AS (SELECT k AS seed, unnest(members) AS r FROM grown WHERE len(members) > 1)"""


_SAME = "upper('NAME-' || category || '-' || brand || '-' || list_aggregate(list_sort(list_distinct(regexp_extract_all(replace(upper(name), upper(brand), ' '), '[A-Za-z0-9]+'))), 'string_agg', ''))"
_NEAR_PAIRS = f"""n AS (SELECT *, {_CLEAN} || ' PN' || pk || ' MK' || pk || ' QX' || pk AS name FROM ({_NEAR}) near), keyed AS (SELECT *, replace({_SAME}, ' ', '') AS key FROM n),
shared AS (SELECT key FROM keyed GROUP BY key HAVING count(DISTINCT source) > 1), rest AS (SELECT * FROM keyed WHERE key NOT IN (SELECT key FROM shared)),
{_PAIRS.replace("FROM c WHERE", "FROM c WHERE a IN (SELECT id FROM rest) AND b IN (SELECT id FROM rest) AND")}"""


@query(f"""WITH RECURSIVE {_NEAR_PAIRS}, {_greedy_sql('rest', 'pairs')}
SELECT id, key AS group_key FROM keyed WHERE key IN (SELECT key FROM shared)
UNION ALL SELECT o.id, n.group_key FROM found f JOIN ordered o USING (r) JOIN (SELECT seed, string_agg(id, '-' ORDER BY r) AS group_key FROM found JOIN ordered USING (r) GROUP BY seed) n USING (seed)""")
def match_listings(spark: SparkSession, folder: str) -> DataFrame:
    return match.match_listings(_near(spark, folder))


@query()
def compare(spark: SparkSession, folder: str) -> DataFrame:
    found = serve.filter_listings(_near(spark, folder).withColumn("specs", F.create_map(F.lit("x"), F.lit("y"))), serve.Filters(search="ring"))
    return match.match_listings(found)


#: Names without a token of their own: brand, a part of the name and a class of size; every third part shares one name and a price in tens.
_HOT = f"""SELECT id, source, category, brand, pk,
  CASE WHEN pk % 3 = 0 THEN 'Common Ring 16G Steel' ELSE concat(p_name, ' ', brand, ' S', CAST(CAST(floor(p_size / 10) AS INT) AS STRING), ' kit of parts') END AS name,
  CAST(floor(p_retailprice / 10) * 10 + 10 * CAST(substr(source, 2) AS INT) AS BIGINT) AS price FROM ({tables.LISTINGS_SQL}) listing JOIN part ON p_partkey = pk"""


def _hot(spark: SparkSession, folder: str) -> DataFrame:
    hot = tables.spread(tables.view(spark, folder, _HOT, "lineitem", "part"), "id")
    return cut(hot.withColumns({"raw_name": F.col("name"), "model": F.lit(None).cast("string")}))


_CLASSES = f"""h AS ({_HOT}), k AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g'), ' +'), lambda w: length(w) > 1))) AS w FROM h),
c AS (SELECT source, category, price, w, min(id) AS id, count(*) AS n FROM k GROUP BY source, category, price, w),
m AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS a_n, b.n AS b_n, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity
  FROM c a JOIN c b ON a.category = b.category AND a.source <> b.source AND a.id < b.id AND greatest(a.price, b.price) <= 1.6 * least(a.price, b.price))"""


@query(f"WITH {_CLASSES} SELECT a_id, b_id, a_n, b_n, round(similarity, 6) AS similarity FROM m WHERE similarity >= 0.7")
def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = match.class_pairs(match.classed(_hot(spark, folder)))
    return found.select("a_id", "b_id", "a_n", "b_n", F.round("similarity", 6).alias("similarity"))


#: A fixture for greedy choices: neighbours by name differ from listing to listing, and prices close groups.
_MIXED = f"""SELECT id, source, category, brand, pk, concat(p_name, ' ', brand, ' size', CAST(p_size AS STRING), ' M', CAST(pk % 4 AS STRING), ' boxed') AS name,
  CAST(floor(p_retailprice * (1 + 0.17 * CAST(substr(source, 2) AS INT) * (pk % 3))) AS BIGINT) AS price FROM ({tables.LISTINGS_SQL}) listing JOIN part ON p_partkey = pk"""
_MIXED_PAIRS = f"""h AS ({_MIXED}), k AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g'), ' +'), lambda w: length(w) > 1))) AS w FROM h),
m AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM k a JOIN k b ON a.category = b.category AND a.source <> b.source AND a.id < b.id AND greatest(a.price, b.price) <= 1.6 * least(a.price, b.price)),
pairs AS (SELECT a, b FROM m WHERE i / (n - i) >= 0.7)"""


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    mixed = tables.spread(tables.view(spark, folder, _MIXED, "lineitem", "part"), "id")
    return cut(mixed.withColumns({"raw_name": F.col("name"), "model": F.lit(None).cast("string")}))


@query(f"""WITH RECURSIVE {_MIXED_PAIRS}, {_greedy_sql('k', 'pairs')}
SELECT o.id, string_agg(m.id, '-' ORDER BY m.r) AS group_key FROM found f JOIN ordered o ON o.r = f.r JOIN found g ON g.seed = f.seed JOIN ordered m ON m.r = g.r GROUP BY o.id""")
def greedy_groups(spark: SparkSession, folder: str) -> DataFrame:
    mixed = _mixed(spark, folder)
    return match.similar_groups(mixed)


_LEFT_PAIRS = _MIXED_PAIRS.replace("pairs AS (SELECT a, b FROM m WHERE", "keyed AS (SELECT *, replace(" + _SAME + ", ' ', '') AS key FROM k), shared AS (SELECT key FROM keyed GROUP BY key HAVING count(DISTINCT source) > 1), rest AS (SELECT * FROM keyed WHERE key NOT IN (SELECT key FROM shared)), pairs AS (SELECT a, b FROM m WHERE a IN (SELECT id FROM rest) AND b IN (SELECT id FROM rest) AND")


@query(f"""WITH RECURSIVE {_LEFT_PAIRS}, {_greedy_sql('rest', 'pairs')},
every AS (SELECT key AS group_key, id, source, name, brand, price FROM keyed WHERE key IN (SELECT key FROM shared)
  UNION ALL SELECT n.group_key, o.id, o.source, o.name, o.brand, o.price FROM found f JOIN ordered o USING (r) JOIN (SELECT seed, string_agg(id, '-' ORDER BY r) AS group_key FROM found JOIN ordered USING (r) GROUP BY seed) n USING (seed))
SELECT 'match-' || substr(md5(group_key), 1, 12) AS id, string_agg(id, ',' ORDER BY id) AS members, count(DISTINCT source) AS sources, min(price) AS lowest_price, max(price) AS highest_price, max(price) - min(price) AS price_diff,
  min(struct_pack(n := length(name), i := id, name := name)).name AS name FROM every GROUP BY group_key""")
def match_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = match.match_groups(_mixed(spark, folder))
    return found.select("id", F.array_join("members", ",").alias("members"), "sources", "lowest_price", "highest_price", "price_diff", "name")


# Groups --------------------------------------------------------------------


@query(f"WITH {_GROUPS} SELECT id, name, brand, category, subcategory, lowest_price, highest_price, has_multiple_sources FROM grp")
def build_match_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).select("id", "name", "brand", "category", "subcategory", "lowest_price", "highest_price", "has_multiple_sources")


@query(f"WITH {_GROUPS} SELECT gid AS id, min(price) AS lowest_price, max(price) AS highest_price, max(price) - min(price) AS price_diff, count(*) AS members, min(struct_pack(n := length(name), i := id, name := name)).name AS name FROM g GROUP BY gid")
def group_records(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_records(grouped(spark, folder))


@query(f"WITH {_GROUPS} SELECT category, count(*) AS n FROM grp GROUP BY category")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.category_counts(_groups(spark, folder))


@query(f"WITH {_GROUPS} SELECT count(*) AS n FROM grp WHERE category = 'economy'")
def group_count(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_count(_groups(spark, folder), "economy")


@query(f"WITH {_GROUPS} SELECT subcategory, count(*) AS n FROM grp WHERE category = 'economy' GROUP BY subcategory")
def subcategory_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.subcategory_counts(_groups(spark, folder), "economy")


@query(f"""WITH {_GROUPS}, v AS (SELECT category, string_split(subcategory, ' > ') AS s FROM grp)
SELECT category, s[1] AS node, 1 AS depth, CAST(0 AS BIGINT) AS own, count(*) AS total FROM v GROUP BY category, s[1]
UNION ALL SELECT category, s[1] || ' > ' || s[2], 2, count(*), count(*) FROM v GROUP BY category, s[1], s[2]""")
def subcategory_tree(spark: SparkSession, folder: str) -> DataFrame:
    return groups.subcategory_tree(_groups(spark, folder))


@query(f"WITH {_GROUPS} SELECT brand, count(*) AS n FROM grp WHERE category = 'small' GROUP BY brand")
def brand_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.brand_counts(_groups(spark, folder), "small")


@query(f"WITH {_GROUPS} SELECT source, count(*) AS products, (SELECT count(*) FROM g) AS total_products, (SELECT count(*) FROM grp) AS total_groups FROM g GROUP BY source")
def health_summary(spark: SparkSession, folder: str) -> DataFrame:
    g = grouped(spark, folder)
    return groups.health_summary(g, groups.build_match_groups(g))


@query(f"WITH {_GROUPS} SELECT category, CAST(sum(has_multiple_sources) AS BIGINT) AS multi, count(*) AS total, round(100.0 * sum(has_multiple_sources) / count(*), 1) AS rate FROM grp GROUP BY category HAVING sum(has_multiple_sources) > 0 ORDER BY multi DESC, category LIMIT 15")
def cross_store_rate(spark: SparkSession, folder: str) -> DataFrame:
    return groups.cross_store_rate(_groups(spark, folder))


@query(f"WITH {_OFFERS} SELECT subcategory AS label, count(*) AS n FROM o WHERE category = 'economy' GROUP BY subcategory ORDER BY n DESC, label LIMIT 15")
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return groups.distribution(offers(spark, folder), "economy")


@query(f"""WITH {_GROUPS}, w AS (SELECT gid AS id, min(CASE WHEN source = 's0' THEN price END) AS price_s0, min(CASE WHEN source = 's1' THEN price END) AS price_s1, min(CASE WHEN source = 's2' THEN price END) AS price_s2, count(DISTINCT source) AS n_sources FROM g GROUP BY gid)
SELECT id, name, price_s0, price_s1, price_s2, n_sources, least(price_s0, price_s1, price_s2) AS lowest, greatest(price_s0, price_s1, price_s2) AS highest, greatest(price_s0, price_s1, price_s2) - least(price_s0, price_s1, price_s2) AS saving FROM w JOIN grp USING (id)""")
def comparison_cards(spark: SparkSession, folder: str) -> DataFrame:
    g = grouped(spark, folder)
    return groups.comparison_cards(groups.build_match_groups(g), g, SOURCES)


@query(f"WITH {_OFFERS} SELECT DISTINCT category, category AS label, 98 AS display_order FROM o")
def category_meta(spark: SparkSession, folder: str) -> DataFrame:
    return groups.with_category_meta(offers(spark, folder).select("category").distinct())


@query(f"""WITH {_GROUPS}, s AS (SELECT g.* FROM g JOIN grp ON g.gid = grp.id WHERE has_multiple_sources = 0)
SELECT id, source, category, brand, subcategory AS model FROM s WHERE EXISTS (SELECT 1 FROM g o WHERE o.category = s.category AND o.brand = s.brand AND o.subcategory = s.subcategory AND o.source <> s.source AND o.gid <> s.gid)""")
def singletons_with_twin(spark: SparkSession, folder: str) -> DataFrame:
    g = grouped(spark, folder).withColumn("model", F.col("subcategory"))
    return groups.singletons_with_twin(g, groups.build_match_groups(g))


# Views ---------------------------------------------------------------------


@query(f"WITH {_OFFERS} SELECT id, price FROM o WHERE category = 'economy' AND price BETWEEN 100 AND 90000 AND in_stock AND (name ILIKE '%RING%' OR brand ILIKE '%RING%' OR raw_name ILIKE '%RING%') AND (subcategory = 'economy' OR subcategory LIKE 'economy > %') AND size <> '' AND size = '11'")
def filter_listings(spark: SparkSession, folder: str) -> DataFrame:
    f = serve.Filters(category="economy", min_price=100, max_price=90000, in_stock=True, search="RING", subcategory="economy", facets={"size": "11"})
    return serve.filter_listings(offers(spark, folder), f).select("id", "price")


#: Offers in one group for each part: unlike exact names, these groups have members of several shops.
_BY_PART = f"""{_OFFERS}, bp AS (SELECT *, 'part-' || CAST(pk AS VARCHAR) AS gid FROM o),
low AS (SELECT gid, source, min(price) AS low FROM bp GROUP BY gid, source),
made AS (SELECT gid AS id, min(low) AS lowest_price, max(low) AS highest_price, CAST(count(*) > 1 AS INT) AS has_multiple_sources FROM low GROUP BY gid)"""


def _by_part(spark: SparkSession, folder: str) -> DataFrame:
    return offers(spark, folder).withColumn("match_group_id", F.concat(F.lit("part-"), F.col("pk").cast("string")))


@query(f"""WITH {_BY_PART} SELECT id, lowest_price, highest_price FROM made WHERE lowest_price >= 100 AND has_multiple_sources = 1
AND id IN (SELECT gid FROM bp WHERE source = 's1') AND id IN (SELECT gid FROM bp WHERE NOT in_stock) AND id IN (SELECT gid FROM bp WHERE size = '11')""")
def filter_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = _by_part(spark, folder)
    f = serve.Filters(min_price=100, has_multiple_sources=True, source="s1", in_stock=False, facets={"size": "11"})
    return serve.filter_groups(groups.build_match_groups(g), g, f).select("id", "lowest_price", "highest_price")


@query(f"WITH {_OFFERS} SELECT id, price FROM o ORDER BY price DESC, id LIMIT 50 OFFSET 100")
def page_listings(spark: SparkSession, folder: str) -> DataFrame:
    return serve.page_listings(offers(spark, folder), "price_desc", page=3).select("id", "price")


@query(f"WITH {_GROUPS} SELECT id, lowest_price FROM grp ORDER BY lowest_price, id LIMIT 200")
def page_groups(spark: SparkSession, folder: str) -> DataFrame:
    return serve.page_groups(_groups(spark, folder), "price_asc", page=1, limit=1000).select("id", "lowest_price")


@query(f"WITH {_GROUPS} SELECT gid AS id, count(*) AS members, string_agg(id, ',' ORDER BY price, id) AS ids FROM g GROUP BY gid")
def groups_with_members(spark: SparkSession, folder: str) -> DataFrame:
    g = grouped(spark, folder)
    found = serve.groups_with_members(groups.build_match_groups(g), g)
    return found.select("id", F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda m: m["id"]), ",").alias("ids"))


# History -------------------------------------------------------------------


@query(f"""WITH v AS ({tables.OBSERVATIONS_SQL}), w AS (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY recorded_at, price) AS before, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at, price) AS r FROM v)
SELECT product_id, price, recorded_at FROM w WHERE r = 1 OR price IS DISTINCT FROM before""")
def price_changes(spark: SparkSession, folder: str) -> DataFrame:
    return history.price_changes(tables.observations(spark, folder))


@query(f"WITH v AS ({tables.OBSERVATIONS_SQL}), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, price DESC) AS INT) AS rank FROM v) SELECT * FROM w WHERE rank <= 10")
def recent_history(spark: SparkSession, folder: str) -> DataFrame:
    return history.recent_history(tables.observations(spark, folder), 10)


@query(f"""WITH l AS ({tables.LOGS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, status DESC) AS k FROM l),
s AS (SELECT DISTINCT source FROM l UNION ALL SELECT 'never'), o AS (SELECT concat('u', CAST(user_id % 7 AS STRING)) AS source, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max(created_at) AS now FROM l)
SELECT s.source, CASE WHEN created_at IS NULL THEN 'stale' WHEN status = 'error' THEN 'error' WHEN created_at < now - INTERVAL 2 HOURS THEN 'stale' ELSE 'healthy' END AS status, created_at AS last_run, coalesce(n, 0) AS product_count, CASE WHEN status = 'error' THEN error_message END AS last_error
FROM s CROSS JOIN t LEFT JOIN r ON r.source = s.source AND k = 1 LEFT JOIN o ON o.source = s.source""")
def source_status(spark: SparkSession, folder: str) -> DataFrame:
    logs = tables.logs(spark, folder)
    sources = logs.select("source").distinct().union(spark.range(1).select(F.lit("never")))
    items = tables.read_table(spark, folder, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("source"))
    now = logs.agg(F.max("created_at")).first()[0]
    return history.source_status(items, logs, F.lit(now), sources)


# Maintenance ---------------------------------------------------------------


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored listings (parts below a third are missing) and a batch of s0 in which every fourth price differs."""
    g = grouped(spark, folder).select("id", "source", "name", "price", "match_group_id", "scraped_at", "updated_at", "pk")
    batch = g.where((F.col("source") == "s0") & (F.col("pk") % 5 != 0)).withColumns({"price": F.when(F.col("pk") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")), "scraped_at": F.lit("2030-01-01").cast("timestamp_ntz")}).drop("match_group_id", "updated_at")
    return g.where(F.col("pk") % 3 != 0), batch


_UPSERT = f"""WITH {_OFFERS}, cur AS (SELECT * FROM g WHERE pk % 3 <> 0),
bat AS (SELECT id, source, price + CAST(pk % 4 = 0 AS INT) AS price, pk FROM g WHERE source = 's0' AND pk % 5 <> 0)"""


@query(f"""{_UPSERT} SELECT coalesce(bat.id, cur.id) AS id, coalesce(bat.price, cur.price) AS price, coalesce(cur.gid, 'mg-' || bat.id) AS match_group_id, bat.id IS NOT NULL AS fresh FROM cur FULL JOIN bat USING (id)""")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    current, batch = _tables(spark, folder)
    products, _ = ingest.upsert(current, batch, F.lit("2030-01-02").cast("timestamp_ntz"))
    return products.select("id", "price", "match_group_id", (F.year("updated_at") == 2030).alias("fresh"))


@query(f"{_UPSERT} SELECT bat.id AS product_id, bat.price FROM bat LEFT JOIN cur USING (id) WHERE cur.id IS NULL OR cur.price <> bat.price")
def upsert_history(spark: SparkSession, folder: str) -> DataFrame:
    current, batch = _tables(spark, folder)
    return ingest.upsert(current, batch, F.lit("2030-01-02").cast("timestamp_ntz"))[1].select("product_id", "price")


@query(f"{_UPSERT} SELECT coalesce(bat.id, cur.id) AS id FROM cur FULL JOIN bat USING (id) WHERE coalesce(bat.source, cur.source) <> 's0' OR bat.id IS NOT NULL")
def remove_stale(spark: SparkSession, folder: str) -> DataFrame:
    current, batch = _tables(spark, folder)
    products, changed = ingest.upsert(current, batch, F.lit("2030-01-02").cast("timestamp_ntz"))
    return ingest.remove_stale(products, changed, "s0", F.lit("2030-01-01").cast("timestamp_ntz"))[0].select("id")


@query(f"WITH {_OFFERS} SELECT id, source FROM o WHERE source <> 's1'")
def drop_source(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.drop_source(offers(spark, folder), "s1").select("id", "source")


@query(f"WITH {_OFFERS} SELECT count(*) AS changed FROM o WHERE subcategory LIKE '% > %' AND subcategory NOT LIKE '%UDIMM%'")
def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    # Every row changes: memory gets a path of its own, the rest another category or none.
    o = offers(spark, folder).withColumns({"category": F.when(F.col("category").isin("economy", "small"), "ram").otherwise("other"), "name": names.generic_clean(F.col("raw_name"))})
    return ingest.rebuild(o)[1]


#: Three changes to the offers by part, one after the other: some prices of s0, some listings of s1 gone, and those of a part that only s2 had.
_CHANGES = ("source = 's0' AND pk % 50 = 0", "source = 's1' AND pk % 70 = 0", "source = 's2' AND pk % 90 = 0")


@query(f"""WITH {_BY_PART}, after AS (SELECT gid, source, CASE WHEN {_CHANGES[0]} THEN price + 7 ELSE price END AS price FROM bp WHERE NOT ({_CHANGES[1]}) AND NOT ({_CHANGES[2]})),
each AS (SELECT gid, source, min(price) AS low FROM after GROUP BY gid, source)
SELECT gid AS id, min(low) AS lowest_price, max(low) AS highest_price, CAST(count(*) > 1 AS INT) AS has_multiple_sources FROM each GROUP BY gid""")
def refresh_match_groups(spark: SparkSession, folder: str) -> DataFrame:
    now = _by_part(spark, folder)
    stored = groups.build_match_groups(now)
    dearer, *gone = _CHANGES
    steps = [lambda df: df.withColumn("price", F.when(F.expr(dearer), F.col("price") + 7).otherwise(F.col("price"))), *[lambda df, c=c: df.where(~F.expr(c)) for c in gone]]
    for condition, step in zip(_CHANGES, steps, strict=True):
        changed = now.where(condition).select("match_group_id")
        now = step(now)
        stored = cut(groups.refresh_match_groups(stored, now, changed))
    return stored.select("id", "lowest_price", "highest_price", "has_multiple_sources")


# Quality -------------------------------------------------------------------


@query(f"""WITH {_GROUPS} SELECT 'price_spread' AS "check", count(*) FILTER (highest_price > 1.8 * lowest_price AND has_multiple_sources = 1) AS count, count(*) FILTER (highest_price > 1.8 * lowest_price AND has_multiple_sources = 1) = 0 AS passed FROM grp
UNION ALL SELECT 'category_other', count(*) FILTER (category = 'other'), count(*) FILTER (category = 'other') = 0 FROM g
UNION ALL SELECT 'category_removed', count(*), count(*) = 0 FROM g
""" + "".join(f"""UNION ALL SELECT '{n}', count(*), count(*) = 0 FROM g WHERE {c}
""" for n, c in audit.sql_checks().items()) + """UNION ALL SELECT 'non_bundles', count(*), count(*) = 0 FROM g WHERE category = 'package'
UNION ALL SELECT 'package_without_subcategory', 0, true UNION ALL SELECT 'cable_without_subcategory', 0, true UNION ALL SELECT 'condition_outside_package', 0, true
UNION ALL SELECT 'key_split', CAST(count(*) AS BIGINT), count(*) = 0 FROM (SELECT key FROM g WHERE length(name) >= 8 GROUP BY key HAVING count(DISTINCT gid) > 1)
UNION ALL SELECT 'model_split', CAST(count(*) AS BIGINT), count(*) = 0 FROM (SELECT 1 FROM g WHERE false)""")
def run_audit(spark: SparkSession, folder: str) -> DataFrame:
    g = grouped(spark, folder)
    return audit.run_audit(g, groups.build_match_groups(g))


#: Listings with faults: packages and cables without a path, conditions outside packages, prices far apart, one model in several groups.
_FAULTY = """SELECT concat('a', CAST(p_partkey AS STRING)) AS id, concat('s', CAST(p_partkey % 3 AS STRING)) AS source, p_name AS name, p_name AS raw_name, 10 * CAST(p_size AS BIGINT) AS price,
CASE p_partkey % 5 WHEN 0 THEN 'package' WHEN 1 THEN 'cable' WHEN 2 THEN 'gpu' WHEN 3 THEN 'cpu' ELSE 'mouse' END AS category,
CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 <> 1 THEN 'path' END AS subcategory, 'AMD' AS brand, concat('m', CAST(p_partkey % 60 AS STRING)) AS model,
concat('g', CAST(p_partkey % 100 AS STRING)) AS match_group_id, CASE WHEN p_partkey % 7 = 0 THEN '搭板價' END AS condition FROM part"""


@query(f"""WITH f AS ({_FAULTY}), low AS (SELECT match_group_id, source, min(price) AS low FROM f GROUP BY 1, 2),
spread AS (SELECT match_group_id FROM low GROUP BY 1 HAVING count(*) > 1 AND max(low) > 1.8 * min(low)),
model AS (SELECT brand, model FROM f WHERE category = 'cpu' AND condition IS NULL GROUP BY 1, 2 HAVING count(DISTINCT match_group_id) > 1)
SELECT 'package_without_subcategory' AS "check", count(*) AS count FROM f WHERE category = 'package' AND coalesce(subcategory, '') = ''
UNION ALL SELECT 'cable_without_subcategory', count(*) FROM f WHERE category = 'cable' AND coalesce(subcategory, '') = ''
UNION ALL SELECT 'condition_outside_package', count(*) FROM f WHERE category <> 'package' AND condition IS NOT NULL
UNION ALL SELECT 'non_bundles', count(*) FROM f WHERE category = 'package' AND condition IS NULL
UNION ALL SELECT 'price_spread', count(*) FROM spread UNION ALL SELECT 'model_split', count(*) FROM model""")
def audit_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The checks that find nothing in the offers, over listings with planted faults."""
    f = tables.view(spark, folder, _FAULTY, "part")
    f = cut(f.withColumns({"specs": F.when(F.col("condition").isNotNull(), F.create_map(F.lit("priceCondition"), F.col("condition"))), "bundle_reason": F.lit(None).cast("string")}))
    found = audit.run_audit(f, groups.build_match_groups(f))
    return found.where(F.col("check").isin("package_without_subcategory", "cable_without_subcategory", "condition_outside_package", "non_bundles", "price_spread", "model_split")).select("check", "count")


# Monitor catalogue ----------------------------------------------------------

_BASE = "concat('mk', CAST(10000 + p_partkey AS STRING))"
_MONITORS = f"SELECT p_partkey, concat({_BASE}, CASE p_partkey % 4 WHEN 1 THEN 'w' WHEN 2 THEN 'xyz' ELSE '' END) AS model_key, p_brand AS brand, concat(p_name, ' ', p_type) AS raw_name, p_size % 3 AS labelled FROM part"
_CATALOGUE = f"SELECT concat({_BASE}, CASE p_partkey % 4 WHEN 3 THEN 'long' ELSE '' END) AS model_key, CASE p_partkey % 5 WHEN 0 THEN 0.5 ELSE 0.9 END AS confidence, concat('p', CAST(p_size AS STRING)) AS panel, '未標示' AS \"refreshTier\", concat('r', CAST(p_size % 2 AS STRING)) AS resolution FROM part WHERE p_partkey % 3 <> 0"


def _monitors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = tables.view(spark, folder, _MONITORS, "part")
    specs = F.when(F.col("labelled") == 0, F.create_map(F.lit("panel"), F.lit("own"), F.lit("resolution"), F.lit("4K"))).otherwise(F.create_map(F.lit("resolution"), F.lit(catalogue.UNLABELLED)))
    return found.withColumn("specs", specs), tables.view(spark, folder, _CATALOGUE.replace('"', "`"), "part")


_FOUND = f"""m AS ({_MONITORS}), c AS ({_CATALOGUE}),
h AS (SELECT p_partkey, 0 AS tier, c.model_key AS e, true AS ok FROM m JOIN c USING (model_key) WHERE confidence >= 0.8
  UNION ALL SELECT p_partkey, 1, c.model_key, true FROM m JOIN c ON c.model_key = regexp_replace(m.model_key, 'w$', '') AND c.model_key <> m.model_key WHERE confidence >= 0.8
  UNION ALL SELECT p_partkey, 2, max_by(c.model_key, length(c.model_key)), max_by(confidence, length(c.model_key)) >= 0.8 FROM m JOIN c ON starts_with(m.model_key, c.model_key) AND substr(m.model_key, 1, 6) = substr(c.model_key, 1, 6) GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 3, min_by(c.model_key, length(c.model_key)), min_by(confidence, length(c.model_key)) >= 0.8 FROM m JOIN c ON starts_with(c.model_key, m.model_key) AND substr(m.model_key, 1, 6) = substr(c.model_key, 1, 6) GROUP BY p_partkey),
f AS (SELECT p_partkey, min_by(e, tier) AS e, min_by(ok, tier) AS ok FROM h GROUP BY p_partkey),
looked AS (SELECT m.*, CASE WHEN ok THEN e END AS catalogue_key FROM m LEFT JOIN f USING (p_partkey))"""


@query(f"WITH {_FOUND} SELECT p_partkey, catalogue_key FROM looked")
def lookup_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.lookup_catalogue(*_monitors(spark, folder)).select("p_partkey", "catalogue_key")


@query(f"""WITH {_FOUND} SELECT p_partkey, CASE WHEN labelled = 0 THEN 'own' ELSE c.panel END AS panel, CASE WHEN labelled = 0 THEN '4K' ELSE coalesce(c.resolution, '未標示') END AS resolution, CAST(NULL AS VARCHAR) AS refresh FROM looked LEFT JOIN c ON catalogue_key = c.model_key""")
def fill_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    found, table = _monitors(spark, folder)
    filled = catalogue.fill_unlabelled(catalogue.lookup_catalogue(found, table), table)
    at = lambda k: F.try_element_at("specs", F.lit(k))
    return filled.select("p_partkey", at("panel").alias("panel"), at("resolution").alias("resolution"), at("refreshTier").alias("refresh"))


@query(f"""WITH m AS ({_MONITORS}), c AS ({_CATALOGUE}) SELECT model_key, count(*) AS n, substr(min(struct_pack(r := raw_name, b := m.brand)).r, 1, 90) AS sample, min(struct_pack(r := raw_name, b := m.brand)).b AS brand, bool_or(model_key IN (SELECT model_key FROM c)) AS in_catalogue
FROM m WHERE labelled <> 0 GROUP BY model_key ORDER BY n DESC, model_key LIMIT 80""")
def catalogue_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.catalogue_gaps(*_monitors(spark, folder))


_SCREENS = "SELECT p_partkey, concat(CASE p_partkey % 6 WHEN 0 THEN '三星 S27FG900XC 【曲面】' WHEN 1 THEN 'Alienware AW2725Q $19,900' WHEN 2 THEN 'MAG 272F' WHEN 3 THEN 'G242L' WHEN 4 THEN 'AOC 24B36X' ELSE 'no model' END, ' ', p_name) AS raw_name FROM part"


@query(f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 's27fg900xc' WHEN 1 THEN 'aw2725q' WHEN 2 THEN 'mag272f' WHEN 3 THEN 'g242l' WHEN 4 THEN '24b36x' END AS model_key FROM part")
def monitor_model_keys(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.view(spark, folder, _SCREENS, "part")
    return s.select("p_partkey", catalogue.monitor_model_key(F.col("raw_name")).alias("model_key"))


# Streams -------------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("user_id").alias("product_id"), F.floor(F.col("value") / 50).cast("long").alias("price"))


def _drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what has arrived and return what it wrote last."""
    spark = df.sparkSession
    cut(spark.range(1))
    top = spark.sparkContext.getCheckpointDir()
    out = f"{name}-{uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{top}/{out}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{top}/{out}/rows").start().awaitTermination()
        return spark.read.parquet(f"{top}/{out}/rows")
    writer.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{top}/{out}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{top}/{out}/rows")


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS start, event_type AS source, count(*) AS items FROM events GROUP BY 1, 2")
def stream_source_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = _drained(jobs.stream_source_counts(_event_stream(spark, folder)), "complete", "counts")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "source", "items")


_LANDED = f"SELECT id, source, raw_name AS name, raw_name, price, brand, category, subcategory, pk, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS scraped_at FROM ({tables.LISTINGS_SQL}) x"
#: A second look at two shops: every fifth listing is gone, every third has another price.
_AGAIN = f"SELECT id, source, name, raw_name, CASE WHEN pk % 3 = 0 THEN price + 10 ELSE price END AS price, brand, category, subcategory, pk, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS scraped_at FROM ({_LANDED}) y WHERE source <> 's2' AND pk % 5 <> 0"


@query(f"""WITH a AS ({_LANDED}), b AS ({_AGAIN}), p AS (SELECT id, source, price FROM b UNION ALL SELECT id, source, price FROM a WHERE source = 's2'),
h AS (SELECT id FROM a UNION ALL SELECT b.id FROM b JOIN a USING (id) WHERE a.price <> b.price)
SELECT p.id, p.source, p.price, 'mg-' || p.id AS match_group_id, count(*) AS observations FROM p JOIN h USING (id) GROUP BY 1, 2, 3, 4""")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, the second of which is cut off once before it is done and runs again after it was."""
    top = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    columns = ("id", "source", "name", "raw_name", "price", "brand", "category", "subcategory", "scraped_at")
    first, second = (cut(tables.view(spark, folder, sql, "lineitem", "part").select(*columns)) for sql in (_LANDED, _AGAIN))
    put = jobs.ingest_batch(top, clean=ingest.drop_junk_prices)

    def fail(step: str) -> None:
        if step == "history":
            raise InterruptedError(step)

    put(first, 0)
    try:
        jobs.ingest_batch(top, clean=ingest.drop_junk_prices, finished=fail)(second, 1)
    except InterruptedError:
        pass
    put(second, 1)
    put(second, 1)
    made = jobs.committed(spark, top)
    counted = made["history"].groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("observations"))
    return made["products"].join(counted, "id").select("id", "source", "price", "match_group_id", "observations")


@query(f"""WITH v AS (SELECT DISTINCT product_id, price, recorded_at FROM ({tables.OBSERVATIONS_SQL}) x), w AS (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY recorded_at, price) AS before, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at, price) AS r FROM v)
SELECT product_id, price, recorded_at AS ts FROM w WHERE r = 1 OR price <> before""")
def stream_price_changes(spark: SparkSession, folder: str) -> DataFrame:
    changed = _drained(jobs.stream_price_changes(_event_stream(spark, folder)), "append", "changes")
    return changed.select("product_id", "price", F.col("ts").cast("timestamp_ntz").alias("ts"))
