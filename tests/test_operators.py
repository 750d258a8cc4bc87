"""Names, keys, matching, ingest and streams on hand-written rows."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from offerloom.functions import names, parts, storage
from offerloom.functions.text import has, path, path_skip
from offerloom.operators import audit, groups, history, ingest, match
from offerloom.sources import feeds, pages
from offerloom.streaming import jobs


def each(spark, column, rows, schema="x string"):
    """The values of a column expression for rows."""
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_ascii_word_edges(spark):
    got = each(spark, has(F.col("x"), r"\bWIFI\b"), ["華碩WIFI板", "AWIFI", "wifi 6", "WIFI7", None])
    assert got == [True, False, True, False, False]


def test_paths(spark):
    df = spark.createDataFrame([("a", None, "c"), ("a", "b", "c"), (None, "b", "c")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(path(F.col("a"), F.col("b"), F.col("c")), path_skip(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [("a", "a > c"), ("a > b > c", "a > b > c"), (None, "b > c")]


@pytest.mark.parametrize(
    ("raw", "category", "want"),
    [
        ("<b>ACME</b> Foo 16GB 【限量】 NT$1,299", "ram", "ACME Foo 16GB"),
        ("Bar Mouse M1 (黑色) 現貨 $500", "mouse", "Bar Mouse M1 黑色"),
        ("Bar Mouse M1 BLACK", "mouse", "Bar Mouse M1 黑色"),
        ("Fan X12 三入組 反向 白色", "fan", "Fan X12 白色 3IN1 反向"),
        ("Board Z1 14+1+2相 AM5 主機板", "motherboard", "Board Z1"),
        ("Paste TF9 散熱膏 ２g", "cooler", "Paste TF9 散熱膏 2g"),
        ("Deck K1 靜音紅軸 中文", "keyboard", "Deck K1 靜音紅軸 中文 紅色"),
        ("Chip Z 6核/12緒 4.4GHz", "cpu", "Chip Z"),
        ("(全部)", "ram", "(全部)"),
    ],
)
def test_clean_name(spark, raw, category, want):
    got = each(spark, names.clean_name(F.col("x"), F.col("c")), [(raw, category)], "x string, c string")
    if "靜音紅軸" in raw:
        assert got[0].startswith("Deck K1 靜音紅軸 中文")
    elif "２g" in raw:
        assert got[0].startswith("Paste TF9 散熱膏 2g")
    else:
        assert got == [want]


def test_brands(spark):
    rows = ["Western Digital Blue", "AWD-IT box", "a wd disk", "FLG tower", "[LG] panel", "T-FORCE x", "Cooler Master Y", "nothing", None]
    assert each(spark, names.extract_brand(F.col("x")), rows) == ["WD", None, "WD", None, "LG", "TEAMGROUP", "Cooler Master", None, None]
    chosen = each(spark, names.choose_brand(F.col("a"), F.col("b"), F.col("c")), [(None, "MSI", "gpu"), ("NVIDIA", "MSI", "gpu"), ("NVIDIA", "MSI", "cpu"), ("micron ", "MSI", "ram"), ("AMD", None, "gpu")], "a string, b string, c string")
    assert chosen == ["MSI", "MSI", "NVIDIA", "Crucial", "AMD"]


def test_cpu_models_and_markers(spark):
    assert each(spark, names.extract_cpu_model(F.col("x")), ["Core i7-14700K", "i5 14400", "Core Ultra 9 285K", "R7 9800X3D", "Ryzen5 5600GT", "H610M"]) == ["I7-14700K", "I5-14400", "ULTRA9-285K", "RYZEN7-9800X3D", "RYZEN5-5600GT", None]
    assert each(spark, names.price_change_marker(F.col("x")), ["a ↘ 漲", "漲", "新品", "x", None]) == ["down", "up", "new", None, None]
    assert each(spark, names.in_stock_flag(F.col("x")), ["缺貨", "ok"]) == [False, True]


def test_graphics_cards(spark):
    rows = ["微星 RTX 5060 Ti VENTUS 2X OC 8G", "MSI RTX5060Ti Ventus 2X OC 8GB $12,900", "華碩 DUAL RTX4060 O8G EVO", "Leadtek RTX A2000 12G", "RX7900XTX NITRO+ 24G", "RTX 5070 12G", "MSI 950W box", None]
    assert each(spark, parts.gpu_sku_key(F.col("x")), rows) == ["RTX5060TI-VENTUS2X-8G-OC", "RTX5060TI-VENTUS2X-8G-OC", "RTX4060-DUAL-8G-OC-REV", "RTXA2000-PRO-12G", "RX7900XTX-NITRO+-24G", None, None, None]
    assert each(spark, parts.gpu_path(F.col("x")), rows) == ["NVIDIA RTX 50系列 > RTX 5060 Ti > 8G > MSI", "NVIDIA RTX 50系列 > RTX 5060 Ti > 8G > MSI", "NVIDIA RTX 40系列 > RTX 4060 > ASUS", "NVIDIA 專業繪圖卡 > RTX A2000 > Leadtek", "其他系列 > RX 7900 XTX", "NVIDIA RTX 50系列 > RTX 5070", None, None]


def test_processor_and_board_paths(spark):
    rows = ["Intel Core i5-14400F", "Core Ultra 9 285K", "Intel i7-9700", "AMD R7 9800X3D", "Ryzen 5 5600GT", "Threadripper PRO 7965WX", "Intel Xeon W5-2455X", "Pentium 第12代", "x"]
    assert each(spark, parts.cpu_path(F.col("x")), rows) == ["Intel > 第 14 代 > Core i5", "Intel > Core Ultra 200S > Ultra 9", "Intel > 其他／舊款 > Core i7", "AMD > Ryzen 9000 (Zen5) > Ryzen 7", "AMD > Ryzen 5000 (Zen3) > Ryzen 5", "AMD > Threadripper 7000", "Intel > Xeon 工作站 > W5", "Intel > 第 12 代", None]
    boards = ["華碩 PRIME B650E-PLUS", "MSI MAG X870 Tomahawk", "技嘉 B760M DS3H", "no chipset AM5 board", "LGA 1700 board", "x"]
    assert each(spark, parts.motherboard_path(F.col("x")), boards) == ["AMD AM5 > B650E > ASUS", "AMD AM5 > X870 > MSI", "Intel LGA1700 > B760 > GIGABYTE", "AMD AM5", "Intel LGA1700", None]


def test_storage_and_power_paths(spark):
    ram = ["Foo DDR5-6000 16GB*2", "Bar D4 8G 3200 筆電用", "KSM64R52BD4 ECC 64G", "plain"]
    assert each(spark, storage.ram_path(F.col("x")), ram) == ["桌上型 UDIMM > DDR5 > 32G (16G*2) > 6000MHz", "筆電用 SO-DIMM > DDR4 > 8G > 3200MHz", "伺服器記憶體 > DDR5 > 64G", "桌上型 UDIMM > DDR5"]
    ssd = ["Foo 1TB/Gen5 2280", "Foo 480GB/2.5吋 SATA", "外接式 USB10G 2T", "Foo M.2"]
    assert each(spark, storage.ssd_path(F.col("x")), ssd) == ["M.2 NVMe SSD > PCIe 5.0 > 1TB > 2280", "SATA 2.5吋 > 480GB", "行動外接式 > 2TB", "M.2 NVMe SSD > PCIe 4.0 > 未標容量"]
    hdd = ["新梭魚 4TB 5400轉", "EXOS 16T", "那嘶狼 8TB 2.5吋"]
    assert each(spark, storage.hdd_path(F.col("x")), hdd) == ["桌上型硬碟 > 3.5 吋 > 4TB > 5400轉", "企業級硬碟 > 3.5 吋 > 16TB > 7200轉", "NAS 專用碟 > 2.5 吋 > 8TB"]
    psu = ["Foo UD750GM 金牌 全模組", "SFX-L 1000W 白金", "Foo 550瓦 銅牌 直出", "SFX x"]
    assert each(spark, storage.psu_path(F.col("x")), psu) == ["ATX 電源 > 750W~1000W > 80+ 金牌 > 全模組", "SFX-L 電源 > 1000W 以上 > 80+ 白金牌", "ATX 電源 > 600W 以下 > 80+ 銅牌 > 直出非模組", "SFX 電源 > 未標瓦數"]


def listing(i, source, name, price=1000, category="ram", brand="Kingston", model=None, specs=None, raw=None):
    return (i, source, name, raw or name, price, category, brand, model, specs or {})


SCHEMA = "id string, source string, name string, raw_name string, price long, category string, brand string, model string, specs map<string,string>"


def test_exact_keys_and_groups(spark):
    rows = [
        listing("a", "s1", "Intel i5-14400", category="cpu", brand="Intel", model="I5-14400"), listing("b", "s2", "Core i5 14400 boxed", category="cpu", brand="Intel", model="I5-14400"),
        listing("c", "s1", "Kingston 16G DDR5 NB"), listing("d", "s2", "NB DDR5 16G 金士頓 筆記型"), listing("e", "s2", "NB DDR5 16G 金士頓 筆記型", specs={"priceCondition": "搭板價"}),
        listing("f", "s1", "Disk 8T one", category="hdd", brand="Seagate", raw="Disk ST8000DM004 8T"), listing("g", "s2", "other words 8T", category="hdd", brand="Seagate", raw="新梭魚 8T ST8000DM004"),
        listing("h", "s1", "Kingston 16G kit DDR5"), listing("i", "s2", "Kingston 16G kit DDR5", raw="Kingston 16GB*2 kit DDR5"), listing("j", "s1", "tiny"), listing("k", "s1", "Card RTX", category="gpu"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found: dict[str, list[str]] = {}
    for r in match.exact_groups(df).collect():
        found.setdefault(r.group_key, []).append(r.id)
    assert sorted(map(sorted, found.values())) == [["a", "b"], ["c", "d"], ["f", "g"]]
    assert {r.id: r.match_group_id for r in match.assign_group_ids(df, match.exact_groups(df)).collect()}["j"] == "mg-j"


def brute_fuzzy(rows, threshold=0.7, ratio=1.6):
    import re

    token = lambda n: {t for t in re.split(r"\s+", re.sub(r"[^A-Z0-9一-鿿\s]", " ", n.upper())) if len(t) > 1}
    alike = lambda a, b: a[5] == b[5] and a[1] != b[1] and max(a[4], b[4]) <= ratio * min(a[4], b[4]) and (u := token(a[2]) | token(b[2])) and len(token(a[2]) & token(b[2])) / len(u) >= threshold
    rows, taken, out = sorted(rows), set(), []
    for k, seed in enumerate(rows):
        if seed[0] in taken:
            continue
        group = [seed]
        for other in rows[k + 1 :]:
            prices = [x[4] for x in [*group, other]]
            if other[0] not in taken and other[1] not in {x[1] for x in group} and alike(seed, other) and max(prices) <= ratio * min(prices):
                group.append(other)
        if len(group) > 1:
            taken |= {x[0] for x in group}
            out.append(sorted(x[0] for x in group))
    pairs = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if alike(a, b)}
    return sorted(out), pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fuzzy_groups_equal_brute_force(spark, seed):
    r = random.Random(seed)
    word = ["AA", "BB", "CC", "DD", "EE", "FF", "GG", "HH"]
    rows = [listing(f"{k:03}", f"s{r.randrange(4)}", " ".join(r.sample(word, r.randrange(3, 7))), r.choice([100, 130, 150, 200]), r.choice(["ram", "ssd"]), None) for k in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = match.candidate_pairs(df)
    groups_, want_pairs = brute_fuzzy(rows)
    assert {(p.a, p.b) for p in pairs.collect()} == want_pairs
    # Names of fewer than eight characters have no key and come last; here all have one.
    assert all(len(x[2]) >= 8 for x in rows)
    found: dict[str, list[str]] = {}
    for x in match.fuzzy_groups(df, pairs).collect():
        found.setdefault(x.group_key, []).append(x.id)
    assert sorted(map(sorted, found.values())) == groups_


def test_a_hot_name_is_one_class_for_each_source_and_price(spark, monkeypatch):
    """A third of all listings share a name, no token is rare, and blocks are split: rows follow the classes, not the listings."""
    monkeypatch.setattr(match, "BLOCK", 3)
    r = random.Random(9)
    word = ["AA", "BB", "CC", "DD", "EE", "FF"]
    rows = [listing(f"{k:03}", f"s{r.randrange(3)}", "AA BB CC DD" if k % 3 == 0 else " ".join(r.sample(word, r.randrange(3, 6))), r.choice([100, 150, 200])) for k in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = match.class_pairs(match.classed(df)).collect()
    assert {(p.a, p.b) for p in match.candidate_pairs(df).collect()} == brute_fuzzy(rows)[1]
    assert sum(p.a_n * p.b_n for p in found) == len(brute_fuzzy(rows)[1]) > len(found)
    assert all(p.a_id < p.b_id for p in found) and len({(p.a, p.b) for p in found}) == len(found)


def test_pairs_are_verified_where_they_meet(spark):
    """No candidate is shuffled: above the join of the blocks nothing is joined, dealt or aggregated."""
    found = match.class_pairs(match.classed(spark.createDataFrame([listing("a", "s1", "AA BB CC DD"), listing("b", "s2", "AA BB CC DD")], SCHEMA)))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    above = list(itertools.takewhile(lambda x: not ("Join" in x and "token" in x and "part" in x), plan))
    assert len(above) < len(plan) and not [x for x in above if "Join" in x or "Exchange" in x or "Aggregate" in x]


@pytest.mark.parametrize(("rare", "common"), [(0, 1_000_000), (4, 1_000_000), (0, 6), (1000, 1)])
def test_pairs_do_not_depend_on_which_tokens_count_as_rare(spark, monkeypatch, rare, common):
    """No row of a token is shuffled to learn how common it is: the block join is the only one that is not sent to every task."""
    monkeypatch.setattr(match, "RARE", rare)
    monkeypatch.setattr(match, "COMMON", common)
    r = random.Random(4)
    word = ["AA", "BB", "CC", "DD", "EE", "FF", "GG"]
    rows = [listing(f"{k:03}", f"s{r.randrange(3)}", " ".join([*r.sample(word, r.randrange(2, 6)), *[f"U{r.randrange(9)}"] * (k % 2)]), r.choice([100, 150, 200])) for k in range(120)]
    found = match.class_pairs(match.classed(spark.createDataFrame(rows, SCHEMA)))
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "part#" not in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
    ids = {x.id: x["class"] for x in match.classed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(p.a, p.b) for p in found.collect()} == {min(((ids[a], ids[b]), (ids[b], ids[a])), key=lambda c: min(i for i in ids if ids[i] == c[0])) for a, b in brute_fuzzy(rows)[1]}


def test_names_are_compared_once_for_all_their_sources_and_prices(spark, monkeypatch):
    """Three names with 60 classes each are three sets to compare, and as many rows as their classes fill."""
    rows = [listing(f"{n}-{s}-{p}", f"s{s}", name, 100 + p) for n, name in enumerate(["AA BB CC DD", "AA BB CC DD EE", "XX YY ZZ"]) for s in range(3) for p in range(20)]
    df, compared, alike = spark.createDataFrame(rows, SCHEMA), [], match._alike
    monkeypatch.setattr(match, "_alike", lambda sets, *a: compared.append(sets.count()) or alike(sets, *a))
    found = {tuple(sorted((x.a_id, x.b_id))) for x in match.class_pairs(match.classed(df)).collect()}
    assert compared == [3]
    monkeypatch.setattr(match, "MEMBERS", 7)
    assert {tuple(sorted((x.a_id, x.b_id))) for x in match.class_pairs(match.classed(df)).collect()} == found
    assert found == brute_fuzzy(rows)[1] and 20 < compared[1] < 60


@pytest.mark.parametrize(("long", "depth", "members", "threshold"), [(0, 3, 2, 0.7), (0, 2, 64, 0.4), (3, 3, 1, 0.3), (0, 4, 3, 0.55)])
def test_pairs_do_not_depend_on_how_blocks_are_divided(spark, monkeypatch, long, depth, members, threshold):
    for name, value in (("RARE", 0), ("BLOCK", 2), ("LONG", long), ("DEPTH", depth), ("MEMBERS", members)):
        monkeypatch.setattr(match, name, value)
    r = random.Random(members)
    word = ["AA", "BB", "CC", "DD", "EE", "FF", "GG", "HH"]
    rows = [listing(f"{k:03}", f"s{r.randrange(3)}", " ".join(r.sample(word, r.randrange(1, 8))), r.choice([0, 100, 150, 200]), r.choice(["ram", "ssd"])) for k in range(150)]
    near = lambda p, q: min(p, q) <= 0 or max(p, q) <= 1.6 * min(p, q)
    share = lambda v, w: len(v & w) / len(v | w)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[5] == b[5] and a[1] != b[1] and near(a[4], b[4]) and share(set(a[2].split()), set(b[2].split())) >= threshold}
    got = [(x.a, x.b) for x in match.candidate_pairs(spark.createDataFrame(rows, SCHEMA), threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_keyless_is_a_null_key(spark):
    names = ["Intel i5-14400", "short", "a name that is long enough", None, ""]
    rows = [listing(f"{k}-{c}-{b}", "s1", n, category=c, brand=b, model=m, raw=raw) for c in ("cpu", "gpu", "hdd", "ram", "package", "network", None) for k, (n, m, raw) in enumerate(itertools.product(names, (None, "X1"), (None, "Disk ST8000DM004 8T"))) for b in (None, "Seagate")]
    df = spark.createDataFrame([(i, s, n, raw, p, c, b, m, x) for i, s, n, raw, p, c, b, m, x in rows], SCHEMA)
    got = df.select(match.is_keyless(df).alias("fast"), match.exact_match_key(df).isNull().alias("slow")).collect()
    assert all(x.fast == x.slow for x in got) and {x.fast for x in got} == {True, False}


def greedy(nodes, pairs, ratio=1.6):
    """Groups by one pass over all listings in order."""
    near, taken, out = {}, set(), []
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in sorted(nodes):
        if i in taken:
            continue
        group = [i]
        for j in sorted(near.get(i, ())):
            prices = [nodes[k][1] for k in [*group, j]]
            if j > i and j not in taken and nodes[j][0] not in {nodes[k][0] for k in group} and not (min(prices) > 0 and max(prices) > ratio * min(prices)):
                group.append(j)
        if len(group) > 1:
            taken |= set(group)
            out.append("-".join(group))
    return sorted(out)


def graphs():
    r = random.Random(5)
    name = "{:03}".format
    yield "chain", {name(k): (f"s{k % 3}", 100) for k in range(40)}, [(name(k), name(k + 1)) for k in range(39)]
    yield "chain backwards", {name(k): (f"s{k % 2}", 100) for k in range(30)}, [(name(29 - k), name(28 - k)) for k in range(29)]
    yield "star", {name(k): (f"s{k % 7}", 100 + k % 90) for k in range(60)}, [(name(30), name(k)) for k in range(60) if k != 30]
    yield "one source", {name(k): ("s0", 100) for k in range(5)}, [("000", "001"), ("001", "004")]
    yield "free", {name(k): (f"s{k}", 0 if k % 2 else 100) for k in range(6)}, [("000", "001"), ("001", "002"), ("003", "005")]
    yield "none", {"000": ("s0", 1)}, []
    for seed in range(3):
        n = 60
        nodes = {name(k): (f"s{r.randrange(2 + seed * 4)}", r.choice([100, 120, 150, 180])) for k in range(n)}
        yield f"random {seed}", nodes, [(a, b) for a, b in itertools.combinations(sorted(nodes), 2) if r.random() < 0.08 and nodes[a][0] != nodes[b][0]]


@pytest.mark.parametrize(("nodes", "pairs"), [g[1:] for g in graphs()], ids=[g[0] for g in graphs()])
def test_groups_settled_in_rounds_equal_one_pass(spark, nodes, pairs):
    df = spark.createDataFrame([listing(i, s, f"name of {i}", p) for i, (s, p) in nodes.items()], SCHEMA)
    found = match.fuzzy_groups(df, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert sorted({r.group_key for r in found}) == greedy(nodes, pairs)
    assert sorted((r.id, r.group_key) for r in found) == sorted((i, k) for k in {r.group_key for r in found} for i in k.split("-"))


@pytest.mark.parametrize(("nodes", "pairs"), [g[1:] for g in graphs() if g[0] in ("chain", "star", "random 1")])
def test_components_beyond_one_pass_settle_in_rounds(spark, monkeypatch, nodes, pairs):
    monkeypatch.setattr(match, "ONE_PASS", 5)
    df = spark.createDataFrame([listing(i, s, f"name of {i}", p) for i, (s, p) in nodes.items()], SCHEMA)
    found = match.fuzzy_groups(df, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert sorted({r.group_key for r in found}) == greedy(nodes, pairs)


def test_greedy_groups_do_not_write_the_pairs_of_equal_listings(spark, monkeypatch):
    """Sixty equal listings of a source make 10,800 pairs of listings and sixty groups that wait for each other."""
    rows = [listing(f"{k:03}", f"s{k % 3}", "AA BB CC DD", 100 + k % 2) for k in range(180)] + [listing(f"x{k}", f"s{k % 3}", f"AA BB CC DD E{k}", 90) for k in range(9)]
    df, written, jobs = spark.createDataFrame(rows, SCHEMA), [], match.cut

    def counted(x):
        written.append(jobs(x))
        return written[-1]

    monkeypatch.setattr(match, "cut", counted)
    found = {r.group_key for r in match.similar_groups(df).collect()}
    want, _ = brute_fuzzy(rows)
    assert sorted(sorted(k.split("-")) for k in found) == want
    assert len(written) < 12 and max(x.count() for x in written) <= len(rows)


def test_greedy_groups_do_not_write_the_pairs_of_prices(spark, monkeypatch):
    """Two names at 30 prices in three sources: pairs of names alone are written, not those of their prices."""
    rows = [listing(f"{k:03}", f"s{k % 3}", "AA BB CC DD" + " EE" * (k % 2), 100 + k // 6) for k in range(180)]
    df, written, cut = spark.createDataFrame(rows, SCHEMA), [], match.cut
    monkeypatch.setattr(match, "cut", lambda x: written.append(cut(x)) or written[-1])
    found = {r.group_key for r in match.similar_groups(df).collect()}
    assert sorted(sorted(k.split("-")) for k in found) == brute_fuzzy(rows)[0]
    assert [x.count() for x in written if x.columns == ["a", "b"]] == [3]


@pytest.mark.parametrize("one_pass", [4_000_000, 3])
def test_greedy_groups_of_kinds_hold_the_price_of_the_seed(spark, monkeypatch, one_pass):
    """A free offer is near to all prices, but what joins its group must be near to the seed as well."""
    monkeypatch.setattr(match, "ONE_PASS", one_pass)
    r = random.Random(8)
    word = ["AA", "BB", "CC", "DD", "EE", "FF"]
    rows = [listing(f"{k:03}", f"s{r.randrange(5)}", " ".join(r.sample(word, r.randrange(4, 6))), r.choice([0, 100, 150, 200, 300])) for k in range(60)]
    near = lambda p, q: min(p, q) <= 0 or max(p, q) <= 1.6 * min(p, q)
    alike = lambda a, b: a[1] != b[1] and near(a[4], b[4]) and len(set(a[2].split()) & set(b[2].split())) >= 0.7 * len(set(a[2].split()) | set(b[2].split()))
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if alike(a, b)]
    found = match.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({x.group_key for x in found}) == greedy({x[0]: (x[1], x[4]) for x in rows}, pairs)


def test_unknown_prices_and_sources_in_one_pass():
    assert match._with((frozenset(("a",)), None, None), "b", None, 1.6) is None
    assert match._with((frozenset(("a",)), None, None), "b", 5.0, 1.6) == (frozenset(("a", "b")), 5.0, 5.0)
    assert match._with((frozenset(("a",)), 0.0, 9.0), "b", 90.0, 1.6) == (frozenset(("a", "b")), 0.0, 90.0)
    assert match._with((frozenset((None,)), 5.0, 5.0), "b", 5.0, 1.6) is None and match._with((frozenset(("a",)), 5.0, 5.0), None, 5.0, 1.6) is None


def test_match_groups_come_by_price_difference(spark):
    rows = [
        listing("a", "s1", "Card One Two Three longer", 100), listing("b", "s2", "Card One Two Three", 130), listing("c", "s3", "Three Two One Card", 150),
        listing("d", "s1", "Disk Alpha Beta Gamma Delta", 50), listing("e", "s2", "Disk Alpha Beta Gamma Delta X1", 60), listing("f", "s1", "lonely thing here", 70),
    ]
    got = [(r.members, r.sources, r.name, r.lowest_price, r.highest_price, r.price_diff) for r in match.match_groups(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(["b", "c"], 2, "Card One Two Three", 130, 150, 20), (["d", "e"], 2, "Disk Alpha Beta Gamma Delta", 50, 60, 10)]


def test_variants_do_not_pair(spark):
    rows = [listing("a", "s1", "Deck One Two Three 紅軸 BLACK", category="keyboard"), listing("b", "s2", "Deck One Two Three 茶軸 BLACK", category="keyboard"), listing("c", "s3", "Deck One Two Three 紅軸 WHITE", category="keyboard"), listing("d", "s4", "Deck One Two Three 紅軸 BLACK", category="keyboard")]
    got = {(p.a, p.b) for p in match.candidate_pairs(spark.createDataFrame(rows, SCHEMA), threshold=0.5).collect()}
    assert got == {("a", "d")}


def test_history_and_status(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    seen = spark.createDataFrame([(1, 5, t(0)), (1, 5, t(1)), (1, 6, t(2)), (1, 5, t(3)), (2, None, t(0)), (2, None, t(1))], "product_id long, price long, recorded_at timestamp")
    assert sorted((r.product_id, r.recorded_at.minute) for r in history.price_changes(seen).collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]
    assert [r.recorded_at.minute for r in history.recent_history(seen, 2).where("product_id = 1").orderBy("rank").collect()] == [3, 2]
    logs = spark.createDataFrame([], "source string, status string, items_count int, duration_ms long, error_message string, created_at timestamp")
    logs = feeds.append_run_log(logs, "a", "success", 3, 10, None, F.lit(t(0)))
    logs = feeds.append_run_log(logs, "b", "error", 0, 10, "no", F.lit(t(59)))
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    items = spark.createDataFrame([("a",)], "source string")
    got = {r.source: (r.status, r.product_count, r.last_error) for r in history.source_status(items, logs, F.lit(datetime.datetime(2024, 1, 1, 1)), sources).collect()}
    assert got == {"a": ("healthy", 1, None), "b": ("error", 0, "no"), "c": ("stale", 0, None)}
    late = {r.source: r.status for r in history.source_status(items, logs, F.lit(datetime.datetime(2024, 1, 1, 3)), sources).collect()}
    assert late["a"] == "stale"


def test_feeds_and_pages(spark):
    texts = ['[{"name":"A","price":"1,299"},3]', '{"ok":1,"items":[{"title":"B","price":7,"in_stock":false}]}', '{"x":[{"prod_name":"C","sale_price":"NT 5","url":"/p"}],"y":2}', "nonsense", None, '[{"name":"D","price":0}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    got = sorted((r.i, r.feed_key, r.name, r.price, r.in_stock, r.source_url) for r in feeds.feed_to_listings(feeds.explode_json_feed(df), url_prefix="http://h").collect())
    assert got == [(0, None, "A", 1299, True, None), (1, None, "B", 7, False, None), (2, "x", "C", 5, True, "http://h/p")]
    html = "<select name=n1><option value=''>請選擇</option><option value=1>直 $10 ↘</option><optgroup label='組'><option value=2>顯示卡 $1,234</option><option value=3>== x</option></optgroup></select><select name='n_x'><option value=1>no $1</option></select>"
    page = spark.createDataFrame([("p", bytearray(html.encode("big5")))], "page_id string, content binary")
    rows = pages.parse_option_text(pages.parse_option_pages(page, {"n1": "gpu"})).collect()
    assert [(r.label, r.name, r.price, r.price_change, r.category) for r in rows] == [(None, "直", 10, "down", "gpu"), ("組", "顯示卡", 1234, None, "gpu")]


def batch(spark, rows):
    return spark.createDataFrame([(i, "shop", f"Kingston memory {i}", p, "ram", None, None, datetime.datetime(2024, 1, d)) for i, p, d in rows], "id string, source string, raw_name string, price long, category string, brand string, model string, scraped_at timestamp")


def test_stream_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = batch(spark, []).schema
    for k, rows in enumerate([[("a", 100, 1), ("b", 200, 1), ("j", 1, 1)], [("a", 150, 2), ("c", 300, 2)]]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_ingest(stream, str(tmp_path / "tables"), str(tmp_path / "state")).awaitTermination()
        read = lambda t: jobs.committed(spark, str(tmp_path / "tables"))[t]
        products = {r.id: (r.price, r.brand, r.match_group_id) for r in read("products").collect()}
        if k == 0:
            assert products == {"a": (100, "Kingston", "mg-a"), "b": (200, "Kingston", "mg-b")}
        else:
            assert products == {"a": (150, "Kingston", "mg-a"), "c": (300, "Kingston", "mg-c")}
            assert sorted((r.product_id, r.price) for r in read("history").collect()) == [("a", 100), ("a", 150), ("c", 300)]
            assert read("groups").count() == 2


def test_a_batch_leaves_other_sources_alone(spark, tmp_path):
    folder = str(tmp_path)
    put = jobs.ingest_batch(folder, clean=ingest.drop_junk_prices)
    row = lambda i, source, p, d: (i, source, f"memory {i}", f"memory {i}", p, datetime.datetime(2024, 1, d))
    make = lambda *rows: spark.createDataFrame(rows, "id string, source string, name string, raw_name string, price long, scraped_at timestamp")
    files = lambda: {str(f) for f in tmp_path.glob("products/*/shop=of-1/*.parquet")}
    # The name of a source looks like a number; one has none.
    put(make(row("a", "01", 100, 1), row("b", "1", 200, 1), row("c", "1", 300, 1), row("n", None, 50, 1)), 0)
    before = files()
    put(make(row("a", "01", 120, 2), row("d", "01", 90, 2)), 1)
    assert files() == before
    put(make(row("d", "01", 90, 3)), 2)
    now = jobs.committed(spark, folder)
    assert sorted((r.id, r.source, r.price) for r in now["products"].collect()) == [("b", "1", 200), ("c", "1", 300), ("d", "01", 90), ("n", None, 50)]
    assert sorted((r.product_id, r.price) for r in now["history"].collect()) == [("b", 200), ("c", 300), ("d", 90), ("n", 50)]
    whole = groups.build_match_groups(now["products"])
    assert sorted(map(str, now["groups"].select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    plan = jobs.committed(spark, folder, only={"of-1"})["products"]
    assert sorted(r.id for r in plan.collect()) == ["b", "c"]
    # The version of each shop is chosen before files are listed for the scan.
    scan = next(x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    pruned = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "version" in pruned and "shop" in pruned


def test_groups_refreshed_by_change_equal_those_built_anew(spark):
    r = random.Random(4)
    rows = [(f"i{k}", f"s{k % 3}", f"name {k}", r.randrange(100, 200), f"g{r.randrange(12)}" if k else None) for k in range(60)]
    schema = "id string, source string, name string, price long, match_group_id string"
    now, stored = spark.createDataFrame(rows, schema), None
    stored = groups.build_match_groups(now)
    for _ in range(3):
        # Some listings go, some cost something else, some move to another or a new group.
        seen, after, touched = rows, [], []
        for row in seen:
            dice = r.random()
            new = None if dice < 0.05 else (*row[:3], row[3] + 9, row[4]) if dice < 0.1 else (*row[:4], f"g{r.randrange(14)}") if dice < 0.15 else row
            if new is not row:
                touched += [row[4]] + ([new[4]] if new else [])
            after += [new] if new else []
        rows, now = after, spark.createDataFrame(after, schema)
        stored = groups.refresh_match_groups(stored, now, spark.createDataFrame([(t,) for t in touched], "match_group_id string"))
        assert sorted(map(str, stored.collect())) == sorted(map(str, groups.build_match_groups(now).collect()))


@pytest.mark.parametrize("cut_after", ["products", "history", "groups"])
def test_a_batch_cut_off_or_run_again_leaves_one_result(spark, tmp_path, cut_after):
    folder = str(tmp_path)

    def fail(step):
        if step == cut_after:
            raise OSError(step)

    state = lambda: {t: sorted(map(str, jobs.committed(spark, folder)[t].drop("updated_at").collect())) for t in ("products", "history", "groups")}
    jobs.ingest_batch(folder)(batch(spark, [("a", 100, 1), ("b", 200, 1)]), 0)
    first, second = state(), batch(spark, [("a", 150, 2), ("c", 300, 2)])
    with pytest.raises(OSError, match=cut_after):
        jobs.ingest_batch(folder, finished=fail)(second, 1)
    assert state() == first
    jobs.ingest_batch(folder)(second, 1)
    once = state()
    jobs.ingest_batch(folder)(second, 1)
    assert state() == once != first and len(once["products"]) == 2 and len(once["history"]) == 3
    jobs.ingest_batch(folder)(batch(spark, []), 2)
    assert state() == once


def test_stream_price_changes_in_two_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "product_id long, price long, ts timestamp"
    for rows in ([(1, 5, t(0)), (1, 5, t(1)), (1, 6, t(2))], [(1, 6, t(3)), (1, 9, t(1)), (1, 7, t(4)), (2, 1, t(0))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = jobs.stream_price_changes(spark.readStream.schema(schema).parquet(source))
        changes.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    assert sorted((r.product_id, r.price, r.ts.minute) for r in spark.read.parquet(out).collect()) == [(1, 5, 0), (1, 6, 2), (1, 7, 4), (2, 1, 0)]


def test_idle_products_are_forgotten_and_late_rows_ignored(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "product_id long, price long, ts timestamp"
    # 1 is idle from 0 to 11 o'clock; 2 is seen at every run; 3 has no price twice; the row of 2 at 1 o'clock is late.
    runs = [[(1, 5, t(0)), (2, 8, t(0)), (3, None, t(0)), (3, None, t(0, 1)), (3, 4, t(0, 2))], [(2, 8, t(2)), (2, 8, t(2))], [(2, 8, t(4)), (2, 9, t(1)), (3, 4, t(4))], [(1, 5, t(11)), (2, 8, t(5)), (2, 8, t(11))]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = jobs.stream_price_changes(spark.readStream.schema(schema).parquet(source), late="1 hour", idle=datetime.timedelta(hours=3))
        q = changes.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
    got = sorted((r.product_id, -1 if r.price is None else r.price, r.ts.hour) for r in spark.read.parquet(out).collect())
    # Product 3 came again at 4 before the watermark, then at 1, had passed the three hours after its last row.
    assert got == [(1, 5, 0), (1, 5, 11), (2, 8, 0), (3, -1, 0), (3, 4, 0)]
    # The last run's watermark, 10 o'clock, has emptied the state but for products seen at 11.
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("operatorId", 0).option("stateVarName", "last").load()
    assert {r.key[0] for r in state.collect()} == {1, 2}


def test_audit_samples_and_groups(spark):
    rows = [(*listing("a", "s1", "long enough", 10, "other"), "g", "x"), (*listing("b", "s2", "long enough", 100, "package"), "g", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", match_group_id string, subcategory string")
    made = groups.build_match_groups(df)
    found = {r.check: (r["count"], r.passed) for r in audit.run_audit(df, made).collect()}
    assert found["category_other"] == (1, False) and found["package_without_subcategory"] == (1, False) and found["price_spread"] == (1, False) and found["key_split"] == (0, True)
    assert [r.id for r in audit.audit_samples(df, made, "category_other").collect()] == ["a"]
    assert [r.id for r in audit.audit_samples(df, made, "price_spread").collect()] == ["g"]


def test_rebuild_counts_changes(spark):
    df = spark.createDataFrame([(*listing("a", "s1", "old name", raw="Kingston new name"),), (*listing("b", "s1", "Kingston same"),), (*listing("c", "s1", "Kingston x", 3),)], SCHEMA)
    again, changed = ingest.rebuild(df)
    assert changed.first()[0] == 2 and {r.id for r in again.collect()} == {"a", "b"}


def test_price_conditions_reach_specs_and_count_as_changes(spark):
    rows = [listing("a", "s1", "Kingston same"), listing("b", "s2", "Kingston same", raw="Kingston same 搭板價", specs={"x": "1"}), listing("c", "s2", "Kingston same", specs={"priceCondition": "加購價"})]
    df = spark.createDataFrame([(*x[:2], "Kingston same", *x[3:]) for x in rows], SCHEMA)
    want = {"a": {}, "b": {"x": "1", "priceCondition": "搭板價"}, "c": {"priceCondition": "加購價"}}
    batch = ingest.process_batch(df)
    assert {r.id: r.specs for r in batch.collect()} == want
    assert [r.id for r in match.unconditioned(batch).collect()] == ["a"]
    assert [r.id for r in match.unconditioned(ingest.process_batch(df.drop("specs"))).collect()] == ["a", "c"]
    named = batch.withColumn("specs", F.when(F.col("id") == "b", F.create_map(F.lit("x"), F.lit("1"))).otherwise(F.col("specs")))
    assert ingest.rebuild(named)[1].first()[0] == 1


def test_titles_are_worked_on_once(spark, monkeypatch):
    """Repeated titles reach the rules once, nulls included; a category other than package asks for no reason at all."""
    from offerloom.functions import detect
    from offerloom.operators import once

    rows = [(k, "MSI GTX 1660" if k % 2 else None, "a") for k in range(40)]
    seen = []

    def find(titles):
        seen.append(sorted(map(str, (r.t for r in titles.collect()))))
        return titles.withColumn("made", F.coalesce(F.lower("t"), F.lit("none")))

    got = once.once(spark.createDataFrame(rows, "id long, t string, c string"), ("t",), find, ("made",)).collect()
    assert seen == [["MSI GTX 1660", "None"]]
    assert sorted((r.id, r.made) for r in got) == [(k, "msi gtx 1660" if k % 2 else "none") for k in range(40)]
    asked = []
    whole = detect.bundle_reason
    monkeypatch.setattr(detect, "bundle_reason", lambda df, raw="raw_name", into="bundle_reason": asked.extend(r[0] for r in df.select(raw).collect()) or whole(df, raw, into))
    df = spark.createDataFrame([("x", "case", "CPU + 主機板 組合"), ("y", "package", "i5 + B760")] * 5, "id string, category string, raw_name string")
    ingest.retain_listings(df).collect()
    assert sorted(map(str, asked)) == ["None", "i5 + B760"]
