"""WARC archives, shards, URL filters and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerloom.llm import sharding, url_filter, warc
from offerloom.llm.queries import ORACLE_SQL, QUERIES


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(1)
    body = ["", None, "short", "é" * 60, "x" * 99, "y" * 100, "z" * 200_000] + ["".join(r.choice("<p>abc ") for _ in range(400)) for _ in range(60)]
    rows = [(i, f"http://a.example/{i}\r\nX: y" if i % 7 == 0 else f"http://a.example/{i}", body[i % len(body)], "extra") for i in range(200)] + [(500, None, body[8], "e"), (None, "u", body[9], "e"), (3, "u", body[3], "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=20_000)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) == sum(m.records for m in manifest.collect())
    assert manifest.count() > 3
    first: dict[str, int] = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        to = first.get(h) if len(p) >= 100 else None
        revisit = to is not None and to != i
        want[("" if i is None else str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(to) if revisit else None, None if revisit else p)] += 1
    have = Counter((g.id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to, None if g.payload is None else bytes(g.payload)) for g in got)
    assert have == want
    assert all("\r" not in g.uri for g in got)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_damaged_archive_is_refused():
    frames = list(warc.archive([b"WARC/1.1\r\n\r\n" + bytes([k]) * 500 for k in range(20)]))
    data = b"".join(frames)

    def reader(raw):
        at = [0]

        def read(n):
            at[0] += n
            return raw[at[0] - n : at[0]]

        return read

    assert len(list(warc.records(reader(data), chunk=37))) == 20
    with pytest.raises(ValueError):
        list(warc.records(reader(data[:-5]), chunk=37))
    with pytest.raises(ValueError):
        list(warc.records(reader(frames[1] + data)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100, 997, 5000])
def test_network_is_a_permutation(spark, n):
    got = [x[0] for x in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n == 5000:
        assert got != list(range(n)) and got == [x[0] for x in spark.range(n).repartition(7).select("id", sharding.permuted(F.col("id"), n).alias("p")).orderBy("id").select("p").collect()]


def test_shards(spark):
    texts = [None, "", "a", "é" * 10, "x" * 20_000] + [f"text {i}" for i in range(200)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(9, "same", 0)] * 50 + [(None, "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sharding.shards(docs, count=24).collect()
    assert len(got) == len(rows)
    size = Counter(x.shard for x in got)
    assert max(size.values()) - min(size.values()) <= 1 and set(size) == set(range(24))
    for s in size:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(size[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((x.id, x.size, x.crc32) for x in got) == want
    key = lambda x: (x.id is None, x.id or 0, x.size, x.crc32, x.row, x.shard, x.slot)
    assert sorted(got, key=key) == sorted(sharding.shards(docs.repartition(9), count=24).collect(), key=key)
    assert sharding.shards(docs.limit(0)).collect() == []


URLS = {
    None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.COM": ("a.com", ""), "http://a.com/": ("a.com", "/"), "HTTP://Ä.Com/En/#x": ("Ä.com", "/En/"),
    "x://example.com/en/a?b://c": ("example.com", "/en/a"), "http://h?q/r": ("h", ""), "http://h#q/r": ("h", ""), "://w.net/fr/": ("w.net", "/fr/"), "http://u@h:80/p?": ("u@h:80", "/p"),
}


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", url_filter.host(F.col("url")).alias("h"), url_filter.path(F.col("url")).alias("p")).collect()}
    assert got == URLS
    cases = {("a.com", "/"): "com/", ("acom", "/"): None, ("com", "/x"): "com/", ("a.com", ""): None, ("example.com", "/en/x"): "example.com/en/", ("www.example.com", "/en/"): "www.example.com/en/", ("m.www.example.com", "/en/"): "www.example.com/en/", ("x.net", "/es/"): "net/es/", ("x.net", "/es"): None, ("x.org", "/fr/"): None}
    rows = spark.createDataFrame(list(cases), "h string, p string")
    name, _ = url_filter.fitting_rule(F.col("h"), F.col("p"))
    assert {(r.h, r.p): r.n for r in rows.select("h", "p", name.alias("n")).collect()} == cases


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        host = r.choice(["casino.example.org", "win.example.org"]) if bad else r.choice(["news.example.org", "blog.site.org", "casino.site.org"])
        rows.append((i, f"https://{host}/{r.choice(['en', 'de'])}/{i}" + ("?ref=1" if r.random() < 0.5 else "")))
    pages = spark.createDataFrame([*rows, (999, None), (0, rows[0][1])], "page_id long, url string").withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(0, 400, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == 402
    token = {x.page_id: set(x.t) for x in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}
    bad = labels.collect()
    baskets = [(token[x.doc_id], x.quality == 0) for x in bad if x.quality is not None]
    share = sum(b for _, b in baskets) / len(baskets)
    for x in got:
        if x.mined:
            items = set(x.mined.split(" "))
            assert items <= token[x.id]
            held = [b for t, b in baskets if items <= t]
            assert sum(held) / len(held) == pytest.approx(x.confidence) and x.confidence >= url_filter.CONFIDENCE and x.confidence / share >= url_filter.LIFT
        # A token alone that is always bad must be found for every page that has it.
        sure = any(all(b for t, b in baskets if k in t) and sum(k in t for t, _ in baskets) >= url_filter.LEAST_ROWS for k in token[x.id])
        assert not sure or x.mined
        assert x.verdict == ("block" if x.mined else "allow")
    assert sum(x.verdict == "block" for x in got) >= 40


@pytest.mark.parametrize("mark", ["http://a.site.org/a/b/casino/{i}", "http://a.site.org/a/b?x={i}&aff=spam", "http://a.site.org/a/x{w}-casino-y/{i}", "http://a.casino.a.site.org/{i}", "http://a.site.org/a/b?casino={i}"])
def test_marks_anywhere_in_a_url_are_mined(spark, mark):
    spell = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, mark.format(i=spell(i), w=spell(i)) if i % 4 == 0 else f"http://a.x.a.site.org/a/b/{spell(i)}?x={spell(i)}") for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    assert {x.id: x.verdict for x in url_filter.judge(pages, labels, rules=()).collect()} == {i: "block" if i % 4 == 0 else "allow" for i in range(240)}


def test_long_repeated_urls_do_not_multiply_rules(spark):
    long = "http://a.site.org/" + "/".join(f"{a}{b}" for a in "bcdfgh" for b in "aeiouxyz")
    rows = [(i, long if i % 4 == 0 else f"http://{'bc'[i % 2]}.site.org/a") for i in range(120)] + [(500, "http://c.site.org/x/he/y")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {x.id: (x.verdict, x.mined) for x in url_filter.judge(pages, labels, rules=()).collect()}
    assert {i for i, x in got.items() if x[0] == "block"} == {*range(0, 120, 4), 500}
    assert got[500][1] in ("part=he", "word=he")


def test_mining_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.verdict for x in url_filter.judge(pages, none).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), none).collect() == []


def test_queries_are_named_for_every_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from .test_joins_and_scores import brute_components

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {x.doc_id: x.text for x in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        after = {x.doc_id: x.text for x in rows}
        assert set(after) <= set(before) and all(after[i] == before[i] for i in after), name
        if name == "ngram_jaccard_join":
            want, _ = brute_components(list(before.items()), 5, 80)
            assert sorted(after) == sorted(i for i, n, c in want if n == 0 or i == c)
        elif name == "benchmark_decontamination":
            clean = lambda t: " ".join("".join(c if c.isalnum() or c.isspace() or ord(c) > 127 else "" for c in t.lower()).split())
            items = [clean(x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            whole = {i for i, t in before.items() if any(x in clean(t) for x in items)}
            assert not whole & set(after)
            assert len(after) >= len(before) - len(whole) - 2
        elif name == "bpe_encoding_and_decoding":
            assert set(after) == set(before)
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for x in rows:
                ids = library.encode(x.text, add_special_tokens=False).ids
                assert x.ids == ids and x.n_tokens == len(ids)
                assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        else:
            assert 0.6 * len(before) <= len(after) < len(before)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        before = after
