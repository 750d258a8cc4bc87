"""BPE, token counts, quality rules and importance resampling."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerloom.llm import bpe, importance, quality_rules, textbuf, token_counts

ODD = ["", "  ", "<|endoftext|> Hello", "a<|startoftext|>b ΑΣ ΟΔΟΣ İstanbul ß ẞ é é x　y", "don't I'LL we've 123 4５6 ²³ ½", "日本語テスト", "🤷🏽‍♀️ emoji", "x" * 5000, "ab" * 3000, "aaaaaaa aaaa", "\x00\x01 \x7f\x85", "<|endoftext", "ﬁ ﬂ Ǆ", "tab\tnew\nline"]
SPECIAL = (("<|endoftext|>", 50256),)


def documents(limit=150):
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:limit]]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Model(path)
    texts = documents() + ODD
    got = own.encode(texts)
    for g, want in zip(got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert g.tolist() == want.ids
        assert own.decode(g) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_equals_the_library_on_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Model(path)
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library_on_pairs_of_combining_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Model(path)
    marks = [chr(c) for c in range(0x30000) if unicodedata.combining(chr(c))]
    one_of_each_class = list({unicodedata.combining(m): m for m in marks}.values())
    texts = [x for m in marks for other in one_of_each_class for x in (f"a{m}{other} b", f"é{other}{m}")]
    assert [g.tolist() for g in own.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_digests(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), [*documents(40), *ODD]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.d for r in docs.select("doc_id", bpe.digests(F.col("text"), path).alias("d")).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = library.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i if i < len(texts) else -1]) == want


@pytest.mark.parametrize("unit", ["中文文本没有空格但有句号结束。\n", "слово за словом идёт ", "a b ", "无空格", "x"])
def test_long_texts_are_encoded_in_linear_work(unit):
    own = token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)
    text = unit * (40_000 // len(unit)) if len(unit) > 1 else "xyz" * 4000
    want, sent = own.ids(text), []
    plain = own.ids
    own.ids = lambda t: sent.append(len(t)) or plain(t)
    assert own.all_ids(text, 2000, 64) == want
    assert sum(sent) <= (1.2 if any(c.isspace() for c in unit) else 3) * len(text)


def test_bpe_with_a_small_table_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.Model(path), Tokenizer.from_file(path)
    for t in documents(30):
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Hello hello", 5), (2, None, 6), (None, "", 7), (1, "Hello hello", 5)], "doc_id long, text string, IDS int")
    out = bpe.decoded(bpe.encoded(docs, path), path).collect()
    assert len(out) == 4 and out[0].ids == out[3].ids and out[1].ids == [] and out[1].decoded == ""
    assert out[0].decoded == "hello</w> hello</w>"
    assert bpe.encoded(docs.limit(0), path).collect() == []


def test_token_counts_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)
    texts = documents() + ODD
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk, overlap in ((64_000, 512), (200, 16), (50, 4), (997, 64)):
        assert [own.all_ids(t, chunk, overlap) for t in texts] == want


def test_token_count_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (2, None, "z")], "doc_id long, text string, tokens string")
    out = {r.doc_id: r.tokens for r in token_counts.with_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL, limit=1).collect()}
    assert tuple(out[1]) == (3, 2, True) and tuple(out[2]) == (0, 0, False)


def brute_numbers(text):
    raw = (text or "").encode()
    w = raw.split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)}
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_base_numbers_equal_brute_force(spark):
    r = random.Random(1)
    part = ["a", "B", "é", "x|y", "##", "\n", "\n\n", "\t", " ", "the cat sat", "日本", "\x0b", "　"]
    texts = ["".join(r.choice([*part, " "]) for _ in range(r.randrange(80))) for _ in range(150)] + [None, "", "\n", " ", "w " * 200, "x" * 100_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for row in got:
        assert tuple(row.quality[c] for c in quality_rules.BASE) == brute_numbers(texts[row.doc_id]), row.doc_id
        n, again = row.quality.n_words, row.quality.n_repeat_words
        assert row.quality.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (row.quality.base_failed and row.quality.kept)


def test_rules_find_junk_and_keep_the_rest(spark):
    r = random.Random(3)
    clean = [" ".join(r.choice(["some", "plain", "words", "about", "things", *(f"{c}{r.randrange(9999)}" for c in "klm")]) for _ in range(120)) + "." for _ in range(90)]
    junk = [" ".join(x.upper() + "!!" for x in t.split()) for t in clean[:10]] + [" ".join(x + "***" for x in t.split()) for t in clean[10:20]]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(clean + junk)], "doc_id long, text string, quality boolean")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == list(range(90))
    assert quality_rules.keep_good(docs.limit(0)).collect() == []


def test_fit_raises_likelihood_and_keeps_its_meaning():
    rng = np.random.default_rng(0)
    bad = rng.random(4000) < 0.2
    votes = np.where(rng.random((4000, 4)) < np.where(bad[:, None], 0.7, 0.03), 2, 1)
    votes[rng.random((4000, 4)) < 0.2] = 0
    patterns, counts = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    fit = quality_rules.fit_votes(patterns, counts.astype(float), 4)
    assert abs(fit.prior_bad - 0.2) < 0.05 and all(abs(h - 0.7) < 0.08 for h in fit.hit) and all(c > 0.94 for c in fit.clear)


def test_importance_separates_held_out_rows(spark):
    r = random.Random(6)
    text = lambda extra: " ".join(r.choice([f"w{k}" for k in range(60)] + extra) for _ in range(80))
    rows = [(i, text([])) for i in range(400)] + [(1000 + i, text(["vile", "nasty", "rotten"] * 6)) for i in range(100)]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, 1, 0 if i < 1000 else 1) for i, _ in rows if i % 2] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = importance.keep_target_like(docs, labels)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect() if x.doc_id % 2 == 0]
    assert sum(i < 1000 for i in ids) >= 190 and sum(i >= 1000 for i in ids) <= 3
    assert ids == [x.doc_id for x in importance.keep_target_like(docs, labels).collect() if x.doc_id % 2 == 0]


def test_importance_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 100_000), (2, "a b"), (2, "a b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.keep_target_like(docs, empty).count() == 5
    assert importance.classify(docs.limit(0), empty).collect() == []


@pytest.mark.parametrize("quality", [None, 0, 1])
def test_importance_keeps_all_with_one_class(spark, quality):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, quality, 0) for i in range(0, 900, 3)], "doc_id long, quality int, toxic int")
    assert importance.keep_target_like(docs, labels).count() == 900
    assert importance.classify(docs, labels).where("kept").count() == 900


def test_kth_largest(spark):
    r = random.Random(8)
    for values in ([r.random() for _ in range(500)], [1.0] * 50, [float(k // 10) for k in range(100)], [-1e9, 1e9, *[r.gauss(0, 1) for _ in range(98)]]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for k in (1, 2, 17, len(values) - 1):
            assert importance.kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(df, "x", len(values)) == float("-inf")


def test_word_hashes_are_equal_for_equal_words_alone():
    column = pa.array(["Hello  world", None, "", " the\tQuick é x", "abc", "hello"])
    found = list(textbuf.words_of(column))
    spelled = [bytes(w.data[a:b]) for w in found for a, b in zip(w.start, w.end, strict=True)]
    hashes = np.concatenate([w.hash for w in found]).tolist()
    assert spelled == [b"hello", b"world", b"the", b"quick", "é".encode(), b"x", b"abc", b"hello"]
    assert len(set(hashes)) == 7 and hashes[0] == hashes[-1]
    sliced = [h for w in textbuf.words_of(column, limit=3) for h in w.hash.tolist()]
    assert sliced == hashes


@pytest.mark.parametrize("k", [0, 1, 3])
def test_windows_stay_in_documents(k):
    first, n = textbuf.windows_inside(np.array([0, 2, 2, 7]), k + 1)
    assert n.tolist() == [max(0, 2 - k), 0, max(0, 5 - k)] and len(first) == n.sum()
