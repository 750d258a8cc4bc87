"""Merkle manifest, SentencePiece and whitening against brute force and the library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from offerloom.llm import merkle, pieces, whitening
from offerloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def proofs_of(rows):
    """All proofs, by plain lists."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded, path = leaf((*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r), ""
            for tree, j in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run, p = level[j // 16 * 16 :][:16], j % 16
                    path += "".join(run[:p] + run[p + 1 :])
                    folded, j = sha("".join([*run[:p], folded, *run[p + 1 :]])), j // 16
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(path), folded, folded == top[-1][0]


def many_rows():
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "a", "a", "a", "é", f"s{i % 60}"]), "en", i, r.choice([None, "", "Abc É", "low"])) for i in range(900)]
    return rows + [(7, "a", "en", 1, "X")] * 3 + [(None, "a", None, None, None)] * 2


@pytest.mark.parametrize("rows", [[], many_rows()[:1], many_rows(), [(i, "a", "e", 2, "T" * (i % 3)) for i in range(300)]], ids=["none", "one", "many", "one source"])
def test_manifest_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    before = spark.conf.get(merkle._LIMIT)
    got = merkle.verified(docs, *merkle.tampering(F.col("doc_id"), F.col("text"))).collect()
    assert spark.conf.get(merkle._LIMIT) == before
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, proofs_of(rows)))


@pytest.mark.parametrize("anchored", [1, 2])
def test_shared_siblings_of_low_anchors(spark, monkeypatch, anchored):
    """The same proofs whatever the height from which siblings are shared, and with small buckets."""
    monkeypatch.setattr(merkle, "ANCHORED", anchored)
    monkeypatch.setattr(merkle, "BUCKET", 32)
    rows = many_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified(docs, *merkle.tampering(F.col("doc_id"), F.col("text"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, proofs_of(rows)))


def test_nodes_are_repeated_for_every_bucket_under_them(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_FINE", 3)
    rows = spark.createDataFrame([(1, 0, 0), (2, 100, 4095), (3, 4095, 4096), (4, 0, 4096 * 20)], "k long, first long, last long")
    got = sorted((r.k, r.bucket) for r in merkle.spread(rows, "first", "last").collect())
    assert got == sorted([(1, 0), (2, 0), (3, 0), (3, 1), *((4, b) for b in range(21))])


def odd_texts():
    r = random.Random(1)
    out = ["", " ", "   a", "a  b   c    ", "▁", " ▁▁ x ▁", "<s>", "</s> x<unk>", "\x00a", "日本語 龘龘", "🤷🏽‍♀️ emoji", "x" * 5000, "ab" * 3000, "\n\n\t a\r", " " * 100]
    out += ["".join(r.choice(" ▁abcdefghtheT.,é龘中🤷\n\t　०①½ﬁ́") for _ in range(r.randrange(60))) for _ in range(500)]
    return out + ["".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randrange(30))) for _ in range(500)]


def test_pieces_and_spans_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.model(PATH)
    docs = [t or "" for t in pq.read_table(f"{FOLDER}/documents.parquet")["text"].to_pylist()]
    texts = odd_texts() + docs
    for t, e in zip(texts, own.encode(texts), strict=True):
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert e.ids.tolist() == ids
        assert own.decode(e.ids) == library.decode(ids)
        assert list(zip(e.begin.tolist(), e.end.tolist(), strict=True))[1:-1] == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_any_ids_decode_as_in_the_library():
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.model(PATH), random.Random(3)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(259), 28705, 259]) for _ in range(r.randrange(8))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}, {"add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True}])
def test_character_maps_and_alignment_equal_the_library(rule, flags):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    spec = dict(pieces.fields(dict(pieces.fields(library.serialized_model_proto()))[3]))
    own = pieces.Normaliser(pieces.CharMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), False)
    for t in odd_texts()[:300]:
        text, offsets = library.normalize(t, with_offsets=True)
        got = own(t)
        assert got.text == text
        chars = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert got.align[chars].tolist() == np.cumsum([0, *(len(c.encode()) for c in t)])[offsets].tolist()


def test_piece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*odd_texts()[:40], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select("doc_id", "text", pieces.digests(F.col("text"), PATH).alias("d"), pieces.encode(F.col("text"), PATH).alias("p")).collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.d.n_tokens == len(ids) and [p.id for p in r.p] == ids
        assert r.d.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.d.decoded_sha256 == sha(library.decode(ids))
        assert r.d.spans_sha256 == hashlib.sha256(np.array([[p.begin, p.end] for p in r.p], "<u4").tobytes()).hexdigest()
    decoded = pieces.decoded(pieces.encoded(docs, PATH).selectExpr("doc_id", "text", "transform(pieces, p -> p.id) AS ids", "'x' AS Decoded"), PATH)
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in decoded.collect())
    assert pieces.encoded(docs.where("false"), PATH).collect() == []


def eigen(v):
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_spectrum_of_random_matrices(d):
    a = np.random.default_rng(d).standard_normal((d, 2 * d))
    v = a @ a.T
    values, vectors = whitening.spectrum(v)
    want, _ = eigen(v)
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13


@pytest.mark.parametrize("values", [[5.0] * 6 + [1.0] * 6, [3.0] * 8, [0.0] * 4, [1.0] + [0.0] * 9, [1 + 1e-9 * i for i in range(12)], [10.0**-i for i in range(12)]])
def test_spectrum_of_equal_close_and_far_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values),) * 2))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.spectrum(v)
    assert np.abs(got - sorted(values, reverse=True)).max() <= 1e-14 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * got).max() <= 1e-14 * max(values)


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(5).standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(u, vectors * np.sign(values) @ vectors.T, atol=1e-12)


def vectors_of(rows):
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in fine], np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in fine], dtype=object)


def hold(got, rows, components=32):
    """Every row of a result against numpy's eigenvectors over Python integers."""
    ids, x = vectors_of(rows)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(object)
    v = np.array((centred.T @ centred) / n**3, dtype=float)
    values, vectors = eigen(v)
    keep = [k for k in range(min(components, len(v))) if values[k] > 1e-12 * np.trace(v)]
    want = np.array(centred / n, dtype=float) @ vectors[:, keep] / np.sqrt(values[keep])
    assert len(got) == n * len(keep)
    by: dict = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.id, []).append(r)
    assert sorted(by) == [k + 1 for k in keep]
    deviation = {}
    for i, e in zip(ids, (centred**2).sum(axis=1), strict=True):
        deviation.setdefault(i, []).append(int(e))
    for k in keep:
        own = by[k + 1]
        assert {i: sorted(r.deviation for r in g) for i, g in own.items()} == {i: sorted(e) for i, e in deviation.items()}
        flat = {i: sorted(r.whitened for r in g) for i, g in own.items()}
        sides = []
        for sign in (1, -1):
            theirs: dict = {}
            for i, z in zip(ids, sign * want[:, k], strict=True):
                theirs.setdefault(i, []).append(float(z))
            sides.append(max(abs(a - b) for i in flat for a, b in zip(flat[i], sorted(theirs[i]), strict=True)))
        assert min(sides) < 1e-8
        assert all(r.n == n and abs(r.explained - values[k] / np.trace(v)) < 1e-10 and r.identity_error < 1e-9 for g in own.values() for r in g)


SCHEMA = "vec_id long, embedding array<float>, id string"


def test_whitening_equals_eigh(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.standard_normal(7) * [5, 3, 2, 1, 0.5, 0.3, 0.2]).tolist()) for i in range(300)] + [(5, [1.0] * 7)] * 200
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    odd = [(900, None), (901, []), (902, [1.0] * 6 + [None]), (903, [float("nan")] * 7), (904, [float("-inf")] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], SCHEMA).repartition(3)
    hold(whitening.whitened(df).collect(), rows + odd)
    hold(whitening.whitened(df, components=2).collect(), rows + odd, 2)


def test_whitening_of_large_entries_is_exact(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(c) for c in r.integers(-(10**8), 10**8, 3) / 7.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = whitening.quantised(df)
    w = whitening.fit(x)
    _, exact = vectors_of(rows)
    assert w.n == 50 and w.sums == exact.sum(axis=0).tolist()
    with pytest.raises(Exception, match="52 bits"):
        whitening.quantised(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_whitening_without_rows_or_variance(spark):
    columns = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, "")], [(1, [1.0, 2.0], ""), (1, [1.0, 2.0], "")]):
        got = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == columns and got.collect() == []
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0], "")], SCHEMA))


def test_whitening_query_equals_eigh(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    hold(QUERIES["op13_whitening"](spark, FOLDER).withColumnRenamed("vec_id", "id").collect(), rows)
