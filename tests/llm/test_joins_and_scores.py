"""N-gram join, LM scoring and decontamination against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.llm import decontaminate, lm, ngram_join
from offerloom.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return sorted((i, len(s), low.get(find(x))) for x, (i, s) in enumerate(sets) if i is not None), sets


def corpus(seed, groups=12, copies=40):
    """Unrelated texts, groups of drifting near copies, short texts and a passage that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 15, 25, 60, 120]))]
        for _ in range(r.choice([1, 2, 5, copies])):
            text = list(base)
            for _ in range(r.randrange(0, 1 + len(text) // 12)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            if r.random() < 0.3:
                text += [r.choice(vocabulary)] * r.randrange(3)
            out.append(" ".join(text))
        out.append(" ".join([r.choice(vocabulary) for _ in range(30)] + passage))
    out += ["", "   \n\t", "One", "one", "One two", "ONE TWO", "a b c d", "A  B\tC\nD", "x" * 50_000, "é É"]
    return out


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_join_equals_brute_force(spark, seed, width, percent):
    rows = [(i, t) for i, t in enumerate(corpus(seed))] + [(None, None), (7, "repeated id with a text of its own here"), (7, "repeated id with a text of its own here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, component int")
    got = sorted((r.id, r.n, r.component) for r in ngram_join.near_duplicates(docs, width=width, percent=percent).collect() if r.id is not None)
    want, _ = brute_components(rows, width, percent)
    assert got == want


@pytest.mark.parametrize(("scanned", "nearest"), [(8, (1, None)), (20, (16, 1024, None))])
def test_long_lists_are_dealt_anew_and_scanned_by_parts(spark, monkeypatch, scanned, nearest):
    monkeypatch.setattr(ngram_join, "SCANNED", scanned)
    monkeypatch.setattr(ngram_join, "NEAREST", nearest)
    # A passage that all share, groups of drifting copies of it, and chains in which only neighbours link.
    r = random.Random(8)
    shared = [f"p{k}" for k in range(30)]
    texts = []
    for g in range(6):
        base = shared + [f"g{g}x{k}" for k in range(30)]
        for _ in range(15):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(30, 60)] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(text))
            base[r.randrange(30, 60)] = f"d{r.randrange(10**6)}"
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.id, x.n, x.component) for x in ngram_join.near_duplicates(docs, width=2, percent=80).collect())
    assert got == brute_components(rows, 2, 80)[0]


def test_common_blocks_are_left_and_no_link_with_them(spark):
    # Phrases of one n-gram that all texts hold, unrelated texts, and groups of near copies whose lists are as long.
    r = random.Random(11)
    phrases = [f"c{k} d{k} e{k}" for k in range(8)]

    def text(base):
        out = list(base)
        for p in phrases:
            out.insert(r.randrange(len(out)), p)
        return " ".join(out)

    alone = [text([f"w{r.randrange(10**6)}" for _ in range(80)]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    join = ngram_join._Join(docs, "text", "doc_id", 3, 80)
    found = join.proposed(join.base.select("text", F.lit(0).cast("long").alias("of")), join.total, 0)
    assert found.select(F.explode("hubs").alias("h")).where("h.long").count() <= 200
    rows = list(enumerate(alone[:100]))
    for g in range(6):
        base = text([f"g{g}x{k}" for k in range(80)]).split(" ")
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(6)):
                copy[r.randrange(len(copy))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = sorted((x.id, x.n, x.component) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80).collect())
    assert got == brute_components(rows, 3, 80)[0]


def test_linked_sets_share_more_keys_than_they_may_leave():
    r = random.Random(12)
    for percent in (80, 85):
        for n in (20, 60, 150, 400):
            for _ in range(20):
                x = np.unique(np.array([r.randrange(1 << 63) for _ in range(n)], np.uint64))
                low = ngram_join.needed(n, n, percent)
                y = np.unique(np.append(x[:low], np.array([r.randrange(1 << 63) for _ in range(n - low)], np.uint64)))
                assert 100 * low >= percent * (2 * n - low)
                both = np.intersect1d(*(np.unique(ngram_join.keys_of(s, percent)) for s in (x, y)))
                shared = Counter((both & ngram_join.TAG).tolist())
                assert shared[0] or any(k > ngram_join.spare(ngram_join.differing(t - 1, percent)) for t, k in shared.items() if t)


def test_components_of_a_small_graph_take_few_jobs(spark):
    names = [f"n{k:03}".encode() for k in range(300)]
    random.Random(13).shuffle(names)
    cuts = {100, 101, 250}
    edges = [(a, b) for k, (a, b) in enumerate(zip(names, names[1:])) if k not in cuts]
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 6
    want = {x: min(p) for p in (names[:101], names[102:251], names[251:]) for x in p}
    assert {bytes(k): bytes(v) for k, v in got.items()} == want


def test_links_through_rows_without_id(spark):
    words_ = [f"w{k}" for k in range(60)]
    a, b, c = (" ".join(["x"] * 0 + words_[k : k + 56]) for k in (0, 2, 4))
    docs = spark.createDataFrame([(1, a), (None, b), (3, c)], "doc_id long, text string")
    assert sorted((x.component, x.n) for x in ngram_join.near_duplicates(docs, width=2, percent=92).collect()) == [(1, 55)] * 3
    kept = ngram_join.keep_one(docs, width=2, percent=92).collect()
    assert [x.doc_id for x in kept] == [1]


def test_keep_one_judges_rows_not_ids(spark):
    one, other = "one text with quite enough words in it", "another one that has nothing in common at all"
    rows = [(1, one), (1, other), (2, one), (None, other), (None, None), (None, None), (4, ""), (4, ""), (5, "alone is this one here today too"), (5, "alone is this one here today too")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, r int, R_ string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    assert got == Counter({(1, one): 1, (1, other): 1, (None, None): 2, (4, ""): 2, (5, rows[-1][1]): 1})


def test_sketches_never_forbid_a_link():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 400)
        x = [r.randrange(1 << 63) for _ in range(n)]
        y = x[r.randrange(0, 1 + n // 8) :] + [r.randrange(1 << 63) for _ in range(r.randrange(0, 1 + n // 8))]
        if not y:
            continue
        p, q = (np.frombuffer(ngram_join.sketch(np.array(v, dtype=np.uint64)), np.uint64)[None, :] for v in (x, y))
        width = min(p.shape[1], q.shape[1])
        apart = int(np.bitwise_count(ngram_join.folded(p, width) ^ ngram_join.folded(q, width)).sum())
        assert apart <= len(set(x) ^ set(y))
        if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
            assert ngram_join.may_link(np.array([len(x)]), np.array([len(y)]), np.array([apart]), 80)[0]


def test_keep_one_leaves_one_of_each_component(spark):
    rows = list(enumerate(corpus(5)))
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, set string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want, _ = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, c in want if n == 0 or i == c)


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_linkable_pair_of_sizes_shares_a_range():
    for percent in (80, 85):
        for n in range(1, 400):
            for a, b, _ in ngram_join.partner_sizes(n, percent):
                assert {r for r, _ in ngram_join.ranges_of(a, percent)} & {r for r, _ in ngram_join.ranges_of(b, percent)}


def test_lm_equals_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["A", "b", "c", "the", "The", "x1", "é"]) for _ in range(r.randrange(0, 60))) for _ in range(60)] + [None, "", " \n", "rare", " ".join(f"t{k % 13}" for k in range(1500))]
    rows = [(i, t, i % 5 != 1, i) for i, t in enumerate(texts)] + [(3, texts[3], True, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, block int")
    for order in (2, 3):
        got = sorted(lm.score(docs, F.col("learn"), order=order, block_bytes=700).collect(), key=lambda x: (x.id, x.score))
        tokens = sorted(((i, [*words(t), None], learn) for i, t, learn, _ in rows), key=lambda x: (x[0], len(x[1])))
        count = [Counter() for _ in range(order + 1)]
        for _, w, learn in tokens:
            for k in range(1, order + 1):
                count[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1) if learn)
        n, v = sum(count[1].values()), len(count[1])
        for g, (i, w, learn) in zip(got, tokens, strict=True):
            base = score = 0.0
            for j, x in enumerate(w):
                p = (count[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))
                base += math.log10(p)
                for k in range(2, order + 1):
                    h = tuple(w[j - k + 1 : j])
                    if j >= k - 1 and count[k - 1][h]:
                        p = (count[k][(*h, x)] + lm.PULL * p) / (count[k - 1][h] + lm.PULL)
                score += math.log10(p)
            assert (g.id, g.train, g.n_tokens, g.n_known, g.train_tokens) == (i, learn, len(w), sum(count[1][(x,)] > 0 for x in w), n)
            assert g.base_score == pytest.approx(base, abs=1e-9)
            assert g.score == pytest.approx(score, abs=1e-9)


def test_lm_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).collect() == []
    one = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.train_tokens, one.n_known) == (0, 0) and math.isfinite(one.score)


def distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_alignment_equals_dynamic_programming():
    r = random.Random(0)
    for _ in range(800):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randrange(1, n))) for n in (15, 22))
        most = r.randrange(6)
        want = distance_within(p, t)
        assert (decontaminate.banded(p, t, most) is None) == (want > most)


def test_leaks(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnoprst") for _ in range(r.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((14, 30, 60, 60))] + [(9, "too short"), (10, None), (11, "")]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = lambda t: "".join(c for k, c in enumerate(t) if k % 33 != 5)
    rows = [(1, noise(300)), (2, None), (3, ""), (4, noise(50) + " " + items[0][1].upper() + "! " + noise(9)), (5, items[1][1].replace(" ", "  \n")), (6, noise(80) + edited(items[2][1]) + noise(80)), (7, items[3][1][: len(items[3][1]) * 2 // 3]), (8, "x" * 30_000), (4, items[0][1] + " " + items[1][1])]
    docs = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.id, x.item) for x in decontaminate.leaks(docs, bench).collect())
    assert got == [(4, 0), (4, 0), (4, 1), (5, 1), (6, 2), (7, 3)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 8]
    spans = {(x.id, x.item): x for x in decontaminate.leaks(docs, bench).collect()}
    hit = spans[(5, 1)]
    assert rows[4][1].encode()[hit.start : hit.stop].decode().split()[0] in items[1][1]
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.leaks(docs.limit(0), bench).collect() == []
    split = decontaminate.blocks(bench, chars=100)
    assert sum(len(x.ids) for x in split) == 4


@pytest.mark.parametrize(("at", "length", "every"), [(20, 120, 0), (30, 130, 0), (20, 140, 0), (15, 150, 20), (37, 125, 11)])
def test_leaks_of_windows_anywhere(at, length, every):
    r = random.Random(at)
    noise = lambda n: "".join(r.choice("abcdefghijklmnoprst ") for _ in range(n))
    items = [" ".join(noise(700).split()) for _ in range(6)]
    index = decontaminate.Index.of(list(enumerate(items)))
    edited = lambda t: "".join("0" if every and k % every == 3 else c for k, c in enumerate(t))
    docs = [noise(400) + edited(t[at : at + length]) + noise(400) for t in items] + [noise(1500)]
    data, _, clean_at = decontaminate.normalised(*decontaminate.tb.buffer_of(pa.array(docs)))
    got = {}
    for d, it, low, high, hits in decontaminate._regions(index, data, clean_at):
        own = data[clean_at[d] : clean_at[d + 1]].tobytes()
        if (hit := decontaminate._verified(index, it, own, low, high, hits)) is not None:
            got[d] = (it, *hit)
    assert {d: x[0] for d, x in got.items()} == {k: k for k in range(6)}
    m = decontaminate.WINDOW
    for d, (it, edits, start, stop) in got.items():
        piece = data[clean_at[d] + start : clean_at[d] + stop].tobytes()
        least = min(distance_within(index.texts[it][s : s + m], piece) for s in range(at - 12, at + length - m + 12, 6))
        assert least <= decontaminate.budget(m) + 6 and edits <= decontaminate.budget(m)
        assert every or edits == 0


def test_nearest_equals_dynamic_programming():
    r = random.Random(4)
    for _ in range(800):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randrange(1, n))) for n in (15, 22))
        most, want = r.randrange(6), distance_within(p, t)
        got = decontaminate.nearest(p, t, most)
        assert want <= got <= most if want <= most else got == want
