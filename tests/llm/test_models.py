"""Tiling and the quality classifier."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality, tiling
from lodestone.llm.common import StageTables


def brute_tiles(a, b, least):
    ma, mb, total = [0] * len(a), [0] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [1] * best
                total += best


def test_tiles_cover_as_greedy_tiling_does():
    for seed in range(10_000):
        rnd = random.Random(seed)
        letters, least = rnd.randint(1, 6), rnd.randint(1, 4)
        a, b = ([rnd.randint(1, letters) for _ in range(rnd.randint(0, n))] for n in (18, 12))
        found = tiling.tiles(a, b, least)
        assert sum(t[2] for t in found) == brute_tiles(a, b, least)
        assert all(a[i : i + k] == b[j : j + k] and k >= least for i, j, k in found)
        for side in (0, 1):
            places = [x for t in found for x in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))


def test_repetitive_texts_take_time_in_proportion():
    began = time.time()
    assert sum(t[2] for t in tiling.tiles([1] * 300_000, [1] * 200, 4)) == 200
    assert sum(t[2] for t in tiling.tiles([1, 2, 3, 2] * 80_000, [1, 2, 3, 2, 3, 2, 1] * 30, 4)) > 100
    block = tiling.Block([(1, "so it goes on and on " * 40), (2, "never there at all")], 4)
    assert [x[:3] for x in block.judge("on and on so it goes " * 40_000, 0.6)] == [(0, 240, 240)]
    assert time.time() - began < 60


def test_words_between_seeds_join_nothing():
    block = tiling.Block([(1, "a b c d e f g h i j")], 4)
    assert block.judge("a b c d x e f y g z h i j", 0.0) == [(0, 4, 10, 1)]
    assert block.judge("a b c d e x c d e f y g h i j", 0.0)[0][:2] == (0, 9)
    assert block.judge("a b c d x e f y", 0.6) == []


def test_blocks_of_tests(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 12)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(8))) for k in range(5)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(9, items[1][1] + " " + items[4][1])], "doc_id long, text string")
    found = tiling.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in found} == {0: [0], 1: [1], 2: [2], 3: [3], 4: [4], 9: [1, 4]}


def test_symbols_of_all_planes():
    text = "a한韓\uffff😀𝒳"
    got = quality.codes([text], 1)[0].tolist()
    assert got[:3] == [97, 0xD55C, 0x97D3] and len(set(got)) == len(got) and all(0 <= g < quality.SYMBOLS for g in got)
    assert quality.BOS not in got and got[-1] == quality.EOS


def test_leaks(spark):
    random.seed(1)
    prose = lambda n: " ".join(random.choice("abcdefgh") + str(random.randint(0, 400)) for _ in range(n))
    sentences = [prose(9) + "." for _ in range(5)]
    item, other = " ".join(sentences), prose(40)
    shuffled = " ".join(reversed(sentences)).upper()
    docs = [(1, prose(50) + " " + item), (2, shuffled + " " + prose(30)), (3, prose(90)), (4, None), (5, ""), (6, " ".join(sentences[:2])), (7, "tiny test")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string")
    tests = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "..."), (14, "Tiny, test!")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in tiling.find_leaks(df, tests).collect()}
    assert got == {1: [10], 2: [10], 3: [], 4: [], 5: [], 6: [], 7: [14]}
    assert tiling.find_leaks(df, tests.limit(0)).filter("size(leaks) > 0").count() == 0
    assert tiling.find_leaks(df.limit(0), tests).count() == 0


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney by the book, over folded symbols."""
    def symbols(t):
        return [quality.BOS] * (order - 1) + [ord(c) for c in t] + [quality.EOS]

    counts = {order: Counter()}
    for t in texts:
        s = symbols(t)
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: quality.discounts(*[sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    follow = {n: defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            follow[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / quality.SYMBOLS
        cs = follow[n].get(g[:-1])
        if not cs:
            return p(g[1:])
        cut = lambda c: 0 if c == 0 else d[n][min(c, 3) - 1]
        c = counts[n].get(g, 0)
        return max(c - cut(c), 0) / sum(cs) + sum(cut(x) for x in cs) / sum(cs) * p(g[1:])

    def perplexity(t):
        s = symbols(t)
        grams = [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]
        return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams))

    return perplexity


def test_perplexity_equals_the_book(spark, tmp_path):
    random.seed(2)
    texts = ["".join(random.choice("aab cd") for _ in range(random.randint(0, 60))) for _ in range(40)]
    odd = ["", "zzzz", "abé", "aab" * 30]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    tables = StageTables(spark)
    model = quality.Model(docs.filter("doc_id < 40"), "text", tables)
    got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, model, "text", tables).collect()}
    want = brute_model(texts, quality.ORDER)
    for i, t in enumerate(texts + odd):
        assert math.isclose(got[i], want(t), rel_tol=1e-4), t


def test_classifier_keeps_clean_and_drops_junk(spark):
    random.seed(3)
    word = lambda: random.choice(["the", "and", "house", "stone", "river", "walks", "under", "light"])
    good = [" ".join(word() for _ in range(60)) for _ in range(400)]
    junk = ["".join(random.choice("#$%&*!QXZ") for _ in range(300)) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else None, 1.0) for i, t in enumerate(good + junk)] + [(None, None, "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep double")
    trusted = spark.createDataFrame([(i,) for i in range(0, 400)] + [(9999,), (None,)], "doc_id long")
    out = quality.classify(df, trusted).collect()
    assert len(out) == len(rows)
    assert np.mean([r.keep for r in out if r.doc_id is not None and r.doc_id < 400]) > 0.97
    assert not any(r.keep for r in out if r.doc_id is not None and r.doc_id >= 400)
    assert quality.classify(df.limit(30), trusted.limit(0)).filter("keep").count() == 30


def test_thresholds_are_whole(spark):
    assert quality.discounts(0, 1, 1, 1) == (0.5, 1.0, 1.5)
    grams, sizes = quality.codes(["ab", ""], 3)
    assert sizes.tolist() == [3, 1] and len(grams) == 4
    assert spark.range(1).select(F.lit(1)).count() == 1
