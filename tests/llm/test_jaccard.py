import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import jaccard, simhash


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """The rows that stay: the first of each component, all pairs compared."""
    s, up = [sets(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] == set() or (s[i] | s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_stage_equals_all_pairs(spark):
    import corpus_pipeline

    random.seed(4)
    word = lambda: random.choice("abcdefghij") + str(random.randint(0, 300))
    rows = []
    for size, edits in [(100, 1), (200, 2), (400, 4), (60, 1), (60, 2), (60, 3)]:
        for _ in range(15):
            base = [word() for _ in range(size)]
            near = list(base)
            for at in random.sample(range(size), edits):
                near[at] = "edit"
            rows += [" ".join(base), " ".join(near)]
    chain = [word() for _ in range(80)]
    for i in range(60):  # a group of near copies that shares one line with texts unlike it
        chain[random.randrange(80)] = word()
        rows.append(" ".join(chain))
    line = " ".join(word() for _ in range(12))
    rows += [line + " " + " ".join(word() for _ in range(random.randint(1, 30))) for _ in range(90)]
    rows += ["", None, "A b", "a  B", "a b c", rows[0].upper().replace(" ", "\n"), "x " * 50, "x " * 9]
    random.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = [r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id for r in simhash.deduplicate(df.repartition(5), bucket_limit=3).collect()} == want


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "q r s t")], "doc_id long, text string")
    assert simhash.deduplicate(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(df).collect()) == ["1", "None"]
    names = ["node", "__row", "fp", "_metadata", "label"]
    wide = df.select("doc_id", "text", *[F.lit(7).alias(c) for c in names])
    rows = simhash.deduplicate(wide).collect()
    assert len(rows) == 2 and all(r[c] == 7 for r in rows for c in names) and rows[0].__fields__ == ["doc_id", "text", *names]


def test_fingerprint_of_a_set():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 100):
        g = rng.integers(-(1 << 63), 1 << 63, n)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in g) > n)
        assert jaccard.fingerprint(g) == int(np.uint64(want).astype(np.int64))


def test_bucket_pairs_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted({(int(g), int(l), int(x)) for g, l, x in zip(rng.integers(0, 9, 200), rng.integers(0, 5, 200), rng.permutation(200))})
    gram, label, node = (np.array(c) for c in zip(*rows))
    same = np.full(len(rows), 10)
    want = {(min(x[2], y[2]), max(x[2], y[2])) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1]}
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(jaccard, "STEP_PAIRS", step)
        got = [p for a, b in jaccard.bucket_pairs(gram, same, same * 0, node, label) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_wide_buckets_are_dealt_by_a_second_order(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(200)], []
    for _ in range(60):  # one base, two texts in three below 0.8 from each other
        at = rng.randrange(160)
        text = base[:at] + [word() for _ in range(rng.choice([2, 30, 40]))] + base[at + 40 :]
        rows += [" ".join(text), " ".join(text[:-1] + ["edit"])]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep, made = jaccard.StageTables.keep, {}

    def noted(self, frame, name):
        out = keep(self, frame, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard.StageTables, "keep", noted)
    proposed = {}
    for wide in (4, 10**9):
        monkeypatch.setattr(jaccard, "WIDE", wide)
        made.clear()
        got = jaccard.kept_rows(df, "doc_id", "text", lambda fps, tables: simhash.links(fps, tables), common=10**6)
        assert {r.doc_id for r in got.collect()} == brute(rows)
        proposed[wide] = made["jaccard-near"] + made["jaccard-rest"]
    print(proposed)
    assert 2 * proposed[4] < proposed[10**9]


def test_candidates_of_a_group_grow_with_its_members(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    line, rows = [word() for _ in range(8)], []
    for members in (110, 60):  # two groups with a line in common; core copies link to their base, fringe ones don't
        base = line + [word() for _ in range(112)]

        def edited(words, edits):
            words = list(words)
            for at in rng.sample(range(len(words)), edits):
                words[at] = word()
            return words

        rows += [" ".join(edited(base, rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(members)]
        for _ in range(8):  # twins far from the base, which share their differences
            far = edited(base, 9)
            rows += [" ".join(edited(far, 1)) for _ in range(2)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep, made = jaccard.StageTables.keep, {}

    def noted(self, frame, name):
        out = keep(self, frame, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard.StageTables, "keep", noted)
    monkeypatch.setattr(jaccard, "WIDE", 16)
    got = jaccard.kept_rows(df, "doc_id", "text", lambda fps, tables: simhash.links(fps, tables))
    assert {r.doc_id for r in got.collect()} == brute(rows)
    assert made["jaccard-near"] + made["jaccard-rest"] < 2 * len(rows)


def test_links_are_told_by_differences_from_a_frame():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.permutation(12)[: rng.integers(1, 13)]) for _ in range(40)] + [" ".join(f"w{x}" for x in range(k, 40)) for k in range(8)]
    known = jaccard._Hashes()
    sets = [jaccard.shingles(t.split(), known) for t in texts]
    frame = sets[-3]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([7] * len(texts)), pa.array(texts), pa.array([frame.tolist()] * len(texts))], ["node", "class", "text", "frame"])
    found = pa.Table.from_batches(list(jaccard._differences(iter([batch])))).to_pylist()
    d = {r["node"]: r["d"] for r in found if r["gram"] is None}
    apart = {k: {r["gram"] for r in found if r["node"] == k and r["gram"] is not None} for k in d}
    links = 0
    for i, x in enumerate(sets):
        assert d[i] == len(apart[i]) == len(np.setxor1d(x, frame))
        for j, y in enumerate(sets):
            linked = 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
            assert linked == (18 * len(apart[i] & apart[j]) >= 9 * d[i] - len(x) + 9 * d[j] - len(y))
            links += linked and i != j
    assert links > 10


def test_few_edges_on_the_driver_equal_the_star_steps(spark):
    from lodestone.llm.common import StageTables, components

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = [{(r.node, r.label) for r in components(spark, df, StageTables(spark), few).collect()} for few in (0, 10**6)]
    assert found[0] == found[1] and len(found[0]) > 300
    assert components(spark, df.filter("a = b"), StageTables(spark)).count() == 0
