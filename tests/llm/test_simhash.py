import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import StageTables


def reference_fingerprint(text, n=3):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < n else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    n, up = len(fps), list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_equals_definition(spark):
    texts = ["", None, "one", "Two Words", "a b c", "ÀB c\u00a0d e", "x\x0by z w " * 50, "É a\tb\nc d"]
    for t in texts:
        assert simhash.fingerprint(t) == reference_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", seed=42)).astype(np.int64)


def near_pairs(n):
    random.seed(5)
    rows = []
    for i in range(n):
        a = random.getrandbits(64)
        b = a
        for k in random.sample(range(64), i % 4):
            b ^= 1 << k
        rows.append(tuple(int(np.uint64(x).astype(np.int64)) for x in (a, b)))
    return rows


def test_pivot_rows_are_distances(spark):
    rows = near_pairs(200) + [(0, -1), (-1, 1)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", *simhash.pivot_rows(F.col("a")), simhash.pivot_rows(F.col("b"))[1].alias("other")).collect()
    random.seed(8)
    for a, b, zero, pv, other in got:
        bits = [(a >> 2 * k & 1) + (a >> 2 * k + 1 & 1) for k in range(32)]
        assert zero == sum(bits) and [pv >> 2 * k & 3 for k in range(32)] == [(0, 1, 3)[n] for n in bits]
        most = bin((pv ^ other) & (1 << 64) - 1).count("1")
        unions = [sum(3 << 2 * k for k in range(32) if random.random() < 0.5) for _ in range(50)]
        best = sum(3 << 2 * k for k in range(32) if (b >> 2 * k & 1) + (b >> 2 * k + 1 & 1) > bits[k])
        far = lambda x, r: bin((x ^ r) & (1 << 64) - 1).count("1")
        assert max(abs(far(a, r) - far(b, r)) for r in [*unions, best]) == abs(far(a, best) - far(b, best)) == most


def test_cells_have_no_false_negative(spark):
    rows = near_pairs(200)
    unary = lambda x: sum((0, 1, 3)[(x >> 2 * k & 1) + (x >> 2 * k + 1 & 1)] << 2 * k for k in range(32))
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    table = [(a, b, signed(unary(a)), signed(unary(b))) for a, b in rows]
    df = spark.createDataFrame(table, "a long, b long, pa long, pb long")
    keys = df.select("a", "b", simhash.cells(F.col("pa")).alias("ka"), simhash.cells(F.col("pb")).alias("kb")).collect()
    for r in keys:
        both = set(r.ka) & set(r.kb)
        assert both
        for k1 in both:
            batch = pa.RecordBatch.from_arrays([pa.array([k1, k1]), pa.array([r.a, r.b]), pa.array([0, 0]), pa.array([0, 0])], ["k1", "fp", "d0", "pv"])
            assert any(x[0] == x[1] for x in (b.column(1).to_pylist() for b in simhash.fine_keys([batch])))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    return {r.doc_id: r for r in simhash.near_duplicates(df, **kw).collect()}


def test_components_with_hot_buckets(spark):
    random.seed(2)
    base = [f"w{random.randint(0, 50)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[random.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "x", 7))
    rows += [(100, None, "x", 7), (101, "", "x", 7), (102, "alone in the world", "x", 7)]
    fps = [reference_fingerprint(t) for _, t, *_ in rows]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(components(fps))}
    for limit in (4096, 3):
        got = run(spark, rows, bucket_limit=limit)
        assert {k: r.component_id for k, r in got.items()} == want


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(-(1 << 63), 1 << 63, 40)
    fps = set(map(int, seeds))
    while len(fps) < 900:  # walks of a few bits, so that components are long and cells are full
        x = int(rng.choice(list(fps))) & (1 << 64) - 1
        for k in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
            x ^= 1 << k
        fps.add(int(np.uint64(x).astype(np.int64)))
    fps = sorted(fps)
    want = components([x & (1 << 64) - 1 for x in fps])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for limit in (4096, 5):
        up = list(range(len(fps)))
        place = {x: i for i, x in enumerate(fps)}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in simhash.links(df, StageTables(spark), limit).collect():
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
            a, b = root(place[a]), root(place[b])
            up[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(fps))] == want


def test_query_equals_brute_force(spark):
    from lodestone.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [reference_fingerprint(r.text) for r in docs]
    want = {docs[i].doc_id: (f"{fps[i]:016x}", docs[r].doc_id) for i, r in enumerate(components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op5_simhash"](spark, sf).collect()} == want


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert simhash.deduplicate(df).count() == 2
