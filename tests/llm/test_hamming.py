import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hamming, registry


def brute(rows, queries, k):
    """{query: [(id, distance)]}: all pairs, each id and code once, a null id last."""
    rows = sorted({(i, c) for i, c in rows if c is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    out = {}
    for q, c in sorted({x for x in queries if x[1] is not None}):
        near = sorted(((bin((c ^ v) & (1 << 64) - 1).count("1"), i is None, i or 0, i) for i, v in rows if i != q))
        own, seen = [], set()
        for d, _, _, i in near:
            if (i, d) not in seen:
                seen.add((i, d))
                own.append((i, d))
        out.setdefault(q, []).extend(own)
    return {q: [(i, d) for d, _, i in sorted({(d, (i is None, i or 0), i) for i, d in v}, key=lambda x: x[:2])[:k]] for q, v in out.items()}


def check(spark, rows, queries, k=5, **kw):
    codes = spark.createDataFrame([(*r, "x") for r in rows], "id long, code long, bound string")
    asked = spark.createDataFrame(queries, "query_id long, code long")
    got = {}
    for r in sorted(hamming.search(codes, asked, k, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.distance))
        assert r.rank == len(got[r.query_id])
    assert got == {q: v for q, v in brute(rows, queries, k).items() if v}


@pytest.mark.parametrize("group", [1 << 16, 7])
def test_search_equals_brute_force(spark, group):
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), 1 << 63, 400)
    values[:120] = values[0]
    values[120:200] = values[0] ^ (1 << rng.integers(0, 63, 80))  # many ties at distances 1 and 2
    rows = [(int(i), int(v)) for i, v in enumerate(values)] + [(3, int(values[3])), (500, None), (None, int(values[300])), (40, int(values[301]))]
    check(spark, rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], group_codes=group)


def test_few_rows(spark):
    check(spark, [(1, 5)], [(1, 5), (2, 7)])
    check(spark, [(1, 5), (2, 5), (3, -1)], [(1, 5), (9, 0), (9, None)])
    codes = spark.createDataFrame([(1, 5)], "id long, code long")
    asked = codes.select(F.col("id").alias("query_id"), "code")
    assert hamming.search(codes.limit(0), asked).count() == 0 and hamming.search(codes, asked.limit(0)).count() == 0


def test_probes_reach_every_value():
    rng = np.random.default_rng(7)
    code = rng.integers(-(1 << 63), 1 << 63, 500)
    q = np.concatenate([code[:3], rng.integers(-(1 << 63), 1 << 63, 5)])
    widths, bits = [8] * 8, 2
    for s in range(8):
        seen = []
        for high in range(4):
            value = (code.view(np.uint64) >> np.uint64(8 * s) & np.uint64(255)).astype(np.int64)
            mine = code[value >> 6 == high]
            group = hamming.Group(s, high, widths, bits, mine, np.arange(len(mine)))
            for r in range(9):
                seen += [(int(a), int(b), r) for x, c, *_ in group.probe(q, np.full(len(q), 64), r, 500) for a, b in zip(x, c)]
        want = {(int(a), int(b), bin((int(a) ^ int(b)) >> 8 * s & 255).count("1")) for a in q for b in code}
        assert len(seen) == len(set(seen)) and set(seen) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    codes = [(i, int(np.uint64(sum(1 << b for b in range(64) if b < len(e) and e[b] > 0)).astype(np.int64))) for i, e in rows]
    want = brute(codes, [c for c in codes if c[0] % 20 == 0], 10)
    got = {}
    for r in registry.queries()["op4_hamming"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    assert got == want
