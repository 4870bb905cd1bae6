import random

import numpy as np

from lodestone.llm import chunkdedup


def words(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvé") for _ in range(rnd.randint(2, 9)))
    return rnd, lambda n: " ".join(word() for _ in range(n))


def test_rolling_hash_and_cuts_byte_by_byte():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", bytes(700), bytes(rng.integers(0, 256, 900, dtype=np.uint8)), ("é日 " * 300).encode(), b"ab" * 400, bytes(rng.integers(97, 105, 3000, dtype=np.uint8))]
    for t, got in zip(texts, chunkdedup.chunk_texts(texts)):
        h, rolled = 0, []
        for b in t:
            h = (2 * h + int(chunkdedup.GEAR[b])) % 2**32
            rolled.append(h)
        assert chunkdedup.rolling(np.frombuffer(t, np.uint8)).tolist() == rolled
        r, ends, start = chunkdedup.REACH_CUT, [], 0
        for i in range(1, len(t)):
            inside = t[i] & 0xC0 == 0x80
            least = rolled[i - 1] == min(rolled[max(0, i - 1 - r) : i + r]) and not inside
            far = i - start >= chunkdedup.MAX_BYTES and not inside
            if least and i - start >= chunkdedup.MIN_BYTES or far:
                ends.append(i)
                start = i
        assert got == ends + [len(t)] * bool(t)


def test_growth_byte_by_byte():
    rnd, _ = words(2)

    def slow(a, b):
        same = 0
        while same < min(len(a), len(b), chunkdedup.REACH) and a[same] == b[same]:
            same += 1
        ends = lambda t, k: k == len(t) or t[k : k + 1].isspace()
        whole = next((k for k in range(same, -1, -1) if ends(a, k) and ends(b, k)), None)
        if whole is not None:
            return whole
        return 0 if any(a[k : k + 1].isspace() for k in range(same)) else same

    cases = []
    for _ in range(3000):
        a = bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(0, 12)))
        cases.append((a, a[: rnd.randint(0, len(a))] + bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(0, 4)))))
    cases += [(b"x" * 257, b"x" * 257), (b"x y" * 80, b"x y" * 81), (b"", b"")]
    left, right = [a for a, _ in cases], [b for _, b in cases]
    assert chunkdedup.growth(left, right)[0].tolist() == [slow(a, b) for a, b in cases]
    assert chunkdedup.growth_back(left, right)[0].tolist() == [slow(a, b) for a, b in cases]
    assert chunkdedup.growth(["aé".encode()], ["aê".encode()])[0].tolist() == [1]


def shared(a, b, least):
    """Whether two word lists share ``least`` words in a row."""
    grams = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    return any(tuple(b[i : i + least]) in grams for i in range(len(b) - least + 1))


def test_equals_brute_force_over_documents(spark):
    """Documents with a row: exactly those that share 50 words in a row with another, all pairs compared."""
    rnd, prose = words(5)
    passages, rows = [prose(n) for n in (49, 50, 51, 55, 70, 300)], []
    for i in range(90):
        parts = [prose(rnd.randint(1, 40))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            cut = p.split()
            parts += [" ".join(cut[: rnd.choice([len(cut), 30, 52])]), prose(rnd.randint(1, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(90, rows[3][1]), (91, None), (92, ""), (93, " "), (3, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int")
    found = chunkdedup.repeats(df).collect()
    texts = [(i, (t or "").split()) for i, t in rows]
    want = {i for i, t in texts for j, u in texts if i != j and shared(t, u, 50)}
    assert {r.doc_id for r in found} == want
    by = {i: (t or "").encode() for i, t in rows}
    for r in found:
        run = by[r.doc_id][r.start : r.stop]
        if not r.kept:
            assert len(run.split()) >= 50
            near = [u for j, u in by.items() if j != r.doc_id]
            assert any(shared(run.split(), u.split(), 40) for u in near)
    left = chunkdedup.without_repeats(df).collect()
    assert len(left) == len(rows) and {c for c in df.columns} == set(left[0].asDict())
    after = [(r.doc_id, (r.text or "").split()) for r in left if (r.doc_id, r.text) != (3, rows[3][1])]
    assert not any(shared(t, u, 50) for i, t in after for j, u in after if i != j)
    assert [r.text for r in left if r.doc_id in (91, 92, 93)] == [None, "", " "]


def test_passages_of_fifty_words_are_found_wherever_the_cuts_fall(spark):
    rnd, prose = words(6)
    rows, passages = [], []
    for i in range(300):
        passages.append(prose(rnd.randint(51, 60)))
        for k in range(2):
            rows.append((2 * i + k, f"{prose(rnd.randint(1, 60))} {passages[i]} {prose(rnd.randint(1, 60))}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in chunkdedup.repeats(df).collect()}
    for i, t in rows:
        run = t.encode()[found[i].start : found[i].stop].decode()
        assert passages[i // 2] in run and len(run) <= len(passages[i // 2]) + 8 and found[i].kept == (i % 2 == 0)


def test_repeats_inside_one_document(spark):
    _, prose = words(9)
    p = prose(60)
    df = spark.createDataFrame([(1, f"{p} {prose(9)} {p} {prose(5)}"), (2, prose(90))], "doc_id long, text string")
    assert chunkdedup.repeats(df).count() == 0
    assert sorted((r.doc_id, r.kept) for r in chunkdedup.repeats(df, inside=True).collect()) == [(1, False), (1, True)]
    assert {r.doc_id: r.text.count(p) for r in chunkdedup.without_repeats(df, inside=True).collect()} == {1: 1, 2: 0}
    assert chunkdedup.repeats(df.limit(0)).count() == 0


def test_query_reads_whole_texts(spark):
    import duckdb

    from lodestone.llm import registry

    sf = "/root/testdata/sf0.001"
    texts = {i: (t or "").split() for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    owner: dict = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            owner.setdefault(" ".join(t[k : k + 50]), set()).add(i)
    want = set().union(*(v for v in owner.values() if len(v) > 1))
    rows = registry.queries()["op7_chunkdedup"](spark, sf).collect()
    got = {r.doc_id for r in rows}
    assert want <= got and len(got - want) <= 2 and len(got) == len(rows)
