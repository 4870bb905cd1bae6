import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import registry, shards
from lodestone.llm.common import bare_scan, fresh_path


def library():
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS, LIB = library()
OWN = shards.TextEncoder(RANKS)


def ids(text):
    return OWN.encode(text)


def test_permutation_is_keyed_and_exact():
    for n in (1, 2, 7, 1000, 4097):
        p = shards.permute(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n)) and (shards.permute(p, n, 9, inverse=True) == np.arange(n)).all()
    assert (shards.permute(np.arange(1000), 1000, 1) != shards.permute(np.arange(1000), 1000, 2)).any()


def test_ids_equal_the_library_for_every_code_point():
    every = [chr(i) for i in [*range(0x40000), *range(0x40000, 0x110000, 97)] if not 0xD800 <= i <= 0xDFFF]
    for at in range(0, len(every), 4096):
        part = every[at : at + 4096]
        for text in ("".join(f"a{c}b {c}" for c in part), "".join(f"7{c}8 {c}{c} !{c}?" for c in part)):
            assert ids(text) == LIB.encode_ordinary(text)


def test_ids_equal_the_library_for_mixed_texts():
    rng = np.random.default_rng(5)
    letters = list("ab Z9'st  \t\n\r\x0b\x1c\x85\xa0\u2003\u3000é日한²½Ⅷ٣_-.,!\u0301\ua7cb\U00010d40😀")
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert ids(text) == LIB.encode_ordinary(text)
    for text in ("it's we'll I'd 'tis 're'", "x" * 5000, " " * 3000 + "x", "\n" * 3000, "!" * 3000):
        assert ids(text) == LIB.encode_ordinary(text)
    assert len(ids(" " * 1_500_000)) == 1_500_000 and len(ids("é" + " " * 1_500_000)) >= 1_500_000


def check(docs, folder, length, per_shard):
    """Every slot holds the sequence that its inverse names, and the shards are whole."""
    shared = shards.share_ranks(docs.sparkSession, P.path("byte_bpe_50k.tiktoken"))
    manifest = shards.write_shards(docs, shared, folder, length=length, slots_per_shard=per_shard)
    back = {r.slot: r for r in shards.read_shards(manifest, folder).collect()}
    n = len(back)
    assert sorted(back) == list(range(n))
    for m in manifest.collect():
        assert m.first_slot == m.shard * per_shard and m.n_slots == min(per_shard, n - m.first_slot)
    order = shards.permute(np.arange(n), n).tolist()
    stream, starts = [], []
    for i in order:
        starts.append(len(stream))
        stream += np.frombuffer(back[i].ids, "<u2").tolist()
    assert (shards.permute(np.array(order), n, inverse=True) == np.arange(n)).all()
    end, texts, held = max(RANKS.values()) + 1, [], []
    for k, x in enumerate(stream):
        held.append(x)
        if x == end:
            texts.append((tuple(held[:-1]), k))
            held = []
    assert not held
    owner, at = {}, 0
    rows = [(r[0], tuple(LIB.encode_ordinary(r[1] or ""))) for r in docs.select("doc_id", "text").collect()]
    assert sorted(t for t, _ in texts) == sorted(t for _, t in rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(i)
    for t, k in texts:
        for place in range(at, k + 1):
            owner[place] = by_text[t]
        at = k + 1
    for i, start in zip(order, starts):
        assert back[i].doc_id in owner[start]
    return manifest, back


def test_shards_of_every_kind_of_input(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7), 1) for i in range(60)] + [(None, None, 1), (60, "", 1), (61, " " * 5000, 1), (61, " " * 5000, 1), (62, "é日 ² " * 900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    manifest, back = check(docs, fresh_path(spark, "shards"), 16, 8)
    late = shards.read_shards(manifest, "", start=10).collect()
    assert sorted(r.slot for r in late) == list(range(10, len(back)))
    assert {r.slot: bytes(r.ids) for r in late}.items() <= {r.slot: bytes(r.ids) for r in back.values()}.items()
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    assert bare_scan(stored) and bare_scan(stored.filter("doc_id > 3").select("text")) and not bare_scan(stored.repartition(4)) and not bare_scan(stored.unionByName(stored))
    check(stored, fresh_path(spark, "shards"), 16, 8)
    check(stored.repartition(4), fresh_path(spark, "shards"), 32, 4)
    check(stored.unionByName(stored), fresh_path(spark, "shards"), 16, 8)
    shared = shards.share_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    assert shards.write_shards(docs.limit(0), shared, fresh_path(spark, "shards")).count() == 0
    assert shards.write_shards(stored.filter("doc_id < 0"), shared, fresh_path(spark, "shards")).count() == 0


def test_key_changes_the_order(spark):
    docs = spark.createDataFrame([(i, f"words of {i} " * 9) for i in range(40)], "doc_id long, text string").coalesce(1)
    shared = shards.share_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    reads = []
    for key in (1, 2, 1):
        folder = fresh_path(spark, "shards")
        found = shards.read_shards(shards.write_shards(docs, shared, folder, length=8, key=key), folder)
        reads.append({r.slot: (r.doc_id, bytes(r.ids)) for r in found.collect()})
    assert reads[0] == reads[2] != reads[1]


def test_query(spark):
    rows = registry.queries()["op2_shards"](spark, "/root/testdata/sf0.001").collect()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert sum(r.n_tokens for r in rows) == sum(len(LIB.encode_ordinary(t)) + 1 for t in texts)
    assert all(r.byte_offset % (8 + 2 * shards.LENGTH) == 0 for r in rows)


def test_ids_beyond_sixteen_bits_are_refused(spark, tmp_path):
    (tmp_path / "ranks").write_text("YQ== 65535\n")
    with pytest.raises(ValueError):
        shards.share_ranks(spark, str(tmp_path / "ranks"))
