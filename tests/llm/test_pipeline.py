import random

import numpy as np
from test_jaccard import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, registry


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(ids) == out.count() and ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "secret scans", "bpe"]
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_equal_brute_force(spark, tmp_path):
    """Nulls, empty, repeated and near rows, a leak and a secret through all stages; without labels quality keeps all."""
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 999)) for _ in range(n))
    item, base = prose(30), prose(80).split()
    near = [*base[:40], "edit", *base[41:]]
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), f"{prose(20)} {item} {prose(20)}", f"{prose(9)} token: abcdefgh12345 é日 {prose(9)}", None, "", " ", prose(50), "b", prose(2000)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(8, texts[8], "en", "s", 1), (None, texts[8], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    first = {order[k][0] for k in brute([(k, r[1]) for k, r in enumerate(order)])}
    assert first == {0, 3, 4, 5, None, 9, 10}
    encode = Tokenizer.from_file(bpe.default_vocabulary()).encode
    mended = dict.fromkeys(first - {3}) | {4: texts[4].replace("token: abcdefgh12345", "[SECRET]")}
    assert got == {i: encode(t or ({i: x for i, x, *_ in rows}[i] or ""), add_special_tokens=False).ids for i, t in mended.items()}
