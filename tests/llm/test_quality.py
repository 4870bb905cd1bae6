import math
import random

from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.common import StageTables


def test_toxic_documents_are_not_trusted(spark, tmp_path):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, 1, None), (6, None, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r.doc_id for r in quality.trusted_ids(spark, str(tmp_path)).collect()] == [1]


def test_small_languages_have_limits_of_their_own(spark):
    random.seed(7)
    words = {"aa": ["mono", "nomo", "onom"], "bb": ["".join(random.choice("bcdfghjklpqrstvwxz") for _ in range(7)) for _ in range(400)]}
    prose = lambda lang, n=40: " ".join(random.choice(words[lang]) for _ in range(n))
    rows = [(i, prose("bb"), "bb") for i in range(600)] + [(1000 + i, prose("aa"), "aa") for i in range(60)]
    mixed = [(2000 + i, " ".join("".join(random.choice("mno ") for _ in range(8)) for _ in range(30)), "aa") for i in range(20)]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    out = quality.classify(df, spark.createDataFrame([(r[0],) for r in rows], "doc_id long")).collect()
    high = {r.lang: r.high for r in out}
    assert high["aa"] < 0.7 * high["bb"]
    assert sum(r.keep for r in out if r.doc_id < 2000) > 640 and not any(r.keep for r in out if r.doc_id >= 2000)


def test_a_fold_leaves_its_own_documents_out(spark, tmp_path):
    rows = [(i, f"{chr(97 + i)}{chr(98 + i)}" * 9, i % 3) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, f int").write.parquet(str(tmp_path / "d"))
    docs, tables = spark.read.parquet(str(tmp_path / "d")), StageTables(spark)
    got = quality.perplexities(docs, quality.Model(docs, "text", tables, fold_col="f", folds=3), "text", tables, F.col("f")).collect()
    for k in range(3):
        alone = quality.Model(docs.filter(F.col("f") != k), "text", tables)
        want = {r.doc_id: r.perplexity for r in quality.perplexities(docs, alone, "text", tables).collect()}
        assert all(math.isclose(r.perplexity, want[r.doc_id], rel_tol=1e-6) for r in got if r.f == k)


def test_query_writes_no_texts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    keep, wrote = quality.StageTables.keep, {}
    monkeypatch.setattr(quality.StageTables, "keep", lambda self, df, name: wrote.setdefault(name, df.columns) and keep(self, df, name))
    got = quality.op10_query(spark, sf)
    assert not [n for n, columns in wrote.items() if "text" in columns]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    whole = quality.classify(docs, quality.trusted_ids(spark, sf))
    assert whole.columns == ["doc_id", "lang", "text", "perplexity", "low", "high", "keep"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.drop("text").collect()))
