"""One-edit typo matching."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions import query as q
from lodestone.functions.text import is_syllable, to_jamo

from .match import match_term


def shares_letters(name: Column, token: str) -> Column:
    """The cheap test: so many of a token's syllables, or of its pairs of letters, are in the name."""
    strings, need = q.shared_letters(token)
    return reduce(lambda a, b: a + b, [F.contains(name, F.lit(x)).cast("int") for x in strings]) >= need


def contains_fuzzy(name: Column, token: str) -> Column:
    """Whether some part of ``name`` is one edit (a jamo, for Hangul) from the token; the cheap test goes first."""
    pattern = to_jamo(token)

    @pandas_udf("boolean")
    def near(names: pd.Series) -> pd.Series:
        return names.map(lambda n: n is not None and q.within_one_edit(to_jamo(n), pattern))

    # Python only gets the names that pass: the others are nulls to it.
    kept = F.when(shares_letters(name, token), name)
    return F.coalesce(near(kept), F.lit(False))


def variants(spark: SparkSession, vocab: DataFrame, term: str, most: int = q.TYPO_VARIANTS) -> DataFrame:
    """``(variant, doc)``: the most frequent one-edit variants of a term that the vocabulary ``(tok, doc)`` holds.

    The variants of a term are some hundred rows made on the driver, so they are the broadcast side.
    """
    rows, found = [], q.runs(term)
    for i, run in enumerate(found):
        fixed = lambda v: " ".join([*found[:i], v, *found[i + 1 :]])  # noqa: B023, E731
        if len(run) >= 3 and all(map(is_syllable, run)):
            for at, c in enumerate(run):
                for v in q.syllable_variants(c):
                    pairs = ([run[at - 1] + v] if at else []) + ([v + run[at + 1]] if at + 1 < len(run) else [])
                    rows += [(len(rows), fixed(run[:at] + v + run[at + 1 :]), p, len(pairs)) for p in pairs]
        elif len(run) >= 4 and run.isascii() and run.isalpha():
            rows += [(len(rows) + k, fixed(v), v, 1) for k, v in enumerate(q.word_variants(run))]
    table = spark.createDataFrame(rows, "no int, variant string, tok string, parts int")
    joined = vocab.join(F.broadcast(table), "tok")
    each = joined.groupBy("variant", "parts").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), F.min("no").alias("no"))
    return each.filter("n = parts").orderBy(F.col("doc").desc(), "no").limit(most).select("variant", "doc")


def first_files(rows: DataFrame, most: int = q.TYPO_FILES) -> DataFrame:
    """Rows of the first ``most`` files, by id."""
    files = rows.select("file_id").distinct().orderBy("file_id").limit(most)
    return rows.join(files, "file_id", "left_semi")


def search_content(spark: SparkSession, index: dict[str, DataFrame], vocab: DataFrame, term: str) -> DataFrame:
    """``(chunk_id, file_id, term, variant)``: chunks that hold a variant, credited to the term as typed."""
    found = [r[0] for r in variants(spark, vocab, term).collect()]  # at most TYPO_VARIANTS
    rows = [first_files(match_term(index, v)).withColumns({"term": F.lit(term), "variant": F.lit(v)}) for v in found]
    none = index["postings"].filter("false").select("chunk_id", "file_id").withColumns({"term": F.lit(term), "variant": F.lit("")})
    return reduce(lambda a, b: a.unionByName(b), rows, none)


def merge_matches(exact: DataFrame, fuzzy: DataFrame, most: int = q.HITS_PER_FILE) -> DataFrame:
    """Exact and fuzzy matches ``(path, terms, hits)`` of each path: exact hits first; fuzzy terms that aren't exact."""
    a = exact.select("path", F.col("terms").alias("t1"), F.col("hits").alias("h1"))
    b = fuzzy.select("path", F.col("terms").alias("t2"), F.col("hits").alias("h2"))
    none = F.array().cast("array<string>")
    both = a.join(b, "path", "full")
    t1, t2 = F.coalesce("t1", none), F.coalesce("t2", none)
    hit_none = F.array().cast(exact.schema["hits"].dataType)
    return both.select(
        "path",
        F.array_union(t1, t2).alias("terms"),
        F.slice(F.concat(F.coalesce("h1", hit_none), F.coalesce("h2", hit_none)), 1, most).alias("hits"),
        F.array_except(t2, t1).alias("fuzzy_terms"),
    )
