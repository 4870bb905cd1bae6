"""Matching terms against the index."""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import query as q

from .index import BUCKETS, first_per_file


def bucket_of(token: str, buckets: int = BUCKETS) -> int:
    """The bucket that ``token_bucket`` gives a token, worked out on the driver, so that the filter is a constant."""
    value = xxhash.xxh64_intdigest(token.encode(), 42)
    return (value - (1 << 64) if value >> 63 else value) % buckets


def phrase(postings: DataFrame, words: list[str], prefix: bool = False) -> DataFrame:
    """``(chunk_id, file_id)`` of the chunks that hold the tokens in a row; the last may be a prefix.

    The postings of all tokens are read once, of a stored index (with ``tok_bucket``) only their buckets, unless the last
    is a prefix; a start position is a hit if every place after it is filled.
    """
    places = []
    for k, w in enumerate(words):
        hit = F.startswith("tok", F.lit(w)) if prefix and k == len(words) - 1 else F.col("tok") == w
        places.append(F.when(hit, F.lit(k)))
    wanted = reduce(lambda a, b: a | b, [F.startswith("tok", F.lit(w)) if prefix and k == len(words) - 1 else F.col("tok") == w for k, w in enumerate(words)])
    rows = postings.filter(wanted)
    exact = words[:-1] if prefix else words
    if "tok_bucket" in postings.columns and len(exact) == len(words):  # a stored index: read the tokens' buckets only
        rows = rows.filter(F.col("tok_bucket").isin(sorted({bucket_of(w) for w in exact})))
    if len(words) == 1:
        return rows.select("chunk_id", "file_id").distinct()
    starts = rows.select("chunk_id", "file_id", "pos", F.explode(F.array_compact(F.array(*places))).alias("k"))
    full = starts.groupBy("chunk_id", "file_id", (F.col("pos") - F.col("k")).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("filled"))
    return full.filter(F.col("filled") == (1 << len(words)) - 1).select("chunk_id", "file_id").distinct()


def any_phrase(postings: DataFrame, compiled: q.Phrases) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [phrase(postings, p, compiled.prefix) for p in compiled.alternatives]).distinct()


def verified(candidates: DataFrame, chunks: DataFrame, pattern: str) -> DataFrame:
    """Candidates whose chunk text matches; only they are read."""
    texts = chunks.select("chunk_id", "text").join(candidates, "chunk_id")
    return texts.filter(F.rlike("text", F.lit(pattern))).select("chunk_id", "file_id")


def match_term(index: dict[str, DataFrame], term: str) -> DataFrame:
    """``(chunk_id, file_id)`` of all chunks that a term matches.

    ``index``: ``chunks``, ``postings``, and where needed ``chars`` and ``loose``.
    """
    postings, none = index["postings"], index["postings"].filter("false").select("chunk_id", "file_id")
    if q.is_tiny(term):
        return none
    one = q.single_char(term)
    if one:
        out = index["chars"].filter(F.col("ch") == one).select("chunk_id", "file_id").distinct()
    elif q.needs_intersection(term):
        parts = []
        for run in q.runs(term):
            single = q.single_char(run)
            parts.append(index["chars"].filter(F.col("ch") == single).select("chunk_id", "file_id") if single else any_phrase(postings, q.phrases(run)))
        out = reduce(lambda a, b: a.intersect(b), parts)
    else:
        compiled = q.phrases(term)
        if compiled is None:
            return none
        out = any_phrase(postings, compiled)
        if "loose" in index:
            from lodestone.functions.text import loose

            out = out.unionByName(any_phrase(index["loose"], q.phrases(loose(term)))).distinct()
    if q.is_strict(term) or q.needs_intersection(term):
        out = verified(out, index["chunks"], q.term_regex(term))
    return out


def quick(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """``(file_id, terms)``: the terms that each file matches, without snippets."""
    rows = [match_term(index, x).select("file_id", F.lit(x).alias("term")) for x in dict.fromkeys(terms)]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("file_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def hits(index: dict[str, DataFrame], terms: list[str], files: DataFrame, most: int = q.HITS_PER_FILE) -> DataFrame:
    """``(file_id, chunk_id, term)``: at most ``most`` chunks for each of the given files and terms, lowest ids first."""
    rows = [match_term(index, x).withColumn("term", F.lit(x)) for x in dict.fromkeys(terms)]
    wanted = reduce(lambda a, b: a.unionByName(b), rows).join(files.select("file_id"), "file_id", "left_semi")
    return first_per_file(wanted, most, ("file_id", "term")).drop("rn")
