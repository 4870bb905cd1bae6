"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments of about log2 of the number of distinct codes; the index lists, for each
segment and value, the distinct codes that have it. Round r probes all values at segment distance r. A code at total
distance d has a segment at distance d // m or less, so after round r everything up to distance m * (r + 1) - 1 has
been verified: a query is done when its kth verified distance is within that. Rounds go on for the others; after the
last radius every code has been seen.

The index lies in groups: a segment and the high bits of its value; a group beyond GROUP_CODES codes is salted. A query
goes to the groups whose high bits are within the radius, and flips its low bits there by what is left of the radius:
probes are looked up in arrays, and no row is made of them. A group gives back each query's k + 1 nearest only (by
distance, then least id), and none beyond the distance that earlier rounds have reached.

Equal codes are one entry with its least ids (k + 1 of them: no search can return more), so a group of copies costs no
more than a single row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import StageTables

BITS, K = 64, 10
LEAST_WIDTH, MOST_WIDTH = 8, 22
#: Distinct codes in a group of the index at most, about, and candidates that a step of a task verifies.
GROUP_CODES, STEP = 1 << 16, 1 << 21


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The code of a vector: bit i is set if value i is above zero; missing or null values count as zero."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        mask = (1 << i) - (1 << 64 if i == 63 else 0)
        out = out.bitwiseOR(F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def segment_widths(distinct: int) -> list[int]:
    """Widths that sum to 64, near log2 of the number of codes: then a value has about one code."""
    m = max(1, round(BITS / min(MOST_WIDTH, max(LEAST_WIDTH, math.log2(max(2, distinct))))))
    return [BITS // m + (i < BITS % m) for i in range(m)]


def segment(code: Column, widths: list[int], s: int) -> Column:
    """The value of segment ``s``."""
    return F.shiftrightunsigned(code, sum(widths[:s])).bitwiseAND(F.lit((1 << widths[s]) - 1)).cast("int")


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


class Group:
    """The codes of one group, by the low bits of their segment's value."""

    def __init__(self, s: int, high: int, widths: list[int], bits: int, code: np.ndarray, least: np.ndarray):
        self.s, self.high, self.low = s, high, widths[s] - bits
        self.shift, self.width = sum(widths[:s]), widths[s]
        low = self.value(code) & ((1 << self.low) - 1)
        by = np.argsort(low, kind="stable")
        self.code, self.least, self.keys = code[by], least[by], low[by]

    def value(self, code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) >> np.uint64(self.shift) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def probe(self, q: np.ndarray, bound: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(q, code, d, least)``: each query's ``most`` nearest codes whose value here is at exactly ``radius``, none
        beyond ``bound``."""
        value = self.value(q)
        left = radius - np.bitwise_count((value >> self.low) ^ self.high)
        low = value & ((1 << self.low) - 1)
        for r in np.unique(left[(left >= 0) & (left <= self.low)]).tolist():
            mine, flips = np.nonzero(left == r)[0], masks(self.low, r)
            step = max(1, STEP // len(flips))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                probes = low[part][:, None] ^ flips
                lo, hi = np.searchsorted(self.keys, probes.ravel(), "left"), np.searchsorted(self.keys, probes.ravel(), "right")
                held = (hi - lo).reshape(probes.shape).sum(axis=1)
                for a, b in _steps(held):
                    span = slice(a * len(flips), b * len(flips))
                    yield from self._nearest(q[part[a:b]], bound[part[a:b]], held[a:b], lo[span], hi[span], most)

    def _nearest(self, q: np.ndarray, bound: np.ndarray, held: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int):
        size = hi - lo
        who = np.repeat(np.arange(len(q)), held)
        spot = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        d = np.bitwise_count((q[who] ^ self.code[spot]).view(np.uint64)).astype(np.int64)
        near = d <= bound[who]
        who, spot, d = who[near], spot[near], d[near]
        by = np.lexsort((self.least[spot], d, who))
        who, spot, d = who[by], spot[by], d[by]
        first = np.searchsorted(who, who, "left")
        keep = np.arange(len(who)) - first < most
        if keep.any():
            yield q[who[keep]], self.code[spot[keep]], d[keep], self.least[spot[keep]]


def _steps(held: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of queries with about STEP candidates in each."""
    total, at = np.cumsum(held), 0
    while at < len(held):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
        yield at, end
        at = end


def _probe_batches(widths: list[int], bits: int, radius: int, most: int):
    """Rows (g, salt, query, code, rank) sorted by (g, salt, query): a group's codes, then its queries with bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, group = None, [], None
        for batch in batches:
            g, salt, query, code, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            turns = np.nonzero(np.r_[True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (query[1:] != query[:-1])])[0].tolist()
            for a, b in zip(turns, [*turns[1:], len(g)]):
                if (g[a], salt[a]) != now:
                    now, codes, group = (g[a], salt[a]), [], None
                if not query[a]:
                    codes.append((code[a:b], rank[a:b]))
                    continue
                if not codes:
                    continue
                if group is None:
                    group = Group(int(g[a]) >> bits, int(g[a]) & ((1 << bits) - 1), widths, bits, *(np.concatenate(c) for c in zip(*codes)))
                for found in group.probe(code[a:b], rank[a:b], radius, most):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["q", "code", "d", "least"])

    return run


def search(codes: DataFrame, queries: DataFrame, k: int = K, group_codes: int = GROUP_CODES) -> DataFrame:
    """``(query_id, rank, id, distance)``: the k nearest of ``codes(id, code)`` to each of ``queries(query_id, code)``.

    The order is distance, then id (a null id last). A query's own rows are left out by id. Fewer than k others: all of
    them. Ids are integers. Null codes match nothing, empty tables give no row, and ids that repeat with one code count
    once. Other columns are not read.
    """
    spark = codes.sparkSession
    tables = StageTables(spark)
    codes = codes.filter(F.col("code").isNotNull()).select("id", "code")
    place = F.dense_rank().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    members = codes.withColumn("n", place).filter(F.col("n") <= k + 1)  # cut before the shuffle too
    entries = members.groupBy("code").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    entries = tables.keep(entries.withColumn("least", F.coalesce(F.element_at("ids", 1).cast("long"), F.lit((1 << 63) - 1))), "mih-entries")
    queries = tables.keep(queries.filter(F.col("code").isNotNull()).select("query_id", "code").distinct(), "mih-queries")
    # Codes that hold a query's own id give it one row less each; ids that repeat with other codes are the only reason
    # for more than one.
    own = codes.distinct().join(queries.select("query_id").distinct().hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("query_id")), "left_semi")
    most = k + max(1, own.groupBy("id").count().agg(F.max("count")).first()[0] or 0)
    n = entries.count()
    widths = segment_widths(n)
    spread = 2 * spark.sparkContext.defaultParallelism / len(widths)
    bits = min(min(widths), max(0, math.ceil(math.log2(max(1, n / group_codes, spread)))))
    group = lambda code, s: F.lit(s << bits).bitwiseOR(F.shiftright(segment(code, widths, s), widths[s] - bits))
    salt = lambda n: F.ceil(n / F.lit(group_codes)).cast("int")
    index = entries.select("code", "least", F.explode(F.array(*[group(F.col("code"), s) for s in range(len(widths))])).alias("g"))
    sizes = tables.keep(index.groupBy("g").agg(salt(F.count("*")).alias("salts")), "mih-groups")
    index = index.join(sizes, "g").select("g", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("query"), "code", F.col("least").alias("rank"))
    index = tables.keep(index, "mih-index")
    waiting = tables.keep(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS).cast("long")), "mih-waiting")
    found, done = None, []
    by = Window.partitionBy("q").orderBy("d", "least", "code")
    for radius in range(max(widths) + 1):
        near = [F.shiftright(segment(F.col("q"), widths, s), widths[s] - bits) for s in range(len(widths))]
        all_groups = F.explode(F.sequence(F.lit(0), F.lit((len(widths) << bits) - 1)))
        if radius < bits:  # flips of the high bits, as a constant array
            flips = F.array(*[F.lit(int(x)) for r in range(radius + 1) for x in masks(bits, r)])
            group_of = lambda s, h: lambda x: F.lit(s << bits).bitwiseOR(h.bitwiseXOR(x))
            all_groups = F.explode(F.flatten(F.array(*[F.transform(flips, group_of(s, h)) for s, h in enumerate(near)])))
        asked = waiting.select("q", "bound", all_groups.alias("g")).join(sizes, "g")
        asked = asked.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("query"), F.col("q").alias("code"), F.col("bound").alias("rank"))
        dealt = index.unionByName(asked).repartition("g", "salt").sortWithinPartitions("g", "salt", "query")
        fresh = dealt.mapInArrow(_probe_batches(widths, bits, radius, most), "q long, code long, d long, least long")
        pairs = (fresh if found is None else fresh.unionByName(found.select("q", "code", "d", "least"))).distinct()
        before, found = found, tables.keep(pairs.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most).drop("r"), "mih-found")
        if before is not None:
            tables.drop(before)
        covered = len(widths) * (radius + 1) - 1
        reach = found.groupBy("q").agg(F.count_if(F.col("d") <= covered).alias("n"), F.when(F.count("*") >= most, F.max("d")).otherwise(BITS).alias("bound"))
        last = radius == max(widths)
        state = tables.keep(waiting.select("q").join(reach, "q", "left").select("q", (F.lit(last) | (F.coalesce("n", F.lit(0)) >= most)).alias("ready"), F.coalesce("bound", F.lit(BITS)).cast("long").alias("bound")), "mih-state")
        done.append(tables.keep(found.join(state.filter("ready"), "q", "left_semi"), "mih-done"))
        waiting = state.filter("NOT ready").select("q", "bound")
        if waiting.isEmpty():
            break
    tables.drop(index, found)
    all_found = done[0]
    for more in done[1:]:
        all_found = all_found.unionByName(more)
    hits = queries.join(all_found.withColumnRenamed("code", "near"), queries["code"] == all_found["q"]).select("query_id", "near", "d")
    rows = hits.join(entries.select(F.col("code").alias("near"), "ids"), "near").select("query_id", F.explode("ids").alias("id"), F.col("d").cast("int").alias("distance"))
    rows = rows.filter(~F.col("id").eqNullSafe(F.col("query_id"))).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", F.col("id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = StageTables(spark).keep(table.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")), "mih-codes")
    queries = codes.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "code")
    return search(codes, queries)


OP4_SQL = """
WITH c AS (
  SELECT vec_id AS id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INT ELSE 0 END)) AS code
  FROM embeddings
), p AS (
  SELECT a.id AS query_id, b.id, bit_count(xor(a.code, b.code))::INT AS distance FROM c a JOIN c b ON a.id <> b.id WHERE a.id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, id, distance FROM p
)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""
