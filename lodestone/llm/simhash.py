"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits over word shingles. To link all fingerprints within 3 bits:

1. Exact copies collapse first: only distinct fingerprints go on.
2. The pivot table holds each fingerprint's Hamming distances to 33 references: zero, and one for each block of two
   neighbouring bits, in which only that block is set. The distance to a reference in which any union of blocks is set
   is a sum of these, so the table answers for 2^32 references. By the triangle inequality no coordinate of two near
   fingerprints differs by more than 3; the largest difference over all those references is the sum, over the blocks, of
   the differences in the number of bits set. A block's number follows from two distances, and is kept in unary in two
   bits, so the largest difference is the bit count of an XOR of two such rows (``pivot_rows``).
3. Candidates meet in cells of the pivot table: at most 3 of the 32 numbers differ, so of six groups of blocks at least
   three agree, and 20 tables, each with the numbers of three groups as its key, lose no link. No pair is ever formed
   across cells. A cell with more than ``bucket_limit`` members is dealt again by what the numbers leave open, as
   distances to single bits (220 tables, ``fine_keys``), which leaves 13 bits free: a cell has at most 8,192 members.
4. In a cell, sorted by the distance to zero, a pair is discarded when that coordinate or the largest difference exceeds
   3; survivors are verified by XOR and a bit count. Verified links are thinned to a spanning forest before they leave
   the task, so a large group of near copies gives a line for each member, not for each pair.
5. Components come from ``common.components``.

``deduplicate`` is the operator over texts: links are pairs of a shingle Jaccard similarity of at least 0.8. The pivot
tables' links go through that exact check, and ``jaccard`` completes them, as near texts may differ in more bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import StageTables, components

SEED = 42
MAX_DISTANCE = 3
BUCKET_LIMIT = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The references of the pivot table beside zero: block b is the bits 2b and 2b + 1.
BLOCKS = 32
PIVOTS = tuple(int(np.uint64(3 << 2 * b).astype(np.int64)) for b in range(BLOCKS))
#: The blocks of each of the six groups, and the tables: the groups that must agree.
GROUPS = tuple(tuple(range(g, BLOCKS, 6)) for g in range(6))
TABLES = tuple(combinations(range(6), 3))
#: The open bits of a hot cell are dealt by 9 of 12 parts.
PARTS, EQUAL_PARTS = 12, 9
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is set in more than half of the shingles' hashes.

    A-Z are lower-cased; words are runs of other bytes than space and 0x09-0x0D; shingles count with repeats. Fewer
    words than a shingle: the whole sequence; none, or null: zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return digest(b" ".join(parts), SEED)
    total, ones, step = len(parts) - words + 1, np.zeros(64, np.int64), 1 << 16
    for at in range(0, total, step):
        part = parts[at : at + step + words - 1]
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(words)))]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; texts cross to Python in Arrow batches, and only the longs come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for at in range(0, batch.num_rows, 256):
                fps += [fingerprint(t, words) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def distances(fp: Column) -> tuple[Column, list[Column]]:
    """The distance to zero, and those to the other references."""
    return F.bit_count(fp), [F.bit_count(fp.bitwiseXOR(F.lit(p))) for p in PIVOTS]


def pivot_rows(fp: Column) -> tuple[Column, Column]:
    """The distance to zero, and the bits set in each block, which two distances tell, in unary: 0, 1 or 3 at 2b."""
    zero, others = distances(fp)
    out = F.lit(0).cast("long")
    for b, d in enumerate(others):
        n = ((zero - d + 2) / 2).cast("int")
        out = out.bitwiseOR(F.shiftleft((n + F.shiftright(n, 1)).cast("long"), 2 * b))
    return zero, out


def cells(pv: Column) -> Column:
    """An array of the 20 cells of a pivot row: the numbers of three groups of blocks, and the table's number mixed in.

    The two bits of each block lie side by side, 34 bits at most.
    """
    keys = []
    for t, trio in enumerate(TABLES):
        key, at = F.lit(t << 40), 0
        for g in trio:
            for b in GROUPS[g]:
                key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(pv, 2 * b).bitwiseAND(F.lit(3)), at))
                at += 2
        keys.append(key)
    return F.array(*keys)


def fine_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, fp, d0, pv) of hot cells become 220 rows (k1, k2, fp, d0, pv).

    A cell fixes the numbers of its blocks; one bit of each such block and both bits of every other are left open. Two
    near fingerprints differ in at most 3 of these places, 49 at most, so 9 of 12 parts agree, and 3 parts are free.
    """
    chosen = list(combinations(range(PARTS), EQUAL_PARTS))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            k1, fp = part.column(0).to_numpy(), part.column(1).to_numpy()
            table = k1 >> 40
            for t in np.unique(table).tolist():
                mine = np.nonzero(table == t)[0]
                fixed = {b for g in TABLES[t] for b in GROUPS[g]}
                places = [2 * b for b in range(BLOCKS)] + [2 * b + 1 for b in range(BLOCKS) if b not in fixed]
                bits = (fp[mine][:, None] >> np.array(places)) & 1
                split = np.array_split(np.arange(len(places)), PARTS)
                words = [bits[:, p] @ (1 << np.arange(len(p))) for p in split]
                for s, nine in enumerate(chosen):
                    k2 = np.full(len(mine), s << 48)
                    for n, k in enumerate(nine):
                        k2 |= words[k] << (5 * n)
                    take = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(k2), *(part.column(c).take(take) for c in (1, 2, 3))], ["k1", "k2", "fp", "d0", "pv"])


def _root(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while True:
        higher = parent[up]
        if (higher == up).all():
            return up
        up = higher


def bucket_links(key: np.ndarray, fp: np.ndarray, zero: np.ndarray, pivots: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest links among rows sorted by (key, zero); equal neighbours in ``key`` form a cell.

    All cells advance together: at offset d each row meets the row d places on, as long as both lie in one cell and the
    distance to zero, by which they are sorted, is near enough. Then the largest coordinate difference decides, then the
    fingerprints themselves.
    """
    n = len(key)
    parent = np.arange(n)
    out_a, out_b = [], []
    alive, d = np.arange(n), 1
    while len(alive):
        alive = alive[alive + d < n]
        other = alive + d
        near = (key[alive] == key[other]) & (zero[other] - zero[alive] <= max_distance)
        alive = alive[near]
        if not len(alive):
            break
        other = alive + d
        fits = np.bitwise_count((pivots[alive] ^ pivots[other]).view(np.uint64)) <= max_distance
        i, j = alive[fits], other[fits]
        close = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_distance
        i, j = i[close], j[close]
        apart = _root(parent, i) != _root(parent, j) if len(i) else np.zeros(0, bool)
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_a.append(a)
                out_b.append(b)
        d += 1
    return fp[np.array(out_a, np.int64)], fp[np.array(out_b, np.int64)]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, fp, d0, pv) come sorted; a cell that a batch ends in waits for the next batch."""
    rest = None

    def linked(block: np.ndarray) -> pa.RecordBatch:
        fresh = np.r_[True, (block[1:, :2] != block[:-1, :2]).any(axis=1)]
        a, b = bucket_links(np.cumsum(fresh), *(block[:, k].copy() for k in (2, 3, 4)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if rest is not None:
            block = np.concatenate([rest, block])
        if not len(block):
            continue
        last = int(np.argmax((block[:, :2] == block[-1, :2]).all(axis=1)))
        rest, block = block[last:], block[:last]
        if len(block):
            yield linked(block)
    if rest is not None and len(rest) > 1:
        yield linked(rest)


def links(fps: DataFrame, tables: StageTables, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(a, b)`` links of distinct fingerprints ``fps(fp)`` that keep every component of the 3-bit graph."""
    zero, pv = pivot_rows(F.col("fp"))
    table = tables.keep(fps.select("fp", zero.cast("long").alias("d0"), pv.alias("pv")), "simhash-pivots")
    keyed = table.select("fp", "d0", "pv", F.explode(cells(F.col("pv"))).alias("k1"))
    sizes = keyed.groupBy("k1").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    sizes = tables.keep(sizes, "simhash-cells")
    shared = keyed.join(sizes.hint("shuffle_hash"), "k1")
    plain = shared.filter(F.col("n") <= bucket_limit).select("k1", F.lit(0).cast("long").alias("k2"), "fp", "d0", "pv")
    if not sizes.filter(F.col("n") > bucket_limit).isEmpty():
        again = shared.filter(F.col("n") > bucket_limit).select("k1", "fp", "d0", "pv")
        plain = plain.unionByName(again.mapInArrow(fine_keys, "k1 long, k2 long, fp long, d0 long, pv long"))
    dealt = plain.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "d0")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for every row of ``docs``.

    ``component_id`` is the least id reachable over links of at most 3 differing bits, itself included. Null or empty
    texts share fingerprint zero and are linked like any other. Repeated rows are kept, a row for each; a null id never
    is a component's least id unless it has no other. An empty table gives an empty result. Columns other than the two
    named are not read.
    """
    spark = docs.sparkSession
    tables = StageTables(spark)
    signed = tables.keep(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    distinct = tables.keep(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    label = components(spark, links(distinct.select("fp"), tables, bucket_limit), tables)
    classes = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = tables.keep(classes, "simhash-classes")
    least = tables.keep(classes.groupBy("label").agg(F.min("least_id").alias("component_id")), "simhash-least")
    found = tables.keep(classes.join(least, "label").select("fp", "component_id"), "simhash-of-fp")
    tables.drop(distinct, classes, least)
    return signed.join(found, "fp").select("doc_id", "fp", "component_id")


def op5_query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of each near-duplicate component of ``docs``: the least id's, and of rows that share it the first.

    Two texts are linked if their sets of ``jaccard.WORDS``-word shingles have a Jaccard similarity of 0.8 or more. Null
    texts are empty, and empty texts are copies of each other. A null id comes before all others. All columns stay as
    they are, whatever they are called, and an empty table stays empty.
    """
    from .jaccard import kept_rows

    return kept_rows(docs, id_col, text_col, lambda fps, tables: links(fps, tables, bucket_limit))
