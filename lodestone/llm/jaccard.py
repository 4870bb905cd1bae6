"""The exact check of SimHash near-duplicates over texts, and what completes it.

A link is a pair of texts whose sets of ``WORDS``-word shingles have a Jaccard similarity of 0.8 or more. The pivot
tables of ``simhash`` propose pairs; fingerprints of such texts mostly lie further apart, so a prefix filter proposes
the others, and none is missed:

1. Texts that are equal up to case and white space collapse; only the least row of each goes on.
2. Prefix filter: with any one order of all shingles, two sets that are similar enough share a shingle among the first
   n - ceil(0.8 n) + 1 of each. The order is by hash, but shingles that more than COMMON texts of one task hold at
   least come last, the commonest at the very end. The order decides how many candidates there are, never which links
   are found.
3. Pairs of the pivot tables, and neighbours by size in the bucket of a shingle, are verified first, which joins a large
   group of copies by a line for each member and bucket. Then every pair of a bucket that isn't yet in one component is
   verified, if sizes and places in the order leave 0.8 possible.
4. A bucket of more than WIDE members, whose pairs would grow with its square, is not paired. Wide buckets that have a
   member in common form a class, and its frame is the set of shingles that more than half of the class holds. A member
   is written as its differences from the frame, what it lacks and what it has beside it: sets of n and m shingles with d
   and e differences, k of them common, are linked if and only if 18 k >= (9 d - n) + (9 e - m). Where the right side
   is zero or less both are linked to the member whose 9 d - n is least, by a line for each member that needs no check.
   All other links need a common difference, so a prefix filter over the differences, the rarest in the class first,
   proposes them (``framed``). Its own wide buckets go the same way with classes and frames of their own, as long as
   fewer members are left. Two members of a wide bucket are in one class, so no link is lost.
5. Verification counts the common shingles of both whole sets; 9 common >= 4 (n + m) is similarity >= 0.8 in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import StageTables, bare_scan, components

WORDS, COMMON, WIDE = 5, 2, 64
#: Wide buckets get frames again while at most this part of their members is left; then they are paired as they are.
LEFT = 0.75
#: Pairs that a step of the pairing holds, words whose hashes a task remembers, and shingles that it counts at once.
STEP_PAIRS, KNOWN_WORDS, HELD_GRAMS = 1 << 18, 1 << 17, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5)
        return found


def split(text: str | None) -> list[str]:
    """Words in lower case, cut at Unicode white space."""
    return (text or "").lower().split()


def shingles(words: list[str], known: dict, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle are one, none has none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(n, width)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * _ODD + w[i : n - size + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def prefix(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles in the order; ``common`` is sorted, ``rank`` holds places in the order."""
    n = len(grams)
    if not n:
        return grams
    size = n - (4 * n + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        late = common[at] == grams
        grams = np.concatenate([grams[~late], grams[late][np.argsort(rank[at[late]])]])
    return grams[:size]


def _lists(column: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(column) if column else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in column])].astype(np.int32)), pa.array(flat))


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256), at, batch.column(column).slice(at, 256).to_pylist()


def _often_grams(least: int):
    """The shingles in more than ``least`` texts of a task, or of HELD_GRAMS shingles of it, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held)
            held.clear()
            flat.sort()
            # In a run of c equal ones, c - least equal the one ``least`` places on; np.unique of all takes copies of all.
            grams, more = np.unique(flat[: max(len(flat) - least, 0)][flat[least:] == flat[: max(len(flat) - least, 0)]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(more.astype(np.int64) + least)], ["gram", "c"])

        for _, _, texts in _slices(batches, 0):
            held += [shingles(split(t), known) for t in texts]
            size += sum(map(len, held[-len(texts) :]))
            if size > HELD_GRAMS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def fingerprint(grams: np.ndarray) -> int:
    """The SimHash of a set of hashed shingles: a bit is set if more than half of them have it."""
    octets, ones = grams.view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(8):
        ones[8 * k : 8 * k + 8] = np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<i8")[0])


def _signatures(common: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part, _, texts in _slices(batches, 1):
            sizes, firsts, digests, fps = [], [], [], []
            for t in texts:
                words = split(t)
                digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                grams = shingles(words, known)
                sizes.append(len(grams))
                fps.append(fingerprint(grams))
                firsts.append(prefix(grams, common, rank))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _lists(firsts)], ["key", "d1", "d2", "n", "fp", "first"]
            )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, ta, tb) whose whole sets are similar enough; texts are smaller to move than their hashes."""
    known = _Hashes()
    for part, at, left in _slices(batches, 2):
        right = part.column(3).to_pylist()
        keep = []
        for x, y in zip(left, right):
            x, y = shingles(split(x), known), shingles(split(y), known)
            keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, class, text) become the counts (class, gram, c) of their batch's shingles."""
    known = _Hashes()
    for part, _, texts in _slices(batches, 2):
        kinds = part.column(1).to_numpy()
        for kind in np.unique(kinds):
            mine = [shingles(split(texts[i]), known) for i in np.nonzero(kinds == kind)[0]]
            grams, counts = np.unique(np.concatenate(mine), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), kind)), pa.array(grams), pa.array(counts.astype(np.int64))], ["class", "gram", "c"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, class, text, frame) become a row (node, class, n, d, gram) for each of a node's d differences.

    What a node lacks is written as the complement of its number. A row without a gram stands for the node itself.
    """
    known = _Hashes()
    for part, _, texts in _slices(batches, 2):
        nodes, kinds = part.column(0).to_numpy(), part.column(1).to_numpy()
        frames = [np.array(f or [], np.int64) for f in part.column(3).to_pylist()]
        for at in range(0, len(texts), 16):
            sets = [shingles(split(t), known) for t in texts[at : at + 16]]
            differ = [np.r_[np.setdiff1d(x, f, assume_unique=True), ~np.setdiff1d(f, x, assume_unique=True)] for x, f in zip(sets, frames[at : at + 16])]
            d = np.array([len(x) for x in differ])
            flat = np.concatenate([np.r_[np.int64(0), x] for x in differ])
            itself = np.zeros(len(flat), bool)
            itself[np.cumsum(d + 1) - d - 1] = True
            each = lambda column: np.repeat(column, d + 1)
            columns = [each(nodes[at : at + 16]), each(kinds[at : at + 16]), each(np.array([len(x) for x in sets])).astype(np.int32), each(d).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flat, mask=itself)], ["node", "class", "n", "d", "gram"])


def possible(n, at, m, there, d=None, e=None):
    """Whether sets of n and m shingles can reach 0.8 if of their d and e differences from a frame those at places
    ``at`` and ``there`` are the first they share. Without d and e the frame is empty: all shingles are differences."""
    d, e = n if d is None else d, m if e is None else e
    rest = np.minimum(d - at, e - there) if isinstance(n, np.ndarray) else F.least(d - at, e - there)
    return 18 * rest >= 9 * (d + e) - (n + m)


def bucket_pairs(
    gram: np.ndarray, n: np.ndarray, at: np.ndarray, node: np.ndarray, label: np.ndarray, d: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of unlike labels among rows sorted by (gram, label); equal neighbours in ``gram`` are a bucket.

    A row meets the rows of its bucket that come after its own label's, so members of one label are never paired.
    """
    d = n if d is None else d
    starts = np.r_[True, gram[1:] != gram[:-1]]
    ends = np.r_[np.nonzero(starts)[0][1:], len(gram)]
    stop = ends[np.cumsum(starts) - 1]
    turn = np.nonzero(np.r_[starts[1:] | (label[1:] != label[:-1]), True])[0] + 1
    begin = turn[np.searchsorted(turn, np.arange(len(gram)), side="right")]
    todo = np.maximum(stop - begin, 0)
    lo = 0
    total = np.cumsum(todo)
    while lo < len(gram):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP_PAIRS, side="right")))
        each = todo[lo:hi]
        i = np.repeat(np.arange(lo, hi), each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[lo:hi], each)
        fits = possible(n[i], at[i], n[j], at[j], d[i], d[j])
        i, j = node[i[fits]], node[j[fits]]
        yield np.minimum(i, j), np.maximum(i, j)
        lo = hi


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n, at, node, label, d) come sorted by (gram, label); a bucket that a batch ends in waits for the next."""
    rest = None

    def paired(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in bucket_pairs(*block.T):
            if len(a):
                by = np.lexsort((b, a))
                a, b = a[by], b[by]
                first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    for batch in batches:
        block = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if rest is not None:
            block = np.concatenate([rest, block])
        if not len(block):
            continue
        last = int(np.argmax(block[:, 0] == block[-1, 0]))
        rest, block = block[last:], block[:last]
        if len(block):
            yield from paired(block)
    if rest is not None and len(rest) > 1:
        yield from paired(rest)


def common_shingles(docs: DataFrame, least: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in more than ``least`` texts of some task, sorted, and their places in the order.

    The driver takes the commonest million at most; the others keep their place by hash, which costs candidates only.
    """
    counted = docs.select("text").mapInArrow(_often_grams(least), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "gram").limit(1_000_000).toPandas()
    gram, c = rows["gram"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    by = np.argsort(gram)
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, c))] = np.arange(len(gram))
    return gram[by], rank[by]


def _check(pairs: DataFrame, docs: DataFrame, tables: StageTables, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that are similar enough, from the texts of the nodes that are in a pair."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = tables.keep(docs.select("node", "text").join(nodes.hint("shuffle_hash"), "node", "left_semi"), name + "-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    found = tables.keep(both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long"), name)
    tables.drop(texts)
    tables.rest()
    return found


def _pivot_pairs(posts: DataFrame, fingerprint_links: Callable, tables: StageTables) -> DataFrame:
    """``(a, b)``: nodes whose fingerprints are equal or linked by the pivot tables, as lines to each one's least node."""
    fps = tables.keep(posts.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "jaccard-fps")
    links = fingerprint_links(fps.select("fp"), tables)
    ends = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    apart = links.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    same = posts.join(fps.filter("n > 1"), "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(same)


def framed(docs: DataFrame, wide: DataFrame, tables: StageTables) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` that are certain, and postings ``(gram, n, at, node, d)`` that propose all others.

    ``wide(gram, node)`` are the members of wide buckets; links of two members of one bucket are meant.
    """
    least = wide.groupBy("gram").agg(F.min("node").alias("a"))
    lines = wide.join(least, "gram").select("a", F.col("node").alias("b")).distinct()
    classes = tables.keep(components(docs.sparkSession, lines, tables).withColumnRenamed("label", "class"), "jaccard-classes")
    texts = tables.keep(docs.select("node", "text").join(classes.hint("shuffle_hash"), "node").select("node", "class", "text"), "jaccard-class-texts")
    counts = texts.mapInArrow(_class_grams, "class long, gram long, c long").groupBy("class", "gram").agg(F.sum("c").alias("c"))
    sizes = classes.groupBy("class").agg(F.count("*").alias("size"))
    most = counts.filter(2 * F.col("c") > WIDE).join(sizes, "class").filter(2 * F.col("c") > F.col("size"))
    frames = tables.keep(most.groupBy("class").agg(F.collect_list("gram").alias("frame")), "jaccard-frames")
    kind = "node long, class long, n int, d int, gram long"
    apart = tables.keep(texts.join(frames, "class", "left").select("node", "class", "text", "frame").mapInArrow(_differences, kind), "jaccard-differences")
    excess = 9 * F.col("d") - F.col("n")
    nodes = apart.filter("gram IS NULL")
    hubs = tables.keep(nodes.groupBy("class").agg(F.min(F.struct(excess.alias("excess"), "node")).alias("hub")), "jaccard-hubs")
    h = F.col("hub.excess")
    certain = nodes.join(hubs, "class").filter((excess + h <= 0) & (F.col("node") != F.col("hub.node"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    certain = tables.keep(certain, "jaccard-certain")
    # Differences of one node come first and meet nothing, so only their number counts.
    often = apart.filter("gram IS NOT NULL").groupBy("class", "gram").agg(F.count("*").alias("c")).filter("c > 1")
    by = Window.partitionBy("node")
    held = apart.join(often, ["class", "gram"]).withColumns({"rank": F.row_number().over(by.orderBy("c", "gram")), "held": F.count("*").over(by)})
    held = held.withColumn("at", (F.col("d") - F.col("held") + F.col("rank") - 1).cast("int")).join(hubs, "class")
    # The least excess of a node that may still be linked to this one: those of the hub's lines meet only others.
    other = F.when(excess + h <= 0, 1 - h).otherwise(h)
    posts = held.filter(18 * (F.col("d") - F.col("at")) >= excess + other)
    posts = tables.keep(posts.select(F.xxhash64("class", "gram").alias("gram"), "n", "at", "node", "d"), "jaccard-framed")
    tables.drop(classes, texts, frames, apart, hubs)
    tables.rest()
    return certain, posts


def labelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    return posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def open_buckets(posts: DataFrame, labels: DataFrame, tables: StageTables) -> DataFrame:
    """The postings of buckets that hold unlike labels, with ``label`` and the bucket's size ``c``."""
    posts = labelled(posts, labels)
    sizes = posts.groupBy("gram").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return tables.keep(posts.join(tables.keep(sizes.select("gram", "c"), "jaccard-open"), "gram"), "jaccard-dealt")


def links(docs: DataFrame, signed: DataFrame, fingerprint_links: Callable, tables: StageTables, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: links that keep every component of the graph of pairs at 0.8, and the components' ``(node, label)``.

    ``docs(node, text)`` are all rows, ``signed(node, n, fp, first)`` those that take part; ``source``, the stage table
    that they come from, goes as soon as it has been used.
    """
    spark = docs.sparkSession
    posts = signed.select("node", "n", F.posexplode("first").alias("at", "gram"))
    by = Window.partitionBy("gram").orderBy("n", "node")
    seen = posts.withColumns({"prev": F.lag(F.struct("node", "n", "at")).over(by), "later": F.lead("node").over(by)})
    shared = tables.keep(seen.filter("prev IS NOT NULL OR later IS NOT NULL").drop("later"), "jaccard-shared")
    tables.rest()
    p = F.col("prev")
    near = shared.filter(p.isNotNull() & possible(p["n"], p["at"], F.col("n"), F.col("at")))
    near = near.select(F.least("node", p["node"]).alias("a"), F.greatest("node", p["node"]).alias("b"))
    near = tables.keep(near.unionByName(_pivot_pairs(signed.select("node", "fp"), fingerprint_links, tables)).distinct(), "jaccard-near")
    tables.drop(source)
    tables.rest()
    edges = _check(near, docs, tables, "jaccard-links")
    labels = tables.keep(components(spark, edges, tables), "jaccard-labels")
    posts = open_buckets(shared.select("gram", "n", "at", "node", F.col("n").alias("d")), labels, tables)
    tables.drop(shared)
    dealt, before = posts.filter(F.col("c") <= WIDE), None
    while members := posts.filter(F.col("c") > WIDE).select("node").distinct().count():
        wide = posts.filter(F.col("c") > WIDE)
        if before and members > LEFT * before:
            dealt = dealt.unionByName(wide)
            break
        certain, found = framed(docs, wide.select("gram", "node"), tables)
        edges, before = edges.unionByName(certain), members
        labels = tables.keep(components(spark, edges, tables), "jaccard-labels")
        posts = open_buckets(found, labels, tables)
        tables.drop(found)
        dealt = dealt.unionByName(posts.filter(F.col("c") <= WIDE))
    if before:
        dealt = labelled(dealt.drop("label"), labels)
    dealt = dealt.select("gram", "n", "at", "node", "label", "d").repartition("gram").sortWithinPartitions("gram", "label")
    rest = tables.keep(dealt.mapInArrow(_pair_batches, "a long, b long").distinct().join(near, ["a", "b"], "left_anti"), "jaccard-rest")
    tables.drop(near)
    tables.rest()
    more = _check(rest, docs, tables, "jaccard-more")
    edges = edges.unionByName(more)
    if not more.isEmpty():
        labels = tables.keep(components(spark, edges, tables), "jaccard-labels")
    return edges, labels


def kept_rows(docs: DataFrame, id_col: str, text_col: str, fingerprint_links: Callable, common: int = COMMON) -> DataFrame:
    """The rows of ``docs`` that ``simhash.deduplicate`` keeps.

    A row's node is a hash of its file and its place in it, so rows are not written again if they are a file scan. Two
    rows with one node (a chance of 10^-7 for 10^6 rows) are refused.
    """
    tables = StageTables(docs.sparkSession)
    names = docs.columns
    if not bare_scan(docs):
        docs = tables.keep(docs, "jaccard-docs")
    place = docs.metadataColumn("_metadata")
    rows = docs.withColumn("__node", F.xxhash64(place["file_path"], place["row_index"]))
    texts = rows.select(F.col("__node").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    late, rank = common_shingles(texts, common)
    key = F.struct(F.col(id_col).alias("id"), F.col("__node").alias("node")).alias("key")
    kind = rows.select(key).schema["key"].dataType.simpleString()
    narrow = rows.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = tables.keep(narrow.mapInArrow(_signatures(late, rank), f"key {kind}, d1 long, d2 long, n int, fp long, first array<long>").withColumn("node", F.col("key.node")), "jaccard-signed")
    least = tables.keep(signed.groupBy("d1", "d2").agg(F.min("key").alias("key"), F.count("*").alias("n")), "jaccard-distinct")
    total, nodes = least.agg(F.sum("n")).first()[0] or 0, signed.select("node").distinct().count()
    if total != nodes:
        raise ValueError("two rows have one number: write the table in other files")
    one = signed.join(least.select(F.col("key.node").alias("node")).hint("shuffle_hash"), "node", "left_semi")
    _, labels = links(texts, one, fingerprint_links, tables, signed)
    known = least.select("key", F.col("key.node").alias("node")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stay = tables.keep(known.groupBy("label").agg(F.min("key").alias("key")).select(F.col("key.node").alias("__stays")), "jaccard-stay")
    tables.drop(least)
    tables.rest()
    return rows.join(stay.hint("shuffle_hash"), F.col("__node") == F.col("__stays"), "left_semi").select(*names)
