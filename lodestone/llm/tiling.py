"""Benchmark decontamination by greedy string tiling.

Tests and texts become sequences of words, lower-cased and without punctuation around them. A text and a test that
share a seed (``MIN_MATCH`` words in a row, joined by hash) are compared by running Karp-Rabin greedy string tiling:
hashes of unmarked windows find the longest matches that overlap no marked word, these are marked as tiles, and the
search goes on, until no window of MIN_MATCH words is left. As tiles may come in any order, a text that holds a test's
passages rearranged is caught too. A test is contaminated by a text whose tiles cover at least ``COVERAGE`` of its words.

Hashes are sums of words times powers modulo 2^64, so the hash of any window comes from two running sums and a search
length costs one pass over arrays, whatever repeats; the longest length is found by bisection. A text whose seeds lie in
too few of a test's words is not tiled, as no tiling could cover more.

Tests are read in blocks of at most BLOCK_WORDS words; a block's words and seeds are what is broadcast, so their size
is bounded. Further blocks mean further passes over the texts. A test that alone exceeds the bound is its own block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_MATCH, COVERAGE, BLOCK_WORDS = 4, 0.6, 1_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space, without punctuation at their edges; what is only punctuation goes."""
    return [w for w in (_EDGES.sub("", x) for x in (text or "").lower().split()) if w]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` ids, modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + ids[k : k + n].astype(np.uint64)
    return out


class _Side:
    """The words of one side, their running sums and their marks."""

    def __init__(self, ids: list[int] | np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        n = len(self.ids)
        with np.errstate(over="ignore"):
            mixed = (self.ids.astype(np.uint64) + np.uint64(1)) * _BASE
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))])
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), _BASE)])[:n]
            self.sums = np.r_[np.uint64(0), np.cumsum(mixed * powers, dtype=np.uint64)]
        self.marked = np.zeros(n, bool)

    def longest(self) -> int:
        """The length of the longest stretch without a mark."""
        ends = np.nonzero(np.r_[True, self.marked, True])[0]
        return int(np.diff(ends).max()) - 1

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the windows without a mark, and their hashes."""
        taken = np.r_[0, np.cumsum(self.marked)]
        free = np.nonzero(taken[width:] == taken[: len(taken) - width])[0] if width < len(taken) else np.zeros(0, np.int64)
        return free, (self.sums[free + width] - self.sums[free]) * self.inverse[free]


def tiles(text: list[int], test: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in text, start in test, length)``, none overlapping.

    The next tile is always the longest match of words without a mark; of several the first in the text, then in the
    test. All tiles of one length are marked in one round as long as that order allows it.
    """
    a, b = _Side(text), _Side(test)
    out: list[tuple[int, int, int]] = []
    most = min(len(a.ids), len(b.ids))
    while True:
        low, high, found = min_match - 1, min(most, a.longest(), b.longest()), None
        while low < high:
            width = (low + high + 1) // 2
            (at_a, hash_a), (at_b, hash_b) = a.windows(width), b.windows(width)
            kinds, first = np.unique(hash_b, return_index=True)
            place = np.minimum(np.searchsorted(kinds, hash_a), len(kinds) - 1)
            same = kinds[place] == hash_a if len(kinds) else np.zeros(len(hash_a), bool)
            if same.any():
                low, found = width, (at_a[same], at_b[first[place[same]]])
            else:
                high = width - 1
        if found is None:
            return out
        most, until = low, 0
        for i, j in zip(*(x.tolist() for x in found)):
            if i < until:
                continue
            if b.marked[j : j + low].any():
                break  # these words may stand elsewhere in the test, too
            if (a.ids[i : i + low] != b.ids[j : j + low]).any():
                raise ValueError("two windows share a hash")
            a.marked[i : i + low] = b.marked[j : j + low] = True
            out.append((i, j, low))
            until = i + low


class Block:
    """Some tests, with the hash of every seed."""

    def __init__(self, tests: list[tuple[int, str]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in tests]
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)] for _, t in tests]
        # A test shorter than a seed cannot be found by one, and is matched whole by ``short``.
        seeds = defaultdict(set)
        for k, s in enumerate(self.sequences):
            width = min(min_match, len(s))
            if width:
                for h in window_hashes(np.array(s, np.int64), width).tolist():
                    seeds[width, h].add(k)
        self.widths = sorted({w for w, _ in seeds})
        self.seeds = {w: {h: sorted(v) for (x, h), v in seeds.items() if x == w} for w in self.widths}
        self.sorted = {w: np.array(sorted(self.seeds[w]), np.uint64) for w in self.widths}
        self.raw: dict[str, int] = {}

    def lookup(self, word: str) -> int:
        """The id of a raw word (0: in no test), kept for the words seen of late."""
        found = self.raw.get(word)
        if found is None:
            found = self.vocabulary.get(w, 0) if (w := _EDGES.sub("", word.lower())) else -1
            if len(self.raw) > 500_000:
                self.raw.clear()
            self.raw[word] = found
        return found

    def near(self, text: str) -> dict[int, tuple[list[int], np.ndarray]]:
        """For each test that shares a seed: the text's ids around the seeds, and nothing else of the text.

        Words of no test only break matches, so runs of them shrink to one before anything is compared.
        """
        get, raw = self.raw.get, text.split()
        ids = np.array([self.lookup(w) if (f := get(w)) is None else f for w in raw], np.int64)
        ids = ids[ids >= 0]
        if not len(ids):
            return {}
        keep = (ids > 0) | np.r_[True, ids[:-1] > 0]
        ids = ids[keep]
        out: dict[int, None] = {}
        for width in self.widths:
            if len(ids) < width:
                continue
            hashes = window_hashes(ids, width)
            full = np.convolve(ids > 0, np.ones(width, int), "valid") == width
            hashes = np.unique(hashes[full])
            place = np.minimum(np.searchsorted(self.sorted[width], hashes), len(self.sorted[width]) - 1)
            for h in hashes[self.sorted[width][place] == hashes].tolist():
                out.update(dict.fromkeys(self.seeds[width][h]))
        return {k: ids for k in out}

    def judge(self, text: str, coverage: float = 0.0) -> list[tuple[int, int, int, int]]:
        """``(test, covered words, test's words, tiles)`` of the tests whose words the text's tiles cover so far."""
        out = []
        for k, ids in self.near(text).items():
            test = np.array(self.sequences[k], np.int64)
            least = min(self.min_match, len(test))
            inside = np.isin(ids, test)
            own = np.where(inside, ids, 0)[inside | np.r_[True, inside[:-1]]]
            seeds, hashes = window_hashes(test, least), window_hashes(own, least)
            if self._covered(np.isin(seeds, hashes), least, len(test)).sum() < coverage * len(test):
                continue
            # Only the words in some seed count; a run of others becomes one word that is in no test.
            held = self._covered(np.isin(hashes, seeds), least, len(own))
            found = tiles(np.where(held, own, 0)[held | np.r_[False, held[:-1]]], test, least)
            covered = sum(x[2] for x in found)
            if covered >= coverage * len(test):
                out.append((k, covered, len(test), len(found)))
        return out

    @staticmethod
    def _covered(hit: np.ndarray, width: int, size: int) -> np.ndarray:
        """The words that lie in a window that was hit."""
        inside = np.zeros(size, bool)
        for k in range(width):
            inside[k : k + len(hit)] |= hit
        return inside


def blocks(tests: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The tests in blocks of at most BLOCK_WORDS words; the driver holds one block at a time."""
    block, held = [], 0
    for row in tests.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).orderBy(id_col, text_col).toLocalIterator():
        size = len(row[1].split())
        if block and held + size > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    coverage: float = COVERAGE,
    min_match: int = MIN_MATCH,
    out_col: str = "leaks",
    return_text: bool = True,
) -> DataFrame:
    """``docs`` with ``out_col``: an array of ``(item_id, covered, words, tiles)``, by item, of the tests whose words
    this text's tiles cover to at least ``coverage``.

    Null and empty texts leak nothing, and tests without a word are in no text. A test of fewer than ``min_match`` words
    must occur whole. Long texts are worked on whole, in time about proportional to their length. Rows, repeated rows and other columns are kept; an existing column ``out_col`` is replaced.
    Without tests every array is empty. ``return_text=False`` leaves ``text_col`` null, so that no text comes back
    from Python.
    """
    spark, docs = docs.sparkSession, docs.drop(out_col)
    item = tests.schema[test_id].dataType
    item_kind = pa.string() if isinstance(item, T.StringType) else pa.int64()
    item = item if isinstance(item, T.StringType) else T.LongType()
    kind = T.ArrayType(T.StructType([T.StructField("item_id", item), T.StructField("covered", T.LongType()), T.StructField("words", T.LongType()), T.StructField("tiles", T.LongType())]))
    out = docs.withColumn(out_col, F.array().cast(kind))
    waiting = blocks(tests, test_id, test_text)
    block = next(waiting, None)
    while block is not None:
        after = next(waiting, None)
        blank = after is None and not return_text
        shared = spark.sparkContext.broadcast(Block(block, min_match))
        names = out.columns
        place = names.index(text_col)
        typed = pa.list_(pa.struct([("item_id", item_kind), ("covered", pa.int64()), ("words", pa.int64()), ("tiles", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place, names=names, typed=typed, blank=blank) -> Iterator[pa.RecordBatch]:
            tests_here = shared.value
            for batch in batches:
                found, at = [], 0
                while at < batch.num_rows:
                    for text in batch.column(place).slice(at, 512).to_pylist():
                        hits = tests_here.judge(text, coverage) if text else []
                        found.append([{"item_id": tests_here.ids[k], "covered": c, "words": n, "tiles": t} for k, c, n, t in sorted(hits)])
                    at += 512
                back = [pa.nulls(batch.num_rows, c.type) if blank and k == place else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*back, pa.array(found, typed)], [*names, "__more"])

        schema = out.withColumn("__more", F.col(out_col)).schema
        out = out.mapInArrow(run, schema).withColumn(out_col, F.concat(out_col, "__more")).drop("__more")
        block = after
    return out


def op6_query(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), return_text=False)
    hits = found.select("doc_id", F.explode("leaks").alias("x"))
    return hits.select("doc_id", "x.item_id", "x.covered", "x.words", "x.tiles", (F.col("x.covered") / F.col("x.words")).alias("coverage"))
