"""Substring dedup by content-defined chunking.

A gear hash of 32 bits rolls over each text's UTF-8 bytes, so it depends on the WINDOW bytes before a place. A chunk
ends where the hash is the least of the REACH_CUT places on either side, at least MIN_BYTES after the last end, and
MAX_BYTES after it where no such place comes. Ends depend on the bytes around them only, so an insertion shifts nothing
beyond the next end or two, and two ends are never far apart in prose. Chunks are compared by a 128-bit digest: the
least document that holds a digest keeps it.

Chunks lose both ends of a passage, so each shared run of chunks grows byte by byte against its keeper's text, up to
REACH bytes on both sides (a chunk is no longer than that), then back to the nearest end of a word, if there is one.
Only then are runs joined, and those of at least MIN_WORDS words reported, or of MIN_RUN bytes, for scripts without
spaces. What the keeper holds of a reported run is reported there as kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import StageTables, let

WINDOW, REACH_CUT, MIN_BYTES, MAX_BYTES = 32, 32, 24, 256
MIN_WORDS, MIN_RUN, REACH = 50, 600, 256
STEP_BYTES, STEP_PLACES = 1_000_000, 8192
#: The gear of each byte: XXH32 of the byte with a fixed seed; byte 0 is neutral.
GEAR = np.array([0] + [xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(1, 256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FAR = np.uint32(0xFFFFFFFF)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte; sums of doubling width give all windows at once."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of the places i to i + span - 1, for every i that has so many after it."""
    width = 1
    while width < span:
        step = min(width, span - width)
        h, width = np.minimum(h[:-step], h[step:]), width + step
    return h


def cut_candidates(data: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
    """Ends (exclusive) whose hash is the least around; places that ``outside`` marks take no part."""
    h = rolling(data)
    if outside is not None:
        h[outside] = _FAR
    edge = np.full(REACH_CUT, _FAR)
    around = _least(np.concatenate([edge, h, edge]), 2 * REACH_CUT + 1)
    ends = np.nonzero((h == around) & (h != _FAR))[0] + 1
    inner = ends[ends < len(data)]
    return inner[(data[inner] & 0xC0) != 0x80]  # not inside a character


def chunk_ends(data: np.ndarray, candidates: list[int]) -> list[int]:
    """The ends of a text's chunks, from the candidates in it (both from its start)."""
    size, ends, start = len(data), [], 0
    for c in candidates:
        while c - start > MAX_BYTES:
            start = _boundary(data, start + MAX_BYTES)
            ends.append(start)
        if c - start >= MIN_BYTES:
            ends.append(c)
            start = c
    while size - start > MAX_BYTES:
        start = _boundary(data, start + MAX_BYTES)
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


def _boundary(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_texts(texts: list[bytes]) -> Iterator[list[int]]:
    """The chunk ends of each text; texts are hashed together, with neutral bytes between them."""
    gap = bytes(max(WINDOW, REACH_CUT))
    data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
    outside = np.ones(len(data), bool)
    at = len(gap)
    for t in texts:
        outside[at : at + len(t)] = False
        at += len(t) + len(gap)
    found, at = cut_candidates(data, outside), len(gap)
    for t in texts:
        lo, hi = np.searchsorted(found, [at, at + len(t)], side="right")
        inside = found[lo:hi] - at
        yield chunk_ends(data[at : at + len(t)], inside[inside < len(t)].tolist())
        at += len(t) + len(gap)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc, start, stop, d1, d2)``: the chunks of each text in bytes, and their digests.

    ``doc`` is a hash of id and text, so rows with equal id and text are one document. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, 0
            each = max(1, min(4096, n * STEP_BYTES // max(1, batch.column(2).nbytes)))
            while at < n:
                texts = batch.column(2).slice(at, each).to_pylist()
                rows, starts, stops, digests = [], [], [], []
                for i, (t, ends) in enumerate(zip(texts, chunk_texts(texts))):
                    begins = [0, *ends[:-1]][: len(ends)]
                    rows += [at + i] * len(ends)
                    starts += begins
                    stops += ends
                    digests += [xxhash.xxh3_128_digest(t[a:b]) for a, b in zip(begins, ends)]
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                    ["doc_id", "doc", "start", "stop", "d1", "d2"],
                )
                at += each

    kind = docs.schema[id_col].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, doc long, start int, stop int, d1 long, d2 long")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("doc"), text.alias("data"))


NEAR = ["w0", "w1", "left", "right"]


def _contexts(kind: str):
    """Rows (doc_id, doc, data, own, kept) become a row for each place: the words before its start and its stop, and
    the bytes before and after it. ``own`` are the document's runs, ``kept`` the places where it is a keeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = batch.column(2)[k].as_py()
                space = _SPACE[np.frombuffer(t, np.uint8)]
                words = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]])] if t else np.zeros(1, np.int64)
                for flag in (0, 1):
                    places = batch.column(3 + flag).slice(k, 1).flatten()
                    for at in range(0, len(places), STEP_PLACES):
                        part = places.slice(at, STEP_PLACES)
                        start, stop = part.field("start"), part.field("stop")
                        lo, hi = start.to_numpy(), stop.to_numpy()
                        n, take = len(part), pa.array(np.full(len(part), k))
                        other = [part.field(c) for c in ("k_id", "k", "kstart", "kstop")] if not flag else [pa.nulls(n, c.type) for c in (batch.column(0), batch.column(1), start, start)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, bool(flag))), batch.column(0).take(take), batch.column(1).take(take), start, stop, *other,
                                pa.array(words[lo].astype(np.int32)), pa.array(words[hi].astype(np.int32)),
                                pa.array([t[max(0, x - REACH - 1) : x] for x in lo.tolist()], pa.binary()), pa.array([t[x - 1 : x + REACH + 1] for x in hi.tolist()], pa.binary()),
                            ],
                            ["kept", "doc_id", "doc", "start", "stop", "k_id", "k", "kstart", "kstop", *NEAR],
                        )

    schema = f"kept boolean, doc_id {kind}, doc long, start int, stop int, k_id {kind}, k long, kstart int, kstop int, w0 int, w1 int, left binary, right binary"
    return run, schema


def _square(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of REACH + 1 bytes, zero after their ends, and their lengths."""
    size = np.array([len(x) for x in column], np.int64)
    return np.frombuffer(b"".join(x.ljust(REACH + 1, b"\0") for x in column), np.uint8).reshape(-1, REACH + 1), size


def growth(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of the bytes that follow runs in two texts belong to them: equal ones, back to where a word ends in
    both, or to the last whole character where the equal bytes hold no end of a word. Also the first text's bytes.

    A text that ends within REACH bytes ends a word.
    """
    (x, nx), (y, ny) = _square(a), _square(b)
    rows, place = len(x), np.arange(REACH + 1)
    equal = (x == y) & (place < np.minimum(np.minimum(nx, ny), REACH)[:, None])
    same = np.where(equal.all(axis=1), REACH, np.argmin(equal, axis=1))
    ends = lambda t, n: _SPACE[t] & (place < n[:, None]) | (place == n[:, None])
    both = ends(x, nx) & ends(y, ny) & (place <= same[:, None])
    last = REACH - np.argmax(both[:, ::-1], axis=1)
    spaced = (_SPACE[x] & (place < same[:, None])).any(axis=1)
    inside = lambda t, n, at: (at < n) & (t[np.arange(rows), np.minimum(at, REACH)] & 0xC0 == 0x80)
    whole = same.copy()
    for _ in range(4):
        whole -= (whole > 0) & (inside(x, nx, whole) | inside(y, ny, whole))
    return np.where(both.any(axis=1), last, np.where(spaced, 0, whole)), x, nx


def growth_back(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the bytes before runs, which come reversed, from the start backwards."""
    (x, nx), (y, ny) = _square(a), _square(b)
    rows, place = len(x), np.arange(REACH + 1)
    equal = (x == y) & (place < np.minimum(np.minimum(nx, ny), REACH)[:, None])
    same = np.where(equal.all(axis=1), REACH, np.argmin(equal, axis=1))
    begins = lambda t, n: _SPACE[t] & (place < n[:, None]) | (place == n[:, None])
    both = begins(x, nx) & begins(y, ny) & (place <= same[:, None])
    last = REACH - np.argmax(both[:, ::-1], axis=1)
    spaced = (_SPACE[x] & (place < same[:, None])).any(axis=1)
    whole = same.copy()
    for _ in range(4):  # the first byte of what comes with a run starts a character
        whole -= (whole > 0) & (x[np.arange(rows), np.maximum(whole - 1, 0)] & 0xC0 == 0x80)
    return np.where(both.any(axis=1), last, np.where(spaced, 0, whole)), x, nx


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (8 columns of both places, w0, w1, la, ra, lb, rb): the places grown, with words before start and stop."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            n = batch.num_rows
            la, ra, lb, rb = (batch.column(k).to_pylist() for k in (10, 11, 12, 13))
            back, x, size = growth_back([t[::-1] for t in la], [t[::-1] for t in lb])
            place = np.arange(REACH + 1)
            space = _SPACE[x] | (place >= size[:, None])
            begins = ~space[:, :-1] & space[:, 1:]  # a word begins at this byte: the one before it is a space, or none
            w0 = batch.column(8).to_numpy() - (begins & (place[:-1] < back[:, None])).sum(axis=1)
            on, x, size = growth([t[1:] for t in ra], [t[1:] for t in rb])
            space = _SPACE[x]
            before = np.c_[_SPACE[np.frombuffer(b"".join(t[:1] for t in ra), np.uint8)], space[:, :-1]]
            w1 = batch.column(9).to_numpy() + (~space & before & (place < on[:, None])).sum(axis=1)
            move = lambda k, by: pa.array((batch.column(k).to_numpy() + by).astype(np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), move(2, -back), move(3, on), batch.column(4), batch.column(5), move(6, -back), move(7, on), pa.array(w0.astype(np.int32)), pa.array(w1.astype(np.int32))],
                ["doc_id", "doc", "start", "stop", "k_id", "k", "kstart", "kstop", "w0", "w1"],
            )


def joined(spans: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Overlapping and touching spans ``(start, stop, words before start, words before stop)`` as one."""
    out: list[list[int]] = []
    for a, b, v, w in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, w
        else:
            out.append([a, b, v, w])
    return [tuple(x) for x in out]


def _reported(min_words: int, min_run: int):
    """Rows (doc_id, doc, runs): the joined runs that are long enough, and the keepers' places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                runs = batch.column(2).slice(k, 1).flatten()
                start, stop, w0, w1 = (runs.field(c).to_numpy() for c in ("start", "stop", "w0", "w1"))
                gone = [x for x in joined(list(zip(start.tolist(), stop.tolist(), w0.tolist(), w1.tolist()))) if x[3] - x[2] >= min_words or x[1] - x[0] >= min_run]
                if not gone:
                    continue
                first = np.array([x[0] for x in gone])
                spot = np.searchsorted(first, start, side="right") - 1
                held = (spot >= 0) & (start < np.array([x[1] for x in gone])[np.maximum(spot, 0)])
                kept, n = runs.filter(pa.array(held)), len(gone)
                take = pa.array(np.full(n, k))
                columns = [(batch.column(0).take(take), kept.field("k_id")), (batch.column(1).take(take), kept.field("k")), (pa.array(first, pa.int32()), kept.field("kstart")), (pa.array([x[1] for x in gone], pa.int32()), kept.field("kstop"))]
                yield pa.RecordBatch.from_arrays([*[pa.concat_arrays([x, y]) for x, y in columns], pa.array([False] * n + [True] * len(kept))], ["doc_id", "doc", "start", "stop", "kept"])

    return run


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, doc, spans): the runs that go, and what is kept outside them."""
    for batch in batches:
        rows, starts, stops, flags = [], [], [], []
        for k, spans in enumerate(batch.column(2).to_pylist()):
            gone = joined([(x["start"], x["stop"], 0, 0) for x in spans if not x["kept"]])
            out, cuts = [(a, b, False) for a, b, *_ in gone], iter([*[x[:2] for x in gone], (1 << 31, 1 << 31)])
            cut = next(cuts)
            for a, b, *_ in joined([(x["start"], x["stop"], 0, 0) for x in spans if x["kept"]]):
                while cut[1] <= a:
                    cut = next(cuts)
                while cut[0] < b and a < b:
                    out.append((a, cut[0], True))
                    a = max(a, cut[1])
                    if a < b:
                        cut = next(cuts)
                out.append((a, b, True))
            out = [x for x in out if not x[2] or x[1] - x[0] >= MIN_BYTES]
            rows += [k] * len(out)
            for made, place in ((starts, 0), (stops, 1), (flags, 2)):
                made += [x[place] for x in out]
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(flags, pa.bool_())], ["doc_id", "doc", "start", "stop", "kept"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN, inside: bool = False) -> DataFrame:
    """``(doc_id, doc, start, stop, kept)``: runs of at least ``min_words`` words, or ``min_run`` bytes, that other
    documents hold too; with ``inside``, also those that one document holds twice.

    ``kept`` is true if this document is the least that holds the run's parts (by id, then by hash; a null id comes
    first). Bytes that a lesser document keeps are in no kept run. Offsets are bytes. Null and empty texts hold no run;
    rows with equal id and text are one document, and an empty table gives no row. A document's runs are grouped in one
    task, which its length bounds; digests and keepers' places that many documents share are combined map-side, and
    the joins back are of plain exchanges. Other columns are not read.
    """
    tables = StageTables(docs.sparkSession)
    table = tables.keep(chunks(docs, id_col, text_col), "cdc-chunks")
    digest, kind = ["d1", "d2"], docs.schema[id_col].dataType.simpleString()
    place = F.xxhash64("doc", "start") if inside else F.col("doc")
    held = table.groupBy(*digest).agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select(*digest)
    held = tables.keep(held, "cdc-shared")  # both sides of the join are then plain exchanges, and a hot digest is split
    hits = hits_kept = tables.keep(table.join(held.hint("shuffle_hash"), digest, "left_semi"), "cdc-hits")
    tables.drop(table, held)
    first = tables.keep(hits.groupBy(*digest).agg(F.min(F.struct("doc_id", "doc", "start")).alias("f")), "cdc-first")
    away = F.col("f.doc") != F.col("doc")
    if inside:
        away = away | (F.col("f.start") != F.col("start"))
    hits = hits.join(first, digest).filter(away).select("doc_id", "doc", "start", "stop", F.col("f.doc_id").alias("k_id"), F.col("f.doc").alias("k"), (F.col("start") - F.col("f.start")).alias("shift"))
    line = Window.partitionBy("doc_id", "doc").orderBy("start", "stop")
    before = lambda c: F.lag(c).over(line)
    touches = (before("stop") == F.col("start")) | (before("start") == F.col("start"))  # the latter: a row that repeats
    goes_on = touches & (before("k") == F.col("k")) & (before("shift") == F.col("shift"))
    runs = hits.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "doc", "run").agg(F.first("k_id").alias("k_id"), F.first("k").alias("k"), F.first("shift").alias("shift"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = tables.keep(runs.select("doc_id", "doc", "start", "stop", "k_id", "k", (F.col("start") - F.col("shift")).alias("kstart"), (F.col("stop") - F.col("shift")).alias("kstop")).distinct(), "cdc-runs")
    tables.drop(first)
    own = runs.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("start", "stop", "k_id", "k", "kstart", "kstop")).alias("own"))
    keeps = runs.select(F.col("k_id").alias("doc_id"), F.col("k").alias("doc"), F.col("kstart").alias("start"), F.col("kstop").alias("stop")).distinct()
    keeps = keeps.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("start", "stop")).alias("kept"))
    asked = tables.keep(_outer(own, keeps), "cdc-asked")
    run, schema = _contexts(kind)
    texts = _narrow(docs, id_col, text_col)
    near = texts.join(asked, texts["doc"].eqNullSafe(asked["doc"]) & texts["doc_id"].eqNullSafe(asked["doc_id"])).select(texts["doc_id"], texts["doc"], "data", "own", "kept")
    near = tables.keep(near.mapInArrow(run, schema), "cdc-near")
    keeper = near.filter("kept").select(F.col("doc_id").alias("i"), F.col("doc").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"), F.col("left").alias("lb"), F.col("right").alias("rb"))
    keeper = keeper.dropDuplicates(["i", "d", "s", "e"])
    same = F.col("k_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("d")) & (F.col("kstart") == F.col("s")) & (F.col("kstop") == F.col("e"))
    ends = near.filter("NOT kept").join(keeper, same).select("doc_id", "doc", "start", "stop", "k_id", "k", "kstart", "kstop", "w0", "w1", F.col("left").alias("la"), F.col("right").alias("ra"), "lb", "rb")
    grown = tables.keep(ends.mapInArrow(_grown, f"doc_id {kind}, doc long, start int, stop int, k_id {kind}, k long, kstart int, kstop int, w0 int, w1 int"), "cdc-grown")
    tables.drop(near, asked, runs, hits_kept)
    each = grown.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("start", "stop", "w0", "w1", "k_id", "k", "kstart", "kstop")).alias("runs"))
    spans = f"doc_id {kind}, doc long, start int, stop int, kept boolean"
    found = tables.keep(each.mapInArrow(_reported(min_words, min_run), spans).distinct(), "cdc-found")
    tables.drop(grown)
    both = found.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("start", "stop", "kept")).alias("spans"))
    return both.mapInArrow(_parted, spans)


def _outer(own: DataFrame, keeps: DataFrame) -> DataFrame:
    """``(doc_id, doc, own, kept)`` of all documents that have either; what one lacks is empty."""
    rows = own.withColumn("kept", F.lit(None).cast(keeps.schema["kept"].dataType)).unionByName(keeps.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    none = lambda c, kind: F.coalesce(F.first(c, ignorenulls=True), F.array().cast(kind)).alias(c)
    return rows.groupBy("doc_id", "doc").agg(none("own", own.schema["own"].dataType), none("kept", keeps.schema["kept"].dataType))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN, inside: bool = False) -> DataFrame:
    """``docs`` with every run that another document keeps cut out of its text; rows and other columns stay."""
    found = repeats(docs, id_col, text_col, min_words, min_run, inside).filter("NOT kept")
    cuts = found.groupBy(F.col("doc").alias("__doc")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__cuts"))
    cuts = StageTables(docs.sparkSession).keep(cuts, "cdc-cuts")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumn("__doc", F.xxhash64(F.col(id_col), data)).join(cuts, "__doc", "left")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__cuts", i - 1)["stop"])
    parts = lambda d: F.transform("__cuts", lambda c, i: F.substring(d, start(i) + 1, c["start"] - start(i)).cast("string"))
    tail = lambda d: F.substring(d, F.element_at("__cuts", -1)["stop"] + 1, F.octet_length(d)).cast("string")
    text = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(let(data, lambda d: F.concat(F.array_join(parts(d), ""), tail(d))))
    return keyed.withColumn(text_col, text).select(*docs.columns)


def op7_query(spark, sf_dir: str) -> DataFrame:
    """The documents with a repeated run: how many, their bytes, and the bytes that another document keeps."""
    runs = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size = (F.col("stop") - F.col("start")).cast("long")
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop"))), lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    out = runs.groupBy("doc_id", "doc").agg(F.count("*").alias("n_runs"), F.sum(size).alias("repeated_bytes"), F.sum(F.when(F.col("kept"), 0).otherwise(size)).cast("long").alias("removed_bytes"), spans.alias("spans"))
    return out.drop("doc")
