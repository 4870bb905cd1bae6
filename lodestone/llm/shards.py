"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts are tokenized and packed, end of text after each, into sequences of ``length`` ids. Sequences are numbered by
input split (two passes: the first only counts, so that neither texts nor ids are shuffled for the numbering). A keyed
Feistel permutation of [0, n) with cycle-walking then gives every sequence its global slot; no order is stored or
sorted globally, and anybody who has the key and n can compute it, or invert it. Ranges of slots are shards, and ranges
of shards are the partitions that write them. A record has a fixed stride, so a reader resumes at slot s by a seek to
``(s % slots_per_shard) * stride``.

Record: first document's id (int64) and ``length`` ids (uint16), little-endian, filled up with PAD.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import StageTables, bare_scan, fresh_path
from .warc import _filesystem

LENGTH, SLOTS_PER_SHARD, KEY, ROUNDS = 512, 16384, 0x5EED, 6
PAD = 0xFFFF
NO_ID = -(1 << 63)
#: Partitions that write shards at most; beyond it a partition writes several shards, one after the other.
MOST_PARTS = 100_000
#: Offsets of input splits lie in so many files; a task reads the files of its own splits.
BUCKETS = 256
#: Fixed value: the pre-splitting of byte-level BPE, but that a row of white space is one piece (see TextEncoder).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of SplitMix64, keyed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key)]


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of ``index`` under the keyed permutation of [0, n); ``inverse`` gives the indexes of slots.

    A balanced Feistel network permutes the least even number of bits that hold n; a result outside [0, n) goes through
    it again, which ends after fewer than four turns on average.
    """
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return left << shift | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class TextEncoder:
    """Ids of whole texts, without an end, as the library's byte-level BPE gives them.

    The usual pattern looks ahead, to leave the last of several white-space characters to the word that follows. That
    costs a third of the time, and a long row of blanks overflows the stack. Here texts are cut before that character,
    if there are such places at all, and the pattern needs no look-ahead.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.run = tiktoken.Encoding("shards", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.end = max(ranks.values()) + 1
        self.cut = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if text.isascii() and not any(x in text for x in ("  ", "\n", "\r", "\t", "\v", "\f")):
            return self.run(text)
        parts = self.cut.split(text)
        return self.run(text) if len(parts) == 1 else [x for p in parts for x in self.run(p)]


_ENCODERS: dict = {}


def _encoder(shared) -> TextEncoder:
    """The encoder of a broadcast vocabulary, once for each Python worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(shared.value)
    return _ENCODERS[key]


def share_ranks(spark: SparkSession, path: str):
    """Broadcast a file of ranks (base64 and number on each line); its size is bounded by the vocabulary."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) + 1 >= PAD:
        raise ValueError("ids must fit in 16 bits")
    return spark.sparkContext.broadcast(ranks)


def _streams(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[int, list[int | None], list[list[int]]]]:
    """``(split, ids of documents, their token ids without the end)`` for slices of about 1 MB."""
    encode = _encoder(shared).encode
    for batch in batches:
        n, at = batch.num_rows, 0
        each = max(1, min(1024, n * 1_000_000 // max(1, batch.column(2).nbytes)))
        while at < n:
            splits, docs, texts = (batch.column(k).slice(at, each).to_pylist() for k in range(3))
            bounds = [0, *(i for i in range(1, len(splits)) if splits[i] != splits[i - 1]), len(splits)]
            for a, b in zip(bounds, bounds[1:]):
                yield splits[a], docs[a:b], [encode(t) for t in texts[a:b]]
            at += each


def _offsets(counted: DataFrame, tables: StageTables) -> tuple[str, int]:
    """The folder of ``(split, at)`` by bucket, where ``at`` is the number of sequences in the splits before, and the
    number of all sequences. The driver sees a row for each bucket."""
    keyed = counted.withColumn("bucket", F.pmod("split", F.lit(BUCKETS)).cast("int"))
    sums = sorted(map(tuple, keyed.groupBy("bucket").agg(F.sum("n")).collect()))
    base, total = {}, 0
    for bucket, n in sums:
        base[bucket], total = total, total + n
    if not total:
        return "", 0
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.get(F.array(*[F.lit(base.get(k, 0)).cast("long") for k in range(BUCKETS)]), F.col("bucket"))
    folder = fresh_path(tables.spark, "shards-offsets")
    keyed.select("split", (start + before).alias("at"), "bucket").write.partitionBy("bucket").parquet(folder)
    return folder, total


def _offset(folder: str, split: int, known: dict[int, dict[int, int]]) -> int:
    bucket = split % BUCKETS
    if bucket not in known:
        system, root = _filesystem(folder)
        table = pads.dataset(f"{root}/bucket={bucket}", filesystem=system, format="parquet").to_table()
        known[bucket] = dict(zip(table["split"].to_pylist(), table["at"].to_pylist()))
    return known[bucket][split]


def write_shards(
    docs: DataFrame,
    shared,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    slots_per_shard: int = SLOTS_PER_SHARD,
    key: int = KEY,
) -> DataFrame:
    """Writes all shards and returns the manifest ``(shard, path, first_slot, n_slots, stride, sha256)``.

    Null and empty texts give their end only; rows may repeat, and long texts are worked on one at a time, whatever is
    in them. Other columns are not read. Both passes must see the same input splits, so anything but a plain file scan is
    written first; if a file changed in between, the second pass raises. A task writes shards under names of its own and
    the manifest is committed by Spark, so a lost executor's files are never read. An empty table gives no shard.
    """
    spark = docs.sparkSession
    tables = StageTables(spark)
    docs = docs.select(id_col, text_col)
    if not bare_scan(docs):
        docs = tables.keep(docs, "shards-docs")
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.input_file_block_length())
    source = docs.select(split.alias("split"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for s, _, ids in _streams(batches, shared):
            totals[s] = totals.get(s, 0) + sum(map(len, ids)) + len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["split", "n"])

    counted = tables.keep(source.mapInArrow(count, "split long, n long").groupBy("split").agg(F.sum("n").alias("n")), "shards-counts")
    offsets, total = _offsets(counted.select("split", F.ceil(F.col("n") / F.lit(length)).alias("n")), tables)
    if not total:
        return spark.createDataFrame([], "shard long, path string, first_slot long, n_slots long, stride long, sha256 string")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, rest, owners, known = None, 0, np.zeros(0, np.uint16), [], {}

        def cut(final: bool) -> pa.RecordBatch | None:
            nonlocal index, rest, owners
            whole = -(-len(rest) // length) if final else len(rest) // length
            if not whole:
                return None
            data = np.full(whole * length, PAD, np.uint16)
            used = min(len(rest), whole * length)
            data[:used] = rest[:used]
            ends = np.cumsum([n for _, n in owners])
            first = [owners[k][0] for k in np.searchsorted(ends, np.arange(whole) * length, side="right").tolist()]
            slots = permute(np.arange(index, index + whole), total, key)
            rows = data.reshape(whole, length)
            place = int(np.searchsorted(ends, used, side="right"))
            owners = [] if used == len(rest) else [(owners[place][0], int(ends[place]) - used), *owners[place + 1 :]]
            rest, index = rest[used:], index + whole
            return pa.RecordBatch.from_arrays([pa.array(slots // slots_per_shard), pa.array(slots), pa.array([NO_ID if d is None else d for d in first], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["shard", "slot", "doc_id", "ids"])

        end = _encoder(shared).end
        for s, docs_here, ids in _streams(batches, shared):
            if s != now:
                if now is not None and (out := cut(True)):
                    yield out
                now, index = s, _offset(offsets, s, known)
            owners += [(d, len(x) + 1) for d, x in zip(docs_here, ids)]
            fresh = array("H")
            for x in ids:
                fresh.extend(x)
                fresh.append(end)
            rest = np.concatenate([rest, np.frombuffer(fresh, np.uint16)])
            if out := cut(False):
                yield out
        if now is not None and (out := cut(True)):
            yield out

    stride = 8 + 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        shard, sink, path, first, n, sha = None, None, "", 0, 0, None

        def close() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "first_slot": [first], "n_slots": [n], "stride": [stride], "sha256": [sha.hexdigest()]})

        for batch in batches:
            shards, slots, owners = (batch.column(k).to_numpy() for k in range(3))
            for i in range(batch.num_rows):
                if shards[i] != shard:
                    if sink is not None:
                        yield close()
                    shard, first, n, sha = int(shards[i]), int(slots[i]), 0, hashlib.sha256()
                    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                    sink = system.open_output_stream(path, compression=None)
                if slots[i] != first + n:
                    raise ValueError("a slot is missing or taken twice: the input changed between two reads")
                record = int(owners[i]).to_bytes(8, "little", signed=True) + batch.column(3)[i].as_py()
                sha.update(record)
                sink.write(record)
                n += 1
        if sink is not None:
            yield close()

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    shards = -(-total // slots_per_shard)
    parts = min(shards, MOST_PARTS)
    dealt = source.mapInArrow(sequences, "shard long, slot long, doc_id long, ids binary")
    dealt = dealt.repartitionById(parts, F.floor(F.col("shard") * F.lit(parts) / F.lit(shards)).cast("int")).sortWithinPartitions("slot")
    schema = "shard long, path string, first_slot long, n_slots long, stride long, sha256 string"
    dealt.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    if manifest.agg(F.sum("n_slots")).first()[0] != total:
        raise ValueError("slots are missing: the input changed between two reads")
    return manifest


def read_slots(system, path: str, first_slot: int, stride: int, start: int = 0, most: int | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """``(slot, first document, ids)`` of a shard from slot ``start`` on: one seek, then sequential reads."""
    with system.open_input_file(path) as f:
        slot = max(start, first_slot)
        f.seek((slot - first_slot) * stride)
        while (most is None or most > 0) and len(data := f.read(stride)) == stride:
            ids = np.frombuffer(data, "<u2", offset=8)
            owner = int.from_bytes(data[:8], "little", signed=True)
            yield slot, None if owner == NO_ID else owner, ids[: len(ids) - int((ids[::-1] != PAD).argmax()) if (ids != PAD).any() else 0]
            slot, most = slot + 1, None if most is None else most - 1


def read_shards(manifest: DataFrame, folder: str, start: int = 0) -> DataFrame:
    """``(slot, shard, byte_offset, doc_id, ids)`` of all records from slot ``start`` on, a task for a few shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        names = ["slot", "shard", "byte_offset", "doc_id", "ids"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*[pa.int64()] * 4, pa.binary()])], names)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for slot, owner, ids in read_slots(system, row["path"], row["first_slot"], row["stride"], start):
                    rows.append((slot, row["shard"], (slot - row["first_slot"]) * row["stride"], owner, ids.tobytes()))
                    if len(rows) == 2048:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    wanted = manifest.filter(F.col("first_slot") + F.col("n_slots") > start).select("shard", "path", "first_slot", "stride")
    return wanted.repartition(max(1, wanted.count())).mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, ids binary")


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Every slot as read back: its shard, place, first document, number of ids and their digest."""
    import public_tokenizers

    shared = share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fresh_path(spark, "shards")
    back = read_shards(write_shards(docs, shared, folder), folder)
    return back.select("slot", "shard", "byte_offset", "doc_id", F.floor(F.octet_length("ids") / 2).cast("int").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
