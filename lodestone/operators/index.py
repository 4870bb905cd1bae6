"""Chunks and the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

CHUNK_CHARS, CHUNK_SHIFT, BUCKETS = 800, 1 << 20, 64
_CHUNK = "struct<text:string,size:int,lines:int,marks:array<struct<offset:int,line:int>>>"


def chunk_lines(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Trimmed lines without blank ones, joined until they hold ``limit`` characters; marks give each line's offset."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("text"), (i + 1).alias("line")))
    kept = F.filter(lines, lambda x: x["text"] != "")
    zero = F.struct(F.array().cast(f"array<{_CHUNK}>").alias("done"), F.lit(None).cast(_CHUNK).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["open"]
        mark = lambda at: F.array(F.struct(at.cast("int").alias("offset"), x["line"].cast("int").alias("line")))
        size = F.coalesce(now["size"], F.lit(0)) + F.length(x["text"])
        grown = F.struct(
            F.when(now.isNull(), x["text"]).otherwise(F.concat(now["text"], F.lit("\n"), x["text"])).alias("text"),
            size.cast("int").alias("size"),
            (F.coalesce(now["lines"], F.lit(0)) + 1).cast("int").alias("lines"),
            F.when(now.isNull(), mark(F.lit(0))).otherwise(F.concat(now["marks"], mark(now["size"] + now["lines"]))).alias("marks"),
        )
        full = size >= limit
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"),
            F.when(~full, grown).alias("open"),
        )

    return F.aggregate(kept, zero, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunks(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """``(chunk_id, file_id, chunk_no, text, marks)``; a chunk's id tells its file by arithmetic.

    A file of more than CHUNK_SHIFT chunks (some 800 MB of text) is refused, as its ids would run into the next file's.
    """
    out = files.select(F.col(id_col).alias("file_id"), F.posexplode(chunk_lines(F.col(text_col))).alias("chunk_no", "c"))
    return out.select(chunk_id().alias("chunk_id"), "file_id", F.col("chunk_no").cast("int").alias("chunk_no"), "c.text", "c.marks")


def chunk_id() -> Column:
    """The id of a chunk, from ``file_id`` and ``chunk_no``."""
    whole = F.col("file_id") * CHUNK_SHIFT + F.col("chunk_no")
    return F.when(F.col("chunk_no") < CHUNK_SHIFT, whole).otherwise(F.raise_error(F.lit("a file has too many chunks")).cast("long"))


def postings(chunk_table: DataFrame, fold: bool = True, with_readings: bool = False) -> DataFrame:
    """``(tok, chunk_id, file_id, pos)``. Reading tokens follow after a gap, so no phrase crosses into them."""
    text = t.index_form(F.col("text")) if fold else t.normalize(F.col("text"))
    keyed = chunk_table.select("chunk_id", "file_id", text.alias("__t"))
    out = keyed.select("chunk_id", "file_id", F.posexplode(t.tokens(F.col("__t"))).alias("pos", "tok"))
    if with_readings:
        read = keyed.select("chunk_id", "file_id", F.size(t.tokens(F.col("__t"))).alias("n"), F.posexplode(t.readings(F.col("__t"))).alias("k", "r"))
        more = read.select("chunk_id", "file_id", (F.col("n") * (F.col("k") + 1) + 10 * (F.col("k") + 1)).alias("base"), F.posexplode(t.tokens(F.col("r"))).alias("p", "tok"))
        out = out.unionByName(more.select("chunk_id", "file_id", (F.col("base") + F.col("p")).alias("pos"), "tok"))
    return out.select("tok", "chunk_id", "file_id", F.col("pos").cast("int").alias("pos"))


def char_postings(chunk_table: DataFrame) -> DataFrame:
    """``(ch, chunk_id, file_id)`` for the distinct CJK characters of each chunk, readings included."""
    text = t.normalize(F.col("text"))
    every = F.array_union(t.cjk_chars(text), F.flatten(F.transform(t.readings(text), t.cjk_chars)))
    return chunk_table.select(F.explode(every).alias("ch"), "chunk_id", "file_id")


def loose_postings(chunk_table: DataFrame, is_ocr: Column) -> DataFrame:
    """Postings of vowel-folded tokens, for chunks that come from OCR only."""
    loose = chunk_table.filter(is_ocr).withColumn("text", t.loose_text(t.normalize(F.col("text"))))
    return postings(loose, fold=False)


def vocabulary(posting_table: DataFrame) -> DataFrame:
    """``(tok, doc)``: the number of chunks that hold a token, from postings."""
    return posting_table.select("tok", "chunk_id").distinct().groupBy("tok").agg(F.count("*").alias("doc"))


def chunk_vocabulary(chunk_table: DataFrame) -> DataFrame:
    """The same from chunks: a chunk is one row, so its tokens are made distinct in it and only counts are shuffled."""
    each = chunk_table.select(F.explode(F.array_distinct(t.tokens(t.index_form(F.col("text"))))).alias("tok"))
    return each.groupBy("tok").agg(F.count("*").alias("doc"))


def token_bucket(tok: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(buckets)).cast("int")


def write_index(posting_table: DataFrame, path: str, buckets: int = BUCKETS, parts: int = 16) -> None:
    """Postings by token bucket and sorted in it, so that a term reads one bucket and few row groups.

    Each bucket is dealt into ``parts`` by file, so a common word's postings are no single task's.
    """
    bucketed = posting_table.withColumn("tok_bucket", token_bucket(F.col("tok"), buckets))
    salted = bucketed.withColumn("__part", F.pmod(F.xxhash64("file_id"), F.lit(parts)))
    sorted_rows = salted.repartition("tok_bucket", "__part").sortWithinPartitions("tok_bucket", "tok", "chunk_id", "pos").drop("__part")
    sorted_rows.write.mode("overwrite").partitionBy("tok_bucket").parquet(path)


def replace_files(table: DataFrame, saved: DataFrame, key: str = "file_id") -> DataFrame:
    """A table with the rows of some files replaced: anti-join and append."""
    return table.join(saved.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(saved.select(*table.columns))


def chunk_bounds(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.groupBy("file_id").agg(F.min("chunk_id").alias("min_chunk"), F.max("chunk_id").alias("max_chunk"))


def first_per_file(rows: DataFrame, most: int = 3, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The lowest chunk ids of each file (and term)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))
    return rows.withColumn("rn", place).filter(F.col("rn") <= most)
