"""The engine: a stored index over crawled folders, and searches in it.

A version of the index is a folder of tables (``entries``, ``errors``, ``files``, ``chunks``, ``postings``, ``chars``,
``loose``, ``vocab``, ``meta``); ``meta`` is written last, so readers take the newest finished version and a rebuild never
disturbs them. Searches read stored postings by token bucket; nothing is tokenized at query time but the query.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import query as q
from lodestone.functions import text as t
from lodestone.operators import catalog as cat
from lodestone.operators import fuzzy, index, mail, match, rank, snippet
from lodestone.sources import extract, listing

#: Versions of the tokenizer, and of the extractors by extension where it isn't 1.
TOKENIZER, EXTRACTORS = 5, {"pdf": 2, "hwpx": 2, "hwp": 2}
TABLES = ("entries", "errors", "files", "chunks", "postings", "chars", "loose", "vocab", "meta")
MAILS = "path string, account string, folder string, uid long, subject string, sender string, recipients string, sent_at string"
FILE_BUCKETS = 256


@dataclass
class Found:
    """``items`` in their order with snippets, and the number of all matches of each source."""

    items: DataFrame
    totals: dict[str, int]


def extractor_version(extension: Column) -> Column:
    return reduce(lambda c, kv: F.when(extension == kv[0], F.lit(kv[1])).otherwise(c), EXTRACTORS.items(), F.lit(1))


def numbered(paths: DataFrame, first: int) -> DataFrame:
    """``paths(path, …)`` with ``file_id`` from ``first`` on: by a hash's bucket, then by path; a sum for each bucket
    goes through the driver."""
    keyed = paths.withColumn("__b", F.pmod(F.xxhash64("path"), F.lit(FILE_BUCKETS)).cast("int"))
    base, at = {}, first
    for b, n in sorted(map(tuple, keyed.groupBy("__b").count().collect())):
        base[b], at = at, at + n
    start = F.get(F.array(*[F.lit(base.get(b, 0)).cast("long") for b in range(FILE_BUCKETS)]), F.col("__b"))
    return keyed.withColumn("file_id", start + F.row_number().over(Window.partitionBy("__b").orderBy("path")) - 1).drop("__b")


class Engine:
    """``folder`` is shared by driver and executors and holds all versions of the index and the mail table."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str] = (), excluded: list[str] = ()):
        self.spark, self.folder, self.roots, self.excluded = spark, folder.rstrip("/"), list(dict.fromkeys(roots)), list(excluded)

    # -- versions ---------------------------------------------------------------------------------------------------

    def _path(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The finished versions."""
        system, path = self._path(self.folder)
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(self._path(f"{self.folder}/{n}/meta/_SUCCESS")[1]))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.versions()[-1] if version is None else version}/{name}")

    def _next(self) -> str:
        """The place of the next version; what an unfinished one has left there goes."""
        place = f"{self.folder}/v{max(self.versions(), default=0) + 1}"
        system, path = self._path(place)
        system.delete(path, True)
        return place

    def _index(self, place: str, chunks: DataFrame) -> None:
        """Postings and what follows from them, of stored chunks."""
        index.write_index(index.postings(chunks, with_readings=True), f"{place}/postings")
        index.char_postings(chunks).write.parquet(f"{place}/chars")
        index.loose_postings(chunks, F.coalesce(F.col("location.ocr"), F.lit(False))).write.parquet(f"{place}/loose")
        index.vocabulary(self.spark.read.parquet(f"{place}/postings")).write.parquet(f"{place}/vocab")

    def _finish(self, place: str) -> None:
        self.spark.range(1).select(F.lit(TOKENIZER).alias("tokenizer"), F.current_timestamp().alias("indexed_at")).write.parquet(f"{place}/meta")
        for old in self.versions()[:-2]:
            system, path = self._path(f"{self.folder}/v{old}")
            system.delete(path, True)

    # -- building ---------------------------------------------------------------------------------------------------

    def rebuild(self) -> dict[str, int]:
        """Crawls all roots and takes over every file that hasn't changed; returns the summary."""
        return self._build(None)

    def catch_up(self) -> dict[str, int]:
        """The same after a cheap look: folders whose time is as stored are not listed again."""
        return self._build(self.versions()[-1] if self.versions() else None)

    def _listing(self, place: str, known: int | None) -> tuple[DataFrame, DataFrame]:
        if known is None:
            return listing.crawl(self.spark, self.roots, self.excluded, f"{place}/listing")
        old = self.read("entries", known)
        parent = cat.parent_of(F.col("path"))
        roots = self.spark.createDataFrame([(r.rstrip("/"),) for r in self.roots], "path string")
        folders = old.filter("kind = 'folder'").select("path", "mtime")
        above = folders.select(parent.alias("path")).unionByName(roots).distinct()
        seen = listing.list_folders(above.repartition(self.spark.sparkContext.defaultParallelism)).filter("kind = 'folder'")
        seen = seen.filter(cat.not_excluded(F.col("path"), F.col("name"), self.excluded)).select("path", F.col("mtime").alias("now"))
        state = folders.join(seen, "path", "full")
        changed = state.filter("now IS NOT NULL AND (mtime IS NULL OR mtime <> now)").select("path").unionByName(roots).distinct()
        changed.write.parquet(f"{place}/changed")
        changed = self.spark.read.parquet(f"{place}/changed")
        fresh, errors = listing.crawl(self.spark, [r[0] for r in state.filter("mtime IS NULL").select("path").toLocalIterator()], self.excluded, f"{place}/listing")
        again = listing.list_folders(changed.repartition(self.spark.sparkContext.defaultParallelism)).filter(cat.not_excluded(F.col("path"), F.col("name"), self.excluded))
        gone = state.filter("now IS NULL").select("path")
        kept = old.join(changed.withColumnRenamed("path", "__up"), parent == F.col("__up"), "left_anti")
        kept = kept.join(cat.subtree(kept, gone).select("path"), "path", "left_anti")
        rows = kept.unionByName(again.filter("kind <> 'unreadable'").select(*kept.columns)).unionByName(fresh.select(*kept.columns))
        return rows.dropDuplicates(["path"]), errors.unionByName(again.filter("kind = 'unreadable'").select("path", F.col("error").alias("message")))

    def _build(self, known: int | None) -> dict[str, int]:
        spark, place, before = self.spark, self._next(), self.versions()[-1:]
        entries, errors = self._listing(place, known)
        entries.write.parquet(f"{place}/entries")
        errors.write.parquet(f"{place}/errors")
        found = spark.read.parquet(f"{place}/entries").filter("kind = 'file'").filter(F.col("extension").isin(list(extract.FORMATS)))
        found = found.select("path", "size", F.col("mtime").alias("modified_at"), extractor_version(F.col("extension")).alias("wanted"))
        if before:
            old, old_chunks = self.read("files", before[0]), self.read("chunks", before[0])
            same = F.col("o.size").eqNullSafe(F.col("f.size")) & (F.col("o.modified_at") == F.col("f.modified_at")) & (F.col("o.extractor") >= F.col("f.wanted")) & (F.col("o.status") != "error")
            stays = old.alias("o").join(found.alias("f"), F.col("o.path") == F.col("f.path")).filter(same).select("o.*")
            stays.write.parquet(f"{place}/unchanged")
            stays = spark.read.parquet(f"{place}/unchanged")
            todo, first = found.join(stays.select("path"), "path", "left_anti"), (old.agg(F.max("file_id")).first()[0] or 0) + 1
        else:
            stays, old_chunks, todo, first = None, None, found, 1
        # Newest files first within a task, as a long run then serves what was changed of late.
        numbered(todo, first).orderBy(F.col("modified_at").desc()).write.parquet(f"{place}/todo")
        todo = spark.read.parquet(f"{place}/todo")
        extract.extract_paths(todo).write.parquet(f"{place}/extracted")
        rows = spark.read.parquet(f"{place}/extracted")
        state = rows.groupBy("path").agg(F.first("status").alias("status"), F.first("error").alias("error"))
        files = todo.join(state, "path").select("file_id", "path", "size", "modified_at", "status", "error", F.col("wanted").alias("extractor"))
        chunks = rows.filter("chunk_no IS NOT NULL").join(todo.select("path", "file_id"), "path")
        chunks = chunks.select(index.chunk_id().alias("chunk_id"), "file_id", "chunk_no", "location", "text", "marks")
        if stays is not None:
            files = files.unionByName(stays.select(*files.columns))
            chunks = chunks.unionByName(old_chunks.join(stays.select("file_id"), "file_id", "left_semi").select(*chunks.columns))
        files.write.parquet(f"{place}/files")
        chunks.write.parquet(f"{place}/chunks")
        self._index(place, spark.read.parquet(f"{place}/chunks"))
        for scratch in ("listing", "changed", "unchanged"):
            system, path = self._path(f"{place}/{scratch}")
            system.delete(path, True)
        total, extracted = found.count(), state.filter("status = 'done'").count()
        failed = state.filter("status = 'error'").count()
        self._finish(place)
        return {"total": total, "extracted": extracted, "skipped": total - extracted - failed, "errors": failed}

    def retokenize(self) -> bool:
        """New postings from stored chunks if they are of another tokenizer; no file is read again."""
        now = self.versions()[-1]
        if self.read("meta", now).first()["tokenizer"] == TOKENIZER:
            return False
        place = self._next()
        for name in ("entries", "errors", "files", "chunks"):
            self.read(name, now).write.parquet(f"{place}/{name}")
        self._index(place, self.spark.read.parquet(f"{place}/chunks"))
        self._finish(place)
        return True

    def stats(self) -> dict[str, int]:
        """Entries, chunks, and files by status."""
        by = {f"files_{r.status}": r.n for r in self.read("files").groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {"entries": self.read("entries").count(), "errors": self.read("errors").count(), "chunks": self.read("chunks").count()} | by

    # -- mail -------------------------------------------------------------------------------------------------------

    def mails(self) -> DataFrame:
        system, path = self._path(f"{self.folder}/mails/_SUCCESS")
        return self.spark.read.schema(MAILS).parquet(f"{self.folder}/mails") if system.exists(path) else self.spark.createDataFrame([], MAILS)

    def sync_mail(self, batch: DataFrame) -> None:
        """Stores a batch of mails; one with a path that is stored replaces it."""
        rows = index.replace_files(self.mails(), batch.select(*[c.split()[0] for c in MAILS.split(", ")]), "path")
        self._store_mails(rows)

    def remove_account(self, account: str) -> None:
        self._store_mails(mail.without_account(self.mails(), account))

    def _store_mails(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/mails-next")
        system, path = self._path(f"{self.folder}/mails")
        system.delete(path, True)
        system.rename(self._path(f"{self.folder}/mails-next")[1], path)

    def mail_folders(self) -> DataFrame:
        return mail.folder_counts(self.mails())

    # -- searching --------------------------------------------------------------------------------------------------

    def search(self, text: str, options: q.SearchOptions | None = None) -> Found:
        """Files, folders and mails that match every term in name, path or content, the first ``limit`` with snippets.

        With ``fuzzy``, contents are searched for typos too if fewer than WIDEN_BELOW rows match as typed.
        """
        options, version = options or q.SearchOptions(), self.versions()[-1]
        stored = {name: self.read(name, version) for name in ("postings", "chunks", "chars", "loose")}
        entries = cat.with_keys(self.read("entries", version).withColumn("time", F.col("mtime")))
        files = self.read("files", version).select("file_id", "path")
        mails = cat.with_keys(mail.entries(self.mails()).withColumn("time", F.unix_millis(F.to_timestamp("date"))))
        terms = list(dict.fromkeys(q.tokenize(text)))
        none = F.array().cast("array<string>")
        content = None
        if not options.names_only and terms:
            content = match.quick(stored, terms).join(files, "file_id").select("path", "terms", none.alias("fuzzy_terms"))
        exact = replace(options, fuzzy=False)
        shown, found = rank.search(entries, mails, text, exact, content)
        hits, totals = terms, self._totals(found)
        if options.fuzzy and sum(totals.values()) < q.WIDEN_BELOW:
            variants = {}
            if content is not None:
                vocab = self.read("vocab", version)
                rows = [fuzzy.search_content(self.spark, stored, vocab, x) for x in terms]
                near = reduce(lambda a, b: a.unionByName(b), rows).join(files, "file_id")
                variants = {r.variant: r.term for r in near.select("term", "variant").distinct().collect()}  # TYPO_VARIANTS a term
                near = near.groupBy("path").agg(F.collect_set("term").alias("terms"), none.alias("hits"))
                content = fuzzy.merge_matches(content.select("path", "terms", none.alias("hits")), near).select("path", "terms", "fuzzy_terms")
            hits = [*terms, *variants]
            shown, found = rank.search(entries, mails, text, options, content)
            totals = self._totals(found)
        items = shown.select("path", "name", "kind", "source", "score", "fuzzy", F.col("matched_in"), "time")
        if content is None:
            return Found(items.withColumn("hits", F.array().cast("array<struct<term:string,label:string,before:string,match:string,after:string>>")), totals)
        return Found(self._with_hits(items, files, stored, hits, options), totals)

    @staticmethod
    def _totals(found: list[DataFrame]) -> dict[str, int]:
        return {r.source: r.n for f in found for r in f.groupBy("source").agg(F.count("*").alias("n")).collect()}

    def _with_hits(self, items: DataFrame, files: DataFrame, stored: dict[str, DataFrame], terms: list[str], options: q.SearchOptions) -> DataFrame:
        """At most HITS_PER_FILE hits for each shown file; only the chunks of these are read."""
        shown = files.join(F.broadcast(items.select("path")), "path")  # LIMIT rows at most
        rows = index.first_per_file(match.hits(stored, terms, shown).groupBy("file_id", "chunk_id").agg(F.min("term").alias("term"))).drop("rn")
        rows = stored["chunks"].join(rows, ["chunk_id", "file_id"])
        made = F.lit(None).cast("struct<at:int,before:string,match:string,after:string>")
        for x in terms:
            if q.term_regex(x):
                made = F.when(F.col("term") == x, snippet.snippet(t.nfkc(F.col("text")), x)).otherwise(made)
        rows = rows.withColumn("s", made).withColumn("label", t.describe_location(t.resolve_location(F.col("marks"), F.coalesce("s.at", F.lit(0)))))
        hit = F.struct("chunk_id", "term", "label", "s.before", "s.match", "s.after")
        each = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(hit)).alias("h"))
        each = each.join(files, "file_id").select("path", F.transform("h", lambda x: x.dropFields("chunk_id")).alias("hits"))
        order = rank.by_relevance()[:2] if options.sort != "newest" else [F.col("fuzzy"), F.col("time").desc_nulls_last(), F.col("score").desc()]
        kind = each.schema["hits"].dataType
        return items.join(each, "path", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind))).orderBy(*order, F.lower("name"), "path")
