"""Crawls folders into entries, level by level: every level's folders are listed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.catalog import not_excluded

ENTRY = "name string, path string, kind string, extension string, mtime long, size long, error string"
#: Folders that one task lists at least.
FOLDERS_A_TASK = 16


def _local(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path) of folders become a row for each file and folder in them; one that can't be read, a row with an error."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            prefix = folder[: folder.index("://") + 3] if "://" in folder else ""
            rows = []
            try:
                system, place = _local(folder)
                for x in system.get_file_info(fs.FileSelector(place)):
                    if x.type not in (fs.FileType.File, fs.FileType.Directory):
                        continue
                    kind = "file" if x.type == fs.FileType.File else "folder"
                    stem, dot, ext = x.base_name.rpartition(".")
                    path = prefix + x.path if not prefix or x.path.startswith("/") else f"{folder.rstrip('/')}/{x.base_name}"
                    rows.append((x.base_name, path, kind, ext.lower() if stem and kind == "file" else "", (x.mtime_ns or 0) // 1_000_000, x.size if kind == "file" else None, None))
            except OSError as e:
                rows = [(folder.rsplit("/", 1)[-1], folder, "unreadable", "", 0, None, f"{type(e).__name__}: {e}"[:300])]
            types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def list_folders(folders: DataFrame) -> DataFrame:
    """Entries of the folders ``(path)``, a row each, and a row of kind ``unreadable`` for a folder that fails."""
    return folders.select("path").mapInArrow(_listed, ENTRY)


def crawl(spark: SparkSession, roots: list[str], excluded: list[str], stage: str) -> tuple[DataFrame, DataFrame]:
    """``(entries, errors)`` of all files and folders below the roots; links are not followed.

    Each level is written below ``stage``, so the work is one job for each level of depth, whatever its width. Roots
    inside other roots are listed once.
    """
    whole = [r.rstrip("/") or "/" for r in dict.fromkeys(roots)]
    tops = [r for r in whole if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in whole)]
    frontier, levels = spark.createDataFrame([(r,) for r in tops], "path string"), []
    while True:
        n = frontier.count()
        if not n:
            break
        wide = frontier.repartition(max(1, min(n // FOLDERS_A_TASK + 1, 4 * spark.sparkContext.defaultParallelism)))
        found = list_folders(wide).filter(not_excluded(F.col("path"), F.col("name"), excluded))
        place = f"{stage}/level-{len(levels)}"
        found.write.mode("overwrite").parquet(place)
        levels.append(place)
        frontier = spark.read.schema(ENTRY).parquet(place).filter("kind = 'folder'").select("path")
    rows = spark.read.schema(ENTRY).parquet(*levels) if levels else spark.createDataFrame([], ENTRY)
    return rows.filter("kind <> 'unreadable'").drop("error"), rows.filter("kind = 'unreadable'").select("path", F.col("error").alias("message"))
