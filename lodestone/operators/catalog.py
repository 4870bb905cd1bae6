"""The name catalog: entries, filters, change logs, snapshot differences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import query as q
from lodestone.functions import text as t

ENTRY = "name string, path string, kind string, extension string, mtime long"
#: Folder names that a crawl leaves out, and volatile folders whose changes are not followed.
EXCLUDED_NAMES = ("$recycle.bin", "system volume information", "node_modules", ".git")
CHURN_NAMES = ("appdata", "$recycle.bin", "system volume information", "node_modules", ".git", ".cache", ".claude", ".vscode", ".gradle", "temp", "tmp")
CHURN_TOPS = ("windows", "program files", "program files (x86)", "programdata")
CHURN = r"(?i)[\\/](" + "|".join(map(re.escape, CHURN_NAMES)) + r")([\\/]|$)|^[a-z]:[\\/](" + "|".join(map(re.escape, CHURN_TOPS)) + r")([\\/]|$)"


def with_keys(entries: DataFrame) -> DataFrame:
    """Entries with the normalized keys that search uses, computed once at ingest."""
    named = entries.withColumn("name_norm", t.normalize(F.col("name")))
    return named.withColumns({"path_norm": t.comparable_path(F.col("path")), "name_compact": t.compact_name(F.col("name_norm"))})


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_scope(path_norm: Column, scopes: list[str]) -> Column:
    """The path is a scope or lies below one; an empty scope holds everything."""
    wanted = [q.comparable(s) for s in scopes]
    if not wanted or "" in wanted:
        return F.lit(True)
    return any_of([(path_norm == s) | F.startswith(path_norm, F.lit(s + "\\")) for s in wanted])


def matches_filters(options: q.SearchOptions) -> Column:
    """Scope, kind and extension filters over keyed entries."""
    out = in_scope(F.col("path_norm"), options.scopes)
    if options.kind in ("file", "folder"):
        out = out & (F.col("kind") == options.kind)
    wanted = q.normal_extensions(options.extensions)
    if wanted:
        out = out & (F.col("kind") == "file") & F.lower("extension").isin(wanted)
    return out


def not_excluded(path: Column, name: Column, excluded: list[str], names: tuple[str, ...] = EXCLUDED_NAMES, sep: str = "/") -> Column:
    """Neither a name that is left out nor an excluded folder or anything below it, whatever the case."""
    low = F.lower(path)
    below = [(low == p) | F.startswith(low, F.lit(p + sep)) for p in (x.lower().rstrip(sep) for x in excluded)]
    return ~F.lower(name).isin(list(names)) & ~any_of(below)


def is_churn(path: Column, roots: list[str]) -> Column:
    """In a volatile folder, unless a root that is itself inside one is the path or holds it."""
    chosen = [r.lower().rstrip("\\/") for r in roots if re.search(CHURN, r)]
    low = F.lower(path)
    held = [(low == r) | F.startswith(low, F.lit(r + "\\")) | F.startswith(low, F.lit(r + "/")) for r in chosen]
    return path.rlike(CHURN) & ~any_of(held)


def compact_log(changes: DataFrame) -> DataFrame:
    """The last operation of each path of a log ``(path, op, seq, …)``; combined map-side."""
    rest = [c for c in changes.columns if c != "path"]
    last = F.max_by(F.struct(*rest), F.col("seq"))
    return changes.groupBy("path").agg(last.alias("s")).select("path", *[F.col(f"s.{c}").alias(c) for c in rest])


def apply_delta(entries: DataFrame, delta: DataFrame) -> DataFrame:
    """Drops removed and re-added paths, then appends the added rows (those with the entry's columns)."""
    added = delta.filter("op = 'added'").select(*entries.columns)
    return entries.join(delta.select("path"), "path", "left_anti").select(*entries.columns).unionByName(added)


def parent_of(path: Column, sep: str = "/") -> Column:
    return F.regexp_replace(path, rf"[{sep}][^{sep}]*$", "")


def orphans(entries: DataFrame, roots: list[str], sep: str = "/") -> DataFrame:
    """Entries below a root whose parent is neither a root nor a listed folder."""
    low = entries.withColumn("__parent", F.lower(parent_of(F.col("path"), sep)))
    folders = entries.filter("kind = 'folder'").select(F.lower("path").alias("__parent")).distinct()
    below = any_of([F.startswith(F.lower("path"), F.lit(r.lower().rstrip(sep) + sep)) for r in roots])
    return low.filter(below & ~F.col("__parent").isin([r.lower() for r in roots])).join(folders, "__parent", "left_anti").drop("__parent")


def ancestors(path: Column, sep: str = "/") -> Column:
    """All proper prefixes of a path that end before a separator."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def subtree(entries: DataFrame, removed: DataFrame, sep: str = "/") -> DataFrame:
    """Entries that are a removed path or lie below one: an equi-join on ancestors, not on prefixes."""
    own = entries.select("*", F.explode(F.array_union(ancestors(F.col("path"), sep), F.array("path"))).alias("__up"))
    return own.join(removed.select(F.col("path").alias("__up")).distinct(), "__up", "left_semi").drop("__up").distinct()


def catch_up(old: DataFrame, new: DataFrame, sep: str = "/") -> DataFrame:
    """``(path, op)``: what a new listing adds or changes in kind or folder time, and removes with all below it.

    A path that is listed again is never removed.
    """
    a = old.select("path", F.struct("kind", F.when(F.col("kind") == "folder", F.col("mtime")).alias("mtime")).alias("a"))
    b = new.select("path", F.struct("kind", F.when(F.col("kind") == "folder", F.col("mtime")).alias("mtime")).alias("b"))
    both = a.join(b, "path", "full")
    added = both.filter("b IS NOT NULL AND (a IS NULL OR NOT a <=> b)").select("path", F.lit("added").alias("op"))
    gone = both.filter("b IS NULL").select("path")
    below = subtree(old, gone, sep).select("path").join(new.select("path"), "path", "left_anti")
    return added.unionByName(below.withColumn("op", F.lit("removed")))


def changed_files(files: DataFrame, found: DataFrame, extractor: int) -> DataFrame:
    """Paths of ``found(path, size, modified_at)`` to extract again: new, other size or time, older extractor, error."""
    known = files.select("path", F.col("size").alias("s"), F.col("modified_at").alias("m"), "status", F.col("extractor").alias("x"))
    same = (F.col("s") == F.col("size")) & (F.col("m") == F.col("modified_at")) & (F.col("x") >= extractor) & (F.col("status") != "error")
    return found.join(known, "path", "left").filter(~F.coalesce(same, F.lit(False))).select("path")


def vanished_files(files: DataFrame, found: DataFrame, owned: Column) -> DataFrame:
    """Owned files that the new listing lacks."""
    return files.filter(owned).join(found.select("path"), "path", "left_anti")
