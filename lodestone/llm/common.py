"""Helpers shared by the training-data operators: stage tables, key mixing and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges whose components the driver finds (3.2 MB); more go through the star steps.
FEW_EDGES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    Only a local session (tests) may leave it unset; a cluster session without it is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a stage table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def bare_scan(df: DataFrame) -> bool:
    """Whether ``df`` is one file scan with projections and filters only, so that a row's input split is known.

    After an exchange, a union, a join or a cached step the name of a row's file is gone, or rows of one split lie in
    several tasks.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" or str(node.nodeName()).startswith("Relation")


class StageTables:
    """Writes intermediate results to the shared folder, so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.written: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.written.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete_path(self.spark, df._stage_path)

    def drop_others(self, *frames: DataFrame) -> None:
        """Remove all tables written so far but those given, which nothing but tables may come from any more."""
        stay = {df._stage_path for df in frames}
        for path in self.written:
            if path not in stay:
                delete_path(self.spark, path)
        self.written = sorted(stay)
        self.rest()

    def rest(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished steps now, not when the driver's heap fills up."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the least node that each reaches. Each round at least halves what is left to join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, x, y = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        x, y = parent[x], parent[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[parent]


def components(spark: SparkSession, edges: DataFrame, tables: StageTables, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, label)`` for each node, label = least node.

    At most ``few`` edges are joined on the driver, whose memory for them is bounded by that. More take alternating
    large-star and small-star steps. Every step is a minimum for each node (combined map-side) that is written out, then
    joined back on the node; both sides of that join are plain exchanges, so that adaptive execution can split the rows
    of a hub. No task sees a whole component.
    """

    def star(pairs: DataFrame, large: bool, name: str) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = tables.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name + "-min")
        joined = both.join(least, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
            out = out.unionByName(least.filter(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
        kept = tables.keep(out.filter(F.col("a") != F.col("b")).distinct(), name)
        tables.drop(least)
        return kept

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        return tuple(row)

    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc")
    seen = state(now)
    if 0 < seen[0] <= few:
        pairs = now.toArrow()
        found = least_reachable(pairs["a"].to_numpy(), pairs["b"].to_numpy())
        tables.drop(now)
        return tables.keep(spark.createDataFrame(pa.table(dict(zip(("node", "label"), map(pa.array, found))))).coalesce(1), "cc-found")
    while seen[0]:
        large = star(now, True, "cc-large")
        small = star(large, False, "cc-small")
        tables.drop(large, now)
        now, before = small, seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
