"""Following a stream of touched paths in bounded micro-batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.catalog import compact_log


def state_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder, or in a temporary one where none is set (local sessions only)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{shared.rstrip('/')}/watch-{uuid.uuid4().hex}"


def classify(changes: DataFrame, exists: str, excluded: str = "false") -> DataFrame:
    """Touched paths as ``added`` (still there) or ``removed``; excluded ones are dropped."""
    return changes.filter(f"NOT ({excluded})").withColumn("op", F.when(F.expr(exists), F.lit("added")).otherwise(F.lit("removed")))


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The finished versions of the state table in a folder, by the number of their batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    done = [n for n in names if n.startswith("state-") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return {int(n.split("-")[1]): f"{folder}/{n}" for n in done}


def follow(stream: DataFrame, folder: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Runs a stream of ``(path, op, seq)`` and returns the log's last operation of each path.

    Each micro-batch merges into the state table by writing its next version, named by the batch's number. What came
    before is found on disk, as the newest finished version of a smaller number: a stream that starts again in the same
    folder goes on from there, and a batch that is tried again never reads its own half. Versions older than
    the one before are deleted. ``trigger`` defaults to what is available now; use ``{"processingTime": "3 seconds"}`` for a running watch.
    """
    spark = stream.sparkSession
    folder = folder or state_folder(spark)

    def merge(batch: DataFrame, number: int) -> None:
        known = versions(spark, folder)
        before = [k for k in known if k < number]
        now = batch.unionByName(spark.read.schema(batch.schema).parquet(known[max(before)])) if before else batch
        compact_log(now).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/state-{number}")
        for k in sorted(before)[:-1]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known[k])
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    run.awaitTermination()
    known = versions(spark, folder)
    return spark.read.schema(stream.schema).parquet(known[max(known)]) if known else spark.createDataFrame([], stream.schema)
