"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunkdedup, hamming, quality, secrets, shards, simhash, tiling, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_query,
        "op2_shards": shards.op2_query,
        "op3_warc": warc.op3_query,
        "op4_hamming": hamming.op4_query,
        "op5_simhash": simhash.op5_query,
        "op6_tiling": tiling.op6_query,
        "op7_chunkdedup": chunkdedup.op7_query,
        "op8_urlfilter": urlfilter.op8_query,
        "op9_secrets": secrets.op9_query,
        "op10_quality": quality.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.OP3_SQL,
        "op4_hamming": hamming.OP4_SQL,
        "op8_urlfilter": urlfilter.OP8_SQL,
        "op9_secrets": secrets.OP9_SQL,
    }
