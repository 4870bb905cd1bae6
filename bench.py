"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from lodestone.operators import index, match
from lodestone.plans import catalog
from lodestone.session import local_session

HEADLINE = ("name_search", "combined_search", "phrase_match", "content_and", "token_df", "chunk_lines", "snippets", "newest_sort", "catch_up_diff", "watch_stream")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="bench-")})
    done, queries = {}, catalog.queries()

    def timed(name: str, f) -> None:
        began = time.time()
        f().write.format("noop").mode("overwrite").save()
        done[name] = round(time.time() - began, 3)

    spark.range(1000).groupBy().count().collect()
    timed("name_search_cold", lambda: queries["name_search"](spark, sf_dir))  # with the start of Python workers
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir))
    # The index as the engine keeps it: written once by token bucket, then searched.
    place = tempfile.mkdtemp(prefix="bench-index-")
    began = time.time()
    chunks = index.chunks(catalog._files(spark, sf_dir))
    chunks.write.parquet(f"{place}/chunks")
    chunks = spark.read.parquet(f"{place}/chunks")
    index.write_index(index.postings(chunks), f"{place}/postings", parts=1)
    done["index_build"] = round(time.time() - began, 3)
    stored = {"postings": spark.read.parquet(f"{place}/postings"), "chunks": chunks}
    timed("warm_phrase", lambda: match.phrase(stored["postings"], ["of", "the"]))
    timed("warm_three_terms", lambda: match.quick(stored, ["with", "the", "that"]))
    print(json.dumps({"metric": "total", "value": round(sum(done.values()), 3), "unit": "sec", "queries": done, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
