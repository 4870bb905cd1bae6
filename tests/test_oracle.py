import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.sources import fixtures

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "part", "conversations", "events", "pages", "customer", "lineitem")


def rows(found):
    return sorted(tuple(str(v) for _, v in sorted(r.items())) for r in found)


@pytest.mark.parametrize("name", [*fixtures.oracle_sql(), "source_mail", "source_all", "churn_filter", "token_df", "fuzzy_name", "watch_stream", "phrase_match", "phrase_prefix", "content_and", "combined_search"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = [r.asDict() for r in entry.queries()[name](spark, SMALL).collect()]
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert rows(got) == rows(dict(zip(names, r)) for r in cursor.fetchall()) and got
