"""URL filters, WARC, chunk dedup, shards and Hamming search on small tables."""

import fnmatch
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from lodestone.llm import chunkdedup, urlfilter, warc
from lodestone.llm.common import StageTables

URLS = [None, "", "no scheme", "http://NET/", "https://a.net", "http://x.example.net/en/q?a#b", "http://example.com/de/", "http://notexample.com/de/", "x://org/fr/", "http://a.org/fr", "http://e.com/.net/", "http://a.net:80/", "http://😀.net/é"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    want = dict.fromkeys(range(len(URLS)), (None, "allow"))
    want |= {3: ("net/", "block"), 5: ("example.net/en/", "allow"), 6: ("example.com/de/", "block"), 8: ("org/fr/", "allow"), 12: ("net/", "block")}
    assert got == want
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_globs_against_fnmatch():
    random.seed(4)
    pats = ["".join(random.choice("ab*?") for _ in range(random.randint(0, 9))) for _ in range(40)]
    auto = urlfilter.GlobAutomaton([[c if c in "*?" else ord(c) for c in p] for p in pats])
    assert auto.words > 1
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 10))) for _ in range(200)]
    fits = auto.run([np.array([ord(c) for c in t], np.int64) for t in texts])
    for i, t in enumerate(texts):
        assert fits[i].tolist() == [fnmatch.fnmatchcase(t, p) for p in pats]


def test_warc_round_trip(spark):
    big = "é" * 400_000
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, None), (4, "http://c", ""), (6, "x\r\ny", "short"), (7, "x", "short"), (8, "x", "WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    chunks = warc.archive_pages(pages)
    last = {r.page_id: r for r in chunks.filter("last").collect()}
    assert set(last) == {r[0] for r in rows}
    for i, _, html in rows:
        data = (html or "").encode()
        r = last[i]
        digest = r.declared_digest.removeprefix("sha1:") if r.record_type == "revisit" else r.payload_digest
        assert digest == hashlib.sha1(data).hexdigest() and r.declared_bytes == len(data)
        assert r.record_type == ("revisit" if i == 1 else "response")
    assert last[1].refers_to_page == 5 and last[5].chunk_no > 0
    parts = chunks.filter("page_id = 5").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in parts) == big.encode() and len(parts) > 1 and "data" in chunks.columns
    assert all(r.data is None for r in warc.archive_pages(pages, with_data=False).collect())
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_parse_is_chunked_and_strict():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    for raw in (record * 2, gzip.compress(record) * 2):
        rows = list(warc.parse(io.BytesIO(raw), 4))
        assert [len(r["data"]) for r in rows] == [4, 4, 2] * 2 and rows[2]["payload_digest"] == hashlib.sha1(b"0123456789").hexdigest()
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record[:-9])))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\n" + b"x" * 3_000_000)))


def test_chunks_resist_insertions():
    random.seed(6)
    text = bytes(random.choice(b"abcdefgh ") for _ in range(5000))

    def cut(t):
        ends = next(chunkdedup.chunk_texts([t]))
        return [t[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(text), cut(b"inserted words " + text)
    assert b"".join(a) == text and len(set(a) - set(b)) <= 3
    assert all(chunkdedup.MIN_BYTES <= len(c) <= chunkdedup.MAX_BYTES for c in a[:-1])
    both = list(chunkdedup.chunk_texts([text, b"", text[100:]]))
    assert both[0] == next(chunkdedup.chunk_texts([text])) and both[1] == []


def test_stage_tables(spark):
    t = StageTables(spark)
    kept = t.keep(spark.range(3), "x")
    assert kept.count() == 3
    t.drop(kept)
