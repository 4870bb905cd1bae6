import pytest
from pyspark.sql import functions as F

from lodestone.functions import query as q
from lodestone.functions import text as t
from lodestone.operators import catalog as cat
from lodestone.operators import fuzzy, index, mail, match, ocr, rank


def entries(spark, *rows):
    return cat.with_keys(spark.createDataFrame([(n, p, k, e, 0) for n, p, k, e in rows], cat.ENTRY))


def found(spark, rows, text, **options):
    o = q.SearchOptions(**options)
    return [r.path for r in rank.top(rank.scored(entries(spark, *rows), q.tokenize(text), o), o).collect()]


def test_tokens(spark):
    df = spark.createDataFrame([("서버구축 WEB01 10.0.3.21",), ("WEB01IP10.0.3.21",), ("web서버",)], "x string")
    got = [r[0] for r in df.select(t.tokens(t.normalize(F.col("x")))).collect()]
    assert got == [["서버", "버구", "구축", "web", "01", "10", "0", "3", "21"], ["web", "01", "ip", "10", "0", "3", "21"], ["web", "서버"]]


def test_scope_limit_and_order(spark):
    rows = [("a.txt", "D:\\업무\\a.txt", "file", "txt"), ("a.txt", "D:\\업무2\\a.txt", "file", "txt")]
    assert found(spark, rows, "a", scopes=["D:/업무/"]) == ["D:\\업무\\a.txt"]
    many = [(f"m{i:03d}.txt", f"D:\\x\\m{i:03d}.txt", "file", "txt") for i in range(250)]
    assert len(found(spark, many, "m")) == 200
    both = [("x", "D:\\server\\x", "file", ""), ("server", "D:\\z\\server", "file", ""), ("server plan", "D:\\q", "folder", "")]
    assert found(spark, both, "server")[0] == "D:\\z\\server"


def test_fuzzy_after_exact(spark):
    rows = [("report.doc", "a\\report.doc", "file", "doc"), ("reprot.doc", "a\\reprot.doc", "file", "doc"), ("보고", "a\\보고", "file", "")]
    assert found(spark, rows, "report", fuzzy=True) == ["a\\report.doc", "a\\reprot.doc"]
    assert found(spark, rows, "report") == ["a\\report.doc"]


def make_index(spark, *texts, is_ocr=()):
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    chunks = index.chunks(files).cache()
    return {"chunks": chunks, "postings": index.postings(chunks, with_readings=True), "chars": index.char_postings(chunks), "loose": index.loose_postings(chunks, F.col("file_id").isin(list(is_ocr)))}


def files_of(spark, ix, term):
    return sorted(r[0] for r in match.match_term(ix, term).select("file_id").distinct().collect())


@pytest.mark.parametrize(
    "term, expected",
    [("서버", [0, 1]), ("치", [2, 3, 6]), ("21세", [4]), ("10.0.3.21", [5]), ("설치정보", [2, 6]), ('"정보 설치"'.strip('"'), []), ("전경애", [7, 8]), ("resume", [10]), ("a", []), ("web", [11]), ("ai", [])],
)
def test_matching(spark, term, expected):
    ix = make_index(
        spark, "서버구축 안내", "서버의 상태", "설치 정보", "김치", "그는 21세 이다", "주소 10.0.3.21", "설치정보", "회장 全京愛", "전경어 (사진)", "전경에 있다", "résumé", "webserver air", "10,0,3,21", is_ocr=[8]
    )
    assert files_of(spark, ix, term) == expected


def test_quick_equals_full(spark):
    ix = make_index(spark, *[f"line {i} with plan {i % 3}" for i in range(30)])
    quick = {(r.file_id, x) for r in match.quick(ix, ["plan", "with"]).collect() for x in r.terms}
    full = {(r.file_id, r.term) for r in match.hits(ix, ["plan", "with"], ix["chunks"].select("file_id").distinct()).collect()}
    assert quick == full and len(quick) == 60


def test_big_file_does_not_hide_small(spark):
    ix = make_index(spark, "\n".join(f"needle number {i} " + "x" * 60 for i in range(600)), "needle here")
    hits = match.hits(ix, ["needle"], ix["chunks"].select("file_id").distinct()).groupBy("file_id").count().collect()
    assert {r[0]: r[1] for r in hits} == {0: 3, 1: 1}


def test_typo_content(spark):
    ix = make_index(spark, "견적서 보냄", "the report is here")
    vocab = index.vocabulary(ix["postings"])
    assert [r.variant for r in fuzzy.variants(spark, vocab, "견젹서").collect()] == ["견적서"]
    assert [r.file_id for r in fuzzy.search_content(spark, ix, vocab, "reprot").collect()] == [1]


def test_chunks_of_blank_and_null(spark):
    files = spark.createDataFrame([(1, ""), (2, None), (3, " \n \n"), (4, "a\r\n\r\nb")], "file_id long, text string")
    assert [(r.file_id, r.text) for r in index.chunks(files).collect()] == [(4, "a\nb")]


def test_delta_algebra(spark):
    old = spark.createDataFrame([("a", "file", 1), ("b", "file", 1)], "path string, kind string, mtime long")
    log = spark.createDataFrame([("a", "removed", 1, "file", 0), ("c", "added", 2, "file", 5), ("c", "removed", 3, "file", 0), ("b", "added", 4, "file", 9)], "path string, op string, seq long, kind string, mtime long")
    now = cat.apply_delta(old, cat.compact_log(log))
    assert [tuple(r) for r in now.collect()] == [("b", "file", 9)]


def test_catch_up_is_idempotent(spark):
    schema = "path string, kind string, mtime long"
    old = spark.createDataFrame([("/r/a", "folder", 1), ("/r/a/x", "file", 0), ("/r/a/s", "folder", 1), ("/r/a/s/y", "file", 0)], schema)
    new = spark.createDataFrame([("/r/a", "folder", 2), ("/r/a/x", "file", 0), ("/r/b", "file", 0)], schema)
    assert sorted(map(tuple, cat.catch_up(old, new).collect())) == [("/r/a", "added"), ("/r/a/s", "removed"), ("/r/a/s/y", "removed"), ("/r/b", "added")]
    assert cat.catch_up(new, new).count() == 0


def test_mail_incremental(spark):
    schema = "account string, folder string, uid_validity string, uid long"
    server = spark.createDataFrame([("m", "inbox", "1", u) for u in (1, 2)], schema)
    cursor = spark.createDataFrame([("m", "inbox", "1", 0)], "account string, folder string, uid_validity string, last_uid long")
    assert [r.uid for r in mail.to_fetch(server, server.limit(0), cursor).collect()] == [2, 1]
    later = spark.createDataFrame([("m", "inbox", "1", 2)], cursor.schema)
    more = server.unionByName(spark.createDataFrame([("m", "inbox", "1", 3)], schema))
    assert [r.uid for r in mail.to_fetch(more, server, later).collect()] == [3]
    reset = more.withColumn("uid_validity", F.lit("2"))
    assert sorted(r.uid for r in mail.synced(server, reset, later).collect()) == [1, 2, 3]


def test_vertical_columns(spark):
    place = [("아", 100, 50), ("2", 330, 58), ("최", 460, 50), ("들", 100, 128), ("1", 330, 136), ("삼", 460, 128), ("홍", 100, 206), ("세", 330, 206)]
    words = [("i", c, x, y, 50, 52) for c, x, y in place] + [("j", "장비", 0, 0, 50, 52), ("j", "설치", 60, 0, 50, 52), ("j", "확인서", 120, 0, 50, 52)]
    words += [("k", c, 10 + 3 * n, 10 + 60 * n, 50, 52) for n, c in enumerate("가나다")] + [("k", "라", 16, 500, 50, 52), ("k", None, 1, 1, 1, 1)]
    df = spark.createDataFrame(words, "image string, text string, x int, y int, w int, h int")
    got = ocr.vertical_columns(df).orderBy("image", "no").collect()
    assert [(r.image, r.text) for r in got] == [("i", "아들홍"), ("i", "21세"), ("i", "최삼"), ("k", "가나다")]
    assert (got[0].x, got[0].y, got[0].char_width, got[0].char_height, got[0].pitch) == (125.0, 50.0, 50.0, 52.0, 78.0)


def test_sources_and_mailboxes(spark):
    files = entries(spark, ("plan a", "D:\\x\\plan a", "file", "txt"), ("plan b", "D:\\y\\plan b", "file", "doc"))
    mails = cat.with_keys(mail.entries(spark.createDataFrame([("m1", "me", "inbox", "plan mail", "s", "2024"), ("m2", "me", "sent", "plan too", "s", "2024")], "path string, account string, folder string, subject string, sender string, sent_at string")))

    def names(**options):
        shown, found = rank.search(files, mails, "plan", q.SearchOptions(**options))
        return sorted(r.path for r in shown.collect()), [f.count() for f in found]

    assert names() == (["D:\\x\\plan a", "D:\\y\\plan b", "m1", "m2"], [2, 2])
    assert names(source="pc", extensions=["doc"]) == (["D:\\y\\plan b"], [1])
    assert names(source="mail", extensions=["doc"], mail_folders=["me\tsent"]) == (["m2"], [1])
    assert names(scopes=["D:/x"], mail_folders=["me\tinbox"]) == (["D:\\x\\plan a", "m1"], [1, 1])


def test_stored_index_reads_the_buckets_of_its_tokens(spark, tmp_path):
    ix = make_index(spark, *[f"common word number {i}" for i in range(40)], "rare word here")
    index.write_index(ix["postings"], f"{tmp_path}/p", parts=3)
    stored = spark.read.parquet(f"{tmp_path}/p")
    for words, prefix in ((["rare", "word"], False), (["common"], False), (["number", "1"], True), (["nothing"], False)):
        want = sorted(map(tuple, match.phrase(ix["postings"], words, prefix).collect()))
        assert sorted(map(tuple, match.phrase(stored, words, prefix).select("chunk_id", "file_id").collect())) == want
    assert {match.bucket_of(r.tok) == r.tok_bucket for r in stored.select("tok", "tok_bucket").distinct().collect()} == {True}
    plan = match.phrase(stored, ["rare", "word"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [tok_bucket" in plan
    assert sorted(map(tuple, index.vocabulary(ix["postings"]).collect())) == sorted(map(tuple, index.chunk_vocabulary(ix["chunks"]).collect()))


def test_churn_and_excludes(spark):
    df = spark.createDataFrame([("/r/tmp/a", "a"), ("/r/b/node_modules", "node_modules"), ("/r/ex2/a", "a"), ("/r/ex/a", "a")], "path string, name string")
    assert [r.path for r in df.filter(cat.not_excluded(F.col("path"), F.col("name"), ["/R/ex"])).collect()] == ["/r/tmp/a", "/r/ex2/a"]
    rows = ["C:\\Users\\me\\AppData\\Local\\x", "C:\\Windows\\System32", "D:\\업무\\보고서", "D:\\tmp\\자료\\a", "D:\\tmp\\자료2", "D:\\logs\\a", "D:\\x\\Windows\\a", "/r/tmp"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    churn = lambda *roots: [r.path for r in df.filter(cat.is_churn(F.col("path"), list(roots))).collect()]
    assert churn("C:\\", "D:\\") == [rows[0], rows[1], rows[3], rows[4], rows[7]]
    assert churn("D:\\tmp\\자료") == [rows[0], rows[1], rows[4], rows[7]]
    assert churn("D:\\TMP\\", "/r/tmp") == rows[:2]
