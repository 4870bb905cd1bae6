import os

from pyspark.sql import functions as F

from lodestone import engine as e
from lodestone.functions import query as q
from lodestone.sources import fixtures


def paths(found):
    return [os.path.basename(r.path) for r in found.items.collect()]


def test_crawl_index_search(spark, tmp_path):
    root = tmp_path / "root"
    (root / "plans" / "old").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for kind, data in fixtures.FILES.items():
        (root / f"f.{kind}").write_bytes(data)
    (root / "plans" / "server plan.txt").write_text("line one\nthe quarterly report is here\n")
    (root / "plans" / "old" / "other.txt").write_text("nothing to see, but a report")
    (root / "node_modules" / "x.txt").write_text("report")
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "empty.txt").write_bytes(b"")
    own = e.Engine(spark, f"file://{tmp_path}/index", [str(root), str(root / "plans")])
    summary = own.rebuild()
    assert summary == {"total": len(fixtures.FILES) + 4, "extracted": len(fixtures.FILES) + 2, "skipped": 1, "errors": 1}
    stats = own.stats()
    assert stats["files_error"] == 1 and stats["files_empty"] == 1 and stats["errors"] == 0

    found = own.search("report")
    assert sorted(paths(found)) == ["other.txt", "server plan.txt"] and found.totals == {"pc": 2}
    hit = next(r for r in found.items.collect() if r.name == "server plan.txt").hits
    assert [(h.term, h.label, h.match) for h in hit] == [("report", "line 2", "report")]
    assert paths(own.search("server report")) == ["server plan.txt"]
    assert paths(own.search("서버")) == ["f.hwp", "f.txt"] and paths(own.search("report", q.SearchOptions(names_only=True))) == []
    assert paths(own.search("plans")) == ["plans", "old", "other.txt", "server plan.txt"] and "x.txt" not in paths(own.search("txt"))
    typo = own.search("reprot", q.SearchOptions(fuzzy=True)).items.collect()
    assert sorted((r.name, r.fuzzy) for r in typo) == [("other.txt", True), ("server plan.txt", True)]
    assert paths(own.search("reprot")) == []

    # What changed, came and went, and nothing else.
    (root / "plans" / "server plan.txt").write_text("a longer text about budgets")
    os.utime(root / "plans", (1, 1))
    (root / "new").mkdir()
    (root / "new" / "deep.txt").write_text("budgets again")
    (root / "plans" / "old" / "other.txt").unlink()
    (root / "plans" / "old").rmdir()
    summary = own.catch_up()
    assert summary["extracted"] == 2 and summary["errors"] == 1
    assert sorted(paths(own.search("budgets"))) == ["deep.txt", "server plan.txt"] and paths(own.search("report")) == []
    assert own.read("files").groupBy("file_id").count().filter("count > 1").count() == 0
    whole = {r.path for r in own.read("entries").select("path").collect()}
    own.rebuild()
    assert {r.path for r in own.read("entries").select("path").collect()} == whole
    assert own.catch_up()["extracted"] == 0 and len(own.versions()) <= 3

    # Another tokenizer: postings anew, no extraction.
    assert not own.retokenize()
    e.TOKENIZER += 1
    try:
        assert own.retokenize() and sorted(paths(own.search("budgets"))) == ["deep.txt", "server plan.txt"]
    finally:
        e.TOKENIZER -= 1


def test_mails_beside_files(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "plan.txt").write_text("x y z")
    own = e.Engine(spark, f"file://{tmp_path}/index", [str(tmp_path / "root")])
    own.rebuild()
    rows = [(f"imap://me/{f}/1/{u}", "me", f, u, s, "a", "b", "2024-01-02T00:00:00Z") for f, u, s in (("inbox", 1, "the plan"), ("sent", 2, "plan too"), ("inbox", 3, ""))]
    own.sync_mail(spark.createDataFrame(rows, e.MAILS))
    own.sync_mail(spark.createDataFrame([(*rows[0][:4], "the other plan", *rows[0][5:])], e.MAILS))
    assert own.mails().count() == 3 and [(r.folder, r.n) for r in own.mail_folders().collect()] == [("inbox", 2), ("sent", 1)]
    found = own.search("plan")
    assert found.totals == {"pc": 1, "mail": 2} and found.items.count() == 3
    assert {r.name for r in own.search("plan", q.SearchOptions(source="mail", mail_folders=["me\tinbox"])).items.collect()} == {"the other plan"}
    own.remove_account("me")
    assert own.mails().count() == 0 and own.search("plan").totals == {"pc": 1}


def test_unreadable_folders_are_errors(spark, tmp_path):
    from lodestone.sources import listing

    rows = listing.list_folders(spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "missing"),)], "path string")).collect()
    assert [r.kind for r in rows] == ["unreadable"] and rows[0].error
    entries, errors = listing.crawl(spark, [str(tmp_path / "missing")], [], f"{tmp_path}/stage")
    assert entries.count() == 0 and errors.filter(F.col("message").isNotNull()).count() == 1
