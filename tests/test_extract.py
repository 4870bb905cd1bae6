import pytest

from lodestone.operators.ocr import image_size
from lodestone.sources import extract, fixtures


def rows(kind, data=None):
    return list(extract.extract_one(f"a.{kind}", fixtures.FILES[kind] if data is None else data, 100))


def told(kind, *keys):
    return [(*(r["location"][k] for k in keys), r["text"]) for r in rows(kind)]


def test_formats():
    assert told("docx", "page") == [(1, "first page"), (2, "second page")]
    assert told("pptx", "slide") == [(1, "shown first"), (2, "shown second")]
    assert told("xlsx", "sheet", "cell") == [("sheet", "A1", "name | price"), ("sheet", "A2", "server | 100")]
    assert rows("xlsx")[1]["marks"][1]["loc"]["cell"] == "B2" and rows("xlsx")[1]["marks"][1]["offset"] == 9
    assert told("hwpx", "page") == [(1, "top\nbelow"), (2, "next page")]
    assert told("hwp", "section", "paragraph") == [(1, 1, "서버 구축\n둘째 문단")]
    assert told("pdf", "page") == [(1, "hello one"), (2, "hello two")]
    assert told("txt", "line") == [(1, "서버")]
    assert told("msg", "mail")[-1] == ("body", "the body")


def test_mail_nesting():
    found = told("eml", "mail", "attachment")
    assert found[0][0] == "header" and "견적서" in found[0][2]
    assert ("body", None, "first line\nsecond line") in found
    assert (None, "note.docx", "attached text") in found
    assert any(a == "inner note.eml" and "nested body" in t for _, a, t in found)


@pytest.mark.parametrize("kind, data, status", [("hwp", fixtures.hwp(["x"], 3), "error"), ("docx", b"no zip", "error"), ("txt", b"", "empty"), ("xyz", b"1", "unsupported")])
def test_statuses(kind, data, status):
    assert rows(kind, data)[0]["status"] == status


def test_too_large():
    assert next(extract.extract_one("a.txt", b"", extract.MAX_FILE + 1))["status"] == "too_large"


def test_crawl_and_extract(spark, tmp_path):
    for kind, data in fixtures.FILES.items():
        (tmp_path / f"f.{kind}").write_bytes(data)
    files = extract.crawl(spark, str(tmp_path))
    assert extract.entries(files).count() == len(fixtures.FILES)
    assert {r.status for r in extract.extract_files(files).select("status").distinct().collect()} == {"done"}


def test_image_sizes_and_names():
    assert image_size(b"\x89PNG\r\n\x1a\n" + bytes(8) + b"\0\0\0\x10\0\0\0\x20") == (16, 32)
    assert image_size(b"GIF89a\x03\0\x04\0") == (3, 4)
    assert image_size(b"\xff\xd8\xff\xc0\0\x11\x08\0\x05\0\x06\x03") == (6, 5)
    assert extract.attachment_names(["a.txt", "A.txt", "b/c"]) == ["a.txt", "A (2).txt", "b_c"]
