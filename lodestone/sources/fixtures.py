"""Small documents of every format, made in code, and the queries that extract them."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from email.message import EmailMessage

from pyspark.sql import functions as F

from . import extract


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*pages: list[str]) -> bytes:
    brk = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = brk.join("".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in page) for page in pages)
    return zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


def pptx(*slides: str) -> bytes:
    parts = {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:t>{s}</a:t></a:p></p:sld>' for i, s in enumerate(slides, 1)}
    order = range(len(slides), 0, -1)  # the presentation shows the last part first
    ids = "".join(f'<p:sldId r:id="r{i}"/>' for i in order)
    rels = "".join(f'<Relationship Id="r{i}" Target="slides/slide{i}.xml"/>' for i in order)
    parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="urn:p" xmlns:r="urn:r">{ids}</p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return zipped(parts)


def xlsx(sheet: str, rows: list[list[str]]) -> bytes:
    shared = list(dict.fromkeys(x for r in rows for x in r))
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="s"><v>{shared.index(x)}</v></c>' for j, x in enumerate(r, 1)) + "</row>" for i, r in enumerate(rows, 1))
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns:r="urn:r"><sheets><sheet name="{sheet}" r:id="a"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
        }
    )


def hwpx(lines: list[tuple[str, int]]) -> bytes:
    """Paragraphs with the vertical place of their line."""
    ps = "".join(f'<hp:p><hp:run><hp:t>{x}</hp:t></hp:run><hp:linesegarray><hp:lineseg vertpos="{top}"/></hp:linesegarray></hp:p>' for x, top in lines)
    return zipped({"Contents/section0.xml": f'<hs:sec xmlns:hs="urn:s" xmlns:hp="urn:h">{ps}</hs:sec>'})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams all lie in ordinary sectors; one level of storages."""
    storages = list(dict.fromkeys(n.split("/")[0] for n in streams if "/" in n))
    items = [(n, None) for n in storages] + [(n, d) for n, d in streams.items()]
    sectors, fat, starts = [], [], {}
    for n, d in streams.items():
        need = max(1, -(-len(d) // 512))
        starts[n] = len(fat)
        fat += [len(fat) + k + 1 for k in range(need - 1)] + [0xFFFFFFFE]
        sectors.append(d.ljust(need * 512, b"\0"))
    index = {n: i + 1 for i, (n, _) in enumerate(items)}
    links = {n: 0xFFFFFFFF for n in index}
    child = {"": 0xFFFFFFFF, **{s: 0xFFFFFFFF for s in storages}}
    for n in index:
        owner = n.split("/")[0] if "/" in n else ""
        links[n], child[owner] = child[owner], index[n]

    def entry(name: str, kind: int, right: int, down: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, 0xFFFFFFFF, right, down) + bytes(36) + struct.pack("<IQ", start, size)

    raw = entry("Root Entry", 5, 0xFFFFFFFF, child[""], 0xFFFFFFFE, 0)
    for n, d in items:
        raw += entry(n.split("/")[-1], 1 if d is None else 2, links[n], child.get(n, 0xFFFFFFFF), starts.get(n, 0), len(d or b""))
    need = -(-len(raw) // 512)
    first = len(fat)
    fat += [first + k + 1 for k in range(need - 1)] + [0xFFFFFFFE]
    sectors.append(raw.ljust(need * 512, b"\0"))
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, first, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", len(fat) - 1, *[0xFFFFFFFF] * 108) + b"".join(sectors) + table


def hwp(paragraphs: list[str], flags: int = 1) -> bytes:
    body = b""
    for p in paragraphs:
        text = (p + "\r").encode("utf-16-le")
        body += struct.pack("<I", 67 | len(text) << 20) + text
    z = zlib.compressobj(wbits=-15)
    packed = z.compress(body) + z.flush() if flags & 1 else body
    return compound({"FileHeader": b"HWP Document File".ljust(32, b"\0") + bytes(4) + struct.pack("<I", flags) + bytes(216), "BodyText/Section0": packed})


def pdf(*pages: str) -> bytes:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    for i, text in enumerate(pages):
        body = f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
    return b"%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1)).encode() + b"trailer << /Root 1 0 R >>\n%%EOF"


def eml() -> bytes:
    inner = EmailMessage()
    inner["Subject"], inner["From"], inner["To"] = "inner note", "a@example.com", "b@example.com"
    inner.set_content("nested body")
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "견적서", "Kim <kim@example.com>", "lee@example.com", "Mon, 1 Jan 2024 09:00:00 +0900"
    m.set_content("first line\nsecond line")
    m.add_attachment(docx(["attached text"]), maintype="application", subtype="octet-stream", filename="note.docx")
    m.add_attachment(inner)
    return m.as_bytes()


FILES = {
    "docx": docx(["first page"], ["second page"]),
    "pptx": pptx("shown second", "shown first"),
    "xlsx": xlsx("sheet", [["name", "price"], ["server", "100"]]),
    "hwpx": hwpx([("top", 0), ("below", 100), ("next page", 0)]),
    "hwp": hwp(["서버 구축", "둘째 문단"]),
    "pdf": pdf("hello one", "hello two"),
    "eml": eml(),
    "txt": "서버".encode("cp949"),
    "msg": compound({"__substg1.0_0037001F": "plan".encode("utf-16-le"), "__substg1.0_1000001F": "the body".encode("utf-16-le")}),
}


def _extraction(kind: str):
    def run(spark, sf_dir):
        data = FILES[kind]
        files = spark.createDataFrame([(f"/fixtures/a.{kind}", len(data), bytearray(data))], "path string, length long, content binary")
        return extract.extract_files(files).select("path", "status", "chunk_no", F.to_json("location").alias("location"), "text")

    return run


def _literal(make):
    def run(spark, sf_dir):
        return make(spark)

    return run


def queries():
    from lodestone.functions import query as q
    from lodestone.functions import text as t

    words = lambda spark, *w: spark.createDataFrame([(x,) for x in w], "word string")
    out = {f"extract_{k}": _extraction(k) for k in FILES}
    out |= {name: _matching(term) for name, (term, _) in MATCHES.items()}
    out["loose_fold"] = _literal(lambda s: words(s, "전경애", "전경에", "전경어").select("word", t.loose_text(F.col("word")).alias("loose")))
    out["hanja_reading"] = _literal(lambda s: words(s, "全京愛", "金鍾煥", "서버").select("word", F.array_join(t.readings(F.col("word")), ",").alias("readings")))
    out["syllable_variants"] = _literal(lambda s: words(s, *q.syllable_variants("각")))
    return out


def _values(columns: str, rows: list[tuple], kinds: str) -> str:
    """SQL of literal rows; ``\\n`` in a text is a line end."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    picked = ", ".join(f"{c}::{k} AS {c}" for c, k in zip(columns.split(", "), kinds.split(", ")))
    return f"SELECT {picked} FROM (VALUES {body}) v({columns})"


def _extracted(kind: str, *chunks: tuple[str, str]) -> str:
    rows = [(f"/fixtures/a.{kind}", "done", n, where, text) for n, (where, text) in enumerate(chunks)]
    return _values("path, status, chunk_no, location, text", rows, "VARCHAR, VARCHAR, INTEGER, VARCHAR, VARCHAR")


def oracle_sql() -> dict[str, str]:
    """What the fixtures hold, written out: these queries read none of the driver's tables."""
    inner = '"attachment":"inner note.eml"}'
    return {
        "extract_docx": _extracted("docx", ('{"page":1}', "first page"), ('{"page":2}', "second page")),
        "extract_pptx": _extracted("pptx", ('{"slide":1}', "shown first"), ('{"slide":2}', "shown second")),
        "extract_xlsx": _extracted("xlsx", ('{"sheet":"sheet","cell":"A1"}', "name | price"), ('{"sheet":"sheet","cell":"A2"}', "server | 100")),
        "extract_hwpx": _extracted("hwpx", ('{"page":1}', "top\nbelow"), ('{"page":2}', "next page")),
        "extract_hwp": _extracted("hwp", ('{"paragraph":1,"section":1}', "서버 구축\n둘째 문단")),
        "extract_pdf": _extracted("pdf", ('{"page":1}', "hello one"), ('{"page":2}', "hello two")),
        "extract_txt": _extracted("txt", ('{"line":1}', "서버")),
        "extract_msg": _extracted("msg", ('{"mail":"header"}', "Subject: plan\nFrom:  <>\nTo: \nAttachments:"), ('{"mail":"body"}', "the body")),
        "extract_eml": _extracted(
            "eml",
            ('{"mail":"header"}', "Subject: 견적서\nFrom: Kim <kim@example.com>\nTo: lee@example.com\nDate: Mon, 01 Jan 2024 09:00:00 +0900\nAttachments: note.docx, inner note.eml"),
            ('{"mail":"body"}', "first line\nsecond line"),
            ('{"attachment":"note.docx"}', "note.docx"),
            ('{"paragraph":1,"attachment":"note.docx"}', "attached text"),
            ("{" + inner, "inner note.eml"),
            ('{"mail":"header",' + inner, "Subject: inner note\nFrom: a@example.com\nTo: b@example.com\nDate: \nAttachments:"),
            ('{"mail":"body",' + inner, "nested body"),
        ),
        "loose_fold": _values("word, loose", [("전경애", "전경어"), ("전경에", "전경어"), ("전경어", "전경어")], "VARCHAR, VARCHAR"),
        "hanja_reading": _values("word, readings", [("全京愛", "전경애"), ("金鍾煥", "금종환,김종환"), ("서버", "")], "VARCHAR, VARCHAR"),
        "syllable_variants": "SELECT chr((44032 + (i * 21 + v) * 28 + t)::INTEGER) AS word FROM range(19) x(i), range(21) y(v), range(28) z(t) WHERE (i <> 0)::INTEGER + (v <> 0)::INTEGER + (t <> 1)::INTEGER = 1",
        **{name: _values("file_id, text", [(i, SENTENCES[i]) for i in found], "BIGINT, VARCHAR") for name, (_, found) in MATCHES.items()},
    }


#: Texts of scripts written without spaces, and what a term finds in them; the ninth comes from OCR.
SENTENCES = ("서버구축 안내", "서버의 상태", "설치 정보", "김치", "그는 21세 이다", "나이 21 그리고 세", "설치정보", "회장 全京愛", "전경어", "전경에 있다", "회원 金鍾煥", "설치_정보")
MATCHES = {
    "cjk_phrase_match": ("서버", (0, 1)),
    "cjk_spacing_match": ("설치정보", (2, 6, 11)),
    "cjk_char_match": ("치", (2, 3, 6, 11)),
    "cjk_mixed_match": ("21세", (4,)),
    "cjk_loose_match": ("전경애", (7, 8)),
    "cjk_reading_match": ("김종환", (10,)),
}


def _matching(term: str):
    def run(spark, sf_dir):
        from lodestone.operators import index, match

        files = spark.createDataFrame(list(enumerate(SENTENCES)), "file_id long, text string")
        chunks = index.chunks(files)
        stored = {"chunks": chunks, "postings": index.postings(chunks, with_readings=True), "chars": index.char_postings(chunks), "loose": index.loose_postings(chunks, F.col("file_id") == 8)}
        return files.join(match.match_term(stored, term).select("file_id").distinct(), "file_id")

    return run
