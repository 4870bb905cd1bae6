"""Extraction of text and positions from files: bytes to ``(location, text)`` rows.

A format is a function from bytes to lines ``(location, text)``; ``chunked`` joins lines into chunks with marks.
Locations are dictionaries with the fields of ``LOCATION``; files go through ``extract_files`` in Arrow batches.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cfb

MAX_FILE, CHUNK_CHARS, MAX_DEPTH, MAX_ATTACHMENTS = 30 * 1024 * 1024, 800, 3, 50
FIELDS = ("line int", "page int", "paragraph int", "section int", "slide int", "sheet string", "cell string", "ocr boolean", "mail string", "attachment string")
LOCATION = "struct<" + ",".join(f.replace(" ", ":") for f in FIELDS) + ">"
CHUNK = f"path string, status string, error string, chunk_no int, location {LOCATION}, text string, marks array<struct<offset:int,loc:{LOCATION}>>"
Line = tuple[dict, str]


class Unsupported(Exception):
    """The format is known to be unreadable here (encrypted, for example)."""


def decode_text(data: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp949", "replace")


def plain_text(data: bytes) -> Iterator[Line]:
    for i, line in enumerate(re.split(r"\r?\n", decode_text(data)), 1):
        yield {"line": i}, line


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _text(node: ElementTree.Element, *tags: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) in tags)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    found = {}
    for r in _xml(z, path):
        target = r.get("Target", "")
        found[r.get("Id", "")] = target[1:] if target.startswith("/") else f"{folder}/{target}"
    return found


def _rel_id(node: ElementTree.Element) -> str:
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), "")


def docx(data: bytes) -> Iterator[Line]:
    """Paragraphs; pages by rendered breaks, else by manual ones, else paragraph numbers."""
    body = _xml(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml")
    rendered = any(_local(x.tag) == "lastRenderedPageBreak" for x in body.iter())
    is_break = (lambda x: _local(x.tag) == "lastRenderedPageBreak") if rendered else (lambda x: _local(x.tag) == "br" and any(k.endswith("}type") and v == "page" for k, v in x.attrib.items()))
    paged = rendered or any(is_break(x) for x in body.iter())
    page = 1
    for n, p in enumerate((x for x in body.iter() if _local(x.tag) == "p"), 1):
        parts: list[tuple[int, str]] = []
        for x in p.iter():
            if is_break(x):
                page += 1
            elif _local(x.tag) == "t":
                parts.append((page, x.text or ""))
        at = next((g for g, s in parts if s.strip()), page)
        yield ({"page": at} if paged else {"paragraph": n}), "".join(s for _, s in parts)


def pptx(data: bytes) -> Iterator[Line]:
    """One line group for each slide, in the presentation's order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names, first = z.namelist(), 1
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "ppt/presentation.xml" in names:
        root, rels = _xml(z, "ppt/presentation.xml"), _relations(z, "ppt/presentation.xml")
        first = int(root.get("firstSlideNum", "1"))
        slides = [s for s in (rels.get(_rel_id(x)) for x in root.iter() if _local(x.tag) == "sldId") if s in names] or slides
    for k, name in enumerate(slides):
        lines = [_text(p, "t") for p in _xml(z, name).iter() if _local(p.tag) == "p"]
        yield {"slide": first + k, "__alone": True}, "\n".join(x for x in lines if x.strip())


def xlsx(data: bytes) -> Iterator[Line]:
    """A row is a chunk: cells joined by `` | ``, with a mark for each cell."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = [_text(s, "t") for s in _xml(z, "xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    rels = _relations(z, "xl/workbook.xml")
    for sheet in (x for x in _xml(z, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"):
        part = rels.get(_rel_id(sheet))
        if part not in names:
            continue
        for row in (x for x in _xml(z, part).iter() if _local(x.tag) == "row"):
            cells = []
            for c in (x for x in row if _local(x.tag) == "c"):
                kind, value = c.get("t"), _text(c, "v")
                text = shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else _text(c, "t") if kind == "inlineStr" else value
                if text.strip():
                    cells.append(({"sheet": sheet.get("name"), "cell": c.get("r")}, text.strip()))
            if cells:
                marks, at = [], 0
                for loc, text in cells:
                    marks.append((at, loc))
                    at += len(text) + 3
                yield cells[0][0] | {"__alone": True, "__marks": marks}, " | ".join(t for _, t in cells)


def hwpx(data: bytes) -> Iterator[Line]:
    """Paragraphs with section and page; a page starts where a paragraph's first line doesn't lie below the last."""
    z = zipfile.ZipFile(io.BytesIO(data))
    parts = sorted((n for n in z.namelist() if re.search(r"section\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    page = 0
    for s, name in enumerate(parts, 1):
        last, paged = None, False
        for n, p in enumerate((x for x in _xml(z, name) if _local(x.tag) == "p"), 1):
            tops = [int(x.get("vertpos", "0")) for x in p.iter() if _local(x.tag) == "lineseg"]
            fresh = p.get("pageBreak") == "1"
            for top in tops:
                if last is None or top <= last and not fresh or fresh:
                    page += 1
                last, paged, fresh = top, True, False
            yield ({"page": page} if paged else {"section": s, "paragraph": n}), _text(p, "t")


def hwp(data: bytes) -> Iterator[Line]:
    """Paragraph texts of the body sections; encrypted and distribution documents are refused."""
    found = cfb.streams(data)
    flags = struct.unpack_from("<I", found["FileHeader"], 36)[0]
    if flags & 0x2 or flags & 0x4:
        raise Unsupported("encrypted or distribution document")
    names = sorted((n for n in found if n.startswith("BodyText/Section")), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for s, name in enumerate(names, 1):
        body = zlib.decompressobj(-15).decompress(found[name]) if flags & 0x1 else found[name]
        at = n = 0
        while at + 4 <= len(body):
            (head,) = struct.unpack_from("<I", body, at)
            at, size = at + 4, head >> 20
            if size == 0xFFF:
                (size,) = struct.unpack_from("<I", body, at)
                at += 4
            if head & 0x3FF == 67:  # paragraph text
                n += 1
                yield {"section": s, "paragraph": n}, _hwp_text(body[at : at + size])
            at += size


def _hwp_text(raw: bytes) -> str:
    """UTF-16 text; control characters below 32 take eight units, but for a few of one unit."""
    units, out, k = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2]), [], 0
    while k < len(units):
        u = units[k]
        if u >= 32:
            out.append(struct.pack("<H", u))
        elif u in (10, 13):
            out.append(b"\n\0")
        elif u in (9, *range(1, 9), 11, 12, *range(14, 24)):
            out.append(b"\t\0" if u == 9 else b"")
            k += 7
        k += 1
    return b"".join(out).decode("utf-16-le", "replace")


_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT\*|\bTd\b|\bTD\b|\bTm\b|\bTj\b|\bTJ\b|\bET\b|'|\"", re.S)


def pdf(data: bytes) -> Iterator[Line]:
    """Pages of a PDF whose text is in simple fonts: content streams, plain or deflated, without object streams."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", data, re.S)}
    if b"/Encrypt" in data[-2048:]:
        raise Unsupported("encrypted document")
    root = next((o for o in objects.values() if re.search(rb"/Type\s*/Pages\b", o) and not re.search(rb"/Parent\b", o)), None)
    order: list[int] = []

    def walk(obj: bytes, depth: int) -> None:
        kids = re.search(rb"/Kids\s*\[(.*?)\]", obj, re.S)
        for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) if kids and depth < 50 else ():
            child = objects.get(int(k), b"")
            if re.search(rb"/Type\s*/Pages\b", child):
                walk(child, depth + 1)
            else:
                order.append(int(k))

    if root is not None:
        walk(root, 0)
    else:
        order = [k for k, o in objects.items() if re.search(rb"/Type\s*/Page\b", o)]
    for number, k in enumerate(order, 1):
        refs = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects.get(k, b""), re.S)
        lines: list[str] = []
        for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else ():
            m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", objects.get(int(r), b""), re.S)
            if m:
                body = zlib.decompress(m[1]) if b"/FlateDecode" in objects[int(r)] else m[1]
                lines += _pdf_lines(body)
        yield {"page": number, "__alone": True}, "\n".join(x.strip() for x in lines if x.strip())


def _pdf_lines(body: bytes) -> list[str]:
    lines, now = [], ""
    for m in _PDF_TEXT.finditer(body):
        s = m[0]
        if s[:1] == b"(":
            now += re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda e: {b"n": b"\n", b"r": b"", b"t": b"\t", b"b": b"", b"f": b""}.get(e[1], e[1] if e[1] in b"()\\" else bytes([int(e[1], 8) & 255])), s[1:-1]).decode("cp1252", "replace")
        elif s[:1] == b"<":
            raw = bytes.fromhex(re.sub(rb"\s", b"", s[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", s[1:-1])) % 2))
            now += raw.decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "cp1252", "replace")
        elif s not in (b"Tj", b"TJ") and now:
            lines.append(now)
            now = ""
    return [*lines, now] if now else lines


def html_text(value: str) -> str:
    value = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", value)
    value = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n", value)
    value = html.unescape(re.sub(r"<[^>]+>", " ", value))
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t]+", " ", value)).strip()


def _addresses(message: EmailMessage, *headers: str) -> str:
    return ", ".join(str(a) for h in headers for v in message.get_all(h, []) for a in getattr(v, "addresses", ()))


def eml(data: bytes, depth: int = 0) -> Iterator[Line]:
    """A header group, the body's lines, then each attachment: its name, and its own text down to MAX_DEPTH."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    attachments = [p for p in message.iter_attachments()][:MAX_ATTACHMENTS] if message.is_multipart() else []
    names = [_attachment_name(a) for a in attachments]
    head = [f"Subject: {message.get('subject', '')}", f"From: {_addresses(message, 'from')}", f"To: {_addresses(message, 'to', 'cc')}", f"Date: {str(message.get('date', ''))[:31]}", f"Attachments: {', '.join(names)}"]
    yield {"mail": "header", "__alone": True}, "\n".join(head)
    body = message.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        for line in (html_text(text) if body.get_content_subtype() == "html" else text).splitlines():
            yield {"mail": "body"}, line
    for part, name in zip(attachments, names):
        yield {"attachment": name, "__alone": True}, name
        if depth >= MAX_DEPTH:
            continue
        try:
            inner = part.get_content().as_bytes() if part.get_content_type() == "message/rfc822" else part.get_payload(decode=True) or b""
            kind = "eml" if part.get_content_type() == "message/rfc822" else suffix(name)
            for loc, text in lines_of(inner, kind, depth + 1) or ():
                nested = f"{name} > {loc['attachment']}" if loc.get("attachment") else name
                marks = {"__marks": [(o, m | {"attachment": name}) for o, m in loc["__marks"]]} if "__marks" in loc else {}
                yield loc | {"attachment": nested} | marks, text
        except Exception:  # noqa: BLE001 - an unreadable attachment keeps its name only
            continue


def _attachment_name(part: EmailMessage) -> str:
    if part.get_content_type() == "message/rfc822":
        return part.get_filename() or f"{part.get_content().get('subject', 'message')}.eml"
    return part.get_filename() or "attachment"


def msg(data: bytes, depth: int = 0) -> Iterator[Line]:
    """Header, body and attachments of an Outlook message."""
    found = cfb.streams(data)

    def prop(prefix: str, tag: str) -> str:
        wide, narrow = found.get(f"{prefix}__substg1.0_{tag}001F"), found.get(f"{prefix}__substg1.0_{tag}001E")
        return wide.decode("utf-16-le", "replace") if wide is not None else (narrow or b"").decode("cp949", "replace")

    folders = sorted({n.split("/")[0] for n in found if n.startswith("__attach")})[:MAX_ATTACHMENTS]
    names = [prop(f + "/", "3707") or prop(f + "/", "3704") or "attachment" for f in folders]
    yield {"mail": "header", "__alone": True}, "\n".join([f"Subject: {prop('', '0037')}", f"From: {prop('', '0C1A')} <{prop('', '5D01') or prop('', '0C1F')}>", f"To: {prop('', '0E04')}", f"Attachments: {', '.join(names)}"])
    for line in prop("", "1000").splitlines():
        yield {"mail": "body"}, line
    for folder, name in zip(folders, names):
        yield {"attachment": name, "__alone": True}, name
        inner = found.get(f"{folder}/__substg1.0_37010102")
        if inner and depth < MAX_DEPTH:
            try:
                for loc, text in lines_of(inner, suffix(name), depth + 1) or ():
                    yield loc | {"attachment": f"{name} > {loc['attachment']}" if loc.get("attachment") else name}, text
            except Exception:  # noqa: BLE001
                continue


FORMATS: dict[str, Callable[..., Iterator[Line]]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "hwpx": hwpx, "hwp": hwp, "pdf": pdf, "eml": eml, "msg": msg} | dict.fromkeys(("txt", "md", "csv", "log", "json", "xml", "html", "ini", "tsv"), plain_text)


def suffix(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name[1:] else ""


def lines_of(data: bytes, kind: str, depth: int = 0) -> Iterator[Line] | None:
    f = FORMATS.get(kind)
    return None if f is None else f(data, depth) if kind in ("eml", "msg") else f(data)


def chunked(lines: Iterator[Line], limit: int = CHUNK_CHARS) -> Iterator[tuple[dict, str, list]]:
    """Chunks ``(location, text, marks)``: lines join until they hold ``limit`` characters; a page or slide ends one."""
    held: list[str] = []
    size, marks = 0, []

    def flush():
        nonlocal held, size, marks
        if held:
            yield marks[0][1], "\n".join(held), marks
        held, size, marks = [], 0, []

    for loc, raw in lines:
        text = raw.strip()
        own = {k: v for k, v in loc.items() if not k.startswith("__")}
        if not text:
            continue
        if loc.get("__alone"):
            yield from flush()
            yield own, text, loc.get("__marks") or [(0, own)]
            continue
        if marks and own.get("page") != marks[-1][1].get("page"):
            yield from flush()
        if not marks or marks[-1][1] != own:
            marks.append((size + len(held), own))
        held.append(text)
        size += len(text)
        if size >= limit:
            yield from flush()
    yield from flush()


def extract_one(path: str, data: bytes | None, size: int) -> Iterator[dict]:
    """Rows of one file: its chunks, or one row with a status ``empty``, ``too_large``, ``error`` or ``unsupported``."""
    blank = {"path": path, "status": "done", "error": None, "chunk_no": None, "location": None, "text": None, "marks": None}
    if size > MAX_FILE:
        yield blank | {"status": "too_large"}
        return
    try:
        lines = lines_of(data or b"", suffix(path))
        rows = [] if lines is None else list(chunked(lines))
    except Exception as e:  # noqa: BLE001 - a broken file is a result, not a failed job
        yield blank | {"status": "error", "error": f"{type(e).__name__}: {e}"[:500]}
        return
    if not rows:
        yield blank | {"status": "unsupported" if lines is None else "empty"}
    for n, (loc, text, marks) in enumerate(rows):
        yield blank | {"chunk_no": n, "location": full_location(loc), "text": text, "marks": [{"offset": o, "loc": full_location(m)} for o, m in marks]}


def full_location(loc: dict) -> dict:
    return {f.split()[0]: loc.get(f.split()[0]) for f in FIELDS}


def crawl(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a root with content, by Spark's own reader: ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def entries(files: DataFrame) -> DataFrame:
    """Catalog entries of crawled files; ``content`` is not read."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))
    return files.select(name.alias("name"), "path", F.lit("file").alias("kind"), ext.alias("extension"), F.unix_millis("modificationTime").alias("mtime"))


def extract_files(files: DataFrame) -> DataFrame:
    """Chunk rows of crawled files; a file beyond MAX_FILE is never sent to Python."""
    data = F.when(F.col("length") <= MAX_FILE, F.col("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ("path", "status", "error", "chunk_no", "location", "text", "marks")]
        for frame in frames:
            for row in frame.itertuples():
                rows = list(extract_one(row.path, None if row.content is None else bytes(row.content), row.length))
                yield pd.DataFrame(rows, columns=columns).astype({"chunk_no": "Int32"})

    return files.select("path", "length", data.alias("content")).mapInPandas(run, CHUNK)


def extract_paths(files: DataFrame) -> DataFrame:
    """Chunk rows of listed files ``(path, size)``; each is read where it is extracted, beyond MAX_FILE not at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .listing import _local

        columns = [c.split()[0] for c in ("path", "status", "error", "chunk_no", "location", "text", "marks")]
        for frame in frames:
            for row in frame.itertuples():
                data = b""
                try:
                    if 0 < row.size <= MAX_FILE:
                        system, place = _local(row.path)
                        with system.open_input_file(place) as f:
                            data = f.read()
                    rows = list(extract_one(row.path, data, row.size))
                except OSError as e:
                    rows = [{"path": row.path, "status": "error", "error": f"{type(e).__name__}: {e}"[:500], "chunk_no": None, "location": None, "text": None, "marks": None}]
                yield pd.DataFrame(rows, columns=columns).astype({"chunk_no": "Int32"})

    return files.select("path", "size").mapInPandas(run, CHUNK)


def attachment_names(names: list[str], limit: int = 150) -> list[str]:
    """Names that a file system takes: no reserved characters, cut, and numbered when they repeat."""
    out, seen = [], set()
    for raw in names:
        clean = re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", raw).strip(" .")[:limit] or "attachment"
        stem, dot, ext = clean.rpartition(".") if "." in clean[1:] else (clean, "", "")
        name, n = clean, 1
        while name.lower() in seen:
            n += 1
            name = f"{stem} ({n}){dot}{ext}"
        seen.add(name.lower())
        out.append(name)
    return out
