"""Text functions as Column expressions, and the few Arrow UDFs for what Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Java character classes of the scripts that are written without spaces.
CJK = r"\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
RUN = rf"[{CJK}]+|[\p{{L}}&&[^{CJK}]]+|\p{{N}}+"
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
MEDIALS, FINALS = 21, 28
#: Medial vowels that OCR confuses, by their number, and the one they count as.
LOOSE_MEDIALS = {1: 4, 5: 4, 3: 6, 7: 6}
#: Readings of a few Han characters (public Unihan kHangul data); load_readings takes the full table.
READINGS = {"全": "전", "京": "경", "愛": "애", "金": "금김", "鍾": "종", "煥": "환", "英": "영", "洙": "수"}


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Without combining marks U+0300-U+036F, which the index ignores; other scripts stay as they are."""

    def one(t):
        if t is None or t.isascii():
            return t
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))

    return text.map(one)


@pandas_udf(T.StringType())
def index_form(text: pd.Series) -> pd.Series:
    """NFKC, lower case and without accents in one crossing to Python: the form that is indexed."""

    def one(t):
        if t is None:
            return ""
        if t.isascii():
            return t.lower()
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t).lower())
        return unicodedata.normalize("NFC", "".join(c for c in plain if not "\u0300" <= c <= "\u036f"))

    return text.map(one)


@pandas_udf(T.StringType())
def jamo(text: pd.Series) -> pd.Series:
    """Hangul syllables as conjoining jamo; other characters unchanged."""
    return text.map(lambda t: None if t is None else to_jamo(t))


def normalize(text: Column) -> Column:
    """The form that matching uses: NFKC, lower case; null is empty."""
    return F.lower(nfkc(F.coalesce(text.cast("string"), F.lit(""))))


def text_runs(text: Column) -> Column:
    """Maximal runs of CJK characters, other letters, or digits."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def run_tokens(run: Column) -> Column:
    """Overlapping pairs of a CJK run longer than one character; any other run itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when((F.length(run) > 1) & run.rlike(f"^[{CJK}]"), pairs).otherwise(F.array(run))


def tokens(text: Column) -> Column:
    return F.flatten(F.transform(text_runs(text), run_tokens))


def cjk_chars(text: Column) -> Column:
    """The distinct CJK characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{CJK}]"), F.lit(0)))


def _reading_tables(readings: dict[str, str]) -> tuple[str, str, str]:
    han = "".join(readings)
    return han, "".join(r[0] for r in readings.values()), "".join(r[min(1, len(r) - 1)] for r in readings.values())


def readings(text: Column, table: dict[str, str] = READINGS) -> Column:
    """The Hangul readings of a text with Han characters: by first and by second reading, once if they are the same."""
    han, first, second = _reading_tables(table)
    both = F.array_distinct(F.array(F.translate(text, han, first), F.translate(text, han, second)))
    return F.when(text.rlike(r"\p{IsHan}"), both).otherwise(F.array().cast("array<string>"))


def load_readings(path: str) -> dict[str, str]:
    """A full table of readings from a JSON object of characters."""
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _loose_tables() -> tuple[str, str]:
    source, target = [], []
    for initial in range(19):
        for medial, as_medial in LOOSE_MEDIALS.items():
            for final in range(FINALS):
                source.append(join_syllable(initial, medial, final))
                target.append(join_syllable(initial, as_medial, final))
    return "".join(source), "".join(target)


def loose_text(text: Column) -> Column:
    """Vowels that OCR confuses folded together."""
    return F.translate(text, *_loose_tables())


def join_syllable(initial: int, medial: int, final: int) -> str:
    return chr(HANGUL_FIRST + (initial * MEDIALS + medial) * FINALS + final)


def split_syllable(char: str) -> tuple[int, int, int]:
    rest, final = divmod(ord(char) - HANGUL_FIRST, FINALS)
    return (*divmod(rest, MEDIALS), final)


def is_syllable(char: str) -> bool:
    return HANGUL_FIRST <= ord(char) <= HANGUL_LAST


def to_jamo(text: str) -> str:
    out = []
    for c in text:
        if is_syllable(c):
            initial, medial, final = split_syllable(c)
            out.append(chr(0x1100 + initial) + chr(0x1161 + medial) + (chr(0x11A7 + final) if final else ""))
        else:
            out.append(c)
    return "".join(out)


def loose(text: str) -> str:
    """The driver-side twin of ``loose_text``."""
    return text.translate(str.maketrans(*_loose_tables()))


def comparable_path(path: Column) -> Column:
    """Backslashes, no trailing ones, normalized."""
    return F.regexp_replace(F.translate(normalize(path), "/", "\\"), r"\\+$", "")


def compact_name(name: Column) -> Column:
    """The name without white space and underscores, or null if it has none."""
    return F.when(name.rlike(r"[\s_]"), F.regexp_replace(name, r"[\s_]+", ""))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def html_to_text(html: Column) -> Column:
    """Scripts and styles go, block ends become line ends, other tags spaces; five entities; blanks collapse."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def sort_time(time: Column, now_ms: int) -> Column:
    """Times more than a day ahead count as unknown when sorting."""
    return F.when(time > now_ms + 86_400_000, F.lit(0).cast("long")).otherwise(time)


def find_urls(text: Column) -> Column:
    """http(s) URLs without punctuation at their end."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def mail_uri(scheme: str, account: Column, folder: Column, validity: Column, uid: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.url_encode(account), F.lit("/"), F.url_encode(folder), F.lit("/"), validity.cast("string"), F.lit("/"), F.url_encode(uid.cast("string")))


def parse_mail_uri(uri: Column) -> Column:
    part = lambda i: F.url_decode(F.regexp_extract(uri, "^(imap|pop3)://([^/]*)/([^/]*)/([^/]*)/(.*)$", i))
    return F.struct(part(1).alias("scheme"), part(2).alias("account"), part(3).alias("folder"), part(4).alias("validity"), part(5).alias("uid"))


def size_text(size: Column) -> Column:
    return F.when(size < 1024 * 1024, F.concat(F.greatest(F.lit(1), F.round(size / 1024).cast("long")).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_number(size / 1048576, 1), F.lit(" MB")))


def describe_location(loc: Column) -> Column:
    """A label such as ``page 2, line 3`` from a location struct; attachment names come first."""
    has = lambda k: loc[k].isNotNull()
    label = lambda word, k: F.when(has(k), F.concat(F.lit(word), loc[k].cast("string")))
    return F.concat_ws(
        ", ",
        F.when(has("attachment"), F.concat(F.lit("attachment "), loc["attachment"])),
        F.when(loc["mail"] == "header", F.lit("mail header")).when(loc["mail"] == "body", F.lit("mail body")),
        label("section ", "section"),
        label("sheet ", "sheet"),
        label("cell ", "cell"),
        label("slide ", "slide"),
        label("page ", "page"),
        label("paragraph ", "paragraph"),
        label("line ", "line"),
    )


def resolve_location(marks: Column, at: Column) -> Column:
    """The location of the last mark whose offset is at most ``at``; the first mark's if there is none."""
    before = F.filter(marks, lambda m: m["offset"] <= at)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(marks, F.lit(1)))["loc"]
