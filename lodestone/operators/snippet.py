"""Snippets and highlight ranges, for the shown rows only."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions import query as q
from lodestone.functions.text import READINGS, loose

RADIUS = 40


def snippet(text: Column, term: str, radius: int = RADIUS) -> Column:
    """``struct(at, before, match, after)`` around the first match; without one, the text's head and no match."""
    pattern = q.term_regex(term)
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.length(F.element_at(F.split(text, pattern, 2), 1))
    until = at + F.length(found)
    start, end = F.greatest(at - radius, F.lit(0)), F.least(F.length(text), until + radius)
    before = F.concat(F.when(start > 0, F.lit("…")).otherwise(""), F.substring(text, start + 1, at - start))
    after = F.concat(F.substring(text, until + 1, end - until), F.when(end < F.length(text), F.lit("…")).otherwise(""))
    head = F.substring(text, 1, 2 * radius)
    more = F.when(F.length(text) > 2 * radius, F.lit("…")).otherwise("")
    hit = F.struct(at.alias("at"), squeeze(before).alias("before"), squeeze(found).alias("match"), squeeze(after).alias("after"))
    miss = F.struct(F.lit(None).cast("int").alias("at"), squeeze(head).alias("before"), F.lit("").alias("match"), more.alias("after"))
    return F.when(found.isNotNull(), hit).otherwise(miss)


def ranges(text: str, terms: list[str], is_loose: bool = False) -> list[tuple[int, int]]:
    """Non-overlapping ranges of all terms over the text and its readings: earliest first, then longest."""
    forms = [text]
    if any(c in READINGS for c in text):
        forms += ["".join(READINGS.get(c, c)[0] for c in text), "".join(READINGS.get(c, c)[-1:] if len(READINGS.get(c, c)) > 1 else READINGS.get(c, c) for c in text)]
    if is_loose:
        forms.append(loose(text))
    spans = set()
    for term in terms:
        for form in forms:
            for one in {term, loose(term)} if is_loose else {term}:
                pattern = q.term_regex(one)
                if pattern:
                    spans.update(m.span() for m in regex.finditer(pattern.replace("(?iu)", ""), form, regex.I) if m.end() > m.start())
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def find_ranges(text: Column, terms: list[str], is_loose: bool = False) -> Column:
    @pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b} for a, b in ranges(unicodedata.normalize("NFKC", t or ""), terms, is_loose)])

    return run(text)


def marked(text: str, spans: list[tuple[int, int]], tag: str = "mark") -> str:
    """The text with its ranges tagged."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], f"<{tag}>", text[a:b], f"</{tag}>"]
        at = b
    return "".join(out) + text[at:]


def find_phrase(text: str, match: str) -> str:
    """A match grown to the words around it."""
    found = re.search(r"(\S+\s+)?\S*" + re.escape(match) + r"\S*(\s+\S+)?", text)
    return found[0] if found else match
