"""What comes after OCR: line order, union of engines, medians, vertical columns, image sizes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SCORE = 0.45


def line_order(words: DataFrame, image: str = "image") -> DataFrame:
    """Lines without blank ones and unsure ones, numbered from top to bottom, then left to right."""
    kept = words.filter((F.trim("text") != "") & (F.coalesce(F.col("score"), F.lit(1.0)) >= LEAST_SCORE))
    return kept.withColumn("line", F.row_number().over(Window.partitionBy(image).orderBy("y", "x", "text")))


def union_lines(first: DataFrame, second: DataFrame, image: str = "image") -> DataFrame:
    """Two engines' lines ``(image, line, text)``; a text is kept once, spaces aside, and lines are numbered anew."""
    both = first.withColumn("engine", F.lit(1)).unionByName(second.withColumn("engine", F.lit(2)))
    key = F.regexp_replace("text", r"\s+", "")
    once = both.withColumn("k", F.row_number().over(Window.partitionBy(image, key).orderBy("engine", "line"))).filter("k = 1")
    return once.select(image, F.row_number().over(Window.partitionBy(image).orderBy("engine", "line")).alias("line"), "text")


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def _middle(values) -> float:
    return float(sorted(values)[len(values) // 2])


def _columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words of one image. Going from left to right, a word joins the first column whose mean centre is within 0.6 of
    the column's first height (or the word's, if larger); columns come in the order of their first words, and their
    means in an array, so each word is one comparison of arrays. A column then breaks where the space below a word is
    more than 1.5 times the height of the larger of the two words."""
    text = pdf.text.fillna("").str.strip()
    cells = pdf.assign(text=text, w=pdf.w.clip(lower=1), h=pdf.h.clip(lower=1))[text.str.fullmatch(r".|\d{1,3}")]
    cells = cells.assign(cx=cells.x + (pdf.w / 2).loc[cells.index]).sort_values("cx", kind="stable")
    means, sizes, counts, owner = np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells), int), []
    n = 0
    for centre, height in zip(cells.cx, cells.h):
        fits = np.nonzero(np.abs(means[:n] - centre) <= 0.6 * np.maximum(sizes[:n], height))[0]
        at = int(fits[0]) if len(fits) else n
        if at == n:
            means[n], sizes[n], n = centre, height, n + 1
        counts[at] += 1
        means[at] += (centre - means[at]) / counts[at]
        owner.append(at)
    out = []
    for at, column in cells.assign(owner=owner).groupby("owner"):
        column = column.sort_values("y", kind="stable")
        y, h = column.y.to_numpy(float), column.h.to_numpy(float)
        breaks = np.nonzero(y[1:] - (y[:-1] + h[:-1]) > 1.5 * np.maximum(h[:-1], h[1:]))[0] + 1
        for a, b in zip([0, *breaks], [*breaks, len(column)]):
            if b - a > 1:
                run, steps = column.iloc[a:b], np.diff(y[a:b])
                height = _middle(h[a:b])
                pitch = _middle(steps[steps > 0]) if (steps > 0).any() else 1.3 * height
                out.append((pdf.image.iloc[0], "".join(run.text), means[at], y[a], _middle(run.w), height, pitch))
    out.sort(key=lambda r: (r[2], r[3]))
    return pd.DataFrame([(r[0], i, *r[1:]) for i, r in enumerate(out)], columns=["image", "no", "text", "x", "y", "char_width", "char_height", "pitch"])


def vertical_columns(words: DataFrame) -> DataFrame:
    """Words of one character (or one to three digits) stacked into columns, an image at a time: the column's text, mean
    centre and top, and the upper medians of its characters' widths, heights and distances."""
    schema = "image string, no int, text string, x double, y double, char_width double, char_height double, pitch double"
    return words.select("image", "text", "x", "y", "w", "h").groupBy("image").applyInPandas(_columns, schema)


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first bytes of a PNG, GIF, BMP, WebP or JPEG."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8":
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM":
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind = head[12:16]
        if kind == b"VP8X":
            return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
        if kind == b"VP8 ":
            return tuple(x & 0x3FFF for x in struct.unpack("<HH", head[26:30]))
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            if head[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def skip_image(path: Column, size: Column, width: Column, height: Column) -> Column:
    """System pictures and icons: under 100 pixels, or of unknown size and under 2 KiB."""
    system = path.rlike(r"(?i)[\\/](windows|program files|appdata)[\\/]")
    return system | F.coalesce(F.greatest(width, height) < 100, size < 2048)
