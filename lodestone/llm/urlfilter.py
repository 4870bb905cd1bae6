"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of a multiword Shift-And mask. For every URL one state vector advances
over its canonical form; a shift, an OR and an AND for each symbol move all patterns at once, and a bit before a ``*``
keeps itself. URLs advance together, a column of symbols at a time, as rows of a numpy matrix.

The canonical form of a URL is a dot, the host, a boundary symbol that no byte equals, and the path, in UTF-8 bytes. A
rule of host ``h`` and path ``p`` is the glob ``*.h<boundary>p*``: the dot makes it fit the host and its subdomains
only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols: 0-255 bytes, then the host's end, then padding, which only the loops of ``*`` survive.
BOUNDARY, PAD, SYMBOLS = 256, 257, 258


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query judges by.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def rule_glob(rule: UrlRule) -> list[int | str]:
    """The rule as symbols, "*" for any run of symbols, and "?" for any one if the path has them."""
    path: list[int | str] = []
    for c in rule.path:
        path += [c] if c in "*?" else list(c.encode())
    return ["*", *b".", *rule.host.encode(), BOUNDARY, *path, "*"]


class GlobAutomaton:
    """All patterns in one row of 64-bit words; bit ``first[r] + k``: k symbols of pattern r have been read.

    Runs of ``*`` take no bit of their own: the bit that they follow loops on every symbol. Patterns are anchored at
    both ends.
    """

    def __init__(self, patterns: list[list[int | str]]):
        spans, at = [], 0
        for p in patterns:
            size = 1 + sum(x != "*" for x in p)
            spans.append((at, size))
            at += size
        self.words = max(1, -(-at // 64))
        loop, accept = [False] * at, []
        arrive = np.zeros((SYMBOLS, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.loops = np.zeros(self.words, np.uint64)
        bit = lambda k: (k // 64, np.uint64(1) << np.uint64(k % 64))
        for (first, size), p in zip(spans, patterns):
            k = first
            w, b = bit(k)
            self.start[w] |= b
            for x in p:
                if x == "*":
                    loop[k] = True
                    continue
                k += 1
                w, b = bit(k)
                for symbol in range(PAD) if x == "?" else [x]:
                    arrive[symbol, w] |= b
            accept.append(bit(first + size - 1))
        for k in range(at):
            if loop[k]:
                w, b = bit(k)
                self.loops[w] |= b
        self.arrive, self.accept = arrive, accept

    def run(self, symbols: list[np.ndarray]) -> np.ndarray:
        """A Boolean matrix (row, pattern); rows leave as they end, so the work is the symbols' number."""
        n = len(symbols)
        out = np.zeros((n, len(self.accept)), bool)
        if not n:
            return out
        sizes = np.array([len(s) for s in symbols])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([symbols[i] for i in order]) if sizes.sum() else np.zeros(0, np.int64)
        offsets = np.r_[0, np.cumsum(sizes[order])[:-1]]
        state = np.repeat(self.start[None, :], n, axis=0)
        live = n
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(sizes.max())):
            while live and sizes[order[live - 1]] <= pos:
                live -= 1
            read = self.arrive[flat[offsets[:live] + pos]]
            now = state[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & read) | (now & self.loops)
        for r, (w, b) in enumerate(self.accept):
            out[order, r] = (state[:, w] & b) != 0
        return out


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. Without ``://``, or null: both empty. Of the rules that fit, the longest text wins, then the
    longest host, then the first given. No rule: null, and the verdict is ``default``. Rows and other columns are kept;
    existing columns of the four names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    split = pages.withColumns({"host": host, "path": path})
    names = split.columns
    h, p = names.index("host"), names.index("path")
    globs = [rule_glob(r) for r in rules]
    rank = sorted(range(len(rules)), key=lambda r: (-len(rules[r].text), -len(rules[r].host), r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        for batch in batches:
            symbols = []
            for a, b in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist()):
                symbols.append(np.array([46, *a.encode(), BOUNDARY, *b.encode()], np.int64))
            fits = automaton.run(symbols)
            chosen = np.full(batch.num_rows, -1)
            for r in reversed(rank):
                chosen[fits[:, r]] = r
            rule = pa.array([rules[r].text if r >= 0 else None for r in chosen], pa.string())
            verdict = pa.array([rules[r].verdict if r >= 0 else default for r in chosen], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*names, "rule", "verdict"])

    schema = split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).schema
    return split.mapInArrow(run, schema)


def op8_query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, verdict, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""
