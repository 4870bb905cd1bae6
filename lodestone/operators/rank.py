"""Scoring, order and cut-offs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import query as q
from lodestone.functions import text as t

from .catalog import matches_filters
from .fuzzy import contains_fuzzy


def _hits(token: str) -> Column:
    """Whether a token is in the name or path, spaces aside."""
    tight = "".join(token.split())
    spaced = tight != token
    out = F.contains("name_norm", F.lit(token)) | F.contains("path_norm", F.lit(token)) | F.coalesce(F.contains("name_compact", F.lit(tight)), F.lit(False))
    return out | F.contains(F.regexp_replace("path_norm", r"\s+", ""), F.lit(tight)) if spaced else out


def scored(entries: DataFrame, tokens: list[str], options: q.SearchOptions, content: DataFrame | None = None) -> DataFrame:
    """Entries that match every token in name, path or content, with ``score``, ``fuzzy`` and where they matched.

    ``content(path, terms, fuzzy_terms)`` has a row for each path with content matches.
    """
    rows = entries.filter(matches_filters(options))
    if content is not None:
        rows = rows.join(content, "path", "left")
    else:
        rows = rows.withColumns({"terms": F.array().cast("array<string>"), "fuzzy_terms": F.array().cast("array<string>")})
    keep, score, fuzzy, by_name, by_content = F.lit(True), F.lit(0), F.lit(False), F.lit(False), F.lit(False)
    for token in tokens:
        exact = _hits(token)
        inside = F.coalesce(F.array_contains("terms", token), F.lit(False))
        typos = options.fuzzy and q.may_have_typo(token)
        near = ~exact & ~inside & contains_fuzzy(F.coalesce("name_compact", "name_norm"), token) if typos else F.lit(False)
        named = exact | near
        keep = keep & (named | inside)
        fuzzy = fuzzy | near | (inside & ~named & F.coalesce(F.array_contains("fuzzy_terms", token), F.lit(False)))
        name = F.when(F.col("name_norm") == token, 120).when(F.startswith("name_norm", F.lit(token)), 70).when(F.contains("name_norm", F.lit(token)), 45).otherwise(0)
        score = score + F.when(named, name + F.when(F.contains("path_norm", F.lit(token)), 15).otherwise(0)).otherwise(0) + F.when(inside, 30).otherwise(0)
        by_name, by_content = by_name | named, by_content | inside
    score = score + F.when(F.col("kind") == "folder", 3).otherwise(0)
    matched = F.array_compact(F.array(F.when(by_name, F.lit("name")), F.when(by_content, F.lit("content"))))
    return rows.filter(keep).withColumns({"score": score.cast("int"), "fuzzy": fuzzy, "matched_in": matched})


def by_relevance() -> list[Column]:
    return [F.col("fuzzy"), F.col("score").desc(), F.col("name_norm"), F.col("path")]


def top(rows: DataFrame, options: q.SearchOptions) -> DataFrame:
    """The first ``limit`` rows: by relevance, or the newest among the NEWEST_CANDIDATES most relevant."""
    ordered = rows.orderBy(*by_relevance())
    if options.sort == "newest":
        ordered = ordered.limit(q.NEWEST_CANDIDATES)
        time = t.sort_time(F.col("time"), options.now_ms) if options.now_ms is not None else F.col("time")
        ordered = ordered.orderBy("fuzzy", time.desc_nulls_last(), F.col("score").desc(), "name_norm", "path")
    return ordered.limit(options.limit)


def merged(first: DataFrame, second: DataFrame, limit: int = q.PAGE) -> DataFrame:
    """Two sources' top rows, ordered again without the name."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.orderBy("fuzzy", F.col("score").desc(), "path").limit(limit)


def in_mailboxes(mails: DataFrame, options: q.SearchOptions) -> DataFrame:
    """The mails of the chosen ``account TAB folder`` keys; of all without a choice."""
    return mails.filter(F.concat_ws("\t", "account", "folder").isin(options.mail_folders)) if options.mail_folders else mails


def search(entries: DataFrame, mails: DataFrame, text: str, options: q.SearchOptions, content: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The first rows of files and mails together, and the matches of each source that is asked for, for their totals.

    ``source`` is ``pc``, ``mail`` or ``all``; scopes, kinds and extensions don't concern mails, and ``names_only``
    leaves contents out.
    """
    tokens, content = q.tokenize(text), None if options.names_only else content
    plain = replace(options, scopes=[], kind=None, extensions=[])
    sources = [(entries, options)] * (options.source != "mail") + [(in_mailboxes(mails, options), plain)] * (options.source != "pc")
    found = [scored(rows, tokens, o, content).withColumn("source", F.lit("pc" if o is options else "mail")) for rows, o in sources]
    shown = [top(f, options) for f in found]
    if len(shown) == 1:
        return shown[0], found
    both = shown[0].unionByName(shown[1], allowMissingColumns=True)
    first = [F.col("fuzzy")]
    if options.sort == "newest":
        first.append((t.sort_time(F.col("time"), options.now_ms) if options.now_ms is not None else F.col("time")).desc_nulls_last())
    return both.orderBy(*first, F.col("score").desc(), "path").limit(options.limit), found
