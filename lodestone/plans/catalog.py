"""The registered queries of the search engine and their SQL.

Carriers: ``part`` rows stand for catalog entries, ``documents`` for files, ``conversations`` for mails, ``events`` for
a change log and ``lineitem`` for word boxes. Every query runs over its whole tables and ends in a unique order or in
no order at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import query as q
from lodestone.functions import text as t
from lodestone.operators import catalog as cat
from lodestone.operators import fuzzy, index, mail, match, ocr, rank, snippet
from lodestone.session import spread, table
from lodestone.streaming import watch

#: A fixed clock for the newest-first queries: 2024-01-05T00:00:00Z in milliseconds.
NOW_MS = 1_704_412_800_000
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# -- carriers ---------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    path = F.concat_ws("\\", "p_brand", "p_type", F.concat("p_name", F.lit("-"), "p_partkey"))
    kind = F.when(F.col("p_size") % 10 == 0, F.lit("folder")).otherwise(F.lit("file"))
    return cat.with_keys(p.select(F.col("p_name").alias("name"), path.alias("path"), kind.alias("kind"), F.lower("p_type").alias("extension"), F.col("p_partkey").alias("mtime")))


PARTS = """parts AS (
  SELECT p_name AS name, p_brand || '\\' || p_type || '\\' || p_name || '-' || p_partkey AS path,
    CASE WHEN p_size % 10 = 0 THEN 'folder' ELSE 'file' END AS kind, lower(p_type) AS extension, p_partkey AS mtime FROM part
), keyed AS (
  SELECT *, lower(name) AS name_norm, lower(path) AS path_norm, regexp_replace(lower(name), '[\\s_]+', '', 'g') AS name_compact FROM parts
)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return index.chunks(_files(spark, sf))


def _index(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    chunks = _chunks(spark, sf)
    return {"chunks": chunks, "postings": index.postings(chunks)}


CHUNKS = """lines AS (
  SELECT doc_id, line_no, txt, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS txt
    FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents)) WHERE txt <> ''
), rec AS (
  SELECT doc_id, n, 0 AS chunk_no, length(txt) AS size FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN r.size >= 800 THEN r.chunk_no + 1 ELSE r.chunk_no END,
    CASE WHEN r.size >= 800 THEN length(l.txt) ELSE r.size + length(l.txt) END
  FROM rec r JOIN lines l ON l.doc_id = r.doc_id AND l.n = r.n + 1
), chunks AS (
  SELECT doc_id AS file_id, doc_id * 1048576 + chunk_no AS chunk_id, chunk_no, string_agg(txt, chr(10) ORDER BY n) AS text
  FROM rec JOIN lines USING (doc_id, n) GROUP BY ALL
)"""
POSTINGS = (
    CHUNKS
    + """, postings AS (
  SELECT file_id, chunk_id, unnest(r) AS tok, unnest(range(len(r))) AS pos
  FROM (SELECT file_id, chunk_id, regexp_extract_all(strip_accents(lower(text)), '\\p{L}+|\\p{N}+') AS r FROM chunks)
)"""
)


def _pair(a: str, b: str) -> str:
    """Chunks in which the tokens follow each other; ``b`` may be an SQL condition on y.tok."""
    return f"SELECT DISTINCT x.chunk_id, x.file_id FROM postings x JOIN postings y ON x.chunk_id = y.chunk_id AND y.pos = x.pos + 1 WHERE x.tok = '{a}' AND {b}"


_LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


# -- text functions ---------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, len(r)::BIGINT AS n_runs, md5(array_to_string(r, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+') AS r FROM documents)")
def text_runs(spark, sf):
    runs = t.text_runs(t.normalize(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.md5(F.array_join(runs, " ")).alias("digest"))


@_query(f"WITH RECURSIVE {POSTINGS} SELECT tok, count(DISTINCT chunk_id) AS doc FROM postings GROUP BY tok")
def token_df(spark, sf):
    return index.chunk_vocabulary(_chunks(spark, sf))


@_query(
    "SELECT tok, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '\\p{L}+|\\p{N}+')) AS tok FROM documents) GROUP BY tok"
)
def folded_vocab(spark, sf):
    toks = t.tokens(t.fold_accents(t.normalize(F.col("text"))))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(toks)).alias("tok")).groupBy("tok").agg(F.count("*").alias("files"))


@_query(
    "SELECT p_partkey, array_to_string(CASE WHEN length(s) > 1 THEN list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) ELSE [s] END, ' ') AS pairs FROM (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part)"
)
def bigram_tokens(spark, sf):
    s = F.replace("p_name", F.lit(" "), F.lit(""))
    pairs = F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array(s))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pairs, " ").alias("pairs"))


@_query(
    """SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
  '(?i)<br\\s*/?>|</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))) AS digest FROM pages"""
)
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(t.html_to_text(F.col("html"))).alias("digest"))


@_query(
    "SELECT page_id, k::BIGINT AS k, regexp_replace(u, '[.,;:!?)\\]]+$', '') AS url FROM (SELECT page_id, unnest(r) AS u, unnest(range(len(r))) AS k FROM (SELECT page_id, regexp_extract_all(html || ' ' || url, 'https?://[^\\s<>\"'']+') AS r FROM pages))"
)
def url_extract(spark, sf):
    urls = t.find_urls(F.concat_ws(" ", "html", "url"))
    return table(spark, sf, "pages").select("page_id", F.posexplode(urls).alias("k", "url")).select("page_id", *_LONG("k"), "url")


# -- chunks and positions ---------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {CHUNKS} SELECT file_id, chunk_id, chunk_no::BIGINT AS chunk_no, length(text)::BIGINT AS size, md5(text) AS digest FROM chunks")
def chunk_lines(spark, sf):
    return _chunks(spark, sf).select("file_id", "chunk_id", *_LONG("chunk_no"), F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


MARKS = (
    CHUNKS
    + """, marks AS (
  SELECT doc_id, chunk_no, line_no, (coalesce(sum(length(txt)) OVER w, 0) + row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY n) - 1)::BIGINT AS off
  FROM rec JOIN lines USING (doc_id, n)
  WINDOW w AS (PARTITION BY doc_id, chunk_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
)


@_query(f"WITH RECURSIVE {MARKS} SELECT doc_id * 1048576 + chunk_no AS chunk_id, string_agg(off || ':' || line_no, ',' ORDER BY off) AS marks FROM marks GROUP BY ALL")
def chunk_marks(spark, sf):
    pairs = F.transform("marks", lambda m: F.concat_ws(":", m["offset"], m["line"]))
    return _chunks(spark, sf).select("chunk_id", F.array_join(pairs, ",").alias("marks"))


@_query(f"WITH RECURSIVE {MARKS} SELECT doc_id * 1048576 + chunk_no AS chunk_id, 'line ' || arg_max(line_no, off) AS label FROM marks WHERE off <= 400 GROUP BY ALL")
def location_label(spark, sf):
    names = ["attachment", "mail", "section", "sheet", "cell", "slide", "page", "paragraph"]
    empty = [F.lit(None).cast("string").alias(n) for n in names]
    marks = F.transform("marks", lambda m: F.struct(m["offset"].alias("offset"), F.struct(*empty, m["line"].alias("line")).alias("loc")))
    at = _chunks(spark, sf).select("chunk_id", t.resolve_location(marks, F.lit(400)).alias("loc"))
    return at.select("chunk_id", t.describe_location(F.col("loc")).alias("label"))


@_query(f"WITH RECURSIVE {CHUNKS} SELECT file_id, min(chunk_id) AS min_chunk, max(chunk_id) AS max_chunk FROM chunks GROUP BY file_id")
def chunk_bounds(spark, sf):
    return index.chunk_bounds(_chunks(spark, sf))


# -- matching ---------------------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {POSTINGS} " + _pair("of", "y.tok = 'the'"))
def phrase_match(spark, sf):
    return match.phrase(_index(spark, sf)["postings"], ["of", "the"])


@_query(f"WITH RECURSIVE {POSTINGS} " + _pair("of", "starts_with(y.tok, 'tha')"))
def phrase_prefix(spark, sf):
    return match.any_phrase(_index(spark, sf)["postings"], q.phrases("of tha"))


@_query(f"WITH RECURSIVE {POSTINGS} {_pair('by', 'y.tok = ' + chr(39) + 'the' + chr(39))} UNION {_pair('la', 'y.tok = ' + chr(39) + 'de' + chr(39))}")
def phrase_or_union(spark, sf):
    return match.any_phrase(_index(spark, sf)["postings"], q.Phrases([["by", "the"], ["la", "de"]], False))


@_query(
    f"WITH RECURSIVE {POSTINGS} SELECT c.chunk_id, c.file_id FROM chunks c WHERE chunk_id IN (SELECT chunk_id FROM postings WHERE tok = 'with' INTERSECT SELECT chunk_id FROM postings WHERE tok = 'the') AND regexp_matches(text, '(?i)with[^\\p{{L}}\\p{{N}}]*the')"
)
def runs_intersect(spark, sf):
    ix = _index(spark, sf)
    both = match.phrase(ix["postings"], ["with"]).intersect(match.phrase(ix["postings"], ["the"]))
    return match.verified(both, ix["chunks"], q.term_regex("with the"))


@_query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, file_id FROM chunks WHERE contains(lower(text), 'ñ')")
def char_match(spark, sf):
    chunks = _chunks(spark, sf)
    letters = F.array_distinct(F.regexp_extract_all(t.normalize(F.col("text")), F.lit(r"\p{L}"), F.lit(0)))
    chars = chunks.select(F.explode(letters).alias("ch"), "chunk_id", "file_id")
    return match.verified(chars.filter("ch = 'ñ'").select("chunk_id", "file_id"), chunks, q.term_regex("ñ"))


@_query(f"WITH RECURSIVE {POSTINGS} SELECT chunk_id, file_id FROM ({_pair('by', 'y.tok = ' + chr(39) + 'nc' + chr(39))}) WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE contains(lower(text), 'by-nc'))")
def strict_term(spark, sf):
    return match.match_term(_index(spark, sf), "BY-NC")


@_query(
    f"WITH RECURSIVE {POSTINGS} SELECT file_id, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM (SELECT file_id, 'with' AS term FROM postings WHERE starts_with(tok, 'with') UNION SELECT file_id, 'the' FROM postings WHERE starts_with(tok, 'the')) GROUP BY file_id HAVING count(DISTINCT term) = 2"
)
def content_and(spark, sf):
    found = match.quick(_index(spark, sf), ["with", "the"]).filter(F.size("terms") == 2)
    return found.select("file_id", F.array_join("terms", " ").alias("terms"))


TOP3 = "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS rn FROM"


@_query(f"WITH RECURSIVE {POSTINGS} SELECT file_id, chunk_id, rn::BIGINT AS rn FROM ({TOP3} ({_pair('of', 'y.tok = ' + chr(39) + 'the' + chr(39))})) WHERE rn <= 3")
def top3_chunks(spark, sf):
    return index.first_per_file(match.phrase(_index(spark, sf)["postings"], ["of", "the"])).select("file_id", "chunk_id", *_LONG("rn"))


@_query(f"WITH RECURSIVE {POSTINGS} SELECT chunk_id, file_id FROM (SELECT *, dense_rank() OVER (ORDER BY file_id) AS r FROM (SELECT DISTINCT chunk_id, file_id FROM postings WHERE tok = 'that')) WHERE r <= 200")
def first_files_cap(spark, sf):
    return fuzzy.first_files(match.phrase(_index(spark, sf)["postings"], ["that"])).select("chunk_id", "file_id")


# -- catalog search ---------------------------------------------------------------------------------------------------


def _score(*tokens: str) -> str:
    parts = []
    for x in tokens:
        parts.append(
            f"CASE WHEN contains(name_norm, '{x}') OR contains(path_norm, '{x}') OR contains(name_compact, '{x}') THEN CASE WHEN name_norm = '{x}' THEN 120 WHEN starts_with(name_norm, '{x}') THEN 70 WHEN contains(name_norm, '{x}') THEN 45 ELSE 0 END + CASE WHEN contains(path_norm, '{x}') THEN 15 ELSE 0 END ELSE 0 END"
        )
    return " + ".join(parts) + " + CASE WHEN kind = 'folder' THEN 3 ELSE 0 END"


def _named(*tokens: str) -> str:
    return " AND ".join(f"(contains(name_norm, '{x}') OR contains(path_norm, '{x}') OR contains(name_compact, '{x}'))" for x in tokens)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("path", "name", "kind", F.col("score").cast("long").alias("score"))


def _names_sql(tokens: tuple[str, ...], extra: str = "true", limit: int = 200) -> str:
    return f"WITH {PARTS} SELECT path, name, kind, ({_score(*tokens)})::BIGINT AS score FROM keyed WHERE {_named(*tokens)} AND {extra} ORDER BY score DESC, name_norm, path LIMIT {limit}"


def _search_names(spark, sf, text: str, **options) -> DataFrame:
    o = q.SearchOptions(**options)
    return _shown(rank.top(rank.scored(_parts(spark, sf), q.tokenize(text), o), o))


@_query(_names_sql(("ring", "small")))
def name_search(spark, sf):
    return _search_names(spark, sf, "Ring small")


@_query(_names_sql(("smallring",)))
def name_compact(spark, sf):
    return _search_names(spark, sf, "smallring")


@_query(_names_sql(("r",), "(path_norm = 'brand#2' OR starts_with(path_norm, 'brand#2\\') OR starts_with(path_norm, 'brand#17\\economy\\'))"))
def scope_filter(spark, sf):
    return _search_names(spark, sf, "r", scopes=["Brand#2", "Brand#17/ECONOMY/"])


@_query(_names_sql(("red",), "kind = 'folder'"))
def kind_filter(spark, sf):
    return _search_names(spark, sf, "red", kind="folder")


@_query(_names_sql(("blue",), "kind = 'file' AND extension IN ('small', 'promo')"))
def ext_filter(spark, sf):
    return _search_names(spark, sf, "blue", extensions=["*.small", ".PROMO", "small"])


@_query(f"WITH {PARTS}, s AS (SELECT path, ({_score('red')})::BIGINT AS score, count(*) OVER () AS total, row_number() OVER (ORDER BY {_score('red')} DESC, name_norm, path) AS k FROM keyed WHERE {_named('red')}) SELECT path, score, total FROM s WHERE k <= 200")
def total_and_limit(spark, sf):
    o = q.SearchOptions()
    found = rank.scored(_parts(spark, sf), ["red"], o)
    total = found.agg(F.count("*").alias("total"))
    return _shown(rank.top(found, o)).select("path", "score").join(F.broadcast(total))


def _event_entries(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    name = F.concat("event_type", F.lit(" "), "event_id")
    rows = e.select(name.alias("name"), F.concat_ws("\\", "event_type", name).alias("path"), F.lit("file").alias("kind"), F.lit("").alias("extension"), F.lit(0).cast("long").alias("mtime"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("time"))
    return cat.with_keys(rows)


@_query(
    f"""WITH keyed AS (
  SELECT event_type || ' ' || event_id AS name_norm, event_type || '\\' || event_type || ' ' || event_id AS path_norm, epoch_us(ts) // 1000 AS time, event_id FROM events
), hit AS (
  SELECT *, CASE WHEN starts_with(name_norm, 'click') THEN 70 WHEN contains(name_norm, 'click') THEN 45 ELSE 0 END + 15 AS score FROM keyed WHERE contains(path_norm, 'click')
), best AS (SELECT * FROM hit ORDER BY score DESC, name_norm, path_norm LIMIT 20000)
SELECT path_norm AS path, time, score::BIGINT AS score FROM best ORDER BY CASE WHEN time > {NOW_MS + 86_400_000} THEN 0 ELSE time END DESC, score DESC, name_norm, path_norm LIMIT 200"""
)
def newest_sort(spark, sf):
    o = q.SearchOptions(sort="newest", now_ms=NOW_MS)
    return rank.top(rank.scored(_event_entries(spark, sf), ["click"], o), o).select("path", "time", *_LONG("score"))


def _doc_entries(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))
    rows = d.select(name.alias("name"), F.concat_ws("\\", "source", "lang", name).alias("path"), F.lit("file").alias("kind"), F.col("lang").alias("extension"), F.lit(0).cast("long").alias("mtime"), F.col("doc_id").alias("file_id"))
    return cat.with_keys(rows)


DOCS = "keyed AS (SELECT doc_id AS file_id, 'doc' || doc_id || '.txt' AS name_norm, source || '\\' || lang || '\\doc' || doc_id || '.txt' AS path_norm, lang AS extension FROM documents)"


def _content(spark, sf, terms: list[str], entries: DataFrame) -> DataFrame:
    found = match.quick(_index(spark, sf), terms)
    return entries.select("path", "file_id").join(found, "file_id").select("path", "terms", F.array().cast("array<string>").alias("fuzzy_terms"))


@_query(
    f"""WITH RECURSIVE {POSTINGS}, {DOCS}, hit AS (SELECT DISTINCT file_id FROM postings WHERE starts_with(tok, 'with'))
SELECT path_norm AS path, (CASE WHEN starts_with(name_norm, 'doc1') THEN 70 ELSE 0 END + 15 + 30)::BIGINT AS score, 'name,content' AS matched
FROM keyed JOIN hit USING (file_id) WHERE contains(path_norm, 'doc1') ORDER BY score DESC, name_norm, path LIMIT 200"""
)
def combined_search(spark, sf):
    entries, o = _doc_entries(spark, sf), q.SearchOptions()
    content = _content(spark, sf, ["with", "doc1"], entries)
    found = rank.top(rank.scored(entries, ["doc1", "with"], o, content), o)
    return found.select("path", *_LONG("score"), F.array_join("matched_in", ",").alias("matched"))


def _mails(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    uid = F.col("conv_id") * 1000 + F.col("turn")
    subject = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60)
    path = F.concat(F.lit("imap://box/"), "role", F.lit("/1/"), uid.cast("string"))
    return c.select(path.alias("path"), F.lit("box").alias("account"), F.col("role").alias("folder"), uid.alias("uid"), subject.alias("subject"), F.lit("someone").alias("sender"), F.lit("2024-01-01T00:00:00Z").alias("sent_at"), F.lit("1").alias("uid_validity"))


MAILS = "mails AS (SELECT 'imap://box/' || role || '/1/' || (conv_id * 1000 + turn) AS path, 'box' AS account, role AS folder, conv_id * 1000 + turn AS uid, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60) AS subject, 'someone' AS sender, '2024-01-01T00:00:00Z' AS sent_at, '1' AS uid_validity FROM conversations)"


@_query(
    f"""WITH {PARTS}, {MAILS}, pc AS (SELECT path, ({_score('a')})::BIGINT AS score FROM keyed WHERE {_named('a')} ORDER BY score DESC, name_norm, path LIMIT 200),
mk AS (SELECT path, CASE WHEN subject = '' THEN '(no subject)' ELSE lower(subject) END AS name_norm, lower(path) AS path_norm, regexp_replace(lower(CASE WHEN subject = '' THEN '(no subject)' ELSE subject END), '[\\s_]+', '', 'g') AS name_compact, 'mail' AS kind FROM mails),
m AS (SELECT path, ({_score('a')})::BIGINT AS score FROM mk WHERE {_named('a')} ORDER BY score DESC, name_norm, path LIMIT 200)
SELECT path, score FROM (SELECT * FROM pc UNION ALL SELECT * FROM m) ORDER BY score DESC, path LIMIT 200"""
)
def merge_sources(spark, sf):
    o = q.SearchOptions()
    mails = cat.with_keys(mail.entries(_mails(spark, sf)))
    a, b = (rank.top(rank.scored(x, ["a"], o), o).select("path", "score", "fuzzy") for x in (_parts(spark, sf), mails))
    return rank.merged(a, b).select("path", *_LONG("score"))


@_query(
    f"""WITH {MAILS}, mk AS (SELECT path, CASE WHEN subject = '' THEN '(no subject)' ELSE lower(subject) END AS name_norm, lower(path) AS path_norm, regexp_replace(lower(CASE WHEN subject = '' THEN '(no subject)' ELSE subject END), '[\\s_]+', '', 'g') AS name_compact, 'mail' AS kind FROM mails WHERE folder = 'user')
SELECT path, ({_score('a')})::BIGINT AS score, 'mail' AS source FROM mk WHERE {_named('a')} ORDER BY score DESC, name_norm, path LIMIT 200"""
)
def source_mail(spark, sf):
    o = q.SearchOptions(source="mail", mail_folders=["box\tuser"], extensions=["small"], kind="file")
    shown, _ = rank.search(_parts(spark, sf), cat.with_keys(mail.entries(_mails(spark, sf))), "a", o)
    return shown.select("path", *_LONG("score"), "source")


@_query(
    f"""WITH {PARTS}, {MAILS}, pc AS (SELECT path, ({_score('a')})::BIGINT AS score, 'pc' AS source FROM keyed WHERE {_named('a')} AND kind = 'file' ORDER BY score DESC, name_norm, path LIMIT 200),
mk AS (SELECT path, CASE WHEN subject = '' THEN '(no subject)' ELSE lower(subject) END AS name_norm, lower(path) AS path_norm, regexp_replace(lower(CASE WHEN subject = '' THEN '(no subject)' ELSE subject END), '[\\s_]+', '', 'g') AS name_compact, 'mail' AS kind FROM mails),
m AS (SELECT path, ({_score('a')})::BIGINT AS score, 'mail' AS source FROM mk WHERE {_named('a')} ORDER BY score DESC, name_norm, path LIMIT 200)
SELECT * FROM (SELECT * FROM pc UNION ALL SELECT * FROM m) ORDER BY score DESC, path LIMIT 200"""
)
def source_all(spark, sf):
    o = q.SearchOptions(kind="file")
    shown, _ = rank.search(_parts(spark, sf), cat.with_keys(mail.entries(_mails(spark, sf))), "a", o)
    return shown.select("path", *_LONG("score"), "source")


@_query("SELECT p_partkey FROM part WHERE p_size % 5 IN (0, 2) AND p_size % 3 <> 0")
def churn_filter(spark, sf):
    """Volatile folders, but for the one that was chosen as a root."""
    folder = F.element_at(F.array(*map(F.lit, ("Tmp", "logs", "AppData", "tmp2", "windows"))), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.concat(F.lit("D:\\"), F.when(F.col("p_size") % 3 == 0, F.lit("tmp\\own\\")).otherwise(F.lit("other\\")), folder, F.lit("\\"), "p_name")
    rows = table(spark, sf, "part").withColumn("path", path)
    return rows.filter(cat.is_churn(F.col("path"), ["D:\\", "D:\\TMP\\own\\"])).select("p_partkey")


# -- snippets ---------------------------------------------------------------------------------------------------------


@_query(
    f"""WITH RECURSIVE {CHUNKS}, hit AS (SELECT chunk_id, text, lower(text) AS low, strpos(lower(text), 'with') - 1 AS p FROM chunks WHERE contains(lower(text), 'with')),
cut AS (SELECT *, greatest(p - 40, 0) AS a, least(length(text), p + 44) AS b FROM hit)
SELECT chunk_id, p::BIGINT AS "at", regexp_replace(CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, p - a), '\\s+', ' ', 'g') AS before,
  substr(text, p + 1, 4) AS match, regexp_replace(substr(text, p + 5, b - p - 4) || CASE WHEN b < length(text) THEN '…' ELSE '' END, '\\s+', ' ', 'g') AS after FROM cut"""
)
def snippets(spark, sf):
    rows = _chunks(spark, sf).select("chunk_id", snippet.snippet(F.col("text"), "with").alias("s")).filter("s.at IS NOT NULL")
    return rows.select("chunk_id", F.col("s.at").cast("long").alias("at"), "s.before", "s.match", "s.after")


@_query(f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, ((length(text) - length(replace(lower(text), 'with', ''))) // 4)::BIGINT AS n_ranges FROM chunks WHERE contains(lower(text), 'with')")
def find_ranges(spark, sf):
    rows = _chunks(spark, sf).filter(F.contains(F.lower("text"), F.lit("with")))
    return rows.select("chunk_id", F.size(snippet.find_ranges(F.col("text"), ["with"])).cast("long").alias("n_ranges"))


# -- typos ------------------------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {POSTINGS} SELECT tok AS variant, count(DISTINCT chunk_id) AS doc FROM postings WHERE damerau_levenshtein(tok, 'wiht') = 1 AND regexp_full_match(tok, '[a-z]+') GROUP BY tok")
def typo_latin(spark, sf):
    vocab = index.vocabulary(_index(spark, sf)["postings"])
    return fuzzy.variants(spark, vocab, "wiht", most=10_000)


@_query(
    f"""WITH {PARTS}, w AS (SELECT path, unnest(list_distinct(flatten(list_transform(range(1, length(name_compact) + 1), lambda i: [substr(name_compact, i, 4), substr(name_compact, i, 5), substr(name_compact, i, 6)])))) AS s FROM keyed)
SELECT DISTINCT path FROM w WHERE damerau_levenshtein(s, 'smlal') <= 1"""
)
def fuzzy_name(spark, sf):
    rows = _parts(spark, sf)
    return rows.filter(fuzzy.contains_fuzzy(F.coalesce("name_compact", "name_norm"), "smlal")).select("path")


@_query(
    f"""WITH RECURSIVE {POSTINGS}, v AS (SELECT tok FROM postings WHERE damerau_levenshtein(tok, 'wiht') = 1 AND regexp_full_match(tok, '[a-z]+') GROUP BY tok ORDER BY count(DISTINCT chunk_id) DESC, tok LIMIT 1),
hit AS (SELECT DISTINCT chunk_id, file_id, v.tok AS variant FROM postings p JOIN v ON starts_with(p.tok, v.tok)),
f AS (SELECT *, dense_rank() OVER (ORDER BY file_id) AS r FROM hit)
SELECT chunk_id, file_id, 'wiht' AS term, variant FROM f WHERE r <= 200"""
)
def fuzzy_widen(spark, sf):
    """The exact pass finds fewer than WIDEN_BELOW files, so the most frequent variant is searched."""
    ix = _index(spark, sf)
    exact = match.quick(ix, ["wiht"])
    vocab = index.vocabulary(ix["postings"])
    if exact.limit(q.WIDEN_BELOW).count() >= q.WIDEN_BELOW:
        vocab = vocab.filter("false")
    best = vocab.join(fuzzy.variants(spark, vocab, "wiht", most=1).select(F.col("variant").alias("tok")), "tok", "left_semi")
    return fuzzy.search_content(spark, ix, best, "wiht")


@_query(
    f"""WITH RECURSIVE {POSTINGS}, a AS (SELECT file_id, min(chunk_id) AS h FROM postings WHERE tok = 'was' GROUP BY 1), b AS (SELECT file_id, min(chunk_id) AS h FROM postings WHERE tok = 'has' OR tok = 'thnt' GROUP BY 1)
SELECT coalesce(a.file_id, b.file_id)::VARCHAR AS path, CASE WHEN a.h IS NULL THEN 'has' WHEN b.h IS NULL THEN 'was' ELSE 'was,has' END AS terms,
  array_to_string(list_filter([a.h, b.h], lambda x: x IS NOT NULL), ',') AS hits, CASE WHEN b.h IS NULL THEN '' ELSE 'has' END AS fuzzy_terms FROM a FULL JOIN b ON a.file_id = b.file_id"""
)
def merge_exact_fuzzy(spark, sf):
    posts = _index(spark, sf)["postings"]
    side = lambda words, term: posts.filter(F.col("tok").isin(words)).groupBy("file_id").agg(F.min("chunk_id").cast("string").alias("h")).select(F.col("file_id").cast("string").alias("path"), F.array(F.lit(term)).alias("terms"), F.array("h").alias("hits"))
    both = fuzzy.merge_matches(side(["was"], "was"), side(["has", "thnt"], "has"))
    return both.select("path", *[F.array_join(c, ",").alias(c) for c in ("terms", "hits", "fuzzy_terms")])


# -- mail -------------------------------------------------------------------------------------------------------------


@_query(f"WITH {MAILS} SELECT CASE WHEN subject <> '' THEN subject ELSE '(no subject)' END AS name, path, 'mail' AS kind, folder, '2024-01-01' AS date FROM mails")
def mail_entries(spark, sf):
    return mail.entries(_mails(spark, sf)).select("name", "path", "kind", "folder", "date")


@_query(f"WITH {MAILS} SELECT account, folder, count(*) AS n FROM mails GROUP BY ALL")
def mail_folder_counts(spark, sf):
    return mail.folder_counts(_mails(spark, sf))


@_query(f"WITH {MAILS} SELECT account, folder, max(uid) AS last_uid FROM mails GROUP BY ALL")
def max_uid(spark, sf):
    return mail.cursors(_mails(spark, sf))


@_query(f"WITH {MAILS} SELECT account, folder, uid FROM mails WHERE uid > 20000 AND uid % 7 <> 0")
def mail_incremental(spark, sf):
    source = _mails(spark, sf)
    cursor = source.select("account", "folder").distinct().select("*", F.lit("1").alias("uid_validity"), F.lit(20_000).cast("long").alias("last_uid"))
    return mail.to_fetch(source, source.filter("uid % 7 = 0"), cursor).select("account", "folder", "uid")


@_query(f"WITH {MAILS} SELECT account, folder, uid FROM mails WHERE folder = 'user' OR uid % 2 = 0 OR uid > 50000")
def mail_validity_reset(spark, sf):
    source = _mails(spark, sf)
    validity = F.when(F.col("folder") == "user", F.lit("0")).otherwise(F.lit("1"))
    cursor = source.select("account", "folder").distinct().select("*", validity.alias("uid_validity"), F.lit(50_000).cast("long").alias("last_uid"))
    return mail.synced(source.filter("uid % 2 = 0"), source, cursor).select("account", "folder", "uid")


@_query(f"WITH {MAILS} SELECT uid, 'imap://box/' || folder || '/1/' || uid AS uri, folder AS parsed_folder, uid::VARCHAR AS parsed_uid FROM mails")
def mail_uri(spark, sf):
    rows = _mails(spark, sf).select("uid", t.mail_uri("imap", F.col("account"), F.col("folder"), F.col("uid_validity"), F.col("uid")).alias("uri"))
    p = t.parse_mail_uri(F.col("uri"))
    return rows.select("uid", "uri", p["folder"].alias("parsed_folder"), p["uid"].alias("parsed_uid"))


# -- changes ----------------------------------------------------------------------------------------------------------


def _log(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", F.lit("removed")).otherwise(F.lit("added"))
    return events.select(F.concat(F.lit("u"), "user_id").alias("path"), op.alias("op"), F.col("event_id").alias("seq"))


LOG = "log AS (SELECT 'u' || user_id AS path, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'added' END AS op, event_id AS seq FROM events)"
LAST = f"{LOG}, delta AS (SELECT path, arg_max(op, seq) AS op, max(seq) AS seq FROM log GROUP BY path)"


@_query(f"WITH {LAST} SELECT path, op, seq FROM delta")
def delta_compact(spark, sf):
    return cat.compact_log(_log(table(spark, sf, "events")))


@_query(f"WITH {LAST}, e AS (SELECT DISTINCT 'u' || c_custkey AS path, -1::BIGINT AS seq FROM customer) SELECT path, seq FROM e WHERE path NOT IN (SELECT path FROM delta) UNION ALL SELECT path, seq FROM delta WHERE op = 'added'")
def delta_apply(spark, sf):
    entries = table(spark, sf, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("path"), F.lit(-1).cast("long").alias("seq")).distinct()
    return cat.apply_delta(entries, cat.compact_log(_log(table(spark, sf, "events"))))


@_query(f"WITH {LAST} SELECT path, op, seq FROM delta")
def watch_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 500).parquet(f"{sf}/events.parquet*")
    touched = _log(stream).withColumn("gone", F.col("op") == "removed")
    return watch.follow(watch.classify(touched, "NOT gone").select("path", "op", "seq"))


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two listings of source/lang/document: folders whose number is in the new one only, or that are gone."""
    d = table(spark, sf, "documents")
    files = d.select(F.concat_ws("/", F.lit("/r"), "source", "lang", F.concat(F.lit("d"), "doc_id")).alias("path"), F.lit("file").alias("kind"), F.lit(0).cast("long").alias("mtime"), "doc_id", "source")
    langs = d.select(F.concat_ws("/", F.lit("/r"), "source", "lang").alias("path"), F.lit("folder").alias("kind"), F.lit(1).cast("long").alias("mtime"), F.lit(0).cast("long").alias("doc_id"), "source").distinct()
    sources = d.select(F.concat_ws("/", F.lit("/r"), "source").alias("path"), F.lit("folder").alias("kind"), F.lit(1).cast("long").alias("mtime"), F.lit(0).cast("long").alias("doc_id"), "source").distinct()
    whole = files.unionByName(langs).unionByName(sources)
    old = whole.filter("NOT (kind = 'file' AND doc_id % 11 = 0)")
    new = whole.filter("source <> 'src3' AND NOT (kind = 'file' AND doc_id % 13 = 0)").withColumn("mtime", F.when(F.col("path").endswith("/de"), F.lit(2)).otherwise(F.col("mtime")))
    return old, new


TREE = """whole AS (
  SELECT '/r/' || source || '/' || lang || '/d' || doc_id AS path, 'file' AS kind, 0 AS mtime, doc_id, source FROM documents
  UNION ALL SELECT DISTINCT '/r/' || source || '/' || lang, 'folder', 1, 0, source FROM documents
  UNION ALL SELECT DISTINCT '/r/' || source, 'folder', 1, 0, source FROM documents
), old AS (SELECT * FROM whole WHERE NOT (kind = 'file' AND doc_id % 11 = 0)
), new AS (SELECT path, kind, CASE WHEN ends_with(path, '/de') THEN 2 ELSE mtime END AS mtime FROM whole WHERE source <> 'src3' AND NOT (kind = 'file' AND doc_id % 13 = 0))"""


@_query(f"WITH {TREE} SELECT n.path, 'added' AS op FROM new n LEFT JOIN old o ON n.path = o.path WHERE o.path IS NULL OR n.mtime <> o.mtime UNION ALL SELECT path, 'removed' FROM old WHERE path NOT IN (SELECT path FROM new)")
def catch_up_diff(spark, sf):
    return cat.catch_up(*_tree(spark, sf))


@_query(f"WITH {TREE} SELECT path FROM old WHERE path = '/r/src1' OR starts_with(path, '/r/src1/') OR path = '/r/src2/de' OR starts_with(path, '/r/src2/de/')")
def subtree_remove(spark, sf):
    old, _ = _tree(spark, sf)
    return cat.subtree(old, old.filter("path IN ('/r/src1', '/r/src2/de')")).select("path")


@_query(f"WITH {TREE} SELECT path FROM old WHERE starts_with(path, '/r/src5/') AND path <> '/r/src5/en' AND kind = 'folder' OR starts_with(path, '/r/src5/en/')")
def orphans(spark, sf):
    old, _ = _tree(spark, sf)
    return cat.orphans(old.filter("path NOT IN ('/r/src5', '/r/src5/en')"), ["/r"]).select("path")


def _states(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 17 == 0, F.lit("error")).when(F.col("n_chars") < 200, F.lit("empty")).otherwise(F.lit("done"))
    files = d.filter("doc_id % 5 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("modified_at"), status.alias("status"), (1 + F.col("doc_id") % 2).cast("int").alias("extractor"))
    found = d.filter("doc_id % 7 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 19 == 0, 1).otherwise(0)).alias("size"), F.lit(1).cast("long").alias("modified_at"))
    return files, found


@_query("SELECT 'd' || doc_id AS path FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 19 = 0 OR doc_id % 17 = 0 OR doc_id % 2 = 0)")
def changed_files(spark, sf):
    files, found = _states(spark, sf)
    return cat.changed_files(files, found, 2)


@_query("SELECT 'd' || doc_id AS path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0 AND doc_id % 2 = 1")
def vanished_files(spark, sf):
    files, found = _states(spark, sf)
    return cat.vanished_files(files, found, F.col("extractor") == 2).select("path")


@_query("SELECT CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN n_chars < 200 THEN 'empty' ELSE 'done' END AS status, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def status_counts(spark, sf):
    return _states(spark, sf)[0].groupBy("status").agg(F.count("*").alias("n"))


# -- after OCR --------------------------------------------------------------------------------------------------------


@_query(
    """SELECT image, line::BIGINT AS line, text FROM (
  SELECT l_orderkey::VARCHAR AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity), l_extendedprice, l_linenumber::VARCHAR || l_returnflag) AS line, l_linenumber::VARCHAR || l_returnflag AS text
  FROM lineitem WHERE 1 - l_tax * 10 >= 0.45)"""
)
def ocr_line_order(spark, sf):
    li = table(spark, sf, "lineitem")
    words = li.select(F.col("l_orderkey").cast("string").alias("image"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("text"), F.round("l_quantity").alias("y"), F.col("l_extendedprice").alias("x"), (1 - F.col("l_tax") * 10).alias("score"))
    return ocr.line_order(words).select("image", *_LONG("line"), "text")


@_query("SELECT l_orderkey, list_sort(list(l_quantity))[(count(*) // 2 + 1)::INT] AS middle FROM lineitem GROUP BY 1")
def upper_median(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ocr.upper_median(F.collect_list("l_quantity")).alias("middle"))


@_query(
    """WITH l AS (SELECT doc_id, unnest(r) AS text, unnest(range(1, len(r) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)),
b AS (SELECT doc_id, line, text, 1 AS engine FROM l WHERE line % 2 = 1 UNION ALL SELECT doc_id, line, text || ' ', 2 FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(text, '\\s+', '', 'g') ORDER BY engine, line) AS k FROM b)
SELECT doc_id AS image, row_number() OVER (PARTITION BY doc_id ORDER BY engine, line) AS line, md5(text) AS digest FROM u WHERE k = 1"""
)
def dedupe_union_lines(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("image", (F.col("p") + 1).alias("line"), "text")
    both = ocr.union_lines(lines.filter("line % 2 = 1"), lines.withColumn("text", F.concat("text", F.lit(" "))))
    return both.select("image", *_LONG("line"), F.md5("text").alias("digest"))


# -- the flagship -----------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``the with`` over documents: content matches, rank, cut, then snippets for the shown files only."""
    ix, entries, o = _index(spark, sf_dir), _doc_entries(spark, sf_dir), q.SearchOptions()
    terms = q.tokenize("the with")
    shown = rank.top(rank.scored(entries, terms, o, _content(spark, sf_dir, terms, entries)), o)
    hits = match.hits(ix, terms, shown, 1)
    texts = ix["chunks"].join(hits, ["chunk_id", "file_id"]).filter("term = 'with'")
    found = texts.select("file_id", snippet.snippet(F.col("text"), "with").alias("hit"))
    return shown.join(found, "file_id", "left").select("path", "score", F.array_join("matched_in", ",").alias("matched_in"), "hit.before", "hit.match", "hit.after").orderBy(F.col("score").desc(), "path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestone.sources import fixtures

    return dict(_QUERIES) | fixtures.queries()


def oracle_sql() -> dict[str, str]:
    from lodestone.sources import fixtures

    return dict(_SQL) | fixtures.oracle_sql()
