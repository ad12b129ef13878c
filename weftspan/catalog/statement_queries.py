"""From text lines to task statements (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspan.catalog.registry import query
from weftspan.catalog.surrogates import CODE_SQL, ENTRIES_SQL, entries_v, lines_v, with_sql
from weftspan.functions import text as T
from weftspan.operators import statements as B
from weftspan.sources.io import table

# The same character classes, in the dialect of the SQL engine.
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
WD = r"[\p{L}\p{N}_]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(c: str) -> str:
    out = f"regexp_replace({c}, 'VOLUME II ?[AB](\\s+\\d{{1,3}})?', ' ', 'g')"
    out = f"regexp_replace({out}, 'National Classification of Occupations\\s*[–-]\\s*2015(\\s+Division \\d)?', ' ', 'g')"
    out = f"regexp_replace({out}, '({WD}){WS}+-{WS}*({WD})', '\\1-\\2', 'g')"
    out = f"regexp_replace({out}, '({WD}){WS}*-{WS}+({WD})', '\\1-\\2', 'g')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


LINES_SQL = f"""raw_lines AS (
  SELECT doc_id, source AS file,
         list_concat(list_concat(['Division ' || (doc_id % 9)::VARCHAR, {CODE_SQL}, 'Clerk ' || lang || ' clerks, ' || lang], string_split(text, chr(10))),
                     ['ISCO 08 Unit Group Details: Code 0000', 'tail text that is cut', (doc_id % 100)::VARCHAR]) AS body FROM documents),
lines_v AS (
  SELECT file, doc_id * 2147483648 + i - 1 AS line_no, body[i] AS text
  FROM (SELECT *, unnest(range(1, len(body) + 1)) AS i FROM raw_lines))"""
FURNITURE = "^(VOLUME II ?[AB]|National Classification of Occupations.*|Division \\d+|\\d{1,3})\\s*$"


@query("furniture_filter", "B1", with_sql(
    f"SELECT file, line_no, text FROM lines_v WHERE NOT regexp_matches({strip_sql('text')}, '{FURNITURE}')", LINES_SQL))
def furniture_filter(spark, d):
    return B.drop_furniture(lines_v(spark, d)).select("file", "line_no", "text")


@query("cleaned_text", "B2", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("text"))


# Codes also occur inside texts; a document is then cut at each of them.
SEGMENT_SQL = LINES_SQL + f""",
kept AS (SELECT * FROM lines_v WHERE NOT regexp_matches({strip_sql('text')}, '{FURNITURE}')),
whole AS (SELECT file, string_agg(text, chr(10) ORDER BY line_no) AS t FROM kept GROUP BY file),
parts AS (SELECT file, unnest(string_split(regexp_replace(t, '\\b(\\d{{4}}\\.\\d{{4}})\\b', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:]) AS part FROM whole),
segments AS (SELECT file, substr(part, 1, 9) AS code, substr(part, 11) AS body FROM parts)"""


@query("code_segments", "B3 B4", with_sql(
    f"""SELECT file, code, {clean_sql("regexp_replace(regexp_replace(body, '(?s)ISCO\\s*08\\s*Unit\\s*Group\\s*Details.*', ''), '(?s)Qualification\\s*Pack\\s*Details.*', '')")} AS body
        FROM segments""", SEGMENT_SQL))
def code_segments(spark, d):
    segments = B.segment_by_code(B.drop_furniture(lines_v(spark, d)))
    return segments.select(
        "file", "code", T.clean_text(T.cut_tails(F.concat_ws("\n", "lines"))).alias("body")
    )


def words_sql(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), ' '), lambda w: w <> '')"


def bare_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[,;]+|[,;]+$', '', 'g')"


def opening_sql(line: str) -> str:
    return f"lower(array_to_string(({words_sql(clean_sql(line))})[1:2], ' '))"


def repeats_sql(line: str, so_far: str) -> str:
    return f"({opening_sql(line)} <> '' AND contains(lower({clean_sql(so_far)}), {opening_sql(line)}))"


BODY = "regexp_replace(regexp_replace(body, '(?s)ISCO\\s*08\\s*Unit\\s*Group\\s*Details.*', ''), '(?s)Qualification\\s*Pack\\s*Details.*', '')"
PHRASES = " ".join(f"WHEN len(w) >= {2 * n} AND plain[1:{n}] = plain[{n + 1}:{2 * n}] THEN {n}" for n in range(6, 0, -1))
PARSED_SQL = SEGMENT_SQL + f""",
listed AS (SELECT file, code, list_filter(list_transform(string_split({BODY}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls FROM segments),
opened AS (SELECT *, ls[1] AS l1, ls[2] AS l2, ls[3] AS l3, coalesce(NOT contains(ls[1], '.'), false) AS p1,
  coalesce(NOT contains(ls[2], '.'), false) AS p2, coalesce(NOT contains(ls[3], '.'), false) AS p3 FROM listed),
counted AS (SELECT *, CASE WHEN two AND p3 AND NOT {repeats_sql('l3', "concat_ws(' ', l1, l2)")} AND length(l1) + length(l2) <= 90 THEN 3 WHEN two THEN 2 WHEN p1 THEN 1 ELSE 0 END AS k
  FROM (SELECT *, coalesce(p1 AND p2 AND NOT {repeats_sql('l2', 'l1')} AND length(l1) <= 90, false) AS two FROM opened)),
cut AS (SELECT file, code, {clean_sql("array_to_string(ls[1:k], ' ')")} AS title, {clean_sql("array_to_string(ls[k + 1:], ' ')")} AS description FROM counted),
tokened AS (SELECT *, {words_sql('title')} AS w FROM cut),
bared AS (SELECT *, list_transform(w, lambda t: {bare_sql('t')}) AS bare FROM tokened),
placed AS (SELECT *, list_position(list_transform(range(1, len(w) + 1), lambda i:
    regexp_full_match(bare[i], '[a-z]{{3,}}s') OR (regexp_full_match(bare[i], '[a-z]+') AND regexp_full_match(coalesce(bare[i + 1], ''), '[a-z]+')
      AND regexp_full_match(bare[i] || coalesce(bare[i + 1], ''), '[a-z]{{4,}}s'))), true) AS pos FROM bared),
returned AS (SELECT file, code,
  CASE WHEN pos > 0 THEN regexp_replace({clean_sql("array_to_string(w[1:pos - 1], ' ')")}, '[,;]+$', '', 'g') ELSE title END AS title,
  CASE WHEN pos > 0 THEN trim(concat_ws(' ', CASE WHEN regexp_full_match(bare[pos], '[a-z]{{3,}}s') THEN array_to_string(w[pos:], ' ')
    ELSE concat_ws(' ', bare[pos] || coalesce(bare[pos + 1], ''), array_to_string(w[pos + 2:], ' ')) END, description)) ELSE description END AS description FROM placed),
phrased AS (SELECT *, CASE {PHRASES} ELSE 0 END AS again FROM (
  SELECT *, list_transform(w, lambda x: regexp_replace(regexp_replace(lower(x), '[,;]+$', '', 'g'), 's+$', '', 'g')) AS plain FROM (SELECT *, {words_sql('title')} AS w FROM returned))),
parsed AS (SELECT code, file, description,
  regexp_replace(regexp_replace(CASE WHEN again = 0 THEN title ELSE array_to_string(w[again + 1:], ' ') END, '\\s+([;,])', '\\1', 'g'), '^[ ;,]+|[ ;,]+$', '', 'g') AS title FROM phrased)"""


@query("parsed_entries", "B5 B6 B7 B13", with_sql(
    """SELECT code AS nco_code, substr(code, 1, 4) AS family, substr(code, 1, 3) AS group3, substr(code, 1, 1) AS division, title AS occupation_title, description, file AS source
       FROM parsed WHERE title <> '' AND length(description) >= 40""", PARSED_SQL))
def parsed_entries(spark, d):
    return B.split_entries(B.segment_by_code(B.drop_furniture(lines_v(spark, d)))).select(
        "nco_code", "family", "group3", "division", "occupation_title", "description", "source"
    )


@query("minimum_content", "B7", with_sql(
    "SELECT nco_code, occupation_title FROM entries_v WHERE occupation_title <> '' AND length(description) >= 40", ENTRIES_SQL))
def minimum_content(spark, d):
    return B.minimum_content(entries_v(spark, d)).select("nco_code", "occupation_title")


def _one_sql(order: str) -> str:
    return with_sql(
        f"""SELECT substr(nco_code, 6, 3) AS code, source, occupation_title, md5(description) AS digest FROM (
              SELECT *, row_number() OVER (PARTITION BY substr(nco_code, 6, 3)
                ORDER BY {order} description DESC, source DESC, occupation_title DESC) AS n FROM entries_v) WHERE n = 1""",
        ENTRIES_SQL,
    )


def _one(spark, d, longest):
    keyed = entries_v(spark, d).withColumn("code", F.substring("nco_code", 6, 3)).drop("nco_code", "lang")
    return B.one_per_code(keyed, "code", longest).select(
        "code", "source", "occupation_title", F.md5("description").alias("digest")
    )


@query("one_entry_per_code", "B8", _one_sql(""))
def one_entry_per_code(spark, d):
    return _one(spark, d, False)


@query("longest_entry_per_code", "B8", _one_sql("length(description) DESC,"))
def longest_entry_per_code(spark, d):
    return _one(spark, d, True)


SPLIT = "string_split(regexp_replace(text, '([.;])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query("sentences", "B9", f"""
    SELECT doc_id, (i - 1)::INTEGER AS place, parts[i] AS sentence
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {SPLIT} AS parts FROM documents))""")
def sentences(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode(B.sentences(F.col("text"))).alias("place", "sentence")
    )


STATEMENT_SQL = ENTRIES_SQL + f""",
sent AS (
  SELECT nco_code, occupation_title, lang, i, {strip_sql(f"regexp_replace({strip_sql('parts[i]')}, ';+$', '')")} AS s
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, {SPLIT.replace('text,', 'description,')} AS parts FROM entries_v))),
ali AS (
  SELECT *, list_max(list_transform(list_filter(list_transform(string_split(replace(occupation_title, ';', '/'), '/'), lambda x: {strip_sql('x')}),
               lambda x: x <> '' AND starts_with(lower(s), lower(x))), lambda x: length(x))) AS cut FROM sent),
tail AS (SELECT *, regexp_replace(substr(s, cut + 1), '^[ ,]+', '') AS rest FROM ali),
tidy AS (
  SELECT *, CASE WHEN cut IS NULL THEN s
                 WHEN substr(rest, 1, 1) = 'ß' THEN 'SS' || substr(rest, 2)
                 ELSE upper(substr(rest, 1, 1)) || substr(rest, 2) END AS t FROM tail),
statements AS (
  SELECT nco_code, row_number() OVER (PARTITION BY nco_code ORDER BY i) AS task_no, lang,
         CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS task_text FROM tidy WHERE length(t) >= 15)"""


@query("task_statements", "B10 B11", with_sql(
    "SELECT nco_code || '-t' || CASE WHEN task_no < 10 THEN '0' ELSE '' END || task_no::VARCHAR AS task_id, nco_code, task_text FROM statements", STATEMENT_SQL))
def task_statements(spark, d):
    return B.split_statements(entries_v(spark, d)).select("task_id", "nco_code", "task_text")


@query("fragment_flags", "B12", with_sql(
    """SELECT count(*) AS n, count(*) FILTER (regexp_matches(task_text, '(?i)\\b(is designated|may be designated|may specialise|may specialize)\\b')) AS n_designation,
              count(*) FILTER (task_text = upper(task_text) AND regexp_matches(task_text, '\\p{L}')) AS n_caps,
              count(*) FILTER (length(task_text) < 40) AS n_short, lang FROM statements GROUP BY lang""", STATEMENT_SQL))
def fragment_flags(spark, d):
    flagged = B.flag_fragments(B.split_statements(entries_v(spark, d)))
    return flagged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_designation").alias("n_designation"),
        F.count_if("is_all_caps").alias("n_caps"),
        F.count_if("is_short").alias("n_short"),
    )


@query("code_prefixes", "B13", f"""
    SELECT {CODE_SQL} AS code, substr({CODE_SQL}, 1, 4) AS family, substr({CODE_SQL}, 1, 3) AS group3, substr({CODE_SQL}, 1, 1) AS division FROM documents""")
def code_prefixes(spark, d):
    return entries_v(spark, d).select(F.col("nco_code").alias("code"), *B.code_prefixes("nco_code"))


@query("entry_counts", "B13 F19 A7", with_sql(
    "SELECT count(*) AS n_entries, count(DISTINCT substr(nco_code, 1, 8)) AS n_families, count(DISTINCT substr(nco_code, 1, 7)) AS n_groups3 FROM entries_v", ENTRIES_SQL))
def entry_counts(spark, d):
    entries = entries_v(spark, d).select(
        T.prefix("nco_code", 8).alias("family"), T.prefix("nco_code", 7).alias("group3")
    )
    return B.entry_counts(entries)
