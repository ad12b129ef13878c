"""The library's input tables, stated over the driver tables twice: as frames
and as SQL. Mappings are fixed and meaningless; they only give every operator
input of the right shape, with nulls and unmatched keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.numeric import zero_fill
from weftspan.operators.index import build_index
from weftspan.operators.labels import content_key
from weftspan.operators.panel import panel_from_flows
from weftspan.operators.survey import attach_index, derive_workers
from weftspan.sources.io import table
from weftspan.sources.maps import recode

# ---------------------------------------------------------------- labels

EVENT_LABEL = {"purchase": "E1", "click": "E2", "signup": "E2", "view": "E0"}


def labels_v(spark: SparkSession, d: str) -> DataFrame:
    """One label per event; ``error`` events have none."""
    e = table(spark, d, "events")
    user = F.col("user_id")
    return e.select(
        F.col("event_id").alias("task_id"),
        user.alias("nco_code"),
        F.concat(F.lit("Brand#"), (user % 25).cast("string")).alias("group3"),
        F.concat(F.lit("F"), (user % 75).cast("string")).alias("family"),
        recode(F.col("event_type"), EVENT_LABEL).alias("score"),
    )


def statements_v(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("task_id"),
        F.col("user_id").alias("nco_code"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25).cast("string")).alias("group3"),
        F.concat(F.lit("Occupation "), F.col("user_id").cast("string")).alias("occupation_title"),
        F.concat_ws(" ", "event_type", "props").alias("task_text"),
    )


LABELS_SQL = """labels_v AS (
  SELECT event_id AS task_id, user_id AS nco_code,
         'Brand#' || (user_id % 25)::VARCHAR AS group3,
         'F' || (user_id % 75)::VARCHAR AS family,
         CASE event_type WHEN 'purchase' THEN 'E1' WHEN 'click' THEN 'E2'
              WHEN 'signup' THEN 'E2' WHEN 'view' THEN 'E0' END AS score
  FROM events)"""

STATEMENTS_SQL = """statements_v AS (
  SELECT event_id AS task_id, user_id AS nco_code,
         'Brand#' || (user_id % 25)::VARCHAR AS group3,
         'Occupation ' || user_id::VARCHAR AS occupation_title,
         event_type || ' ' || props AS task_text
  FROM events)"""

MEASURES_SQL = """count(*) AS n_tasks,
       avg(CASE WHEN score = 'E1' THEN 1.0 ELSE 0.0 END) AS alpha,
       avg(CASE score WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.5 ELSE 0.0 END) AS beta,
       avg(CASE WHEN score IN ('E1', 'E2') THEN 1.0 ELSE 0.0 END) AS zeta"""


def idx_v(spark: SparkSession, d: str) -> DataFrame:
    return build_index(labels_v(spark, d), ["group3"])


IDX_SQL = f"""idx_v AS (
  SELECT group3, {MEASURES_SQL}
  FROM labels_v WHERE score IS NOT NULL GROUP BY group3)"""

# ---------------------------------------------------------------- workers


def workers_raw(spark: SparkSession, d: str, place: bool = False) -> DataFrame:
    """Survey records from order lines. Region and state need three more joins
    and are only added on request."""
    line = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    n = F.col("l_linenumber")
    df = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    columns = [
        F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("sector_code"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sex_code"),
        (F.col("p_size") + 14).alias("age"),
        (F.col("p_size") % 13 + 1).alias("edu_code"),
        (n * 10 + 1).alias("status_code"),
        F.when(
            ~((n == 1) & (F.col("l_returnflag") == "R")), F.col("p_size") * 1000 + n
        ).alias("nic5"),
        F.col("p_brand").alias("nco3_raw"),
        (n + 4).alias("ss_benefit_code"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("earnings_regular"),
        F.when(n != 3, F.col("l_quantity") * 10).alias("earnings_self"),
        (F.col("l_quantity") * 100).alias("mult"),
        F.lit(1).alias("no_qtr"),
        (n % 2).alias("nss"),
        F.lit(0).alias("nsc"),
    ]
    if place:
        o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
        c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
        na = table(spark, d, "nation")
        re = table(spark, d, "region")
        df = (
            df.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(na, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(re, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        columns += [F.col("n_name").alias("state"), F.col("r_name").alias("region")]
    return df.select(*columns)


def workers_v(spark: SparkSession, d: str, place: bool = False) -> DataFrame:
    return derive_workers(workers_raw(spark, d, place))


def merged_v(spark: SparkSession, d: str, place: bool = False) -> DataFrame:
    return attach_index(workers_v(spark, d, place), idx_v(spark, d))


WORKERS_RAW_SQL = """workers_raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS sector_code,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sex_code,
         p_size + 14 AS age, p_size % 13 + 1 AS edu_code,
         l_linenumber * 10 + 1 AS status_code,
         CASE WHEN NOT (l_linenumber = 1 AND l_returnflag = 'R')
              THEN p_size * 1000 + l_linenumber END AS nic5,
         p_brand AS nco3_raw, l_linenumber + 4 AS ss_benefit_code,
         CASE WHEN l_discount <> 0 THEN l_extendedprice END AS earnings_regular,
         CASE WHEN l_linenumber <> 3 THEN l_quantity * 10 END AS earnings_self,
         l_quantity * 100 AS mult, 1 AS no_qtr, l_linenumber % 2 AS nss, 0 AS nsc,
         n_name AS state, r_name AS region
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

WORKERS_SQL = (
    WORKERS_RAW_SQL
    + """,
workers_v AS (
  SELECT *, nco3_raw AS group3,
         CASE WHEN nss = nsc THEN mult / 100 ELSE mult / 200 END / no_qtr AS weight,
         coalesce(earnings_regular, 0) + coalesce(earnings_self, 0) AS monthly_earnings,
         CASE WHEN ss_benefit_code BETWEEN 1 AND 7 THEN true
              WHEN ss_benefit_code = 8 THEN false END AS formal_proxy,
         substr(lpad(nic5::VARCHAR, 5, '0'), 1, 2) AS nic2
  FROM workers_raw WHERE status_code IN (11, 12, 21, 31, 41, 51))"""
)

MERGED_SQL = (
    LABELS_SQL
    + ",\n"
    + IDX_SQL
    + ",\n"
    + WORKERS_SQL
    + """,
merged_v AS (
  SELECT w.*, i.n_tasks, i.alpha, i.beta, i.zeta
  FROM workers_v w LEFT JOIN idx_v i ON w.group3 = i.group3),
scored_v AS (
  SELECT *, CASE WHEN monthly_earnings > 0 THEN monthly_earnings * weight END AS bill
  FROM merged_v WHERE beta IS NOT NULL)"""
)

# Brand digit after the six characters of the prefix stands for the division.
DIVISION_AT = 7

# ---------------------------------------------------------------- payroll

PRIORITY_BAND = {
    "1-URGENT": "18-21",
    "2-HIGH": "22-25",
    "3-MEDIUM": "29-35",
    "4-NOT SPECIFIED": ">35",
    "5-LOW": "26-28",
}
SEGMENT_HEAD = {
    "AUTOMOBILE": "ELEC, MECH OR GEN ENGG PRODUCTS",
    "BUILDING": "BUILDING AND CONSTRUCTION INDUSTRY",
    "FURNITURE": "TEXTILES",
    "HOUSEHOLD": "TRADING - COMMERCIAL ESTABLISHMENTS",
    "MACHINERY": "ENGINEERS - ENGG. CONTRACTORS",
}
GENDER_BY_REST = {"0": "male", "1": "female", "2": "transgender", "3": "not_available"}


def flows_v(spark: SparkSession, d: str) -> DataFrame:
    """Flow counts per order: month of the order moved 23 years on."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey")
    )
    day = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    return df.select(
        F.concat(
            (F.year(day) + 23).cast("string"), F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0")
        ).alias("data_month"),
        recode(F.col("o_orderpriority"), PRIORITY_BAND).alias("age_band"),
        recode((F.col("c_custkey") % 4).cast("string"), GENDER_BY_REST).alias("gender"),
        recode(F.col("c_mktsegment"), SEGMENT_HEAD).alias("industry"),
        F.col("n_name").alias("state"),
        (status == "O").cast("bigint").alias("new"),
        (status == "P").cast("bigint").alias("ceased"),
        (status == "F").cast("bigint").alias("rejoined"),
    )


def payroll_v(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_flows(flows_v(spark, d))


def _case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


FLOWS_SQL = f"""flows_v AS (
  SELECT (year(o_orderdate) + 23)::VARCHAR || '-' ||
         lpad(month(o_orderdate)::VARCHAR, 2, '0') AS data_month,
         {_case('o_orderpriority', PRIORITY_BAND)} AS age_band,
         {_case('(c_custkey % 4)::VARCHAR', GENDER_BY_REST)} AS gender,
         {_case('c_mktsegment', SEGMENT_HEAD)} AS industry,
         n_name AS state,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS nw,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS ceased,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rejoined
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

PAYROLL_SQL = (
    FLOWS_SQL
    + """,
summed_v AS (
  SELECT data_month, age_band, gender, industry, state,
         grouping(gender) AS g, grouping(industry) AS i, grouping(state) AS s,
         sum(nw)::BIGINT AS new_subscribers, sum(ceased)::BIGINT AS ceased,
         sum(rejoined)::BIGINT AS rejoined,
         (sum(nw) - sum(ceased) + sum(rejoined))::BIGINT AS net_payroll
  FROM flows_v
  GROUP BY GROUPING SETS ((data_month, age_band), (data_month, age_band, gender),
                          (data_month, age_band, industry), (data_month, age_band, state))),
payroll_v AS (
  SELECT data_month, 'new_subscribers' AS measure, age_band, gender, industry, state,
         new_subscribers AS value FROM summed_v WHERE i = 1 AND s = 1
  UNION ALL
  SELECT data_month, 'ceased', age_band, gender, industry, state, ceased
  FROM summed_v WHERE i = 1 AND s = 1
  UNION ALL
  SELECT data_month, 'rejoined', age_band, gender, industry, state, rejoined
  FROM summed_v WHERE i = 1 AND s = 1
  UNION ALL
  SELECT data_month, 'net_payroll', age_band, gender, industry, state, net_payroll
  FROM summed_v WHERE g = 1)"""
)

# ---------------------------------------------------------------- raters

RATERS = ["rating_1", "rating_2", "rating_3"]
NOTES = ["notes_1", "notes_2", "notes_3"]


def raters_v(spark: SparkSession, d: str) -> DataFrame:
    """Three ratings per task drawn from digests: often the model's label,
    else another, NA, blank, unknown or null."""
    base = labels_v(spark, d)
    columns = []
    for i in (1, 2, 3):
        digest = F.md5(F.concat(F.col("task_id").cast("string"), F.lit(f"-{i}")))
        a, b = F.substring(digest, 1, 1), F.substring(digest, 2, 1)
        rating = (
            F.when(a <= "7", F.coalesce("score", F.lit("E0")))
            .when(a <= "9", F.lit("E0"))
            .when(a == "a", F.lit(" e1 "))
            .when(a == "b", F.lit("E2"))
            .when(a == "c", F.lit("NA"))
            .when(a == "d", F.lit(""))
            .when(a == "e", F.lit("X"))
        )
        note = F.when(b == "0", F.lit("see R-03")).when(b == "1", F.lit("R-04 and R-05"))
        columns += [rating.alias(f"rating_{i}"), note.alias(f"notes_{i}")]
    return base.select(
        "task_id",
        F.col("score").alias("model"),
        F.coalesce("score", F.lit("unresolved")).alias("stratum"),
        *columns,
    )


def _rater_sql(i: int) -> str:
    a = f"substr(md5(task_id::VARCHAR || '-{i}'), 1, 1)"
    b = f"substr(md5(task_id::VARCHAR || '-{i}'), 2, 1)"
    return f"""CASE WHEN {a} <= '7' THEN coalesce(score, 'E0') WHEN {a} <= '9' THEN 'E0'
         WHEN {a} = 'a' THEN ' e1 ' WHEN {a} = 'b' THEN 'E2' WHEN {a} = 'c' THEN 'NA'
         WHEN {a} = 'd' THEN '' WHEN {a} = 'e' THEN 'X' END AS rating_{i},
         CASE WHEN {b} = '0' THEN 'see R-03' WHEN {b} = '1' THEN 'R-04 and R-05' END AS notes_{i}"""


RATERS_SQL = (
    LABELS_SQL
    + f""",
raters_v AS (
  SELECT task_id, score AS model, coalesce(score, 'unresolved') AS stratum,
         {_rater_sql(1)}, {_rater_sql(2)}, {_rater_sql(3)}
  FROM labels_v),
clean_v AS (
  SELECT task_id, model, stratum, {', '.join(f"CASE WHEN upper(trim(rating_{i})) IN ('E0','E1','E2','NA') THEN upper(trim(rating_{i})) END AS r{i}" for i in (1, 2, 3))},
         notes_1, notes_2, notes_3
  FROM raters_v)"""
)

# ---------------------------------------------------------------- responses

MODEL, RUBRIC = "model-a", "0.2"


def responses_v(spark: SparkSession, d: str) -> DataFrame:
    """Stored responses: three samples per task from three events, with strict
    retries for events that gave no label."""
    e = table(spark, d, "events")
    label = recode(F.col("event_type"), EVENT_LABEL)
    rest = F.col("event_id") % 5
    reason = F.concat(F.lit("About "), F.col("event_type"), F.lit(".\n"))
    first = (
        F.when(label.isNull() & (rest < 3), F.concat(reason, F.lit("SCORE: E9")))
        .when(label.isNull(), F.lit("I cannot classify this."))
        .when(rest == 0, F.concat(reason, F.lit("SCORE: E0\nthen again\n score: "), F.lower(label), F.lit("  \n")))
        .when(rest == 1, F.concat(reason, F.lit("SCORE: "), label, F.lit("\nSCORE: E7")))
        .otherwise(F.concat(reason, F.lit("SCORE: "), label))
    )
    retry = F.when(
        label.isNull() & (F.col("event_id") % 2 == 0),
        F.concat(F.lit("SCORE: E"), (F.col("event_id") % 3).cast("string")),
    ).when(label.isNull(), F.lit("Still no."))
    idx = (F.col("event_id") % 3).cast("int")
    entries = F.filter(
        F.array(
            F.struct(idx.alias("sample_idx"), first.alias("response")),
            F.struct((idx + 100).alias("sample_idx"), retry.alias("response")),
        ),
        lambda s: s.getField("response").isNotNull(),
    )
    task = F.floor(F.col("event_id") / 3).cast("bigint")
    return e.select(
        task.alias("task_id"), F.col("event_id"), F.col("value"), F.inline(entries)
    ).select(
        content_key(F.lit(MODEL), F.lit(RUBRIC), "task_id", "sample_idx").alias("key"),
        F.lit(MODEL).alias("model"),
        F.lit(RUBRIC).alias("rubric_version"),
        "task_id",
        "sample_idx",
        "response",
        (F.lit(1000) + F.col("event_id") % 97).cast("bigint").alias("input_tokens"),
        (F.lit(20) + F.col("event_id") % 13).cast("bigint").alias("output_tokens"),
        F.concat(F.lit("2024-01-01T"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0")).alias("created_at"),
    )


RESPONSES_SQL = """events_l AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'E1' WHEN 'click' THEN 'E2'
            WHEN 'signup' THEN 'E2' WHEN 'view' THEN 'E0' END AS label
  FROM events),
tries AS (
  SELECT event_id, event_id // 3 AS task_id, (event_id % 3)::INTEGER AS sample_idx,
         CASE WHEN label IS NULL AND event_id % 5 < 3 THEN 'About ' || event_type || '.' || chr(10) || 'SCORE: E9'
              WHEN label IS NULL THEN 'I cannot classify this.'
              WHEN event_id % 5 = 0 THEN 'About ' || event_type || '.' || chr(10) || 'SCORE: E0' || chr(10)
                   || 'then again' || chr(10) || ' score: ' || lower(label) || '  ' || chr(10)
              WHEN event_id % 5 = 1 THEN 'About ' || event_type || '.' || chr(10) || 'SCORE: ' || label || chr(10) || 'SCORE: E7'
              ELSE 'About ' || event_type || '.' || chr(10) || 'SCORE: ' || label END AS response
  FROM events_l
  UNION ALL
  SELECT event_id, event_id // 3, (event_id % 3 + 100)::INTEGER,
         CASE WHEN event_id % 2 = 0 THEN 'SCORE: E' || (event_id % 3)::VARCHAR ELSE 'Still no.' END
  FROM events_l WHERE label IS NULL),
responses_v AS (
  SELECT sha256('7:model-a' || chr(1) || '3:0.2' || chr(1) || length(task_id::VARCHAR) || ':' || task_id || chr(1) || length(sample_idx::VARCHAR) || ':' || sample_idx) AS key,
         'model-a' AS model, '0.2' AS rubric_version, task_id, sample_idx, response,
         1000 + event_id % 97 AS input_tokens, 20 + event_id % 13 AS output_tokens,
         '2024-01-01T' || lpad((event_id % 24)::VARCHAR, 2, '0') AS created_at, event_id
  FROM tries),
parsed_v AS (
  SELECT *, list_filter(list_transform(string_split(response, chr(10)), lambda x: upper(trim(x))),
                        lambda x: regexp_full_match(x, 'SCORE:\\s*E[012]'))[-1][-2:] AS label
  FROM responses_v)"""

# ---------------------------------------------------------------- lines


def codes_of(doc_id):
    """Occupation-like code of a document number; longer for numbers from 10**8 on."""
    n = F.col(doc_id)
    return F.concat(
        zero_fill(F.floor(n / 10000).cast("string"), 4), F.lit("."), zero_fill((n % 10000).cast("string"), 4)
    )


CODE_SQL = "format('{:04d}', doc_id // 10000) || '.' || format('{:04d}', doc_id % 10000)"
LINES_PER_PAGE = 40
#: Room for the lines of one document in the numbering; a text of 2 GB has fewer.
LINES_PER_DOCUMENT = 1 << 31


def lines_v(spark: SparkSession, d: str) -> DataFrame:
    """Volumes as text lines: one volume per source, one page run per document,
    with a code line, a title, the text, a tail section and page furniture."""
    doc = table(spark, d, "documents")
    body = F.concat(
        F.array(
            F.concat(F.lit("Division "), (F.col("doc_id") % 9).cast("string")),
            codes_of("doc_id"),
            F.concat_ws(" ", F.lit("Clerk"), "lang", F.lit("clerks,"), "lang"),
        ),
        F.split("text", "\n"),
        F.array(
            F.lit("ISCO 08 Unit Group Details: Code 0000"),
            F.lit("tail text that is cut"),
            (F.col("doc_id") % 100).cast("string"),
        ),
    )
    place = F.col("doc_id") * LINES_PER_DOCUMENT + F.col("i")
    return doc.select("doc_id", F.col("source").alias("file"), F.posexplode(body).alias("i", "text")).select(
        "file",
        F.floor(place / LINES_PER_PAGE).cast("bigint").alias("page"),
        place.alias("line_no"),
        "text",
    )


def entries_v(spark: SparkSession, d: str) -> DataFrame:
    """One entry per document: two aliases as title, the text as description."""
    doc = table(spark, d, "documents")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    pair = F.regexp_extract("text", r"^(\S+ \S+)", 1)
    return doc.select(
        codes_of("doc_id").alias("nco_code"),
        F.concat(word, F.lit(" / "), F.when(pair != "", pair).otherwise(word)).alias("occupation_title"),
        F.col("text").alias("description"),
        F.col("source"),
        F.col("lang"),
    )


ENTRIES_SQL = f"""entries_v AS (
  SELECT {CODE_SQL} AS nco_code,
         regexp_extract(text, '^(\\S+)', 1) || ' / ' ||
         CASE WHEN regexp_extract(text, '^(\\S+ \\S+)', 1) <> '' THEN regexp_extract(text, '^(\\S+ \\S+)', 1)
              ELSE regexp_extract(text, '^(\\S+)', 1) END AS occupation_title,
         text AS description, source, lang
  FROM documents)"""


def with_sql(body: str, *ctes: str) -> str:
    """SQL text with its common tables, each given once."""
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    return f"WITH {', '.join(seen)}\n{body}"

