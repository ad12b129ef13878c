"""Release tables printed from order flows, to be parsed back.

A release covers a calendar year. Its pages hold a month grid, flow blocks,
gender blocks and industry and state tables in the layout of real releases,
with year blocks to skip, aliases, commas, nil marks, unreadable band labels
and rows that do not add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.catalog.surrogates import FLOWS_SQL, flows_v
from weftspan.plans.storage import materialise
from weftspan.sources import fixed_values as V

BAND_LABELS = {
    "<18": "A - Less than 18",
    "18-21": "B - 18 - 21",
    "22-25": "22-25",
    "26-28": "D - 26-28",
    "29-35": "29 - 35",
    ">35": "More than 35",
}
GROSS_TITLES = ["Number of New EPF subscribers", "Members exited", "Exited who rejoined"]


def _n(c: Column) -> Column:
    """Number as printed: commas, and a dash for nil."""
    return F.when(c == 0, F.lit("-")).otherwise(F.format_number(c, 0))


def _row(page: Column, table: int, row: Column | int, cells) -> Column:
    texts = [F.lit(c) if isinstance(c, str) else c for c in cells]
    return F.struct(
        page.cast("int").alias("page"),
        F.lit(table).alias("table_no"),
        (F.lit(row) if isinstance(row, int) else row).cast("int").alias("row_no"),
        F.array(*texts).alias("cells"),
    )


def _month_names(month: Column) -> Column:
    names = F.array(*[F.lit(n.capitalize()) for n in V.MONTH_NAMES])
    return F.get(names, F.substring(month, 6, 2).cast("int") - 1)


def _full(month: Column) -> Column:
    return F.concat(_month_names(month), F.lit(" "), F.substring(month, 1, 4))


def _short(month: Column) -> Column:
    return F.concat(F.substring(_month_names(month), 1, 3), F.lit("-"), F.substring(month, 3, 2))


def _release(month: Column) -> Column:
    year = F.substring(month, 1, 4).cast("int") + 1
    return F.concat(F.lit("epfo_"), year.cast("string"), F.lit("-05"))


def _band_label(band: Column) -> Column:
    return F.coalesce(*[F.when(band == k, F.lit(v)) for k, v in BAND_LABELS.items()])


def _band_no(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in V.PAYROLL_BANDS]), band).cast("int")


def cells_v(spark, d) -> DataFrame:
    cells = flows_v(spark, d).groupBy("data_month", "age_band", "gender", "industry", "state").agg(
        *[F.sum(c).alias(c) for c in ("new", "ceased", "rejoined")]
    )
    return materialise(cells, "flow-cells")


def _with_youngest(df: DataFrame, months: DataFrame, values: list[str]) -> DataFrame:
    """Add a nil row of the youngest band, which orders never fill."""
    nil = months.select(
        "data_month", F.lit("<18").alias("age_band"), *[F.lit(0).cast("bigint").alias(v) for v in values]
    )
    return df.unionByName(nil)


def release_rows_v(spark, d) -> DataFrame:
    cells = cells_v(spark, d)
    month = F.col("data_month")
    mm = F.substring(month, 6, 2).cast("int")
    months = cells.select("data_month").distinct()
    sums = [F.sum(c).alias(c) for c in ("new", "ceased", "rejoined")]
    national = _with_youngest(
        cells.groupBy("data_month", "age_band").agg(*sums), months, ["new", "ceased", "rejoined"]
    ).withColumn("net", F.col("new") - F.col("ceased") + F.col("rejoined"))

    heads = months.select(
        _release(month).alias("release"),
        F.inline(
            F.array(
                _row(mm * 10, 0, 1, [F.concat(F.substring(month, 1, 4), F.lit("-99")), "", "", "", ""]),
                _row(mm * 10, 0, 2, ["Age Slab", "New", "Exited", "Rejoined", "Net"]),
                _row(mm * 10, 0, 3, ["", "(a)", "(b)", "(c)", "(d)"]),
                _row(mm * 10, 0, 4, ["18-21", "1", "1", "1", "1"]),
                _row(mm * 10, 1, 1, [_full(month), "", "", "", ""]),
                _row(mm * 10, 1, 2, ["Age Slab", "New", "Exited", "Rejoined", "Net"]),
                _row(mm * 10, 1, 3, ["", "(a)", "(b)", "(c)", "(d)"]),
                _row(mm * 10, 1, 99, ["Total", "1", "1", "1", "1"]),
            )
        ),
    )
    flow = national.select(
        _release(month).alias("release"),
        F.inline(
            F.array(
                _row(
                    mm * 10, 1, _band_no(F.col("age_band")) + 10,
                    [_band_label(F.col("age_band")), *[_n(F.col(c)) for c in ("new", "ceased", "rejoined", "net")]],
                )
            )
        ),
    )

    wide = cells.groupBy("data_month", "age_band").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("gender") == g, F.col(c))), F.lit(0)).alias(f"{c}_{g}")
            for c in ("new", "ceased", "rejoined")
            for g in V.GENDERS
        ]
    )
    wide = _with_youngest(wide, months, [c for c in wide.columns if c not in ("data_month", "age_band")])
    band = F.col("age_band")
    garbled = ((mm == 6) & (band == ">35")) | ((mm == 12) & band.isin(">35", "29-35"))
    texts: list[Column] = []
    for c in ("new", "ceased", "rejoined"):
        parts = [F.col(f"{c}_{g}") for g in V.GENDERS]
        total = reduce(lambda a, b: a + b, parts)
        if c == "new":
            total = total + F.when((mm == 9) & (band == "22-25"), 1).otherwise(0)
        texts += [_n(p) for p in parts] + [_n(total)]
    gender_heads = months.select(
        _release(month).alias("release"),
        F.inline(
            F.array(
                _row(mm * 10 + 5, 1, 1, [_full(month), *[""] * 15]),
                _row(
                    mm * 10 + 5, 1, 2,
                    ["Age", *[x for t in GROSS_TITLES for x in (t, "", "", "", "")]],
                ),
                _row(mm * 10 + 5, 1, 3, ["", *["Male", "Female", "Trans- gender", "Not Available", "Total"] * 3]),
            )
        ),
    )
    gender = wide.select(
        _release(month).alias("release"),
        F.inline(
            F.array(
                _row(
                    mm * 10 + 5, 1, _band_no(band) + 10,
                    [F.when(garbled, F.lit("~garbled~")).otherwise(_band_label(band)), *texts],
                )
            )
        ),
    )

    grid_months = national.groupBy("data_month").agg(
        F.map_from_entries(F.collect_list(F.struct("age_band", "net"))).alias("by_band")
    )
    grid_heads = months.select(_release(month).alias("release")).distinct().select(
        "release",
        F.inline(F.array(_row(F.lit(1), 1, 1, ["Month/Age", *V.PAYROLL_BANDS, "Total"]))),
    )
    grid = grid_months.select(
        _release(month).alias("release"),
        F.inline(
            F.array(
                _row(
                    F.lit(1), 1, mm + 1,
                    [
                        _short(month),
                        *[
                            _n(F.col("by_band")[b] + F.when((mm == 7) & F.lit(b == "26-28"), 1).otherwise(0))
                            for b in V.PAYROLL_BANDS
                        ],
                        "0",
                    ],
                )
            )
        ),
    )
    parts = [heads, flow, gender_heads, gender, grid_heads, grid]
    parts += _dimension_rows(cells, months, "industry", 200)
    parts += _dimension_rows(cells, months, "state", 300)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("release", F.concat("release", F.lit(".pdf")).alias("file"), "page", "table_no", "row_no", "cells")


def _dimension_rows(cells: DataFrame, months: DataFrame, dim: str, first_page: int) -> list[DataFrame]:
    month = F.col("data_month")
    columns = months.groupBy(_release(month).alias("release")).agg(
        F.sort_array(F.collect_list("data_month")).alias("months")
    )
    net = cells.groupBy("data_month", "age_band", dim).agg(
        F.sum(F.col("new") - F.col("ceased") + F.col("rejoined")).alias("net")
    )
    packed = (
        net.groupBy(_release(month).alias("release"), "age_band", dim)
        .agg(F.map_from_entries(F.collect_list(F.struct("data_month", "net"))).alias("by_month"))
        .join(columns, "release")
    )
    page = (_band_no(F.col("age_band")) + first_page).cast("int")
    title = dim.capitalize()
    heads = packed.select("release", "age_band", "months").distinct().select(
        "release",
        page.alias("page"),
        F.inline(
            F.array(
                F.struct(
                    F.lit(1).alias("table_no"), F.lit(1).alias("row_no"),
                    F.concat(
                        F.array(F.concat(F.lit("Age Bucket : "), F.col("age_band"))),
                        F.transform("months", lambda m: F.lit("")),
                    ).alias("cells"),
                ),
                F.struct(
                    F.lit(1).alias("table_no"), F.lit(2).alias("row_no"),
                    F.concat(F.array(F.lit(title)), F.transform("months", _short)).alias("cells"),
                ),
                F.struct(
                    F.lit(1).alias("table_no"), F.lit(9999).alias("row_no"),
                    F.concat(F.array(F.lit("Grand Total")), F.transform("months", lambda m: F.lit("1"))).alias("cells"),
                ),
            )
        ),
    )
    body = packed.select(
        "release",
        page.alias("page"),
        F.lit(1).alias("table_no"),
        (F.pmod(F.xxhash64(dim), F.lit(9000)) + 10).cast("int").alias("row_no"),
        F.concat(
            F.array(F.col(dim)),
            F.transform("months", lambda m: _n(F.coalesce(F.try_element_at("by_month", m), F.lit(0)))),
        ).alias("cells"),
    )
    return [heads, body]


def release_lines_v(spark, d) -> DataFrame:
    """The text variant: month labels and band lines of fifteen values."""
    rows = release_rows_v(spark, d).filter((F.col("page") % 10 == 5) & (F.col("page") < 200))
    label = F.get("cells", 0)
    text = F.when(F.col("row_no") == 1, label).when(
        F.col("row_no") > 3,
        F.concat(
            F.replace(F.regexp_replace(label, "^[A-F] - ", ""), F.lit(" - "), F.lit("-")),
            F.lit(" "),
            F.array_join(F.slice("cells", 2, 15), " "),
        ),
    ).otherwise(F.lit("Age male female transgender not-available total"))
    body = rows.select(
        F.replace("release", F.lit("epfo"), F.lit("mospi")).alias("release"),
        F.col("file"), "page", F.col("row_no").alias("line_no"), text.alias("text"),
    )
    tail = body.select("release", "file").distinct().select(
        "release", "file",
        F.inline(
            F.array(
                F.struct(F.lit(400).alias("page"), F.lit(1).alias("line_no"), F.lit("2.2 Other scheme").alias("text")),
                F.struct(F.lit(400).alias("page"), F.lit(2).alias("line_no"), F.lit("18-21 1 1 1 1 4 1 1 1 1 4 1 1 1 1 4").alias("text")),
            )
        ),
    )
    return body.unionByName(tail)


_REL = "'epfo_' || (substr(data_month, 1, 4)::INTEGER + 1)::VARCHAR || '-05'"
_MM = "substr(data_month, 6, 2)::INTEGER"

RELEASE_SQL = FLOWS_SQL + f""",
months AS (SELECT DISTINCT data_month, {_REL} AS source_release FROM flows_v),
nat AS (
  SELECT data_month, age_band, sum(nw) AS a, sum(ceased) AS b, sum(rejoined) AS c FROM flows_v GROUP BY ALL
  UNION ALL SELECT data_month, '<18', 0, 0, 0 FROM months),
gen0 AS (SELECT data_month, age_band, gender, sum(nw) AS a, sum(ceased) AS b, sum(rejoined) AS c FROM flows_v GROUP BY ALL),
bands AS (SELECT DISTINCT data_month, age_band FROM nat),
gen AS (
  SELECT k.data_month, k.age_band, g.gender, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c
  FROM bands k CROSS JOIN (VALUES ('male'), ('female'), ('transgender'), ('not_available')) g(gender)
  LEFT JOIN gen0 ON gen0.data_month = k.data_month AND gen0.age_band = k.age_band AND gen0.gender = g.gender
  WHERE NOT ({_MM.replace('data_month', 'k.data_month')} = 9 AND k.age_band = '22-25')
    AND NOT ({_MM.replace('data_month', 'k.data_month')} = 12 AND k.age_band IN ('>35', '29-35'))
    AND NOT ({_MM.replace('data_month', 'k.data_month')} = 6 AND k.age_band = '>35'
             AND (SELECT count(*) FROM bands b WHERE b.data_month = k.data_month) < 6)),
net AS (SELECT data_month, {_REL} AS source_release, age_band, industry, state, nw - ceased + rejoined AS v FROM flows_v),
ind AS (
  SELECT m.data_month, m.source_release, k.age_band, k.industry,
         coalesce((SELECT sum(v) FROM net n WHERE n.data_month = m.data_month AND n.age_band = k.age_band AND n.industry = k.industry), 0) AS v
  FROM months m JOIN (SELECT DISTINCT source_release, age_band, industry FROM net) k ON m.source_release = k.source_release),
sta AS (
  SELECT m.data_month, m.source_release, k.age_band, k.state,
         coalesce((SELECT sum(v) FROM net n WHERE n.data_month = m.data_month AND n.age_band = k.age_band AND n.state = k.state), 0) AS v
  FROM months m JOIN (SELECT DISTINCT source_release, age_band, state FROM net) k ON m.source_release = k.source_release),
parsed AS (
  SELECT data_month, {_REL} AS source_release, measure, age_band, NULL::VARCHAR AS gender, NULL::VARCHAR AS industry, NULL::VARCHAR AS state, v::BIGINT AS value
  FROM (SELECT data_month, age_band, 'new_subscribers' AS measure, a AS v FROM nat UNION ALL SELECT data_month, age_band, 'ceased', b FROM nat
        UNION ALL SELECT data_month, age_band, 'rejoined', c FROM nat UNION ALL SELECT data_month, age_band, 'net_payroll', a - b + c FROM nat)
  UNION ALL
  SELECT data_month, {_REL}, measure, age_band, gender, NULL, NULL, v::BIGINT
  FROM (SELECT data_month, age_band, gender, 'new_subscribers' AS measure, a AS v FROM gen UNION ALL SELECT data_month, age_band, gender, 'ceased', b FROM gen
        UNION ALL SELECT data_month, age_band, gender, 'rejoined', c FROM gen)
  UNION ALL SELECT data_month, source_release, 'net_payroll', age_band, NULL, industry, NULL, v::BIGINT FROM ind
  UNION ALL SELECT data_month, source_release, 'net_payroll', age_band, NULL, NULL, state, v::BIGINT FROM sta)"""
