"""From extracted release tables to payroll panel rows.

Input rows are (release, file, page, table_no, row_no, cells array<string>).
Headers, periods and age buckets apply to the rows after them, across pages;
each is set by the row that states it and carried forward in row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions import payroll as P
from weftspan.plans.ranking import carry_forward
from weftspan.plans.sizing import bounded_map
from weftspan.plans.storage import materialise
from weftspan.sources import fixed_values as V
from weftspan.sources.maps import recode

PLACE = ["table_no", "row_no"]
PANEL = ["data_month", "source_release", "measure", "age_band", "gender", "industry", "state", "value"]
BINDING = "array<struct<pos:int,a:string,b:string>>"
CELL = "struct<measure:string,age_band:string,gender:string,industry:string,state:string,data_month:string,value:bigint>"
NOTE = "struct<context:string,detail:string>"


@dataclass(frozen=True)
class ReleaseParse:
    """What a set of release tables yields: panel rows, the first-page grid
    used for cross-checks, and the log of cells that did not parse."""

    panel: DataFrame
    grid: DataFrame
    issues: DataFrame


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _show(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit("null"))), "|")


def _bound(i: Column, a: Column, b: Column | None = None) -> Column:
    return F.struct(
        i.cast("int").alias("pos"),
        a.alias("a"),
        (F.lit(None).cast("string") if b is None else b).alias("b"),
    )


def _classify(rows: DataFrame) -> DataFrame:
    """Local facts of each row: what its own cells say.

    Every cell is cleaned and parsed here, once; what only some rows need is
    parsed in those rows only.
    """
    fixes = {f"{r}|{c}": m for (r, c), m in V.HEADER_FIXES.items()}

    def fixed(c: Column) -> Column:
        return recode(F.concat(F.col("release"), F.lit("|"), c), fixes)

    c0 = F.col("c0")
    genders = F.when(
        F.contains("joined", F.lit("male")), F.transform("cells", lambda c: P.parse_gender(c))
    ).otherwise(F.array().cast("array<string>"))
    rest_empty = ~F.exists(F.slice("cells", 2, F.size("cells")), lambda c: c != "")
    is_wide, is_grid = c0.isin("State", "Industry"), F.contains(c0, F.lit("Month/Age"))
    clean = rows.withColumn("cells", F.transform("cells", lambda c: P.clean_cell(c)))
    return (
        clean.withColumn("c0", F.get("cells", 0))
        .withColumn("joined", F.lower(F.array_join("cells", " ")))
        .select(
            "release", "page", *PLACE, "cells", "c0",
            F.transform("cells", lambda c: P.parse_value(c)).alias("vals"),
            F.exists("cells", lambda c: c != "").alias("any_text"),
            (rest_empty & (c0 != "")).alias("is_label"),
            genders.alias("genders"),
            (F.array_contains("cells", "(a)") | F.array_contains("cells", "(d)")).alias("lettered"),
            c0.rlike(r"^Age\b").alias("starts_age"),
            (
                F.contains("joined", F.lit("joined in or after"))
                | F.contains("joined", F.lit("net new epf"))
            ).alias("is_variant"),
            P.parse_band(c0).alias("band"),
            P.full_month(c0).alias("full_month"),
            P.short_month(c0).alias("short_month"),
            F.when(is_wide, F.transform("cells", lambda c: F.coalesce(fixed(c), P.short_month(c))))
            .when(is_grid, F.transform("cells", lambda c: P.parse_band(c)))
            .alias("heads"),
            F.coalesce(is_wide & F.exists("cells", lambda c: fixed(c).isNotNull()), F.lit(False)).alias("is_fixed"),
        )
        .withColumn("male", F.exists("genders", lambda g: F.coalesce(g == "male", F.lit(False))))
        .withColumn(
            "is_age",
            F.col("starts_age") & ~F.col("male") & ~F.col("lettered")
            & ~(F.col("is_label") & F.col("c0").startswith("Age Bucket")),
        )
        .withColumn(
            "before",
            F.when(
                F.col("any_text"),
                F.struct(
                    (F.col("is_age") & ~F.col("is_variant")).alias("opens"),
                    F.when(F.col("is_age"), F.col("cells")).alias("header"),
                ),
            ),
        )
        .drop("starts_age")
    )


def _gender_binding(df: DataFrame) -> DataFrame:
    """Column binding of a gender sub-header: (position, gender, measure).

    Fifteen columns, five per measure. If some sub-header cells are garbled,
    the fixed positions of the two known layouts apply, provided that every
    legible cell agrees with them.
    """
    five = [*V.GENDERS, "total"]
    gross = F.array(*[F.lit(m) for m in V.GROSS_MEASURES])
    measures = F.filter(
        F.transform(F.slice(F.col("header"), 2, F.size("header")), lambda c: P.parse_measure(c)),
        lambda m: m.isNotNull(),
    )
    legible = F.filter(
        F.transform("genders", lambda g, i: F.struct(i.cast("int").alias("pos"), g.alias("g"))),
        lambda s: s.getField("g").isNotNull(),
    )
    plain = F.transform(
        legible,
        lambda s, i: _bound(
            s.getField("pos"), s.getField("g"), F.get(gross, F.floor(i / 5).cast("int"))
        ),
    ).cast(BINDING)

    def layout(columns: list[int]) -> Column:
        return F.array(
            *[
                _bound(F.lit(c), F.lit(five[i % 5]), F.lit(V.GROSS_MEASURES[i // 5]))
                for i, c in enumerate(columns)
            ]
        ).cast(BINDING)

    width = F.size("cells")
    template = F.when(width == 16, layout(V.GENDER_COLUMNS_16)).when(
        width == 18, layout(V.GENDER_COLUMNS_18)
    )
    agrees = F.forall(
        legible,
        lambda s: F.exists(
            template,
            lambda t: (t.getField("pos") == s.getField("pos")) & (t.getField("a") == s.getField("g")),
        ),
    )
    sub = F.col("pending") & F.col("male")
    fit = (
        F.when(~sub, F.lit(None).cast("string"))
        .when(measures != gross, F.lit("measures"))
        .when(F.size(legible) == 15, F.lit("plain"))
        .when(template.isNotNull() & agrees, F.lit("positional"))
        .otherwise(F.lit("layout"))
    )
    return df.withColumn("gender_fit", fit).withColumn(
        "gender_bind",
        F.when(F.col("gender_fit") == "plain", plain).when(
            F.col("gender_fit") == "positional", template
        ),
    )


def _states(df: DataFrame) -> DataFrame:
    """State set by each row, null where the row sets none."""
    c0 = F.col("c0")
    consumed = F.col("pending") & (F.col("male") | F.col("lettered"))
    label = F.col("is_label") & ~consumed
    month = F.col("full_month")
    skips = c0.rlike(P.YEAR_BLOCK) | F.contains(
        F.replace(F.lower(c0), F.lit("("), F.lit("")), F.lit("from sep")
    )
    flush = label & (month.isNotNull() | skips)
    bucket = label & ~flush & c0.startswith("Age Bucket")
    header = ~consumed & ~flush & ~bucket
    grid = header & F.contains(c0, F.lit("Month/Age"))
    wide = header & ~grid & c0.isin("State", "Industry")
    age = header & ~grid & ~wide & F.col("is_age")
    head_bind = F.filter(
        F.transform("heads", lambda h, i: _bound(i, h)),
        lambda b: (b.getField("pos") > 0) & b.getField("a").isNotNull(),
    ).cast(BINDING)
    mode = (
        F.when(consumed & F.col("gender_bind").isNotNull(), F.lit("gender"))
        .when(consumed & F.col("male"), F.lit("skip"))
        .when(consumed, F.lit("flow"))
        .when(grid, F.lit("grid"))
        .when(wide, F.lower(c0))
        .when(age & F.col("is_variant"), F.lit("skip"))
        .when(F.col("pending") & F.col("any_text") & ~age, F.lit("flow"))
    )
    return df.select(
        "release", "page", *PLACE, "cells", "c0", "vals", "band", "short_month", "gender_fit",
        (F.col("is_fixed") & wide).alias("is_fixed"),
        (consumed | flush | bucket | grid | wide | age).alias("is_head"),
        F.when(flush, F.struct(month.alias("month"))).alias("period"),
        F.when(flush, F.struct("page", *PLACE)).alias("block"),
        F.when(
            bucket,
            F.struct(P.parse_band(F.regexp_extract(c0, r"^[^:]*:(.*)$", 1)).alias("band")),
        ).alias("bucket"),
        mode.alias("mode"),
        F.when(grid | wide, head_bind).when(
            consumed & F.col("male"), F.coalesce("gender_bind", F.array().cast(BINDING))
        ).alias("bind"),
    )


def resolve_rows(rows: DataFrame) -> DataFrame:
    """Every table row with the period, mode, bucket, block and column binding
    that hold for it.

    Two walks in row order: one finds the header a sub-header belongs to, one
    carries the states. Each walk reads its input twice (rows and pages), so
    inputs are written once.
    """
    local = materialise(_classify(rows), "cells")
    pending = carry_forward(local, ["release"], "page", PLACE, ["before"], inclusive=False)
    pending = pending.select(
        *[c for c in pending.columns if c != "before"],
        (F.coalesce(F.col("before.opens"), F.lit(False)) & F.col("any_text")).alias("pending"),
        F.col("before.header").alias("header"),
    )
    states = materialise(_states(_gender_binding(pending)), "states")
    held = carry_forward(
        states, ["release"], "page", PLACE, ["period", "block", "bucket", "mode", "bind"]
    )
    return held.select(
        *[c for c in held.columns if c not in ("period", "bucket")],
        F.col("period.month").alias("month"),
        F.col("bucket.band").alias("bucket_band"),
    )


def _emit(measure, band, value, gender=None, industry=None, state=None, month=None) -> Column:
    def opt(c):
        return F.lit(None).cast("string") if c is None else c

    return F.struct(
        measure.alias("measure"),
        band.alias("age_band"),
        opt(gender).alias("gender"),
        opt(industry).alias("industry"),
        opt(state).alias("state"),
        opt(month).alias("data_month"),
        value.cast("bigint").alias("value"),
    )


def _note(context: Column, detail: Column) -> Column:
    return F.struct(context.alias("context"), detail.alias("detail"))


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _flow() -> tuple[Column, Column, Column]:
    """(applies, cells, issues) of a band row in a flow block: four measures,
    a - b + c = d checked; a row that fails the check is still emitted."""
    v = [F.get("vals", i + 1) for i in range(4)]
    applies = (F.col("mode") == "flow") & F.col("band").isNotNull() & F.col("month").isNotNull()
    whole = v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull()
    context = _text("flow ", F.col("month"), " ", F.col("band"))
    out = F.array(
        *[_emit(F.lit(m), F.col("band"), v[i]) for i, m in enumerate(V.FLOW_MEASURES)]
    ).cast(f"array<{CELL}>")
    shown = _show(F.slice("cells", 2, 4))
    issues = (
        F.when(~whole, F.array(_note(context, _text("unparseable cells: ", shown))))
        .when(
            v[0] - v[1] + v[2] != v[3],
            F.array(_note(context, _text("identity a-b+c!=d: ", shown))),
        )
        .otherwise(_no(NOTE))
    )
    return applies, F.when(whole, out).otherwise(_no(CELL)), issues.cast(f"array<{NOTE}>")


def _value_at(b: Column) -> Column:
    return F.get(F.col("vals"), b.getField("pos"))


def _broken_sums(bind: Column, value) -> Column:
    """Measures whose four genders do not add up to their total, or do not
    parse."""

    def adds_up(m: str) -> Column:
        mine = F.filter(bind, lambda b: b.getField("b") == m)
        # total minus genders, null if any cell is unread
        rest = F.aggregate(
            mine,
            F.lit(0).cast("bigint"),
            lambda acc, b: acc + F.when(b.getField("a") == "total", value(b)).otherwise(-value(b)),
        )
        return F.coalesce(rest == 0, F.lit(False))

    return F.filter(
        F.array(*[F.when(~adds_up(m), F.lit(m)) for m in V.GROSS_MEASURES]),
        lambda m: m.isNotNull(),
    )


def _gender_cells(bind: Column, value, band: Column, totals: bool) -> Column:
    kept = bind if totals else F.filter(bind, lambda b: b.getField("a") != "total")
    return F.transform(
        kept,
        lambda b: _emit(
            b.getField("b"),
            band,
            value(b),
            gender=F.when(b.getField("a") != "total", b.getField("a")),
        ),
    ).cast(f"array<{CELL}>")


def _wide() -> tuple[Column, Column, Column]:
    """(applies, cells, issues) of a state or industry row: one value per month
    column; totals and page titles are passed over."""
    c0, bucket = F.col("c0"), F.col("bucket_band")
    applies = (
        F.col("mode").isin("state", "industry")
        & (c0 != "")
        & (F.size("bind") > 0)
        & ~F.contains(F.upper(c0), F.lit("TOTAL"))
        & ~F.contains(F.upper(c0), F.lit("PAYROLL"))
    )
    name = recode(c0, V.INDUSTRY_FIXES, c0)
    out = F.transform(
        F.filter("bind", lambda b: _value_at(b).isNotNull()),
        lambda b: _emit(
            F.lit("net_payroll"),
            bucket,
            _value_at(b),
            industry=F.when(F.col("mode") == "industry", name),
            state=F.when(F.col("mode") == "state", name),
            month=b.getField("a"),
        ),
    ).cast(f"array<{CELL}>")
    unread = F.transform(
        F.filter("bind", lambda b: _value_at(b).isNull()),
        lambda b: _note(
            _text(F.col("mode"), " ", b.getField("a"), " ", bucket),
            _text(
                "unparseable cell for ", c0, ": ",
                F.coalesce(F.get(F.col("cells"), b.getField("pos")), F.lit("none")),
            ),
        ),
    ).cast(f"array<{NOTE}>")
    has_bucket = bucket.isNotNull()
    orphan = F.array(_note(F.col("mode"), _text("no age bucket for row ", c0)))
    return (
        applies,
        F.when(has_bucket, out).otherwise(_no(CELL)),
        F.when(has_bucket, unread).otherwise(orphan).cast(f"array<{NOTE}>"),
    )


def _head_issues() -> Column:
    garbled = (
        F.when(F.col("gender_fit") == "measures", F.lit("unrecognised measures"))
        .when(F.col("gender_fit") == "positional", F.lit("positional fallback applied"))
        .when(F.col("gender_fit") == "layout", F.lit("unrecognised layout"))
    )
    return F.filter(
        F.array(
            F.when(
                F.col("is_fixed"),
                _note(_text(F.col("mode"), "-header"), F.lit("applied documented header fix")),
            ),
            F.when(
                garbled.isNotNull(),
                _note(F.lit("gender-header"), _text(garbled, ": ", _show(F.col("cells")))),
            ),
        ),
        lambda n: n.isNotNull(),
    ).cast(f"array<{NOTE}>")


def _parse(held: DataFrame, totals: bool) -> DataFrame:
    """One pass over resolved rows: cells and issues of each row, and, for
    gender rows, what the repair of unreadable labels needs."""
    is_gender = (
        (F.col("mode") == "gender")
        & F.col("month").isNotNull()
        & (F.col("band").isNotNull() | (F.col("c0") != ""))
        & ~F.contains(F.upper("c0"), F.lit("TOTAL"))
    )
    data = ~F.col("is_head")
    held = held.withColumn(
        "bad", F.when(data & is_gender, _broken_sums(F.col("bind"), _value_at))
    )
    good = F.size("bad") == 0
    flow, flow_out, flow_issues = _flow()
    wide, wide_out, wide_issues = _wide()
    context = _text("gender ", F.col("month"), " ", F.col("band"))
    sums = F.transform(
        "bad",
        lambda m: _note(
            _text(context, " ", m), _text("row-sum mismatch or unparseable: ", _show(F.col("cells")))
        ),
    ).cast(f"array<{NOTE}>")
    gender = F.col("bad").isNotNull()
    labelled = F.col("band").isNotNull()
    out = (
        F.when(F.col("is_head"), _no(CELL))
        .when(gender & labelled & good, _gender_cells(F.col("bind"), _value_at, F.col("band"), totals))
        .when(flow, flow_out)
        .when(wide, wide_out)
        .otherwise(_no(CELL))
    )
    issues = (
        F.when(F.col("is_head"), _head_issues())
        .when(gender & labelled, sums)
        .when(flow, flow_issues)
        .when(wide, wide_issues)
        .otherwise(_no(NOTE))
    )
    grid = F.when(
        data & (F.col("mode") == "grid") & F.col("short_month").isNotNull(),
        F.filter(
            F.transform(
                "bind",
                lambda b: F.struct(b.getField("a").alias("age_band"), _value_at(b).alias("value")),
            ),
            lambda s: s.getField("value").isNotNull(),
        ),
    )
    return held.select(
        "release", "page", "month", "block", "short_month",
        out.alias("out"),
        issues.alias("issues"),
        grid.alias("grid"),
        F.when(gender & good, F.struct("band")).alias("valid"),
        F.when(gender & good & ~labelled, F.struct("bind", "vals")).alias("orphan"),
    )


def _repair(parsed: DataFrame, totals: bool) -> DataFrame:
    """Gender rows with an unreadable band label.

    Such a row is given the one band its block lacks, if it is the only such
    row of the block; otherwise it is dropped and logged. A block runs from
    one period label to the next and has a handful of rows; only blocks with
    such a row are looked at.
    """
    orphans = parsed.filter(F.col("orphan").isNotNull())
    blocks = parsed.filter(F.col("valid").isNotNull()).groupBy("release", "block").agg(
        F.collect_set("valid.band").alias("seen"),
        F.count_if(F.col("orphan").isNotNull()).alias("n_orphans"),
    )
    bands = F.array(*[F.lit(b) for b in V.PAYROLL_BANDS])
    joined = orphans.select("release", "page", "month", "block", "orphan").join(
        blocks.filter(F.col("n_orphans") > 0), ["release", "block"]
    ).withColumn("missing", F.array_except(bands, F.col("seen")))
    forced = (F.col("n_orphans") == 1) & (F.size("missing") == 1)
    only = F.get("missing", 0)
    context = _text("gender ", F.col("month"))
    cells = _gender_cells(
        F.col("orphan.bind"),
        lambda b: F.get(F.col("orphan.vals"), b.getField("pos")),
        only,
        totals,
    )
    note = F.when(
        forced,
        _note(_text(context, " ", only), F.lit("garbled band label; assigned as the only missing band")),
    ).otherwise(
        _note(context, _text("dropped unassignable row (missing bands: ", F.array_join("missing", ","), ")"))
    )
    return joined.select(
        "release", "page", "month",
        F.when(forced, cells).otherwise(_no(CELL)).alias("out"),
        F.array(note).cast(f"array<{NOTE}>").alias("issues"),
    )


def parse_release_rows(rows: DataFrame, national_from_gender: bool = False) -> ReleaseParse:
    """Panel rows, first-page grid and issue log of release tables.

    ``national_from_gender`` also emits the total columns of gender blocks as
    national rows, for releases that print no national table.
    """
    parsed = materialise(_parse(resolve_rows(rows), national_from_gender), "parsed")
    parts = parsed.select("release", "page", "month", "out", "issues").unionByName(
        _repair(parsed, national_from_gender)
    )
    panel = (
        parts.select("release", F.col("month").alias("block_month"), F.inline("out"))
        .select(
            F.coalesce("data_month", "block_month").alias("data_month"),
            F.col("release").alias("source_release"),
            "measure", "age_band", "gender", "industry", "state", "value",
        )
    )
    grid = parsed.filter(F.col("grid").isNotNull()).select(
        "release", "page", F.col("short_month").alias("data_month"), F.inline("grid")
    )
    issues = parts.select("release", "page", F.inline("issues"))
    return ReleaseParse(panel, grid, issues)


def parse_text_lines(lines: DataFrame) -> ReleaseParse:
    """Text variant: (release, file, page, line_no, text) with a month label and
    then band rows of fifteen values; a section mark ends the tables."""
    text = F.trim(F.col("text"))
    month = P.full_month("text")
    rest = F.regexp_extract("text", P.BAND_LINE, 2)
    df = materialise(
        lines.withColumn("text", text).select(
            "release", "page", "line_no",
            P.parse_band(F.regexp_extract("text", P.BAND_LINE, 1)).alias("band"),
            rest.alias("rest"),
            F.transform(
                F.filter(F.split(rest, r"\s+"), lambda t: t != ""), lambda t: P.parse_value(t)
            ).alias("vals"),
            F.when(month.isNotNull(), F.struct(month.alias("month"))).alias("period"),
            F.when(F.col("text").rlike(P.SECTION_END), F.lit(True)).alias("ended"),
        ),
        "lines",
    )
    rows = (
        carry_forward(df, ["release"], "page", ["line_no"], ["period", "ended"])
        .filter(F.col("ended").isNull() & F.col("period").isNotNull() & F.col("band").isNotNull())
        .select("release", "page", F.col("period.month").alias("month"), "band", "rest", "vals")
    )
    five = [*V.GENDERS, "total"]
    bind = F.array(
        *[_bound(F.lit(i), F.lit(five[i % 5]), F.lit(V.GROSS_MEASURES[i // 5])) for i in range(15)]
    ).cast(BINDING)
    whole = (F.size("vals") == 15) & F.forall("vals", lambda v: v.isNotNull())
    rows = rows.withColumn("bad", _broken_sums(bind, _value_at))
    context = _text("text ", F.col("month"), " ", F.col("band"))
    panel = (
        rows.filter(whole & (F.size("bad") == 0))
        .select("release", "month", F.inline(_gender_cells(bind, _value_at, F.col("band"), True)))
        .select(
            F.col("month").alias("data_month"),
            F.col("release").alias("source_release"),
            "measure", "age_band", "gender", "industry", "state", "value",
        )
    )
    issues = rows.select(
        "release", "page",
        F.inline(
            F.when(~whole, F.array(_note(context, _text("expected 15 values, got: ", F.col("rest")))))
            .otherwise(F.transform("bad", lambda m: _note(_text(context, " ", m), F.lit("row-sum mismatch"))))
            .cast(f"array<{NOTE}>")
        ),
    )
    grid = panel.select(
        F.col("source_release").alias("release"), F.lit(None).cast("int").alias("page"),
        "data_month", "age_band", "value",
    ).limit(0)
    return ReleaseParse(panel, grid, issues)


def release_map(spark, releases=V.RELEASES) -> DataFrame:
    return bounded_map(spark, list(releases), "source_release string, first_month string, last_month string")


def outside_release(panel: DataFrame, releases: DataFrame) -> DataFrame:
    """Months found outside the range their release owns (or of no known release)."""
    found = panel.groupBy("source_release", "data_month").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("data_month").between(F.col("first_month"), F.col("last_month"))
    return (
        found.join(releases, "source_release", "left")
        .filter(~F.coalesce(inside, F.lit(False)))
        .select("source_release", "data_month", "n")
    )


def stitch(panel: DataFrame, releases: DataFrame) -> DataFrame:
    """The panel unchanged, if every release keeps to its months; else an error."""
    out = outside_release(panel, releases).limit(20).collect()
    if out:
        raise ValueError(f"months outside their release: {[tuple(r) for r in out]}")
    return panel


def grid_mismatches(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """First-page grid cells that differ from the national net flow."""
    net = national(panel).filter(F.col("measure") == "net_payroll").select(
        F.col("source_release").alias("release"), "data_month", "age_band",
        F.col("value").alias("flow_value"),
    )
    return grid.join(net, ["release", "data_month", "age_band"]).filter(
        F.col("value") != F.col("flow_value")
    )


def national(panel: DataFrame) -> DataFrame:
    """Rows with no gender, industry or state: a null dimension means all."""
    return panel.filter(
        F.col("gender").isNull() & F.col("industry").isNull() & F.col("state").isNull()
    )
