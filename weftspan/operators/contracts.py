"""Table contracts, numeric gates and golden comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.plans.sizing import small_side
from weftspan.plans.storage import materialise

VIOLATION_SCHEMA = "rule string, column string, n bigint, sample string"


@dataclass(frozen=True)
class Field:
    """One column of a contract; unset rules are not checked."""

    name: str
    type: str
    nullable: bool = False
    unique: bool = False
    regex: str | None = None
    isin: Sequence[str] | None = None
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    min_length: int | None = None

    def rules(self) -> dict[str, Column]:
        """Rule name to the condition under which a row breaks it."""
        c = F.col(self.name)
        found: dict[str, Column] = {}
        if not self.nullable:
            found["not_null"] = c.isNull()
        if self.regex is not None:
            found["regex"] = ~c.rlike(self.regex)
        if self.isin is not None:
            found["isin"] = ~c.isin(list(self.isin))
        if self.ge is not None:
            found["ge"] = c < self.ge
        if self.gt is not None:
            found["gt"] = c <= self.gt
        if self.le is not None:
            found["le"] = c > self.le
        if self.min_length is not None:
            found["min_length"] = F.length(c) < self.min_length
        return found


@dataclass(frozen=True)
class Contract:
    name: str
    fields: Sequence[Field] = field(default_factory=tuple)


class ContractError(ValueError):
    """Raised with every violation found, not only the first."""


def _shape_faults(df: DataFrame, contract: Contract) -> list[tuple]:
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.type for f in contract.fields}
    faults = [("missing_column", n, 1, t) for n, t in want.items() if n not in have]
    faults += [("unexpected_column", n, 1, t) for n, t in have.items() if n not in want]
    faults += [
        ("type", n, 1, have[n]) for n, t in want.items() if n in have and have[n] != t
    ]
    return faults


def _repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with values that repeat within their column, for all columns in one shuffle.

    Every row gives one (column, value digest) per column; counts are combined before
    the shuffle. Only digests met twice, none in a sound table, are looked at again by
    value, so that two values of one digest do not pass for a repetition.
    """
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.xxhash64(c).alias("digest"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_e")
    cells = df.select(each).select("_e.*").filter(F.col("value").isNotNull())
    twice = cells.groupBy("column", "digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("column", "digest")
    met = cells.join(small_side(materialise(twice, "digests")), ["column", "digest"])
    found = met.groupBy("column", "value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return found.groupBy("column").agg(F.sum("times").alias("n"), F.min("value").alias("sample")).select(F.lit("unique").alias("rule"), "column", "n", "sample")


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Every broken rule with the number of rows breaking it and one sample.

    All row rules are counted in one pass, and all unique columns in another.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    checked = [f for f in contract.fields if types.get(f.name) == f.type]
    parts = [spark.createDataFrame(_shape_faults(df, contract), VIOLATION_SCHEMA)]
    counts, entries = [], []
    for f in checked:
        for rule, broken in f.rules().items():
            key = f"{f.name}__{rule}"
            hit = F.coalesce(broken, F.lit(False))
            counts.append(F.count_if(hit).alias(f"n_{key}"))
            sample = F.when(hit, F.col(f.name).cast("string"))
            counts.append(F.min(sample).alias(f"s_{key}"))
            entries.append(
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(f.name).alias("column"),
                    F.col(f"n_{key}").alias("n"),
                    F.col(f"s_{key}").alias("sample"),
                )
            )
    if counts:
        parts.append(
            df.agg(*counts).select(F.inline(F.array(*entries))).filter(F.col("n") > 0)
        )
    if unique := [f.name for f in checked if f.unique]:
        parts.append(_repeated(df, unique))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """Return the frame unchanged, or raise with all violations."""
    found = violations(df, contract).collect()
    if found:
        lines = [f"{r['column']}: {r['rule']} x{r['n']} e.g. {r['sample']}" for r in found]
        raise ContractError(f"{contract.name}: " + "; ".join(sorted(lines)))
    return df


class GateError(RuntimeError):
    """A numeric limit was not met."""


def gate(df: DataFrame, value: str, minimum=None, maximum=None, name: str = "gate") -> DataFrame:
    """Add a verdict column to a one-row summary: PASS, FAIL or not computable."""
    v = F.col(value)
    fails = F.lit(False)
    if minimum is not None:
        fails = fails | (v < minimum)
    if maximum is not None:
        fails = fails | (v > maximum)
    verdict = (
        F.when(v.isNull() | F.isnan(v.cast("double")), "not computable")
        .when(fails, "FAIL")
        .otherwise("PASS")
    )
    return df.withColumn(name, verdict)


def stop_unless(df: DataFrame, value: str, minimum=None, maximum=None) -> DataFrame:
    """Raise when a one-row summary fails its gate; otherwise pass it on."""
    row = gate(df, value, minimum, maximum, "_verdict").first()
    if row is None or row["_verdict"] != "PASS":
        got = None if row is None else row[value]
        raise GateError(f"STOP: {value} = {got}, limits [{minimum}, {maximum}]")
    return df


def golden_diff(new: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows on one side only, keeping multiplicity; empty means equal."""
    if dict(new.dtypes) != dict(golden.dtypes):
        raise ContractError(f"schemas differ: {new.dtypes} and {golden.dtypes}")
    golden = golden.select(*new.columns)
    return (
        new.exceptAll(golden)
        .withColumn("side", F.lit("new"))
        .unionByName(golden.exceptAll(new).withColumn("side", F.lit("golden")))
    )


# The table contracts.
TASK_STATEMENTS = Contract(
    "task_statements",
    (
        Field("nco_code", "string", regex=r"^\d{4}\.\d{4}$"),
        Field("group3", "string", regex=r"^\d{3}$"),
        Field("occupation_title", "string"),
        Field("task_id", "string", unique=True),
        Field("task_text", "string", min_length=10),
        Field("source", "string", isin=["nco_vol2a", "nco_vol2b", "posting_derived"]),
    ),
)
TASK_SCORES = Contract(
    "task_scores",
    (
        Field("task_id", "string"),
        Field("rubric_version", "string"),
        Field("model", "string"),
        Field("score", "string", isin=["E0", "E1", "E2", "TIE"]),
        Field("votes_e0", "bigint", ge=0),
        Field("votes_e1", "bigint", ge=0),
        Field("votes_e2", "bigint", ge=0),
        Field("tie_escalated", "boolean"),
        Field("scored_at", "string"),
    ),
)
OCCUPATION_INDEX = Contract(
    "occupation_index",
    (
        Field("nco_code", "string"),
        Field("occupation_title", "string"),
        Field("n_tasks", "bigint", gt=0),
        Field("variant", "string", isin=["E1", "E1plus"]),
        Field("alpha", "double", ge=0, le=1),
        Field("beta", "double", ge=0, le=1),
        Field("zeta", "double", ge=0, le=1),
        Field("rubric_version", "string"),
        Field("preliminary", "boolean"),
    ),
)
WORKERS = Contract(
    "workers",
    (
        Field("person_id", "string", unique=True),
        Field("survey_year", "string", isin=["2022-23", "2023-24"]),
        Field("weight", "double", gt=0),
        Field("nco_code_3d", "string", nullable=True),
        Field("nco_code_4d", "string", nullable=True),
        Field("nic_section", "string", nullable=True),
        Field("state", "string"),
        Field("sector", "string", isin=["urban", "rural"]),
        Field("sex", "string"),
        Field("age", "bigint", ge=0, le=120),
        Field("education", "string", nullable=True),
        Field("formal", "boolean", nullable=True),
        Field("earnings", "double", nullable=True),
        Field("exposure_beta", "double", nullable=True, ge=0, le=1),
    ),
)
PAYROLL_PANEL = Contract(
    "payroll_panel",
    (
        Field("data_month", "string", regex=r"^\d{4}-\d{2}$"),
        Field("source_release", "string", regex=r"^(epfo|mospi)_\d{4}-\d{2}$"),
        Field(
            "measure",
            "string",
            isin=["net_payroll", "new_subscribers", "ceased", "rejoined"],
        ),
        Field(
            "age_band", "string", isin=["<18", "18-21", "22-25", "26-28", "29-35", ">35"]
        ),
        Field(
            "gender",
            "string",
            nullable=True,
            isin=["male", "female", "transgender", "not_available"],
        ),
        Field("industry", "string", nullable=True),
        Field("state", "string", nullable=True),
        Field("value", "bigint"),
        Field("series_break_flag", "boolean"),
    ),
)
POSTINGS = Contract(
    "postings",
    (
        Field("posting_id", "string", unique=True),
        Field("source", "string", isin=["ncs"]),
        Field("posted_month", "string", regex=r"^\d{4}-\d{2}$"),
        Field("title", "string"),
        Field("description", "string", nullable=True),
        Field("nco_code_3d", "string", nullable=True),
        Field("city", "string", nullable=True),
        Field("city_tier", "string", nullable=True),
        Field("offered_salary", "double", nullable=True),
        Field("required_experience_years", "double", nullable=True),
        Field("fresher_eligible", "boolean", nullable=True),
    ),
)
