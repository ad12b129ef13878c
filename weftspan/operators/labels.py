"""From stored model responses to one label per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.functions.labels import LABELS, TIE, is_label, parse_response
from weftspan.plans.storage import materialise
from weftspan.sources.io import exists

STRICT_OFFSET = 100
RESPONSE_COLUMNS = [
    "key", "model", "rubric_version", "task_id", "sample_idx", "response",
    "input_tokens", "output_tokens", "created_at",
]


def content_key(*parts: Column | str) -> Column:
    """SHA-256 over all parts that decide a response.

    Each part is preceded by its length and a null has a mark of its own, so
    different lists of parts never spell the same text.
    """
    text = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in text]
    return F.sha2(F.concat_ws("\u0001", *marked), 256)


def work_list(statements: DataFrame, responses: DataFrame, wave: int | None = None) -> DataFrame:
    """Statements without a stored response, optionally the first ``wave`` ids."""
    todo = statements.join(responses.select("key").distinct(), "key", "left_anti")
    return todo if wave is None else todo.orderBy("task_id").limit(wave)


def work_counts(statements: DataFrame, responses: DataFrame) -> DataFrame:
    """Number of statements already answered and still to do."""
    stored = responses.select("key").distinct().withColumn("_hit", F.lit(True))
    return statements.join(stored, "key", "left").agg(
        F.count_if(F.col("_hit")).alias("n_cached"),
        F.count_if(F.col("_hit").isNull()).alias("n_todo"),
    )


def projected_cost(
    todo: DataFrame, tokens_in: float, tokens_out: float, rate_in: float, rate_out: float,
    prior: float = 0.0,
) -> DataFrame:
    """Worst-case cost of a wave, tokens per task times rates per million."""
    each = (tokens_in * rate_in + tokens_out * rate_out) / 1e6
    return todo.agg(F.count(F.lit(1)).alias("n_todo")).select(
        "n_todo",
        (F.col("n_todo") * each).alias("worst_cost"),
        (F.col("n_todo") * each + prior).alias("cumulative_worst"),
    )


def realised_cost(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Token sums times rates per million; missing counts are zero."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in rates]
    cost = sum((F.col(c) * r for c, r in rates.items()), F.lit(0.0)) / 1e6
    return usage.agg(*sums).withColumn("cost", cost)


def latest_responses(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key: the latest response wins, new over stored on equal time.

    ``max_by`` combines before the shuffle, so a key with many versions does
    not gather in one task.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c != "key"]
    order = F.struct("created_at", "_new", "response")
    picked = both.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select("key", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*stored.columns)


STORE_RANGES = 64


def store_range(key: str = "key", ranges: int = STORE_RANGES) -> Column:
    """Range of a key in the stored table: keys of one digest fall in one folder."""
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range")


def upsert_store(spark: SparkSession, path: str, new: DataFrame, ranges: int = STORE_RANGES) -> DataFrame:
    """Upsert responses into a table in folders by key range, and return it.

    Only the folders that new keys fall in are read and written again; all others
    keep their files. What replaces them is written to scratch space first, so a run
    that is lost on the way can be repeated. A table that does not exist begins empty.
    """
    placed = materialise(new.withColumn("range", store_range("key", ranges)), "upsert")
    if exists(spark, path):
        touched = [r["range"] for r in placed.select("range").distinct().collect()]  # at most ``ranges``
        stored = spark.read.parquet(path).filter(F.col("range").isin(touched)).select(*new.columns)
    else:
        stored = new.limit(0)
    merged = latest_responses(stored, placed.select(*new.columns)).withColumn("range", store_range("key", ranges))
    ready = materialise(merged, "merged")
    ready.repartition("range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(path)
    return spark.read.parquet(path).select(*new.columns)


def sample_labels(responses: DataFrame) -> DataFrame:
    """(task_id, sample_idx, label): the first try, else its strict retry.

    First try and retry meet in one group by (task, sample); no self join. Of
    several responses to one try, the latest counts; without a ``created_at``
    column, the last in text order.
    """
    idx = F.col("sample_idx")
    at = ["created_at", "response"] if "created_at" in responses.columns else ["response"]
    parsed = responses.select(
        "task_id",
        (idx % STRICT_OFFSET).alias("sample_idx"),
        (idx >= STRICT_OFFSET).alias("is_retry"),
        parse_response("response").alias("label"),
        "response",
        F.struct(*at).alias("_at"),
    )

    def pick(retry: bool, c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col("is_retry") == retry, F.col("_at")))

    return (
        parsed.groupBy("task_id", "sample_idx")
        .agg(
            pick(False, "label").alias("first_label"),
            pick(True, "label").alias("retry_label"),
            F.coalesce(pick(True, "response"), pick(False, "response")).alias("last_response"),
        )
        .select(
            "task_id",
            "sample_idx",
            F.coalesce("first_label", "retry_label").alias("label"),
            F.col("first_label").isNull().alias("retried"),
            "last_response",
        )
    )


def rejects(samples: DataFrame, shown: int | None = None) -> DataFrame:
    """Samples left without a label after the strict retry, with the reason: the
    last response, whole or its first ``shown`` characters."""
    last = F.col("last_response") if shown is None else F.substring("last_response", 1, shown)
    return samples.filter(F.col("label").isNull()).select(
        "task_id",
        F.format_string(
            "unparseable sample %d after strict retry: %s",
            F.col("sample_idx"),
            last,
        ).alias("reason"),
    )


def vote(samples: DataFrame, key: str = "task_id", label: str = "label") -> DataFrame:
    """Majority label per task; equal top counts give ``TIE``; no votes, null."""
    counts = [
        F.count_if(F.col(label) == x).alias(f"votes_{x.lower()}") for x in LABELS
    ]
    tally = samples.groupBy(key).agg(*counts)
    votes = [F.col(f"votes_{x.lower()}") for x in LABELS]
    top = F.greatest(*votes)
    winners = sum((F.when(v == top, 1).otherwise(0) for v in votes), F.lit(0))
    winner = F.coalesce(*[F.when(v == top, F.lit(x)) for x, v in zip(LABELS, votes)])
    score = F.when(top == 0, F.lit(None)).when(winners > 1, F.lit(TIE)).otherwise(winner)
    return tally.withColumn("score", score).withColumn(
        "tie_escalated", F.coalesce(F.col("score") == TIE, F.lit(False))
    )


def assemble(
    statements: DataFrame, responses: DataFrame, rubric_version: str, model: str
) -> DataFrame:
    """One-sample label table: stored, parseable first responses + provenance."""
    parsed = responses.select("key", parse_response("response").alias("score")).filter(
        F.col("score").isNotNull()
    )
    return statements.join(parsed, "key").select(
        "task_id",
        "nco_code",
        "group3",
        "score",
        F.lit(rubric_version).alias("rubric_version"),
        F.lit(model).alias("model"),
        F.lit(1).cast("long").alias("n_samples"),
        F.lit(True).alias("preliminary"),
    )


def failure_rate(voted: DataFrame, score: str = "score") -> DataFrame:
    """Share of tasks left without any vote."""
    return voted.agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.col(score).isNull()).alias("n_failures"),
        F.avg(F.col(score).isNull().cast("double")).alias("failure_rate"),
    )


def label_distribution(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"))


def usable(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.filter(is_label(score))
