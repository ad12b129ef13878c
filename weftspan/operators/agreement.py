"""Agreement between raters and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.functions.labels import LABELS, LABEL_WEIGHT, clean_label, is_label
from weftspan.functions.numeric import ratio
from weftspan.sources.fixed_values import NOTE_TAGS


def partition_counts(pairs: DataFrame, human: str = "human", model: str = "model") -> DataFrame:
    """How many rows are usable, tied, invalid or blank on the human side.

    A missing human label counts as blank, never as invalid.
    """
    h, m = F.col(human), F.col(model)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_label(human) & is_label(model)).alias("n_usable"),
        F.count_if(F.coalesce(m == "TIE", F.lit(False))).alias("n_ties"),
        F.count_if(h.isNotNull() & (h != "") & ~is_label(human)).alias("n_invalid"),
        F.count_if(h.isNull() | (h == "")).alias("n_blank"),
    )


def confusion_counts(
    pairs: DataFrame, human: str = "human", model: str = "model", keys: Sequence[str] = ()
) -> DataFrame:
    """The nine cells of the confusion matrix as columns n_<human>_<model>,
    zero where no pair falls; one row per key. Conditional counts give the
    zeros without a grid join."""
    cells = [
        F.count_if((F.col(human) == h) & (F.col(model) == m)).alias(f"n_{h}_{m}")
        for h in LABELS
        for m in LABELS
    ]
    return pairs.groupBy(*keys).agg(*cells)


def confusion_matrix(pairs: DataFrame, human: str = "human", model: str = "model") -> DataFrame:
    """One row per human label with a count per model label."""
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("human"),
                *[F.col(f"n_{h}_{m}").alias(f"model_{m}") for m in LABELS],
            )
            for h in LABELS
        ]
    )
    return confusion_counts(pairs, human, model).select(F.inline(rows))


def _cell(h: str, m: str) -> Column:
    return F.col(f"n_{h}_{m}")


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def kappa_from_counts(counts: DataFrame) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa from the nine cells.

    Null for no pairs, and kappa null where chance agreement is complete.
    """
    n = _total([_cell(h, m) for h in LABELS for m in LABELS])
    agree = _total([_cell(x, x) for x in LABELS])
    rows = {h: _total([_cell(h, m) for m in LABELS]) for h in LABELS}
    cols = {m: _total([_cell(h, m) for h in LABELS]) for m in LABELS}
    chance = _total([rows[x].cast("double") * cols[x] for x in LABELS])
    keys = [c for c in counts.columns if not c.startswith("n_E")]
    po, pe = F.col("po"), F.col("pe")
    return counts.select(
        *keys,
        n.alias("n_pairs"),
        ratio(agree.cast("double"), n).alias("po"),
        ratio(chance, n.cast("double") * n).alias("pe"),
    ).withColumn("kappa", F.when(pe < 1, (po - pe) / (1 - pe)))


def cohen_kappa(
    pairs: DataFrame, human: str = "human", model: str = "model", keys: Sequence[str] = ()
) -> DataFrame:
    return kappa_from_counts(confusion_counts(pairs, human, model, keys))


def rating_or_null(c: str) -> Column:
    """A label or NA; anything else counts as blank."""
    clean = clean_label(c)
    return F.when(clean.isin([*LABELS, "NA"]), clean)


def per_rater(ratings: DataFrame, raters: Sequence[str], model: str = "model") -> DataFrame:
    """Kappa, agreement, blanks, NA rows and label counts of each rater.

    All raters come from one scan: counts are taken side by side and only the
    one-row result is turned into rows.
    """
    counts, entries = [], []
    for r in raters:
        v = rating_or_null(r)
        paired = is_label(v) & is_label(model)
        counts += [
            F.count_if(v.isNull()).alias(f"{r}__blank"),
            F.count_if(v == "NA").alias(f"{r}__na"),
        ]
        counts += [
            F.count_if(paired & (v == h) & (F.col(model) == m)).alias(f"{r}__n_{h}_{m}")
            for h in LABELS
            for m in LABELS
        ]
        entries.append(
            F.struct(
                F.lit(r).alias("rater"),
                F.col(f"{r}__blank").alias("blank"),
                F.col(f"{r}__na").alias("na"),
                *[
                    F.col(f"{r}__n_{h}_{m}").alias(f"n_{h}_{m}")
                    for h in LABELS
                    for m in LABELS
                ],
            )
        )
    long = ratings.agg(*counts).select(F.inline(F.array(*entries)))
    shares = [
        _total([_cell(h, m) for m in LABELS]).alias(f"count_{h.lower()}") for h in LABELS
    ]
    return kappa_from_counts(long.select("*", *shares))


def majority_of(columns: Sequence[Column]) -> Column:
    """Most frequent label among several columns of a row; null on a tie or if
    none is a label."""
    votes = {
        x: _total([F.when(c == x, 1).otherwise(0) for c in columns]) for x in LABELS
    }
    out = F.lit(None).cast("string")
    for x, v in votes.items():
        ahead = F.lit(True)
        for y, other in votes.items():
            if y != x:
                ahead = ahead & (v > other)
        out = F.when(ahead, F.lit(x)).otherwise(out)
    return out


def with_majority(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Add the majority label and the number of raters who gave a label."""
    names = [f"_clean_{r}" for r in raters]
    clean = ratings.select("*", *[rating_or_null(r).alias(n) for r, n in zip(raters, names)])
    values = [F.col(n) for n in names]
    given = _total([F.when(is_label(v), 1).otherwise(0) for v in values])
    return clean.select(
        *ratings.columns, majority_of(values).alias("majority"), given.alias("n_labels")
    )


def majority_vs_model(ratings: DataFrame, raters: Sequence[str], model: str = "model") -> DataFrame:
    """Kappa of the majority label against the model, with ties left out and counted."""
    rated = with_majority(ratings, raters)
    tie = F.count_if((F.col("n_labels") > 0) & F.col("majority").isNull()).alias("ties_excluded")
    cells = [
        F.count_if((F.col("majority") == h) & (F.col(model) == m)).alias(f"n_{h}_{m}")
        for h in LABELS
        for m in LABELS
    ]
    return kappa_from_counts(rated.agg(tie, *cells))


def fleiss_kappa(ratings: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Fleiss' kappa over items that every rater labelled; null if none."""
    n = len(raters)
    clean = ratings.select(*[rating_or_null(r).alias(f"_clean_{r}") for r in raters])
    values = [F.col(f"_clean_{r}") for r in raters]
    per_label = {
        x: _total([F.when(v == x, 1).otherwise(0) for v in values]) for x in LABELS
    }
    counted = clean.select(*[c.alias(f"_n_{x}") for x, c in per_label.items()])
    given = [F.col(f"_n_{x}") for x in LABELS]
    everyone = _total(given) == n
    squares = _total([c * c for c in given])
    sums = counted.agg(
        F.count_if(everyone).alias("n_items"),
        F.avg(F.when(everyone, (squares - n) / float(n * (n - 1)))).alias("p_bar"),
        *[F.sum(F.when(everyone, F.col(f"_n_{x}"))).alias(f"t_{x}") for x in LABELS],
    )
    total = F.col("n_items") * n
    pe = _total(
        [ratio(F.col(f"t_{x}").cast("double"), total) * ratio(F.col(f"t_{x}").cast("double"), total) for x in LABELS]
    )
    return sums.select("n_items", "p_bar", pe.alias("pe")).withColumn(
        "kappa", F.when(F.col("pe") < 1, (F.col("p_bar") - F.col("pe")) / (1 - F.col("pe")))
    )


def agreement_by_stratum(
    ratings: DataFrame, raters: Sequence[str], stratum: str = "stratum", model: str = "model"
) -> DataFrame:
    used = F.col("majority").isNotNull() & is_label(model)
    tally = (
        with_majority(ratings, raters)
        .groupBy(stratum)
        .agg(
            F.count_if(used).alias("n"),
            F.count_if(used & (F.col("majority") == F.col(model))).alias("agree"),
        )
    )
    return tally.filter(F.col("n") > 0).withColumn("pct", F.col("agree") / F.col("n"))


def note_tags(ratings: DataFrame, notes: Sequence[str], tags: Sequence[str] = NOTE_TAGS) -> DataFrame:
    """How many note cells mention each tag; tags never met give no row."""
    sums = [
        F.sum(
            _total(
                [
                    F.when(F.contains(F.coalesce(F.col(n), F.lit("")), F.lit(t)), 1).otherwise(0)
                    for n in notes
                ]
            )
        ).alias(t)
        for t in tags
    ]
    rows = F.array(
        *[F.struct(F.lit(t).alias("tag"), F.col(f"`{t}`").alias("n")) for t in tags]
    )
    return ratings.agg(*sums).select(F.inline(rows)).filter(F.col("n") > 0)


def disagreements(pairs: DataFrame, human: str = "human", model: str = "model") -> DataFrame:
    """Usable pairs whose labels differ."""
    return pairs.filter(
        is_label(human) & is_label(model) & (F.col(human) != F.col(model))
    )


def rescore_overlay(
    base: DataFrame, rescored: DataFrame, key: str = "task_id", label: str = "human"
) -> DataFrame:
    """Newer labels replace base labels; invalid ones never do."""
    clean = clean_label(label)
    newer = rescored.select(key, F.when(is_label(clean), clean).alias("_new"))
    return base.join(newer, key, "left").select(
        *[c for c in base.columns if c != label],
        F.coalesce("_new", label).alias(label),
        F.col("_new").isNotNull().alias("rescored"),
    )


def merge_rescores(sheet: DataFrame, scored: DataFrame, key: str = "task_id", label: str = "human") -> DataFrame:
    """Full join of two rescore sources; the second is preferred."""
    a = sheet.select(key, clean_label(label).alias("_a"))
    b = scored.select(key, clean_label(label).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(label))


def agreement_bounds(counts: DataFrame) -> DataFrame:
    """How far disagreement can move the index, from the nine cells.

    Mean index under either side's labels, the effect of full substitution,
    bounds with every disagreement resolved one way, and flip counts.
    """
    n = _total([_cell(h, m) for h in LABELS for m in LABELS]).cast("double")

    def mean(weight) -> Column:
        return ratio(
            _total([_cell(h, m) * F.lit(weight(h, m)) for h in LABELS for m in LABELS]), n
        )

    w = LABEL_WEIGHT
    return counts.select(
        n.cast("long").alias("n_pairs"),
        _total([_cell(h, m) for h in LABELS for m in LABELS if h != m]).alias("n_disagreements"),
        (_cell("E0", "E1") + _cell("E1", "E0")).alias("flips_e0_e1"),
        (_cell("E1", "E2") + _cell("E2", "E1")).alias("flips_e1_e2"),
        (_cell("E0", "E2") + _cell("E2", "E0")).alias("flips_e0_e2"),
        mean(lambda h, m: w[m]).alias("beta_model"),
        mean(lambda h, m: w[h]).alias("beta_human"),
        mean(lambda h, m: min(w[h], w[m])).alias("bound_low"),
        mean(lambda h, m: max(w[h], w[m])).alias("bound_high"),
    ).withColumn("substitution_delta", F.col("beta_human") - F.col("beta_model"))
