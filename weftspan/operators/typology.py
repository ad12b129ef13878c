"""Group features, k-means with restarts, silhouette and cluster profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspan.functions.numeric import ratio, share_where
from weftspan.operators.cuts import median_earnings, scored
from weftspan.plans.ranking import top_per_group
from weftspan.plans.sizing import small_side
from weftspan.plans.storage import materialise
from weftspan.sources import fixed_values as V

FEATURES = [
    "alpha", "e2_share", "grad_share", "female_share", "urban_share", "young_share",
    "log_med_earn",
]
RESTARTS, SEED_PASSES = 50, 4
#: Rows of a matrix in k-means; of a block of the silhouette, and of a step in it.
PIECE_ROWS, BLOCK_ROWS, STEP_ROWS = 1_024, 5_000, 200
#: Digests looked at for each start drawn from a large table.
DRAWN = 64
STRIP_BLOCKS = 16


def group_features(merged: DataFrame, index: DataFrame, min_tasks: int = 5) -> DataFrame:
    """Weighted composition, index parts and log median earnings per group.

    A group without earners takes the median of the group medians.
    """
    shares = scored(merged).groupBy("group3").agg(
        (F.sum("weight") / 1e6).alias("workers_m"),
        share_where(F.col("edu_code").isin(V.POST_SECONDARY), "weight").alias("grad_share"),
        share_where(F.col("sex_code") == 2, "weight").alias("female_share"),
        share_where(F.col("sector_code") == 2, "weight").alias("urban_share"),
        share_where(F.col("age").between(18, 29), "weight").alias("young_share"),
    )
    kept = index.filter(F.col("n_tasks") >= min_tasks).select(
        "group3", "alpha", (F.col("zeta") - F.col("alpha")).alias("e2_share")
    )
    joined = shares.join(small_side(median_earnings(merged)), "group3", "left").join(
        small_side(kept), "group3"
    )
    usual = F.median("med_earn").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("med_earn", F.coalesce("med_earn", usual)).select(
        "group3", "workers_m", "alpha", "e2_share", "grad_share", "female_share",
        "urban_share", "young_share", F.log("med_earn").alias("log_med_earn"),
    )


def standardise(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features to mean 0 and population standard deviation 1; a constant
    feature becomes 0."""
    stats = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    rest = [c for c in df.columns if c not in features]
    return df.select(
        *rest,
        *[
            ((F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit(stats[f"s_{f}"] or 1.0)).alias(f)
            for f in features
        ],
    )


@dataclass
class Run:
    """One restart: its number of clusters, centres, and cost so far; how many
    rounds it took, and whether its centres came to rest."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = math.inf
    rounds: int = 0
    settled: bool = False


def _packed(points: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, x): each row's features as the bytes of its doubles, stored once, so that
    a pass gets them as matrices and not column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)
            at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["_key", "x"])

    rows = points.select(F.col(key).alias("_key"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    return materialise(rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, x binary"), "points")


def _drawn(points: DataFrame, key: str, features: Sequence[str], most: int, restarts: int, seed: int) -> dict[int, np.ndarray]:
    """For each restart the ``most`` points of lowest seeded digest, in one pass;
    only these rows reach the driver."""
    return _drawn_packed(_packed(points, key, features), most, restarts, seed)


def _drawn_packed(data: DataFrame, most: int, restarts: int, seed: int) -> dict[int, np.ndarray]:
    """Only keys are drawn among, and of these, where there are many, only such whose
    digest is low enough for some ``DRAWN`` times as many as asked for."""
    draws = [F.struct(F.lit(r).alias("run"), F.md5(F.concat_ws("|", F.lit(f"{seed}-{r}"), F.col("_key").cast("string"))).alias("draw")) for r in range(restarts)]
    every = data.select("_key", F.inline(F.array(*draws)))
    share = DRAWN * most / max(1, data.count())
    low = every.filter(F.col("draw") < f"{int(share * 16**12):012x}") if share < 1 else every

    def lowest(rows: DataFrame) -> pd.DataFrame:
        found = top_per_group(rows, ["run"], [F.asc("draw"), F.asc("_key")], most, spread=["_key"])
        keys = found.select("run", "draw", F.col("_key").alias("_own")).distinct()
        met = data.join(F.broadcast(keys), F.col("_key").eqNullSafe(F.col("_own"))).select("run", "draw", "_own", "x")
        return met.orderBy("run", "draw", "_own").toPandas().groupby("run").head(most)

    found = lowest(low)
    if share < 1 and len(found) < restarts * most:
        found = lowest(every)
    return {int(r): np.stack([np.frombuffer(x) for x in rows["x"]]) for r, rows in found.groupby("run")}


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres by one matrix product."""
    d2 = x @ (-2.0 * centres.T)
    d2 += (x * x).sum(axis=1)[:, None]
    d2 += (centres * centres).sum(axis=1)
    return np.maximum(d2, 0.0, out=d2)


def _pieces(batches: Iterator[pa.RecordBatch], extra: bool = False):
    """Rows of a task's batches (key, x) as matrices of at most ``PIECE_ROWS`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        x = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(float).reshape(len(column), -1)
        held = batch.column(0).to_numpy() if extra else x
        for at in range(0, len(x), PIECE_ROWS):
            yield x[at : at + PIECE_ROWS], held[at : at + PIECE_ROWS]


def _chances(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each id, by a mixing of 64 bits."""
    with np.errstate(over="ignore"):
        v = ids.astype(np.int64).view(np.uint64) * np.uint64(2 * salt + 1) + np.uint64(salt)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0x9E3779B185EBCA87)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _oversampled(data: DataFrame, ks: Sequence[int], restarts: int, seed: int, passes: int = SEED_PASSES) -> list[Run]:
    """Starting centres by oversampling (k-means||).

    Each restart begins with one drawn point. In each pass a point joins the
    restart's candidates with a chance in proportion to its squared distance from
    them, about 2k a pass; all restarts share the pass. Candidates are weighted by the
    points nearest to them and reduced to k on the driver, which holds some
    2 k (passes + 1) of them for each restart, whatever the size of the table.
    """
    most = max(ks)
    drawn = _drawn_packed(data, most, restarts, seed)
    held = {r: rows[:1] for r, rows in drawn.items()}
    keyed = data.select(F.xxhash64("_key").alias("_id"), "x")
    cost: dict[int, float] = {}
    kind = pa.schema([("run", pa.int32()), ("cost", pa.float64()), ("point", pa.list_(pa.float64()))])
    for turn in range(passes + 1):

        def look(batches, held=dict(held), cost=dict(cost), turn=turn):
            totals = dict.fromkeys(held, 0.0)
            for x, ids in _pieces(batches, extra=True):
                for r, candidates in held.items():
                    d2 = _squares(x, candidates).min(axis=1)
                    totals[r] += float(d2.sum())
                    if cost.get(r):
                        joins = _chances(ids, seed + 1000 * turn + r) * cost[r] < 2 * most * d2
                        if joins.any():
                            yield pa.RecordBatch.from_pylist([{"run": r, "cost": None, "point": point} for point in x[joins].tolist()], kind)
            yield pa.RecordBatch.from_pylist([{"run": r, "cost": n, "point": None} for r, n in totals.items()], kind)

        found = materialise(keyed.mapInArrow(look, "run int, cost double, point array<double>"), "seeding")
        rows = found.filter("point is not null").orderBy("run", "point").toPandas()
        for r, more in rows.groupby("run"):
            held[int(r)] = np.vstack([held[int(r)], *more["point"]])
        sums = found.filter("point is null").groupBy("run").agg(F.sum("cost").alias("cost")).collect()
        cost = {row["run"]: row["cost"] for row in sums}

    def weigh(batches):
        counts = {r: np.zeros(len(c), int) for r, c in held.items()}
        for x, _ in _pieces(batches):
            for r, c in held.items():
                counts[r] += np.bincount(_squares(x, c).argmin(axis=1), minlength=len(c))
        rows = [{"run": r, "at": at, "n": int(n)} for r, c in counts.items() for at, n in enumerate(c) if n]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("run", pa.int32()), ("at", pa.int32()), ("n", pa.int64())]))

    weights = keyed.mapInArrow(weigh, "run int, at int, n long").groupBy("run", "at").agg(F.sum("n").alias("n")).toPandas()
    runs = []
    for r, rows in weights.groupby("run"):
        w = np.zeros(len(held[int(r)]))
        w[rows["at"]] = rows["n"]
        for k in ks:
            runs.append(Run(k, int(r), _reduced(held[int(r)], w, drawn[int(r)], k, seed + int(r))))
    return runs


def _reduced(candidates: np.ndarray, weights: np.ndarray, spare: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of weighted candidates: drawn by distance, then settled among them."""
    if len(np.unique(candidates, axis=0)) < k:
        return spare[:k].copy()
    rng = np.random.default_rng(seed)
    centres = candidates[rng.choice(len(candidates), p=weights / weights.sum())][None, :]
    while len(centres) < k:
        d2 = ((candidates[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        chance = d2 * weights if (d2 * weights).any() else d2
        centres = np.vstack([centres, candidates[rng.choice(len(candidates), p=chance / chance.sum())]])
    for _ in range(20):
        near = ((candidates[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        held = np.bincount(near, weights, k)
        moved = np.stack([np.bincount(near, weights * c, k) for c in candidates.T], axis=1) / np.maximum(held, 1e-300)[:, None]
        centres = np.where(held[:, None] > 0, moved, centres)
    return centres


def kmeans(
    points: DataFrame,
    key: str,
    features: Sequence[str],
    ks: Sequence[int],
    restarts: int = RESTARTS,
    seed: int = V.SEED,
    max_rounds: int = 300,
    tolerance: float = 1e-8,
    starts: str = "oversampled",
) -> dict[int, Run]:
    """Best of many restarts for each number of clusters.

    All restarts advance together: a round is one pass over the points, stored as the
    bytes of their features, in which a task takes the distances to all centres of all
    live restarts by one matrix product, their sums per (restart, cluster) by another, and
    gives counts and sums once. A round shuffles
    centres and never points. ``starts``: ``oversampled`` (k-means||, few rounds) or
    ``drawn`` (the points of lowest digest). A cluster that loses all points keeps its
    centre. A restart still moving after ``max_rounds`` is not ``settled``.
    """
    features = list(features)
    data = _packed(points, key, features)
    if starts == "drawn":
        drawn = _drawn_packed(data, max(ks), restarts, seed)
        runs = [Run(k, r, rows[:k].copy()) for r, rows in drawn.items() for k in ks]
    elif starts == "oversampled":
        runs = _oversampled(data, ks, restarts, seed)
    else:
        raise ValueError(f"unknown starts {starts!r}")
    names = [f"s{i}" for i in range(len(features))]
    schema = "run int, cluster int, n bigint, cost double, " + ", ".join(f"{s} double" for s in names)
    for _ in range(max_rounds):
        live = [i for i, r in enumerate(runs) if not r.settled]
        if not live:
            break
        active = [(i, runs[i].centres) for i in live]
        totals = (
            data.mapInArrow(lambda batches, active=active: _partial_sums(batches, names, active), schema)
            .groupBy("run", "cluster")
            .agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)])
            .toPandas()
        )
        for i, rows in totals.groupby("run"):
            run = runs[i]
            moved = run.centres.copy()
            moved[rows["cluster"].to_numpy()] = rows[names].to_numpy() / rows["n"].to_numpy()[:, None]
            run.cost = float(rows["cost"].sum())
            run.rounds += 1
            run.settled = float(((moved - run.centres) ** 2).sum()) <= tolerance
            run.centres = moved
    best: dict[int, Run] = {}
    for run in runs:
        # Equal to nine digits is equal: the same clusters in another order.
        if run.k not in best or run.cost < best[run.k].cost * (1 - 1e-9):
            best[run.k] = run
    return best


def _partial_sums(batches: Iterator[pa.RecordBatch], names: list[str], active: list) -> Iterator[pa.RecordBatch]:
    """Counts and sums of a task's points by (restart, cluster), and the cost of each
    restart with the first of its clusters that has points."""
    groups = []
    for k in sorted({len(c) for _, c in active}):
        ids = [i for i, c in active if len(c) == k]
        # By cluster, then by restart: least distances are taken along whole rows.
        centres = np.stack([c for _, c in active if len(c) == k], axis=1)
        flat = centres.reshape(-1, centres.shape[2])
        groups.append((k, ids, -2.0 * flat.T, (flat * flat).sum(axis=1), np.zeros(len(flat)), np.zeros_like(flat), np.zeros(len(ids))))
    for x, _ in _pieces(batches):
        own, ones = (x * x).sum(axis=1)[:, None], np.ones(len(x))
        for k, ids, turned, squares, counts, sums, costs in groups:
            d2 = x @ turned
            d2 += squares
            by = d2.reshape(len(x), k, len(ids))
            best = by[:, 0].copy()
            for c in range(1, k):
                np.minimum(best, by[:, c], out=best)
            # A point is of the first of its nearest clusters.
            free = np.ones(best.shape, bool)
            for c in range(k):
                mark = by[:, c] == best
                mark &= free
                free ^= mark
                by[:, c] = mark
            best += own
            costs += np.maximum(best, 0.0, out=best).sum(axis=0)
            counts += ones @ d2
            sums += d2.T @ x
    out = []
    for k, ids, _, _, counts, sums, costs in groups:
        at = np.arange(k * len(ids)).reshape(k, len(ids))
        for n, i in enumerate(ids):
            cost = float(costs[n])
            for c in range(k):
                if counts[at[c, n]]:
                    out.append({"run": i, "cluster": c, "n": int(counts[at[c, n]]), "cost": cost, **dict(zip(names, sums[at[c, n]].tolist(), strict=True))})
                    cost = 0.0
    kind = [("run", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), *[(s, pa.float64()) for s in names]]
    yield pa.RecordBatch.from_pylist(out, pa.schema(kind))


def renumbered(clustered: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Clusters numbered from 0 in the order of their least members, so that equal
    partitions have equal numbers."""
    least = clustered.groupBy(cluster).agg(F.min(key).alias("_least"))
    # One row per cluster.
    number = least.select(cluster, (F.row_number().over(Window.orderBy("_least")) - 1).alias("_number"))
    return clustered.join(F.broadcast(number), cluster).withColumn(cluster, F.col("_number")).drop("_number")


def assign(points: DataFrame, features: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Nearest centre of each row as a plain column expression."""
    options = []
    for c, centre in enumerate(np.asarray(centres)):
        distance = F.lit(0.0)
        for f, value in zip(features, centre):
            distance = distance + (F.col(f) - F.lit(float(value))) * (F.col(f) - F.lit(float(value)))
        options.append(F.struct(distance.alias("d"), F.lit(c).alias("c")))
    return points.withColumn(name, F.least(*options).getField("c"))


def silhouette_values(
    points: DataFrame, key: str, cluster: str, features: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Silhouette of every point under Euclidean distance, exact.

    Points are cut at random into blocks, each packed into one row. A block meets
    ``STRIP_BLOCKS`` others in one group of a cogroup, which adds up distances per
    point and cluster; no pair and no point passes the driver, and a group holds a
    bounded number of points whatever the sizes of the clusters.
    """
    features = list(features)
    data = materialise(
        points.select(F.col(key), F.col(cluster).cast("int").alias("_c"), *[F.col(f).cast("double").alias(f) for f in features]), "points"
    )
    marks = np.array(sorted(r["_c"] for r in data.select("_c").distinct().collect()), np.int32)  # one per cluster
    blocks = max(1, math.ceil(data.count() / block_rows))
    kind = data.schema[key].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        x = np.ascontiguousarray(group[features].to_numpy(dtype=float))
        return pd.DataFrame({
            "_b": [int(group["_b"].iloc[0])], "keys": [group[key].tolist()], "own": [group["_c"].to_numpy(np.int32).tobytes()], "x": [x.tobytes()],
        })

    dealt = data.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    packed = materialise(dealt.groupBy("_b").applyInPandas(pack, f"_b int, keys array<{kind}>, own binary, x binary"), "blocks")
    strips = -(-blocks // STRIP_BLOCKS)
    asking = packed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    asked = packed.select("own", "x", F.floor(F.col("_b") / STRIP_BLOCKS).cast("int").alias("_s")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # a block without points
            return pd.DataFrame({key: [], "own": [], "other": [], "total": []})
        row = left.iloc[0]
        x, keys = np.frombuffer(row["x"]).reshape(-1, len(features)), list(row["keys"])
        total = np.zeros((len(x), len(marks)))
        for own, data in zip(right["own"], right["x"], strict=True):
            y = np.frombuffer(data).reshape(-1, len(features))
            at_mark = (np.frombuffer(own, np.int32)[:, None] == marks).astype(float)
            for begin in range(0, len(x), STEP_ROWS):
                d2 = sum((x[begin : begin + STEP_ROWS, None, f] - y[None, :, f]) ** 2 for f in range(len(features)))
                total[begin : begin + STEP_ROWS] += np.sqrt(d2) @ at_mark
        return pd.DataFrame({
            key: np.repeat(np.array(keys, dtype=object), len(marks)), "own": np.repeat(np.frombuffer(row["own"], np.int32), len(marks)),
            "other": np.tile(marks, len(x)), "total": total.ravel(),
        })

    parts = asking.groupBy("_b", "_s").cogroup(asked.groupBy("_b", "_s")).applyInPandas(sums, f"{key} {kind}, own int, other int, total double")
    sizes = data.groupBy(F.col("_c").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    summed = parts.groupBy(key, "own", "other").agg(F.sum("total").alias("total"))
    own = F.col("own") == F.col("other")
    joined = summed.join(F.broadcast(sizes), "other")
    per_point = joined.groupBy(key, "own").agg(
        F.max(F.when(own, F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    # a point alone in its cluster has silhouette 0
    value = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_point.select(key, F.col("own").alias(cluster), value.alias("silhouette"))


def silhouette(points: DataFrame, key: str, cluster: str, features: Sequence[str]) -> DataFrame:
    return silhouette_values(points, key, cluster, features).agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")
    )


def choose_clusters(
    points: DataFrame, key: str, features: Sequence[str], ks: Sequence[int] = range(3, 8),
    restarts: int = RESTARTS, seed: int = V.SEED, starts: str = "oversampled",
) -> tuple[DataFrame, DataFrame]:
    """Clustered points at the k of highest silhouette, the lowest of equal ones, and
    the score per k. Clusters are numbered by their least members."""
    points = materialise(points, "features")
    fits = kmeans(points, key, features, list(ks), restarts, seed, starts=starts)
    scores = []
    for k, run in sorted(fits.items()):
        labelled = assign(points, features, run.centres)
        row = silhouette(labelled, key, "cluster", features).first()
        scores.append((k, float(row["silhouette"]), run.cost, run.settled))
    best = max(scores, key=lambda s: (round(s[1], 9), -s[0]))[0]
    table = points.sparkSession.createDataFrame(scores, "k int, silhouette double, cost double, settled boolean")
    return (
        renumbered(assign(points, features, fits[best].centres), key),
        table.withColumn("chosen", F.col("k") == best),
    )


def cluster_profiles(
    clustered: DataFrame, features: Sequence[str], weight: str = "workers_m", digits: int = 3
) -> DataFrame:
    """Weighted feature means per cluster, with group count and weight."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(weight).alias(weight),
        *[
            F.round(ratio(F.sum(F.col(f) * F.col(weight)), F.sum(weight)), digits).alias(f)
            for f in features
        ],
    )


def largest_members(
    clustered: DataFrame, weight: str = "workers_m", key: str = "group3", n: int = 5
) -> DataFrame:
    return top_per_group(
        clustered, ["cluster"], [F.desc(weight), F.asc(key)], n, "place", spread=[key]
    ).select("cluster", key, weight, "place")
