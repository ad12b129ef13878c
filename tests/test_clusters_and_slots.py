"""k-means seeding, the blockwise silhouette, and slots by counting, against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from weftspan.operators import sampling as L
from weftspan.operators import typology as T

NAMES = ["x", "y", "z"]


def frame(spark, x, labels=None):
    rows = [(f"p{i:04d}", *map(float, row), int(labels[i]) if labels is not None else 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, x double, y double, z double, cluster int")


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    found = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            found.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        found.append((b - a) / max(a, b))
    return found


@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_silhouette_over_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(T, "STRIP_BLOCKS", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[10] = x[11]
    labels = np.where(np.arange(400) < 250, 3, rng.integers(5, 8, 400))
    labels[0] = 99
    got = T.silhouette_values(frame(spark, x, labels), "id", "cluster", NAMES, block_rows=rows).orderBy("id").collect()
    assert [r["cluster"] for r in got] == labels.tolist()
    assert np.allclose([r["silhouette"] for r in got], plain_silhouette(x, labels), atol=1e-9)


def test_oversampled_starts_cost_no_more_and_take_fewer_rounds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.6, size=(60, 3)) for c in rng.uniform(-9, 9, size=(6, 3))])
    points = frame(spark, x)
    turns = {"drawn": 0, "oversampled": 0}
    for seed in range(3):
        cost = {}
        for starts in turns:
            run = T.kmeans(points, "id", NAMES, [6], restarts=8, seed=seed, starts=starts)[6]
            assert run.settled
            cost[starts] = run.cost
            turns[starts] += run.rounds
        assert cost["oversampled"] <= cost["drawn"] * (1 + 1e-9)
    assert turns["oversampled"] <= turns["drawn"]


def test_kmeans_is_lloyd(spark):
    """From the same starts, the same centres as plain rounds; a round limit is reported."""
    x = np.random.default_rng(8).normal(size=(120, 3))
    points = frame(spark, x)
    drawn = T._drawn(points, "id", NAMES, 3, 1, 5)[0]
    centres = drawn.copy()
    for _ in range(200):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[near == c].mean(axis=0) for c in range(3)])
    run = T.kmeans(points, "id", NAMES, [3], restarts=1, seed=5, starts="drawn")[3]
    assert np.allclose(run.centres, centres) and run.settled
    assert not T.kmeans(points, "id", NAMES, [3], restarts=1, seed=5, starts="drawn", max_rounds=1)[3].settled


def plain_slots(rows, n):
    total = min(n, sum(r[2] for r in rows))
    q = {d: s * total for d, s, _ in rows}
    cap = {d: c for d, _, c in rows}
    slots = {d: min(c, max(1, math.floor(q[d]))) for d, _, c in rows}
    while sum(slots.values()) < total:
        best = max((d for d in slots if slots[d] < cap[d]), key=lambda d: (q[d] - slots[d], [-ord(ch) for ch in d]))
        slots[best] += 1
    while sum(slots.values()) > total and any(v > 1 for v in slots.values()):
        best = max((d for d in slots if slots[d] > 1), key=lambda d: (slots[d] - q[d], [-ord(ch) for ch in d]))
        slots[best] -= 1
    return slots


@pytest.mark.parametrize("seed", range(4))
def test_slots_match_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([0.001, 0.01, 1, 1, 3]) for _ in range(rng.randrange(3, 25))]
    rows = [(f"d{i:02d}", w / sum(weights), rng.choice([1, 2, 5, 40])) for i, w in enumerate(weights)]
    n = rng.choice([2, 12, 30, 500])
    got = L.allocate_slots(spark.createDataFrame(rows, "division string, share double, cap long"), n).collect()
    assert {r["division"]: r["slots"] for r in got} == plain_slots(rows, n)


def test_slots_of_huge_caps(spark):
    rows = [(f"d{i}", 1 / 3, 1_000_000_000) for i in range(3)]
    frame_ = spark.createDataFrame([*rows, ("e", 0.0, 5)], "division string, share double, cap long")
    got = {r["division"]: r["slots"] for r in L.allocate_slots(frame_, 2_000_000_000).collect()}
    assert sum(got.values()) == 2_000_000_000 and got["e"] == 1
    assert max(got.values()) - min(v for d, v in got.items() if d != "e") <= 1


def test_starts_are_drawn_from_few_keys(spark, monkeypatch):
    """Keys of low digest give the starts of all keys, also where too few of them are
    low, keys repeat or are null; a point may lie on two centres."""
    x = np.random.default_rng(2).normal(size=(90, 3))
    x[5] = x[6]
    points = frame(spark, x).selectExpr("CASE WHEN id < 'p0004' THEN NULL WHEN id < 'p0010' THEN 'p0009' ELSE id END AS id", "x", "y", "z")
    monkeypatch.setattr(T, "DRAWN", 90)
    want = T._drawn(points, "id", NAMES, 3, 6, 5)
    for drawn in (1, 4):
        monkeypatch.setattr(T, "DRAWN", drawn)
        got = T._drawn(points, "id", NAMES, 3, 6, 5)
        assert sorted(got) == sorted(want) == list(range(6))
        assert all(got[r].shape == (3, 3) for r in got)


@pytest.mark.parametrize("piece", [7, 1_024])
def test_sums_of_restarts_of_several_sizes(monkeypatch, piece):
    """One pass gives counts, sums and costs of restarts of different k; equal centres
    leave a point to the first."""
    monkeypatch.setattr(T, "PIECE_ROWS", piece)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    centres = [(n, rng.normal(size=(k, 3))) for n, k in enumerate((4, 2, 4, 1))]
    centres[2][1][3] = centres[2][1][0]
    packed = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([r.tobytes() for r in x], pa.binary())], names=["_key", "x"])
    batches = [packed.slice(0, 20), packed.slice(20, 0), packed.slice(20)]
    got = next(T._partial_sums(iter(batches), NAMES, centres)).to_pylist()
    want = []
    for n, c in centres:
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        near = d2.argmin(axis=1)
        assert sum(r["cost"] for r in got if r["run"] == n) == pytest.approx(d2.min(axis=1).sum())
        want += [(n, j, int((near == j).sum()), x[near == j].sum(axis=0)) for j in range(len(c)) if (near == j).any()]
    found = {(r["run"], r["cluster"]): r for r in got}
    assert len(found) == len(want)
    assert all(found[n, j]["n"] == m and np.allclose([found[n, j][f] for f in NAMES], s) for n, j, m, s in want)
