"""Regressions against dense dummies, clustering against brute force."""

import numpy as np
import pandas as pd
import pytest

from weftspan.operators import fixed_effects as Q
from weftspan.operators import typology as T


def unbalanced():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(9):
        for t in range(12):
            for c in ("young", "older"):
                if rng.random() < 0.97:
                    rows.append((f"i{i}", f"2022-{t + 1:02d}", c, 0.1 * i, int(t >= 6), float(rng.normal() + i * t * 0.1)))
    return pd.DataFrame(rows, columns=["industry", "data_month", "cohort", "exposure", "post", "y"])


def dense(df, y, x, effects, cluster):
    dummies = [pd.get_dummies(df[e], dtype=float).to_numpy() for e in effects]
    z = np.hstack(dummies)
    def out(v):
        return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    yt, xt = out(df[y].to_numpy()), out(df[x].to_numpy())
    b = (xt @ yt) / (xt @ xt)
    u = yt - b * xt
    scores = pd.Series(xt * u).groupby(df[cluster].to_numpy()).sum()
    return b, (scores**2).sum() / (xt @ xt) ** 2, len(scores)


def test_two_way_effects_and_errors(spark):
    df = unbalanced()
    young = df[df.cohort == "young"].assign(exposure_post=lambda d: d.exposure * d.post)
    b, sandwich, g = dense(young, "y", "exposure_post", ["industry", "data_month"], "industry")
    row = Q.did(spark.createDataFrame(df), "y").first()
    n, k = len(young), 1 + young.data_month.nunique()
    factor = g / (g - 1) * (n - 1) / (n - k)
    assert row["estimate"] == pytest.approx(b, abs=1e-7)
    assert row["std_error"] == pytest.approx(np.sqrt(factor * sandwich), rel=1e-6)
    assert (row["n_obs"], row["n_clusters"], row["df"]) == (n, g, g - 1)


def test_three_way_effects(spark):
    df = unbalanced()
    wide = df.assign(
        x=df.exposure * df.post * (df.cohort == "young"),
        hm=df.industry + df.data_month, hy=df.industry + df.cohort, my=df.data_month + df.cohort,
    )
    b, _, _ = dense(wide, "y", "x", ["hm", "hy", "my"], "industry")
    got = Q.triple_difference(spark.createDataFrame(df), "y").first()
    assert got["estimate"] == pytest.approx(b, abs=1e-6)


def test_silhouette_in_several_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    lab = np.append(np.arange(59) % 3, 3)
    frame = spark.createDataFrame(
        pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(60), cluster=lab)
    )
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        mine = (lab == lab[i]) & (np.arange(60) != i)
        if not mine.any():
            want.append(0.0)
            continue
        a = d[i][mine].mean()
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    for block in (5000, 17):
        got = T.silhouette_values(frame, "id", "cluster", ["a", "b", "c"], block).orderBy("id").toPandas()
        assert np.allclose(got["silhouette"], want)


def test_kmeans_finds_clear_clusters(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.vstack([c + rng.normal(size=(20, 2)) for c in centres])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(60)))
    labelled, table = T.choose_clusters(frame, "id", ["a", "b"], ks=[2, 3, 4], restarts=8)
    assert table.filter("chosen").first()["k"] == 3
    got = labelled.toPandas().sort_values("id")["cluster"].to_numpy()
    assert all(len(set(got[i * 20:(i + 1) * 20])) == 1 for i in range(3)) and len(set(got)) == 3
