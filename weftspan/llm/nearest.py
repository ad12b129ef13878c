"""Nearest vectors by inner product: a forest of random-projection trees.

Vectors get one more coordinate that makes all lengths equal, so the largest
inner product is the smallest angle. Each tree splits a bounded sample at the
median of its projection on the difference of two random members, down to small
leaves. Every vector is dealt to its leaf in every tree. A query walks all trees
through one priority queue, always at the branch least on the wrong side of a
plane, until it has its number of leaves; the members of those leaves are then
ranked by the exact inner product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspan.llm.language import bounded
from weftspan.plans.ranking import top_per_group
from weftspan.plans.storage import materialise

TREES, LEAF, LEAVES = 16, 48, 320
SAMPLE_VECTORS = 20_000
BLOCK_VECTORS = 4_096
FREE_LEAVES = 4


@dataclass
class Forest:
    """Planes of all trees, one row each. A child below 0 is leaf ``-1 - child``."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    longest: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that brings each to the largest length."""
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector (row) in each tree (column)."""
        lifted, out = self.lifted(vectors), np.empty((len(vectors), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", lifted[inner], self.normals[at]) > self.offsets[at]
                node[inner] = self.children[at, right.astype(int)]
            out[:, tree] = -1 - node
        return out

    def search(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that the shared queue reaches."""
        margins = (self.normals @ np.append(query, 0.0) - self.offsets).tolist()
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < leaves:
            wrong, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                left, right = self.children[node]
                near, far = (right, left) if margin > 0 else (left, right)
                heapq.heappush(queue, (max(wrong, abs(margin)), int(far)))
                node = int(near)
            found.append(-1 - node)
        return found


def grow(sample: np.ndarray, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
    """A forest over a sample of vectors; may be empty, then each tree is a leaf."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, n_leaves = [], [], [], [], 0
    empty = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros((0, 2), np.int64), [], longest)
    points = empty.lifted(sample)
    for _ in range(trees):
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            members, parent, side = todo.pop()
            plane = _plane(points, members, leaf, rng)
            if plane is None:
                name, n_leaves = -1 - n_leaves, n_leaves + 1
            else:
                normal, offset, right = plane
                name = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(members[~right], name, 0), (members[right], name, 1)]
            if parent is None:
                roots.append(name)
            else:
                children[parent][side] = name
    width = points.shape[1]
    return Forest(
        np.array(normals, float).reshape(-1, width), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2), roots, longest
    )


def _plane(points: np.ndarray, members: np.ndarray, leaf: int, rng) -> tuple | None:
    if len(members) <= leaf:
        return None
    for _ in range(8):
        a, b = points[rng.choice(members, 2, replace=False)]
        normal = a - b
        if (length := np.linalg.norm(normal)) > 0:
            normal = normal / length
            along = points[members] @ normal
            offset = float(np.median(along))
            right = along > offset
            if 0 < right.sum() < len(members):
                return normal, offset, right
    return None


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, embedding) of vectors that are not null or zero and have no null or
    non-finite component. Floats stay floats; all else becomes doubles."""
    kind = dict(vectors.dtypes)[column]
    x = F.col(column).cast(kind if kind == "array<float>" else "array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.filter(F.col(key).isNotNull() & F.col(column).isNotNull())
        .select(F.col(key).cast("long").alias("vec_id"), x.alias("embedding"))
        .filter(F.exists("embedding", lambda v: v != 0) & finite)
        # 0 and -0 are one value
        .withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v)))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE_VECTORS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query.

    ``vectors`` and ``queries`` are (vec_id, embedding) from ``usable``; a query's
    own row is no candidate. Vectors of other widths than the widest kind are
    a caller's error. Equal vectors are searched once: each keeps its ``k + 1``
    smallest ids, which is all that a list of ``k`` can show. The forest is grown
    on at most about ``sample`` vectors, whose scores also bound each list from
    below; all vectors are dealt to its leaves, and
    leaves beyond ``BLOCK_VECTORS`` members are ranked in blocks. Rows that repeat
    a vec_id count once. Equal scores are ranked by vec_id. Empty inputs give no rows.
    Nulls, in a vector or in its place, are left out by ``usable``, which also leaves out
    all other columns, so none clashes. There are no texts here.
    """
    ids = top_per_group(vectors.distinct(), ["embedding"], [F.col("vec_id")], k + 1, spread=["vec_id"])
    copies = materialise(
        ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors"
    )
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    longest = float(copies.agg(F.max(square)).first()[0] or 0.0) ** 0.5
    chosen = bounded(copies.select("rep", "embedding"), F.col("rep"), sample).orderBy("rep").collect()
    drawn = np.array([r["embedding"] for r in chosen], float).reshape(len(chosen), -1 if chosen else 0)
    forest = grow(drawn, longest, trees)

    asked = queries.distinct().withColumnRenamed("vec_id", "query_id").join(copies.select("embedding", "rep"), "embedding")
    asked = materialise(asked.select("query_id", "rep", "embedding"), "queries")
    points = _dealt(copies.select("rep", "embedding"), forest).drop("least")
    probes = _dealt(asked.select("rep", "embedding").distinct(), forest, leaves, drawn, k + 1)
    sizes = points.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    # One row per leaf, of which a forest has at most trees x sample.
    sizes = F.broadcast(materialise(sizes, "leaves"))
    points = points.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    probes = probes.join(sizes, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64")})]
        if len(left) and len(right):
            points, reps = np.stack(right["embedding"].to_numpy()).astype(float), right["rep"].to_numpy()
            for begin in range(0, len(left), 1024):
                part = left.iloc[begin : begin + 1024]
                scores = np.stack(part["embedding"].to_numpy()).astype(float) @ points.T
                scores[scores < part["least"].to_numpy()[:, None]] = -np.inf
                keep = min(k + 6, len(points))
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                at, column = np.nonzero(np.take_along_axis(scores, best, axis=1) > -np.inf)
                rows.append(pd.DataFrame({"query": part["rep"].to_numpy()[at], "rep": reps[best[at, column]]}))
        return pd.concat(rows)

    pairs = (
        probes.select("leaf", "block", "rep", "embedding", "least").groupBy("leaf", "block")
        .cogroup(points.select("leaf", "block", "rep", "embedding").groupBy("leaf", "block"))
        .applyInPandas(rank, "query long, rep long").distinct()
    )
    shown = copies.select(F.col("rep").alias("query"), F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.join(shown, "query").join(copies, "rep").select("query", dot.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        scored.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_at", "vec_id", "score"))).alias("found"))
    )
    own = asked.select("query_id", F.col("rep").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _dealt(
    rows: DataFrame, forest: Forest, leaves: int | None = None, drawn: np.ndarray | None = None, shown: int = 0
) -> DataFrame:
    """(leaf, rep, embedding, least): own leaf in every tree, or the leaves searched.

    ``least`` is a score that the query's list can't end below: the lowest of its
    best ``shown`` among the sample's vectors, which are vectors of the table. The
    first leaves searched show their best in any case, so that no list ends short.
    """
    kind = dict(rows.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                vectors = part.column(1).flatten().to_numpy().astype(float).reshape(part.num_rows, -1)
                least = np.full(part.num_rows, -np.inf)
                if leaves is None:
                    found = [row.tolist() for row in forest.leaves(vectors)]
                else:
                    found = [forest.search(v, leaves) for v in vectors]
                    if len(drawn) >= shown:
                        least = np.partition(vectors @ drawn.T, len(drawn) - shown, axis=1)[:, len(drawn) - shown] - 1e-9 * forest.longest**2
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.list_(pa.int64())), pa.array(least)], names=["rep", "embedding", "_leaves", "least"]
                )

    out = rows.mapInArrow(run, f"rep long, embedding {kind}, _leaves array<long>, least double")
    least = F.when(F.col("_at") < FREE_LEAVES, float("-inf")).otherwise(F.col("least"))
    return out.select(F.posexplode("_leaves").alias("_at", "leaf"), "rep", "embedding", "least").select(
        "leaf", "rep", "embedding", least.alias("least")
    )
