"""Links between similar sets that share a bucket key.

Sets carry a binary id that stands for their content, and a list of bucket keys.
Keys that only one set has are dropped by a sieve before anything is moved; the
items of a set are read only if it shares a bucket. Where sketches (minima of some
hash functions) are given, a bucket first drops the sets that resemble no other in it
by far. A bucket is compared as a whole with the exact Jaccard coefficient, and
leaves a star for each of its components rather than all of its pairs. Buckets beyond
``LIMIT`` sets are first compared in parts that have their pivots in common, which finds
what is closely tied; then blocks of them meet in all pairs, but for pairs of blocks that
one component fills. So no pair of a bucket that could tie two components goes unseen.
Buckets of more than ``SPLIT_BLOCKS`` such blocks are split before (``split``, if given)
for as long as that shrinks them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.components import components
from weftspan.llm.sieve import Sieve, id_place, sieve
from weftspan.plans.ranking import top_per_group
from weftspan.plans.storage import materialise

LIMIT = 2_048
#: Standard deviations below the threshold at which a sketch still counts as near.
MARGIN = 5.0
PART, PIVOTS = 1_024, 64
#: Blocks beyond which a split, which makes some nine rows of one, moves less than all pairs of blocks.
SPLIT_BLOCKS = 16
ITEMS_AT_ONCE = 1 << 12
#: Characters or items of buckets that are made sets of at once, or one larger bucket.
BUCKETS_AT_ONCE = 1 << 17


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sets of distinct values."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    column = number[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float32)
    for begin in range(0, len(shared), ITEMS_AT_ONCE):
        a, b = np.searchsorted(column, [begin, begin + ITEMS_AT_ONCE])
        held = np.zeros((n, min(ITEMS_AT_ONCE, len(shared) - begin)), np.float32)
        held[owner[a:b], column[a:b] - begin] = 1
        total += held @ held.T
    return total


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sets of distinct values share."""
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; no set with itself."""
    if len(sets) == 2:
        n = float(common(*sets))
        both = np.array([[0.0, n], [n, 0.0]])
    else:
        both = overlaps(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], float)
    either = sizes[:, None] + sizes[None, :] - both
    linked = (both >= threshold * either - 1e-9) & (both > 0)
    np.fill_diagonal(linked, False)
    return linked


def stars(linked: np.ndarray, names: list) -> list[tuple[int, int]]:
    """Each member of a component of a symmetric table of links, with the
    component's member of least name."""
    left, found = np.ones(len(linked), bool), []
    for start in sorted(range(len(linked)), key=names.__getitem__):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            reached = np.flatnonzero(linked[queue.pop()] & left).tolist()
            left[reached] = False
            queue += reached
            found += [(start, r) for r in reached]
    return found


Buckets = list[tuple[int, list, list]]


def _by_bucket(batches: Iterator[pa.RecordBatch], rows_out: Callable[[Buckets], list[tuple]], kinds: list, names: list) -> Iterator[pa.RecordBatch]:
    """Runs ``rows_out`` on lists of (bucket, ids, values), ids of a bucket once each, from
    rows (bucket, id, value) that are sorted by bucket. A list holds values of
    ``BUCKETS_AT_ONCE`` in all, but for its last bucket."""
    bucket, held, ready, weight = None, {}, [], 0

    def rows(buckets: Buckets) -> Iterator[pa.RecordBatch]:
        if buckets and (out := rows_out(buckets)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        keys, ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        lengths = (pc.list_value_length if pa.types.is_nested(values.type) else pc.binary_length)(values).to_pylist()
        for at, key in enumerate(keys):
            if key != bucket:
                if len(held) > 1:
                    ready.append((bucket, list(held), list(held.values())))
                    if weight >= BUCKETS_AT_ONCE:
                        yield from rows(ready)
                        ready, weight = [], 0
                bucket, held = key, {}
            held[ids[at]] = values[at]
            weight += lengths[at]
    if len(held) > 1:
        ready.append((bucket, list(held), list(held.values())))
    yield from rows(ready)


def as_sets(values: list[pa.Scalar]) -> list[np.ndarray]:
    """Items that are lists of distinct longs, as they are."""
    return [v.values.to_numpy() for v in values]


def shared_keys(signatures: DataFrame) -> DataFrame:
    """(key, id) of (id, keys), each once, for keys that more than one id has, and
    by chance a few more.

    Ids are told apart by a hash of 64 bits; those of a key by its least and greatest.
    """
    seen = signatures.select(F.xxhash64("id").alias("s"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    often = sieve(materialise(seen.filter("a <> b").select("key"), "keys"), F.col("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            hit = often.passes(flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), batch.column(0).take(pa.array(row[hit]))], names=["key", "id"])

    return signatures.select("id", "keys").mapInArrow(run, "key long, id binary").distinct()


def similar_links(
    signatures: DataFrame,
    load: Callable[[Sieve], DataFrame],
    threshold: float,
    sketch: Callable[[Sieve], DataFrame] | None = None,
    split: Callable[[DataFrame, int], DataFrame] | None = None,
    levels: int = 6,
    expand: Callable[[list[pa.Scalar]], list[np.ndarray]] = as_sets,
) -> tuple[DataFrame, DataFrame]:
    """Ties (u, v) that connect all similar sets met in a bucket, and the sets
    (id, items) read for it.

    ``signatures`` is (id, keys); rows may repeat. ``load`` gives (id, items), and
    ``sketch`` gives (id, sketch), for at least the ids that pass a sieve. ``split``
    turns (key, id, sketch) of too large buckets into rows (parent, key, id) of smaller
    ones; a bucket of which one holds more than half is not split.
    ``expand`` makes sets of the items of a bucket.
    """
    members = materialise(_crowded(materialise(shared_keys(signatures), "buckets")), "members")
    sketches = _once(sketch, members, "sketch") if sketch else None
    rows, wide = [], None
    for level in range(levels + 1):
        small = members.filter(F.col("size") <= LIMIT)
        same = small.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
        rows.append(same.select(F.xxhash64("ids").alias("bucket"), F.explode("ids").alias("id")))
        large = members.filter(F.col("size") > LIMIT)
        if large.limit(1).count() == 0:
            break
        huge = large.filter(F.col("size") > SPLIT_BLOCKS * PART)
        if split is None or level == levels or huge.limit(1).count() == 0:
            wide = _with(wide, large.select("key", "id", "size"))
            break
        below = materialise(_crowded(split(huge.select("key", "id").join(sketches, "id"), level + 1).distinct()), "members")
        most = below.groupBy("parent").agg(F.max("size").alias("most"))
        whole = large.join(most, F.col("key") == F.col("parent"), "left").filter((large["size"] <= SPLIT_BLOCKS * PART) | (F.col("most") * 2 > large["size"]))
        whole = materialise(whole.select("key", "id", "size"), "unsplit")
        wide = _with(wide, whole)
        kept = whole.select(F.col("key").alias("parent")).distinct()
        members = materialise(below.join(kept, "parent", "left_anti").select("key", "id", "size"), "members")
    if wide is not None:
        wide = materialise(_unlike(wide), "wide")
        rows.append(_parts(wide))
    buckets = rows[0]
    for more in rows[1:]:
        buckets = buckets.unionByName(more)
    if sketch:
        buckets = _promising(buckets, sketches, threshold)
    buckets = materialise(buckets, "compared")
    sets = _once(load, _with(None if wide is None else wide.select("id"), buckets.select("id")), "items")
    links = materialise(_compared(buckets, sets, threshold, expand).distinct(), "links")
    if wide is None:
        return links, sets
    pairs = _block_pairs(wide, components(links).withColumnRenamed("node", "id"))
    if sketch:
        pairs = _promising(materialise(pairs, "pairs"), sketches, threshold)
    found = _compared(materialise(pairs, "compared"), sets, threshold, expand)
    return materialise(links.unionByName(found).distinct(), "links"), sets


def _with(some: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if some is None else some.unionByName(more)


def _once(load: Callable[[Sieve], DataFrame], rows: DataFrame, value: str) -> DataFrame:
    """(id, value) of the ids of some rows, one row each."""
    wanted = sieve(materialise(rows.select("id").distinct(), "ids"), id_place("id"))
    return materialise(load(wanted).groupBy("id").agg(F.first(value).alias(value)), value)


def _promising(buckets: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id) of the sets whose sketch is near that of another in the bucket."""

    def near(bucket: int, ids: list, sketches: list) -> list[tuple]:
        table = np.stack([k.values.to_numpy() for k in sketches])
        n = table.shape[1]
        same = np.zeros((len(table), len(table)), np.uint8 if n < 256 else np.int32)
        for column in table.T:
            same += column[:, None] == column[None, :]
        np.fill_diagonal(same, 0)
        least = n * threshold - MARGIN * (n * threshold * (1 - threshold)) ** 0.5
        return [(bucket, ids[at]) for at in np.flatnonzero(same.max(axis=1) >= least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bucket(batches, lambda buckets: [row for b in buckets for row in near(*b)], [pa.int64(), pa.binary()], ["bucket", "id"])

    rows = buckets.join(sketches, "id").select("bucket", "id", "sketch")
    return _spread(rows, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, id binary")


def _crowded(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, "key")


def _unlike(wide: DataFrame) -> DataFrame:
    """Rows (key, id, size) of one bucket each among those of equal members."""
    own = F.xxhash64("id")
    told = wide.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(own).alias("a"), F.sum(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))).alias("b")
    )
    return wide.join(told.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _parts(large: DataFrame) -> DataFrame:
    """(bucket, id): each bucket in random parts, dealt anew for every key that a set
    has; the bucket's pivots are in every part, so parts of one component meet."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    part = F.pmod(F.xxhash64("id", "key"), parts)
    own = large.select(F.xxhash64("key", part.cast("long")).alias("bucket"), "id")
    pivots = top_per_group(large, ["key"], [F.xxhash64("id", F.lit(3)), F.col("id")], PIVOTS, spread=["id"])
    each = pivots.select("key", "id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    return own.unionByName(each.select(F.xxhash64("key", F.col("p").cast("long")).alias("bucket"), "id")).distinct()


def _block_pairs(wide: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, id): each bucket of (key, id) cut into blocks of about ``PART``, and
    every pair of blocks as a bucket of its own.

    A component of (id, root) that has ``PART`` members or more in a bucket fills
    blocks alone, and those need not meet each other: ties within a component add
    nothing to it. All other sets are dealt at random.
    """
    tied = wide.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = tied.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.filter(F.col("n") >= PART).select("key", "root", F.ceil(F.col("n") / PART).cast("int").alias("_own"))
    rest = sizes.filter(F.col("n") < PART).groupBy("key").agg(F.ceil(F.sum("n") / PART).cast("int").alias("_rest"))
    whole = F.when(F.col("_own").isNotNull(), F.col("root"))
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("_own", "_rest"))
    dealt = tied.join(own, ["key", "root"], "left").join(rest, "key", "left").select(
        "key", "id", whole.alias("whole"), F.xxhash64(whole, place).alias("block")
    )
    dealt = materialise(dealt, "blocks")
    blocks = dealt.select("key", "block", "whole").distinct()
    x = blocks.select("key", F.col("block").alias("x"), F.col("whole").alias("_x"))
    y = blocks.select("key", F.col("block").alias("y"), F.col("whole").alias("_y"))
    apart = F.col("_x").isNull() | F.col("_y").isNull() | (F.col("_x") != F.col("_y"))
    pairs = x.join(y, "key").filter((F.col("x") <= F.col("y")) & apart)
    met = pairs.select("key", F.xxhash64("key", "x", "y").alias("bucket"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return dealt.join(met, ["key", "block"]).select("bucket", "id")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many tasks as the session shuffles to: a group's work is
    large for its bytes, so tasks must not be merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _compared(buckets: DataFrame, sets: DataFrame, threshold: float, expand: Callable) -> DataFrame:
    def ties(buckets: Buckets) -> list[tuple]:
        sets, found = iter(expand([i for _, _, items in buckets for i in items])), []
        for _, ids, _ in buckets:
            own = [next(sets) for _ in ids]
            if len(ids) > 2:
                found += [(ids[a], ids[b]) for a, b in stars(similar(own, threshold), ids)]
            elif (n := common(*own)) and n >= threshold * (len(own[0]) + len(own[1]) - n) - 1e-9:
                found.append((min(ids), max(ids)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bucket(batches, ties, [pa.binary(), pa.binary()], ["u", "v"])

    rows = buckets.join(sets, "id").select("bucket", "id", "items")
    return _spread(rows, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "u binary, v binary")


def link_counts(groups: DataFrame, sets: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, n_links): for each set of (id, root), how many others of its group
    reach the threshold.

    A group of more than ``block`` sets is cut at random into blocks, and each pair
    of blocks is one task's work, so every pair is compared in exactly one place;
    only counts leave a task.
    """
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.withColumn("o", other).select(
        "root", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
        group = group.drop_duplicates("id")
        ids = group["id"].tolist()
        linked = similar([np.asarray(i, np.int64) for i in group["items"]], threshold)
        if x != y:  # pairs within a block belong to that block alone
            own = group["b"].to_numpy()
            linked &= own[:, None] != own[None, :]
        return pd.DataFrame({"id": ids, "n": linked.sum(axis=1)})

    parts = _spread(rows.join(sets, "id"), "root", "x", "y").groupBy("root", "x", "y").applyInPandas(run, "id binary, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n_links"))
