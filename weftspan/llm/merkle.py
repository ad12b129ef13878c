"""Merkle dataset manifest, with proofs by descent through a content-addressed graph.

Every row is a leaf: the digest of its fields. Within a group, leaves ascend by key;
every ``FAN_OUT`` consecutive nodes become the digest of their digests, until one
node, the subroot, remains. The subroots, ordered by group, give the root in the same
way. What is stored are records digest -> children, nothing else.

A proof starts at the root and goes down by the digits of a leaf's rank: at each
record it takes the child that the digit names and collects the others. Requests that
still agree in their digits travel as one row, so no record is asked for by more rows
than it has children, and a hot group is no hot key. At the leaf the collected
segments are reversed, for folding goes upward.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspan.plans.sizing import small_side
from weftspan.plans.storage import materialise

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The letters that tampering lowers.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_BITS = 33  # of monotonically_increasing_id, for the place within a partition
SEGMENT = "struct<before: string, after: string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for a null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """ASCII capitals lowered, all else as it is."""
    return F.translate(text, CAPITALS, SMALL)


def row_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in fields])


@dataclass
class Manifest:
    """Frames of one manifest.

    ``leaves``: _group, _rank, _depth (levels above the leaf within its group), leaf,
    and the kept columns. ``records``: for each level, from 1 on, (digest, children).
    ``top``: the same for the tree over subroots. ``subroots``: _group, _rank, _depth,
    subroot, and ``_top`` levels above it. ``root``: its digest, None if there are no leaves.
    """

    leaves: DataFrame
    records: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` from 0 within ``_group`` in ``order``, the number
    ``_size`` of rows of the group, and ``_depth``, the levels a tree over them has.

    The table is sorted by ranges; ranks are places within a range shifted by the
    sizes of the ranges before. Equal rows are dealt to ranges by chance, so copies
    of one row don't fill one range.
    """
    spread = rows.withColumn("_chance", F.monotonically_increasing_id())
    cut = spread.repartitionByRange("_group", *order, "_chance").sortWithinPartitions("_group", *order, "_chance")
    placed = materialise(cut.drop("_chance").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    runs = placed.groupBy("_group", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    # One row per range and group: as many as ranges and groups together.
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(
        "_group", "_part", "_first", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy("_group")).alias("_size"),
    )
    depth, left = F.lit(0), F.col("_size")
    for level in range(1, 22):
        depth = F.when(left > FAN_OUT ** (level - 1), level).otherwise(depth)
    found = placed.withColumn("_part", F.shiftright("_at", ROW_BITS)).join(small_side(shift), ["_group", "_part"])
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return found.withColumn("_rank", rank).withColumn("_depth", depth).drop("_at", "_part", "_first", "_before")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level over ``nodes`` (_group, _rank, _depth, digest), and
    the last node of every group as (_group, _depth, digest)."""
    levels, tops = [], nodes.filter("_depth = 0").select("_group", "_depth", "digest")
    height = nodes.agg(F.max("_depth").alias("d")).first()["d"] or 0
    for level in range(1, height + 1):
        run = nodes.filter(F.col("_depth") >= level).groupBy(
            "_group", "_depth", F.expr(f"_rank div {FAN_OUT}").alias("_run")
        ).agg(F.array_sort(F.collect_list(F.struct("_rank", "digest"))).alias("_c"))
        children = F.col("_c.digest")
        made = run.select("_group", "_depth", F.col("_run").alias("_rank"), F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children"))
        made = materialise(made, f"level{level}")
        levels.append(made.select("digest", "children"))
        nodes = made.drop("children")
        tops = tops.unionByName(nodes.filter(F.col("_depth") == level).select("_group", "_depth", "digest"))
    return levels, tops


def build(leaves: DataFrame, group: str, key: str, keep: list[str]) -> Manifest:
    """Manifest of ``leaves``, a frame with ``group``, ``key``, ``leaf`` and ``keep``.

    Nulls: a null group is a group of its own, before all others; a null key comes
    first in its group. Leaves of one key are ordered by their digest, so repeated
    rows are neighbours and any order of them is the same. Texts of any length are
    hashed whole. An empty table gives a manifest without a root. Columns that the
    manifest doesn't name are not read, so none can clash.
    """
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("")).alias("_group"), F.col(key).alias("_key"), "leaf", *keep
    )
    placed = materialise(ranked(materialise(rows, "leaves"), ["_key", "leaf"]), "placed")
    records, tops = tree(placed.withColumnRenamed("leaf", "digest").select("_group", "_rank", "_depth", "digest"))
    within = tops.select("_group", F.col("_depth").alias("_within"), F.col("digest").alias("subroot"))
    ordered = ranked(within.withColumn("_name", F.col("_group")).withColumn("_group", F.lit("")), ["_name"])
    ordered = materialise(ordered.withColumnRenamed("_depth", "_top").withColumnRenamed("_rank", "_place"), "subroots")
    top, root = tree(ordered.select("_group", F.col("_place").alias("_rank"), F.col("_top").alias("_depth"), F.col("subroot").alias("digest")))
    lone = root.first()
    subroots = ordered.select(F.col("_name").alias("_group"), F.col("_within").alias("_depth"), "subroot", "_place", "_top")
    return Manifest(placed, records, subroots, top, lone["digest"] if lone else None)


def _step(asked: DataFrame, records: DataFrame, digits: str | None) -> DataFrame:
    """One record further down: ``_at`` is looked up and replaced by a child, with
    the others appended to ``_path``. Without ``digits`` all children are taken, and
    ``_rank`` grows by a digit."""
    store = records.select(F.col("digest").alias("_at"), "children").dropDuplicates(["_at"])
    met = asked.join(store, "_at")
    if digits is None:
        met = met.select("*", F.posexplode("children").alias("_digit", "_child"))
        met = met.withColumn("_rank", F.col("_rank") * FAN_OUT + F.col("_digit"))
    else:
        met = met.withColumn("_digit", F.expr(digits).cast("int")).withColumn("_child", F.expr("children[_digit]"))
    return met.withColumn("_path", _longer(F.col("_digit"))).withColumn("_at", F.col("_child")).drop("children", "_digit", "_child")


def _longer(digit: Column) -> Column:
    before = F.array_join(F.slice("children", F.lit(1), digit), "")
    after = F.array_join(F.slice("children", digit + 2, F.lit(FAN_OUT)), "")
    return F.concat(F.col("_path"), F.array(F.struct(before.alias("before"), after.alias("after"))))


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves with ``subroot``, ``root`` and ``segments``, from the leaf to the root:
    the digests before and after it, and before and after each node above it.

    ``requests``: a choice of the leaves, as their (_group, _rank); all without it.
    """
    none = F.expr(f"cast(array() as array<{SEGMENT}>)")
    asked = manifest.subroots.withColumn("root", F.lit(manifest.root).cast("string")).withColumn("_at", F.col("root")).withColumn("_path", none)
    for level in range(len(manifest.top), 0, -1):
        # All subroots lie equally deep below the root.
        asked = _step(asked, manifest.top[level - 1], f"(_place div {FAN_OUT ** (level - 1)}) % {FAN_OUT}")
    asked = asked.select("_group", "_depth", "subroot", "root", "_at", "_path", F.lit(0).cast("long").alias("_rank"))
    wanted = requests.select("_group", "_rank") if requests is not None else None
    going = asked.limit(0)
    for level in range(len(manifest.records), 0, -1):
        going = going.unionByName(asked.filter(F.col("_depth") == level))
        if level > 1:
            going = _step(going, manifest.records[level - 1], None)
            if wanted is not None:
                prefix = wanted.select("_group", F.expr(f"_rank div {FAN_OUT ** (level - 1)}").alias("_rank")).distinct()
                going = going.join(prefix, ["_group", "_rank"], "left_semi")
    runs = going.unionByName(asked.filter("_depth = 0")).withColumnRenamed("_rank", "_run").drop("_depth")
    leaves = manifest.leaves if wanted is None else manifest.leaves.join(wanted.distinct(), ["_group", "_rank"], "left_semi")
    met = leaves.withColumn("_run", F.expr(f"_rank div {FAN_OUT}")).join(runs, ["_group", "_run"])
    if not manifest.records:
        return met.withColumn("segments", F.reverse("_path")).drop("_path", "_at", "_run")
    lone = met.filter("_depth = 0").drop("_at", "_run")
    last = _step(met.filter("_depth > 0"), manifest.records[0], f"_rank % {FAN_OUT}").drop("_at", "_run")
    return last.unionByName(lone).withColumn("segments", F.reverse("_path")).drop("_path")


def proof_digest(segments: str = "segments") -> Column:
    """Digest of all siblings, level by level upward, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(segments, lambda s: F.array(s["before"], s["after"]))), ""), 256)


def folded(leaf: Column, segments: str = "segments") -> Column:
    """Root that follows from a leaf and the segments of its proof."""
    return F.aggregate(segments, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
