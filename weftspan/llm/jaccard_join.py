"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Sets that are equal form one
class, and classes are compared once. A tree of paths is grown: at each node a
class follows the shingles that the node samples, so two classes stay together
with a chance that grows with their overlap. Sampling works on minima of hash
functions (coordinates): a node samples coordinates at random, and a class follows
it with the shingle that is its minimum there. Nodes are compared in full, very large
ones are split again first. Runs repeat with other samples until the recall
aimed at is reached; all runs go side by side. Links found join classes to
groups, and in each group all pairs are then compared, so that the counts of links
are exact for the groups found.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspan.llm.batches import fresh, pieces
from weftspan.llm.components import components
from weftspan.llm.hashing import GRAM_BASE, Words, byte_table, mix, run_hashes, signed
from weftspan.llm.sieve import Sieve
from weftspan.llm.similar import link_counts, similar_links
from weftspan.plans.storage import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
NO_ID = -(1 << 63)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with this chance. In one
    run a pair follows a sampled coordinate with a chance of ``threshold``, and a
    node samples ``1 / threshold`` of them on average, so it stays together with a
    chance of 1 - 1/e at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 / math.e)))


def coordinate(values: np.ndarray, number: int) -> np.ndarray:
    """Hash function of one coordinate, over shingle hashes."""
    return mix(values ^ np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF))


def sampled(node: int, threshold: float) -> list[int]:
    """Coordinates that a node samples, each with a chance of
    1 / (threshold * COORDINATES); at least one."""
    draws = mix(np.arange(COORDINATES, dtype=np.uint64) * np.uint64(GRAM_BASE) + np.uint64(node & 0xFFFFFFFFFFFFFFFF))
    found = np.flatnonzero(draws < np.uint64(int(2**64 / (threshold * COORDINATES))))
    return found.tolist() or [int(np.argmin(draws))]


def step(node: int, number: int, minima: np.ndarray) -> np.ndarray:
    """Child node reached with each minimum of one coordinate."""
    return mix(minima * np.uint64(GRAM_BASE) + mix(np.array([(node * 67 + number) & 0xFFFFFFFFFFFFFFFF], np.uint64)))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of several texts, each once and in order. A text
    of fewer than five words is one shingle of all its words."""
    words = Words([t.decode().lower().encode() for t in texts], byte_table("plain"))
    at, grams = words.grams(SHINGLE_WORDS)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    doc = np.concatenate([words.doc[at], short])
    grams = np.concatenate([grams, run_hashes(words.hash, words.first[short], words.first[short + 1], GRAM_BASE)])
    order = np.lexsort([grams, doc])
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def set_ids(grams: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """Sixteen bytes that stand for the content of each set."""
    a = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
    b = np.add.reduceat(mix(grams + np.uint64(0x0123456789ABCDEF)), begins)
    return [struct.pack(">QQ", x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, id, keys): set id and first nodes of every document."""
    roots = [(run, number) for run in range(runs_for(recall, threshold)) for number in sampled(run, threshold)]
    used = sorted({number for _, number in roots})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            doc, grams = shingles(texts)
            ids, keys = [None] * len(texts), [None] * len(texts)
            if len(doc):
                begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                minima = {n: np.minimum.reduceat(coordinate(grams, n), begins) for n in used}
                table = np.stack([signed(step(r, n, minima[n])) for r, n in roots], axis=1)
                for at, own, row in zip(doc[begins].tolist(), set_ids(grams, begins), table, strict=True):
                    ids[at], keys[at] = own, row
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "id", "keys"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, id binary, keys array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """A null doc_id is the smallest; rows that repeat one differ by their text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )


def _wanted(docs: DataFrame, wanted: Sieve, name: str, kind: str, value) -> DataFrame:
    """(id, ``name``) of the sets that may be wanted; ``value`` makes it from all
    shingles of some texts and the bounds of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for _, texts in pieces(batches, "text"):
            doc, grams = shingles(texts)
            if not len(doc):
                continue
            begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            own = set_ids(grams, begins)
            places = np.array([struct.unpack(">I", i[:4])[0] for i in own], np.int64)
            hit = [n for n in np.flatnonzero(wanted.passes(places)).tolist() if own[n] not in told]
            told.update(own[n] for n in hit)
            if hit:
                values = value(grams, begins, np.append(begins[1:], len(grams)), hit)
                yield pa.RecordBatch.from_arrays([pa.array([own[n] for n in hit], pa.binary()), values], names=["id", name])
            if len(told) > 500_000:
                told.clear()

    return docs.select("text").mapInArrow(run, f"id binary, {name} {kind}")


def _load(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """(id, items): the shingles of a set."""

    def items(grams, begins, ends, hit):
        return pa.array([signed(grams[begins[n] : ends[n]]) for n in hit], pa.list_(pa.int64()))

    return _wanted(docs, wanted, "items", "array<long>", items)


def _sketch(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """(id, sketch): the minima of all coordinates, their low halves."""

    def sketch(grams, begins, ends, hit):
        grams = np.concatenate([grams[begins[n] : ends[n]] for n in hit])
        sizes = ends[hit] - begins[hit]
        first = np.cumsum(sizes) - sizes
        table = np.stack([np.minimum.reduceat(coordinate(grams, c), first).astype(np.uint32) for c in range(COORDINATES)], axis=1)
        offsets = pa.array(np.arange(0, table.size + 1, COORDINATES), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(table.view(np.int32).ravel()))

    return _wanted(docs, wanted, "sketch", "array<int>", sketch)


def _split(threshold: float, recall: float):
    """Children of a node. It samples as often as there are runs: a pair survives each
    split with the chance ``recall``, where one sample would lose a third of those left."""
    draws = runs_for(recall, threshold)

    def split(rows: DataFrame, level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            taken: dict[int, list[int]] = {}
            for batch in batches:
                parents, keys, ids = [], [], []
                for key, own, minima in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    table = minima.values.to_numpy().view(np.uint32).astype(np.uint64)
                    if key not in taken:
                        taken[key] = sorted({n for draw in range(draws) for n in sampled(key + level * draws + draw, threshold)})
                    for number in taken[key]:
                        parents.append(key)
                        keys.append(int(signed(step(key, number, table[number : number + 1]))[0]))
                        ids.append(own)
                columns = [pa.array(parents, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["parent", "key", "id"])

        return rows.select("key", "id", "sketch").mapInArrow(run, "parent long, key long, id binary")

    return split


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, class_id, set_id, n_links) of each row of (doc_id, text).

    ``set_id`` is the smallest doc_id with the same set of shingles, ``class_id`` the
    smallest of the group that links connect, and ``n_links`` counts the other sets
    that are similar to the row's. A null text, or one without words, has no set: it
    is a class of its own and links to nothing. Equal texts share a class, however
    often a row repeats. A null doc_id counts as smaller than any other and is
    given back as null. An empty table gives no rows. Texts of any length are read
    whole; of equal candidates for an id the smallest counts. Only doc_id and text are
    read, so no other column clashes.
    """
    rows = materialise(signatures(docs, threshold, recall), "signatures")
    sets_of = rows.filter(F.col("id").isNotNull())
    links, sets = similar_links(
        sets_of, lambda wanted: _load(docs, wanted), threshold, lambda wanted: _sketch(docs, wanted), _split(threshold, recall)
    )
    groups = materialise(components(links).withColumnRenamed("node", "id"), "groups")
    counts = link_counts(groups, sets, threshold)
    first = sets_of.groupBy("id").agg(F.min("doc_id").alias("set_id"))
    named = first.join(groups, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("set_id").alias("class_id"))
    named = materialise(named.join(least, "root").select("id", "set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    # A row's set is unknown to the join if it has none; one class may hold a third of all rows, which an outer join may split.
    found = rows.select("doc_id", "text_hash", "id").join(named, "id", "left")
    own = F.col("doc_id")

    def shown(c):
        return F.when(c != NO_ID, c)

    return found.select(
        shown(own).alias("doc_id"), "text_hash", shown(F.coalesce("class_id", own)).alias("class_id"),
        shown(F.coalesce("set_id", own)).alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: that with the smallest doc_id.

    Rows that repeat a doc_id with an equal text count as copies and one stays.
    Columns are those of ``docs``, whatever their names; nulls, empty and long texts,
    ties and empty tables are as in ``near_duplicates``: a text without words stays.
    """
    _id, _hash, _copy = fresh(docs.columns, "_id", "_hash", "_copy")
    found = near_duplicates(docs, threshold)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(_id), F.col("text_hash").alias(_hash)
    ).distinct()
    named = docs.withColumn(_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(_hash, F.xxhash64("text"))
    once = Window.partitionBy(_id, _hash).orderBy(_id)
    same = named.join(kept, [_id, _hash], "left_semi").withColumn(_copy, F.row_number().over(once))
    return same.filter(F.col(_copy) == 1).select(*docs.columns)
