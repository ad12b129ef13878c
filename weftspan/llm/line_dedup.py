"""Fuzzy line deduplication by MinHash.

Lines are compared without case and without white space at their ends, as sets of
character shingles. Signatures are minima of many hash functions over a line's
shingles; a band of minima that two lines share makes them candidates, and enough
bands are used that near lines hardly ever miss each other. Candidates are verified
with the exact Jaccard coefficient of their shingles, links are joined to components
by distributed union-find, and of each component the first line stays, in the order
of doc_id and place.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import fresh, pieces
from weftspan.llm.components import components
from weftspan.llm.hashing import GRAM_BASE, mix, run_hashes, signed
from weftspan.llm.jaccard_join import NO_ID
from weftspan.llm.sieve import Sieve
from weftspan.llm.similar import similar_links
from weftspan.plans.storage import materialise

SHINGLE_CHARS = 8
THRESHOLD = 0.8
BANDS, ROWS = 10, 4


class Lines:
    """Lines with text of several documents: document and line number, id, and
    the hashes of all shingles with each line's first one."""

    def __init__(self, texts: list[bytes], named: bool = True):
        doc, number, lines = [], [], []
        for at, text in enumerate(texts):
            for place, line in enumerate(text.decode().lower().split("\n")):
                if line := line.strip():
                    doc.append(at)
                    number.append(place)
                    lines.append(line)
        self.doc, self.number = doc, number
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        self.counts = np.maximum(lengths - SHINGLE_CHARS + 1, 1)
        self.first = np.cumsum(self.counts) - self.counts
        if not lines:
            self.ids, self.shingles = [], np.zeros(0, np.uint64)
            return
        at = np.repeat(begins - self.first, self.counts) + np.arange(self.counts.sum())
        self.shingles = run_hashes(codes, at, np.minimum(at + SHINGLE_CHARS, np.repeat(ends, self.counts)))
        self.ids = [line_id(line) for line in lines] if named else []

    def minima(self) -> np.ndarray:
        """Minima of the hash functions, one row each: products of either half of a
        shingle's hash with a random odd factor."""
        halves = (self.shingles >> np.uint64(32)).astype(np.uint32), self.shingles.astype(np.uint32)
        factors = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        held, found = np.empty_like(halves[0]), []
        for number, factor in enumerate(factors):
            np.multiply(halves[number % 2], factor, out=held)
            found.append(np.minimum.reduceat(held, self.first))
        return np.stack(found)

    def keys(self) -> np.ndarray:
        """Band keys, one row per line."""
        minima = self.minima().astype(np.uint64)
        keys = []
        for band in range(BANDS):
            total = np.full(len(self.first), band + 1, np.uint64)
            for row in minima[band * ROWS : (band + 1) * ROWS]:
                total = mix(total * np.uint64(GRAM_BASE) + row)
            keys.append(signed(total))
        return np.stack(keys, axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_lines, line, id, keys) of every line with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            lines = Lines(texts)
            if not lines.ids:
                continue
            keys = lines.keys()
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
            doc = pa.array(lines.doc, pa.int64())
            held = np.bincount(lines.doc, minlength=len(texts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(doc), part.column(1).take(doc), pa.array(held[lines.doc]), pa.array(lines.number, pa.int32()), pa.array(lines.ids, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=["doc_id", "text_hash", "n_lines", "line", "id", "keys"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n_lines int, line int, id binary, keys array<long>")


def _load(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """(id, items): the lower-case text of the lines that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()  # ids of 16 bytes: some 12 MB at most
        for _, texts in pieces(batches, "text"):
            found = {}
            for text in texts:
                for line in text.decode().lower().split("\n"):
                    if line := line.strip():
                        found[line_id(line)] = line
            ids = [i for i in found if i not in told]
            places = np.array([struct.unpack(">I", i[:4])[0] for i in ids], np.int64)
            hit = [ids[n] for n in np.flatnonzero(wanted.passes(places)).tolist()]
            told.update(hit)
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.binary()), pa.array([found[i] for i in hit], pa.string())], names=["id", "items"])
            if len(told) > 100_000:
                told.clear()

    return docs.select("text").mapInArrow(run, "id binary, items string")


def line_id(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _shingle_sets(items: list[pa.Scalar]) -> list[np.ndarray]:
    lines = Lines(["\n".join(i.as_py() for i in items).encode()], named=False)
    values = lines.shingles
    for begin, n in zip(lines.first.tolist(), lines.counts.tolist(), strict=True):
        values[begin : begin + n].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[lines.first] = True
    ends = np.cumsum(np.add.reduceat(new, lines.first, dtype=np.int64))
    return np.split(values[new], ends[:-1])


def superfluous(rows: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, removed) of the documents with lines, as ``signatures`` names
    them, that an earlier line of their component makes superfluous.

    Only lines that occur again, or are linked to others, are looked at once links are
    known: the rest of the table is counted by id and left behind.
    """
    links, _ = similar_links(rows.select("id", "keys"), lambda wanted: _load(docs, wanted), threshold, expand=_shingle_sets)
    groups = materialise(components(links).withColumnRenamed("node", "id"), "groups")
    times = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    named = times.join(groups, "id", "left").filter(F.col("root").isNotNull() | (F.col("n") > 1)).select("id", F.coalesce("root", "id").alias("root"))
    # A line in a third of all rows is one key of this join, whose rows adaptive execution splits.
    met = materialise(rows.select("id", "doc_id", "text_hash", "line").join(named, "id").select("doc_id", "text_hash", "line", "root"), "repeated")
    place = F.struct("doc_id", "text_hash", "line")
    kept = met.groupBy("root").agg(F.min(place).alias("kept"))
    # Sets, since rows may repeat a document.
    return met.join(kept, "root").filter(place != F.col("kept")).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def line_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_removed, removed) of (doc_id, text).

    ``removed`` lists the places, from 0, of lines that an earlier line of their
    component makes superfluous. Blank lines are no lines here and stay. Documents
    without lines (null, empty or blank texts) are absent, and an empty table gives no
    row. Rows that repeat a doc_id and its text are one document; equal lines, ties in
    every respect, stay at their first place by doc_id, text digest and line; a null
    doc_id comes before all others and is given back as ``NO_ID``. Lines and texts of
    any length are read whole. Only doc_id and text are read, so no other column clashes.
    """
    rows = materialise(signatures(docs), "lines")
    lines = rows.groupBy("doc_id", "text_hash").agg(F.max("n_lines").cast("long").alias("n_lines"))
    found = lines.join(superfluous(rows, docs, threshold), ["doc_id", "text_hash"], "left")
    return found.select(
        "doc_id", "text_hash", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the superfluous lines of each text taken out, and ``n_chars``
    (if there is such a column) counted anew. All rows stay, also those of which no
    line is left; a null text stays null. All columns stay, whatever their names; the
    rest is as in ``line_report``."""
    _id, _hash, _removed = fresh(docs.columns, "_id", "_hash", "_removed")
    report = superfluous(materialise(signatures(docs), "lines"), docs, threshold).select(
        F.col("doc_id").alias(_id), F.col("text_hash").alias(_hash), F.col("removed").alias(_removed)
    )
    named = docs.withColumn(_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(_hash, F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _removed)
    cleaned = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    joined = named.join(report, [_id, _hash], "left").withColumn("text", F.when(F.col(_removed).isNull(), F.col("text")).otherwise(cleaned))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        joined = joined.withColumn("n_chars", F.when(F.col(_removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return joined.select(*docs.columns)
