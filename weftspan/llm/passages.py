"""Substring deduplication by repeated-phrase automata.

A window is a run of words of fixed length. Of the shorter phrases in a window, the
one with the least hash is its anchor; equal windows have equal anchors, so only
windows whose anchor occurs at least twice can repeat. Those are taken from the
documents in segments (the windows of one anchor) and dealt by anchor to shards of
bounded size. In a shard, windows that recur word for word are confirmed and
compiled to an Aho-Corasick automaton over word numbers, and every segment is
streamed through it. That locates each occurrence, and all but the first in the order
of (doc_id, place) are marked. Equal segments are streamed once, however many
documents hold them. An anchor with more different segments than a shard may hold (a
phrase that a third of the documents have, each among words of its own) gathers none:
its windows are dealt each by its own hash, and only those whose hash recurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces, text_batches
from weftspan.llm.hashing import GRAM_BASE, Words, byte_table, run_hashes, signed
from weftspan.llm.sieve import Sieve, sieve
from weftspan.plans.storage import materialise

WINDOW_WORDS = 20
PHRASE_WORDS = 8
SHARD_SEGMENTS = 3_000
NO_ID = -(1 << 63)


class Anchors:
    """Segments of several texts: first window, windows, and anchor of each."""

    def __init__(self, texts: list[bytes], window: int, phrase: int):
        self.words = words = Words(texts, byte_table("spaced"))
        count = len(words.hash) - window + 1
        none = np.zeros(0, np.int64)
        self.first, self.windows, self.anchor = none, none, none.view(np.uint64)
        if count <= 0:
            return
        width = window - phrase + 1
        at = np.arange(len(words.hash) - phrase + 1)
        grams = run_hashes(words.hash, at, at + phrase, GRAM_BASE)
        least = grams[:count].copy()
        for shift in range(1, width):
            np.minimum(least, grams[shift : shift + count], out=least)
        place = np.arange(count)
        for shift in range(width - 1, -1, -1):
            here = grams[shift : shift + count] == least
            place[here] = np.flatnonzero(here) + shift
        start = np.flatnonzero(words.doc[:count] == words.doc[window - 1 :])
        if not len(start):
            return
        # A segment ends where the anchor's place changes or a text ends.
        new = np.ones(len(start), bool)
        new[1:] = (place[start[1:]] != place[start[:-1]]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first = start[begin]
        self.windows = np.diff(np.append(begin, len(start)))
        self.anchor = least[self.first]

    def windows_of(self, segments: np.ndarray) -> np.ndarray:
        """First words of all windows of these segments."""
        n = self.windows[segments]
        return np.repeat(self.first[segments] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )


@dataclass
class Plan:
    """Which segments are looked at: ``often`` passes anchors that occur at least
    twice, ``hot`` those of them cut to windows, ``again`` the hashes of such windows
    that occur at least twice. Each may pass more by chance, which costs time only."""

    often: Sieve
    hot: Sieve | None = None
    again: Sieve | None = None


def _counted(docs: DataFrame, keys: str, find) -> DataFrame:
    """(keys, n): how often ``find(texts)``, a list of arrays, gives each row of keys,
    summed in each piece before it is dealt."""
    names = keys.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            values = np.stack(find(texts))
            if not values.shape[1]:
                continue
            found, n = np.unique(values, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(signed(row)) for row in found), pa.array(n.astype(np.int64))], names=[*names, "n"])

    kind = ", ".join(f"{name} long" for name in [*names, "n"])
    return docs.select("text").mapInArrow(run, kind).groupBy(*names).agg(F.sum("n").alias("n"))


def plan_of(docs: DataFrame, window: int = WINDOW_WORDS, phrase: int = PHRASE_WORDS, most: int | None = None) -> Plan:
    """Counts anchors, then the different segments of those that occur more than
    ``most`` times, then the windows of those with more than ``most`` such segments.
    Each count is one pass over the documents and only made if there is anything to
    count."""
    most = SHARD_SEGMENTS if most is None else most

    def anchors(texts: list[bytes]) -> list[np.ndarray]:
        return [Anchors(texts, window, phrase).anchor]

    recurring = materialise(_counted(docs, "anchor", anchors).filter("n > 1"), "anchors")
    plan = Plan(sieve(recurring, F.col("anchor")))
    many = recurring.filter(F.col("n") > most)
    if many.isEmpty():
        return plan
    candidates = sieve(many, F.col("anchor"))

    def digests(texts: list[bytes]) -> list[np.ndarray]:
        found = Anchors(texts, window, phrase)
        hit = np.flatnonzero(candidates.passes(signed(found.anchor)))
        first = found.first[hit]
        return [found.anchor[hit], run_hashes(found.words.hash, first, first + found.windows[hit] + window - 1, GRAM_BASE)]

    kinds = _counted(docs, "anchor digest", digests).groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"))
    hot = materialise(kinds.filter(F.col("segments") > most), "hot_anchors")
    if hot.isEmpty():
        return plan
    plan.hot = sieve(hot, F.col("anchor"))

    def windows(texts: list[bytes]) -> list[np.ndarray]:
        found = Anchors(texts, window, phrase)
        first = found.windows_of(np.flatnonzero(plan.hot.passes(signed(found.anchor))))
        return [run_hashes(found.words.hash, first, first + window, GRAM_BASE)]

    again = _counted(docs, "hash", windows).filter("n > 1").select("hash")
    plan.again = sieve(materialise(again, "hot_windows"), F.col("hash"))
    return plan


def segments(docs: DataFrame, plan: Plan, with_words: bool, window: int = WINDOW_WORDS, phrase: int = PHRASE_WORDS) -> DataFrame:
    """(anchor, digest, doc_id, text_hash, start, windows[, words]) of the segments
    whose anchor passes; ``digest`` stands for the words, ``start`` counts words. Of a
    hot anchor, each window that passes is a segment of its own, with its hash as anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            found = Anchors(texts, window, phrase)
            words, anchor = found.words, signed(found.anchor)
            passed = plan.often.passes(anchor)
            first, n, key = found.first[passed], found.windows[passed], anchor[passed]
            if plan.hot is not None:
                cut = passed & plan.hot.passes(anchor)
                own = found.windows_of(np.flatnonzero(cut))
                hashes = signed(run_hashes(words.hash, own, own + window, GRAM_BASE))
                own, hashes = own[plan.again.passes(hashes)], hashes[plan.again.passes(hashes)]
                whole = passed & ~cut
                first, key = np.concatenate([found.first[whole], own]), np.concatenate([anchor[whole], hashes])
                n = np.concatenate([found.windows[whole], np.ones(len(own), np.int64)])
            if not len(first):
                continue
            last = first + n + window - 1
            digest = signed(run_hashes(words.hash, first, last, GRAM_BASE))
            doc = pa.array(words.doc[first])
            columns = [
                pa.array(key), pa.array(digest), part.column(0).take(doc), part.column(1).take(doc),
                pa.array(first - words.first[words.doc[first]]), pa.array(n.astype(np.int64)),
            ]
            names = ["anchor", "digest", "doc_id", "text_hash", "start", "windows"]
            if with_words:
                spans = zip(words.starts[first].tolist(), words.ends[last - 1].tolist(), strict=True)
                columns.append(pa.array([b" ".join(words.data[a:b].split()) for a, b in spans], pa.binary()))
                names.append("words")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "anchor long, digest long, doc_id long, text_hash long, start long, windows long" + (", words binary" if with_words else "")
    return _keyed(docs).mapInArrow(run, kind)


def _spelled(texts: list[bytes]) -> tuple[list[str], int]:
    """Each text as a string of ``width`` letters a word. The letters of each place
    in a word are their own alphabet of 64, so that no node of an automaton has many
    children and no match begins within a word."""
    numbers: dict[bytes, int] = {}
    split = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]
    width = 1
    while 64**width < len(numbers):
        width += 1
    names = []
    for n in range(len(numbers)):
        name = ""
        for place in range(width):
            name += chr(0x100 + 64 * place + n % 64)
            n //= 64
        names.append(name)
    return ["".join(map(names.__getitem__, t)) for t in split], width


def locate(rows: list[tuple], window: int) -> list[list[tuple]]:
    """What recurs in each segment (anchor, words, first occurrence, occurrences) of
    a shard, in which those of one anchor lie together.

    Gives runs (first window, last window + 1, first occurrence of that first
    window). Where an anchor has one segment only, that stands for all its windows;
    else each window that two segments, or two occurrences of one, have is a
    phrase of the automaton.
    """
    import ahocorasick

    texts, width = _spelled([r[1] for r in rows])
    automaton = ahocorasick.Automaton()
    size, begin = window * width, 0
    while begin < len(rows):
        end = begin + 1
        while end < len(rows) and rows[end][0] == rows[begin][0]:
            end += 1
        if end == begin + 1:
            if rows[begin][3] > 1:
                automaton.add_word(texts[begin], (True, rows[begin][2]))
        else:
            count: dict[str, int] = {}
            first: dict[str, tuple] = {}
            for text, (_, _, (doc, digest, start), n) in zip(texts[begin:end], rows[begin:end], strict=True):
                for at in range(0, len(text) - size + 1, width):
                    key, place = text[at : at + size], (doc, digest, start + at // width)
                    count[key] = count.get(key, 0) + n
                    if key not in first or place < first[key]:
                        first[key] = place
            for key, n in count.items():
                if n > 1:
                    automaton.add_word(key, (False, first[key]))
        begin = end
    if not len(automaton):
        return [[] for _ in rows]
    automaton.make_automaton()
    found = []
    for text in texts:
        runs: list[tuple] = []
        for last, (whole, place) in automaton.iter(text):
            to = (last + 1) // width - window + 1
            at = 0 if whole else to - 1
            if runs and runs[-1][1] == at and _follows(runs[-1], place):
                runs[-1] = (runs[-1][0], to, runs[-1][2])
            else:
                runs.append((at, to, place))
        found.append(runs)
    return found


def _follows(run: tuple, place: tuple) -> bool:
    doc, digest, start = run[2]
    return (doc, digest, start + run[1] - run[0]) == place


def repeated_spans(docs: DataFrame, window: int = WINDOW_WORDS, phrase: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, text_hash, spans): stretches of words, from ``a`` to before ``b``, that
    windows whose words also start earlier cover; documents without any are absent."""
    plan = plan_of(docs, window, phrase)
    place = F.struct("doc_id", "text_hash", "start")
    distinct = segments(docs, plan, True, window, phrase).groupBy("anchor", "digest", "words").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")
    )
    fields = ["at", "to", "doc_id", "text_hash", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list, digests: list) -> pa.RecordBatch:
            found = locate(rows, window)
            hit = [n for n, runs in enumerate(found) if runs]
            kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
            runs = [[dict(zip(fields, (a, b, *p), strict=True)) for a, b, p in found[n]] for n in hit]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[n][0] for n in hit], pa.int64()), pa.array([digests[n] for n in hit], pa.int64()), pa.array(runs, kind)],
                names=["anchor", "digest", "runs"],
            )

        rows, digests = [], []
        for batch in batches:
            for anchor, digest, words, doc, text, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= SHARD_SEGMENTS and anchor != rows[-1][0]:
                    yield shard(rows, digests)
                    rows, digests = [], []
                rows.append((anchor, words, (doc, text, start), n))
                digests.append(digest)
        if rows:
            yield shard(rows, digests)

    flat = distinct.select("anchor", "digest", "words", "first.doc_id", "first.text_hash", "first.start", "n")
    kind = f"anchor long, digest long, runs array<struct<{', '.join(f'{f}: long' for f in fields)}>>"
    located = flat.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, kind)
    own = segments(docs, plan, False, window, phrase).join(located, ["anchor", "digest"])
    here = F.col("start")

    def later(x):
        return ~((x["doc_id"] == F.col("doc_id")) & (x["text_hash"] == F.col("text_hash")) & (x["start"] == here + x["at"]))

    def span(x):
        return F.struct((here + x["at"]).cast("int").alias("a"), (here + x["to"] + window - 1).cast("int").alias("b"))

    marked = own.select("doc_id", "text_hash", F.transform(F.filter("runs", later), span).alias("spans")).filter(F.size("spans") > 0)
    return marked.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, phrase: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of (doc_id, text).

    Words are runs of bytes other than ASCII white space. A word goes if a window
    that covers it starts earlier too: in a document of smaller doc_id, or earlier in
    its own. ``kept`` joins the others by one space. A null or empty text has no
    words; a text of fewer words than a window keeps all. A null doc_id is smaller
    than any other. Rows that repeat a doc_id and its text are one document and lose
    the same words; texts that share a doc_id are ordered by a digest. Texts without
    repeats are not moved. Texts of any length are read whole, and an empty table gives
    no rows. Only doc_id and text are read, so no other column clashes.
    """
    with text_batches(docs.sparkSession):
        marked = repeated_spans(docs, window, phrase).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
        marked = materialise(marked, "spans")
    held = sieve(marked, F.col("_hash"))
    named = docs.select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash")
    )

    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        return pd.Series(held.passes(places.to_numpy()))

    moved = named.filter(passes("_hash")).join(marked, ["_id", "_hash"], "left").select("doc_id", "spans", "text")
    still = named.filter(~passes("_hash")).select("doc_id", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"), "text")
    return _without(moved).unionByName(_without(still))


def _without(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, spans, text) with the words of the spans taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            total, removed, kept = [], [], []
            for spans, text in zip(part.column(1), texts, strict=True):
                words = text.split()
                total.append(len(words))
                if spans.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, spans.values.field("a").to_numpy(), 1)
                    np.add.at(edges, spans.values.field("b").to_numpy(), -1)
                    left = np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    cast = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return cast.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
