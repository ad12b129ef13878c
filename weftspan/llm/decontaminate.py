"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words at the set positions of a fixed mask and ignores those
between, so a replaced word spoils only some of the masks at some places. The
benchmark's seeds are joined with those of every document; each hit fixes an
alignment of item and document, on which the words are then compared one by one
and the best stretch is kept. A stretch counts if it matches enough words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import fresh, pieces
from weftspan.llm.hashing import Words, byte_table, mix

#: Positions that count are 1. Six words each, spans of 7, 8 and 9.
MASKS = ("1110111", "11011011", "101101011")
#: Fewest words of an item that can be evidence, and enough matched words.
LEAST_WORDS, ENOUGH_WORDS = 5, 13
SIMILARITY, MISMATCH_COST = 0.8, 3
#: Items up to so many words are found whatever words are replaced, and longer ones with
#: any two replaced: a third of the others is longer than a mask.
SHORT_WORDS = 20
#: Words of the benchmark that are held by a task at once.
BLOCK_WORDS = 400_000
SIEVE = 1 << 21


def allowed(n: int) -> int:
    """Most words of an item of n that may be replaced."""
    return n - math.ceil(SIMILARITY * n)


def run_of(n: int) -> int:
    """Words that surely stand in a row, if ``allowed`` of n are replaced anywhere."""
    return -(-(n - allowed(n)) // (allowed(n) + 1))


def masks_for(lengths: set[int]) -> list[str]:
    """The fixed masks, and for short items, by length, a full one of the run that must
    be left: a few replaced words can spoil all placings of the fixed ones there."""
    return [*MASKS, *sorted({"1" * run_of(n) for n in lengths if LEAST_WORDS <= n <= SHORT_WORDS})]


def seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every placing of a mask within one text."""
    count = len(words.hash) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(count, int(mask, 2), np.uint64)
    for place, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words.hash[place : place + count]
    at = np.flatnonzero(words.doc[:count] == words.doc[len(mask) - 1 :])
    return at, mix(total[at])


def prepared(texts: list[bytes]) -> Words:
    return Words([t.decode().lower().encode() for t in texts], byte_table("plain"))


class Block:
    """Seeds and words of some items."""

    def __init__(self, ids: list, texts: list[str]):
        words = prepared([t.encode() for t in texts])
        self.ids, self.hash, self.first = ids, words.hash, words.first
        lengths = np.diff(words.first)
        self.masks = masks_for({int(n) for n in lengths})
        found = []
        for mask in self.masks:
            at, hashes = seeds(words, mask)
            if mask in MASKS:
                own = lengths[words.doc[at]] >= LEAST_WORDS
            else:  # a full mask serves the short items whose run it is
                own = np.isin(lengths[words.doc[at]], [n for n in range(LEAST_WORDS, SHORT_WORDS + 1) if run_of(n) == len(mask)])
            at, hashes = at[own], hashes[own]
            found.append((at, hashes))
        at = np.concatenate([f[0] for f in found])
        hashes = np.concatenate([f[1] for f in found])
        order = np.argsort(hashes, kind="stable")
        self.seed, self.at = hashes[order], at[order]
        self.item = words.doc[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.seed & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    def alignments(self, words: Words) -> np.ndarray:
        """Distinct (document, item, word of the document under the item's first)."""
        rows = []
        for mask in self.masks:
            at, hashes = seeds(words, mask)
            near = self.sieve[(hashes & np.uint64(SIEVE - 1)).astype(np.int64)]
            at, hashes = at[near], hashes[near]
            low = np.searchsorted(self.seed, hashes, "left")
            count = np.searchsorted(self.seed, hashes, "right") - low
            if not count.sum():
                continue
            which = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            doc_at = np.repeat(at, count)
            shift = doc_at - (self.at[which] - self.first[self.item[which]])
            rows.append(np.stack([words.doc[doc_at], self.item[which], shift], axis=1))
        return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)

    def stretch(self, words: Words, doc: int, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """What matches on one alignment: first word in the document and in the
        item, words, matched words; None if it isn't enough. That is the best local
        stretch, or, if this is too little, all from the first to the last equal word,
        where these are four fifths of the whole item."""
        a, b = self.first[item], self.first[item + 1]
        begin = max(shift, words.first[doc])
        end = min(shift + b - a, words.first[doc + 1])
        same = words.hash[begin:end] == self.hash[a + begin - shift : a + end - shift]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH_COST))])
        lowest = np.minimum.accumulate(total)
        last = int(np.argmax(total - lowest))
        first = int(np.argmax(total[: last + 1] == lowest[last]))
        matched = int(same[first:last].sum())
        if matched < min(ENOUGH_WORDS, math.ceil(SIMILARITY * (b - a))):
            matched = int(same.sum())
            if matched < math.ceil(SIMILARITY * (b - a)):
                return None
            equal = np.flatnonzero(same)
            first, last = int(equal[0]), int(equal[-1]) + 1
        return int(begin + first - words.first[doc]), int(begin + first - shift), last - first, matched


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, doc_word and
    item_word (first word of the best stretch, from 0), n_words, n_matched.

    Items are dealt to blocks of about ``block_words`` words; each block visits
    every document in one pass, so what a task holds does not grow with the
    benchmark. Words are lower-cased runs of letters and digits. Items of fewer
    than ``LEAST_WORDS`` words, and null or empty texts, match nothing. A
    null doc_id or item_id is kept as null; rows that repeat both ids are merged,
    the stretch with most matches first, then the earliest. Texts of any length are
    read whole; empty tables give no row; only the four named columns are read, so no
    other clashes.
    """
    size = benchmark.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("words")).first()["words"] or 0
    blocks = max(1, -(-size // block_words))
    dealt = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    found = None
    for number in range(blocks):
        own = dealt.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        block = Block([r["item_id"] for r in own], [r["text"] for r in own])
        hits = _scan(docs, block)
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("n_matched", (-F.col("doc_word")).alias("a"), (-F.col("item_word")).alias("b"), (-F.col("n_words")).alias("c")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select(
        "doc_id", "item_id", (-F.col("x.a")).alias("doc_word"), (-F.col("x.b")).alias("item_word"),
        (-F.col("x.c")).alias("n_words"), F.col("x.n_matched").alias("n_matched"),
    )


def _scan(docs: DataFrame, block: Block) -> DataFrame:
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            words, rows = prepared(texts), []
            keys = None
            for doc, item, shift in block.alignments(words).tolist():
                found = block.stretch(words, doc, item, shift)
                if found:
                    keys = keys or part.column(0).to_pylist()
                    rows.append((keys[doc], block.ids[item], *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def remove_overlapping(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without overlap with any item; all columns stay, whatever their names.

    Rows are told apart by a digest of their text, so equal texts go together and a
    null or repeated doc_id changes nothing; a null or empty text stays.
    """
    (key,) = fresh(docs.columns, "_text_hash")
    hit = overlaps(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(hit, key, "left_anti").select(*docs.columns)
