"""Scoring of texts by a causal self-attention model over subword ids.

What is predicted are the ids of a text's pieces, each with a mark if it begins a
word, and one end: together they give back the words. Counts of words and of pieces
come from all training texts. The model (``attention.py``) is trained on every window
of every training text: each shard of texts is gone through as it is read, then the
parameters are averaged, and the next round starts from there with other windows. All
texts are then cut into overlapping windows in which every symbol is scored once.

The base score needs the count of every word of every text. Words that make up at
least one in ``COMMON`` of all words go to the tasks as one bounded table; the others
are met in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm import attention
from weftspan.llm.batches import pieces
from weftspan.llm.hashing import Words, byte_table, mix, signed
from weftspan.llm.tokens import END_ID, default_tokenizer, encoder_of, id_type
from weftspan.plans.storage import materialise

COMMON = 1_000_000
COUNT_BYTES = 1 << 20
KEPT_WORDS = 600_000
#: Each round takes its part of the windows; of a corpus of fewer than that, all of them.
ROUNDS, LEAST_WINDOWS, RATE = 3, 48_000, 0.012
#: A small corpus is gone through again in each round, up to so often.
MOST_PASSES = 4
#: Windows of a shard (at least), held at once and put in a random order, of a step.
SHARD_WINDOWS, HELD_WINDOWS, BATCH, LARGE_BATCH = 64_000, 16_384, 96, 256
FAN_IN, CHUNK = 64, 8_192
SCORED_WINDOWS = 512
#: Symbols whose codes are made at once where texts need not be told apart.
GROUP_SYMBOLS = 1 << 18


def words_of(texts: list[bytes]) -> Words:
    """Words of texts with A-Z lowered, told apart by 64-bit hashes."""
    return Words([t.lower() for t in texts], byte_table("spaced"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, trained, held): occurrences of each word in the rows of ``docs``
    (``_text``, ``_train``) to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "_text", COUNT_BYTES):
            words = words_of(texts)
            train = np.asarray(part.column(0).to_pylist(), bool)[words.doc]
            kinds, at = np.unique(words.hash, return_inverse=True)
            held = np.bincount(at, minlength=len(kinds))
            trained = np.bincount(at[train], minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(signed(kinds)), pa.array(trained), pa.array(held)], names=["hash", "trained", "held"])

    parts = docs.select("_train", "_text").mapInArrow(run, "hash long, trained long, held long")
    return materialise(parts.groupBy("hash").agg(F.sum("trained").alias("trained"), F.sum("held").alias("held")), "words")


@dataclass
class Base:
    """Counts behind the base score: N tokens and V distinct ones with their ends, and
    the common words' hashes (sorted) and counts."""

    tokens: int
    kinds: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray

    def log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def base_counts(docs: DataFrame, words: DataFrame) -> tuple[Base, DataFrame]:
    """Base, and the words that are not common as (hash, trained)."""
    ends = docs.filter("_train").count()
    size = words.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v"), F.sum("held").alias("all")).first()
    common = F.col("held") * COMMON > (size["all"] or 0)
    top = words.filter(common).select("hash", "trained").orderBy("hash").toPandas()
    base = Base((size["n"] or 0) + ends, size["v"] + (ends > 0), ends, top["hash"].to_numpy(np.int64), top["trained"].to_numpy(np.int64))
    return base, words.filter(~common).select("hash", "trained")


ENCODED = (
    "n_tokens long, known long, base double, rare array<long>, rare_n array<int>, ids binary, starts binary"
)


def encode(docs: DataFrame, base: Base, path: str) -> DataFrame:
    """One row per row of ``docs``: ids and word starts (packed bits) of its pieces, its
    number of tokens, the sum over its common words and end, and its other words."""
    rows = docs.select("_key", "_train", "_held_out", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        logs, end = base.log(base.counts), float(base.log(np.array([base.ends]))[0])
        for part, texts in pieces(batches, "_text", COUNT_BYTES):
            words = words_of(texts)
            kinds, kind = np.unique(words.hash, return_inverse=True)
            doc, own, times = _counted(words.doc, kind, len(kinds))
            hashes = signed(kinds)[own]
            at = np.minimum(np.searchsorted(base.hashes, hashes), max(0, len(base.hashes) - 1))
            common = base.hashes[at] == hashes if len(base.hashes) else np.zeros(len(hashes), bool)
            total = np.bincount(doc[common], times[common] * logs[at[common]], len(texts)) + end
            known = np.bincount(doc[common], times[common] * (base.counts[at[common]] > 0), len(texts)).astype(np.int64) + (base.ends > 0)
            cuts = pa.array(np.searchsorted(doc[~common], np.arange(len(texts) + 1)).astype(np.int32))
            rare = pa.ListArray.from_arrays(cuts, pa.array(hashes[~common]))
            rare_n = pa.ListArray.from_arrays(cuts, pa.array(times[~common].astype(np.int32)))
            encoded = _all_pieces(encoder, texts, words, kind, len(kinds))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(total), rare, rare_n,
                 pa.array([e[0] for e in encoded], pa.binary()), pa.array([e[1] for e in encoded], pa.binary())],
                names=[*part.schema.names[:-1], *[c.split()[0] for c in ENCODED.split(", ")]],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_key {kind}, _train boolean, _held_out boolean, {ENCODED}")
    return materialise(out.withColumn("_row", F.monotonically_increasing_id()), "encoded")


def _counted(doc: np.ndarray, kind: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, kind (of ``many``) and number of each distinct word of each text."""
    met, times = np.unique(doc * max(1, many) + kind, return_counts=True)
    return met // max(1, many), met % max(1, many), times


def _all_pieces(encoder, texts: list[bytes], words: Words, kind: np.ndarray, many: int) -> list[tuple[bytes, bytes]]:
    """``_pieces`` of each text, by one look at each of ``many`` kinds of words. A text
    with a special token's opening keeps its case, and is encoded alone."""
    if len(encoder) > KEPT_WORDS:
        encoder.clear()
    at = np.empty(many, np.int64)
    at[kind] = np.arange(len(kind))
    found = [encoder[words.data[a:b]] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
    table = np.frombuffer(b"".join(found), encoder.type)
    sizes = np.fromiter(map(len, found), np.int64, many) // encoder.type.itemsize
    held = sizes[kind]
    ends = np.concatenate([[0], np.cumsum(held)])
    ids = table[np.repeat((np.cumsum(sizes) - sizes)[kind] - ends[:-1], held) + np.arange(ends[-1])]
    starts = np.zeros(len(ids), bool)
    starts[ends[:-1][held > 0]] = True
    cuts = ends[words.first].tolist()
    end = np.array([END_ID], encoder.type).tobytes()
    return [
        _pieces(encoder, t) if b"<|" in t else (ids[a:b].tobytes() + end, np.packbits(np.append(starts[a:b], True)).tobytes())
        for t, a, b in zip(texts, cuts, cuts[1:], strict=False)
    ]


def _pieces(encoder, text: bytes) -> tuple[bytes, bytes]:
    """Ids of a text and its end, and the packed bits of those that begin a word."""
    if len(encoder) > KEPT_WORDS:
        encoder.clear()
    found = [encoder[w] for w in (text if b"<|" in text else text.lower()).split()]
    width = encoder.type.itemsize
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // width
    starts = np.zeros(int(lengths.sum()) + 1, bool)
    starts[np.cumsum(lengths) - lengths] = True
    starts[-1] = True
    return b"".join(found) + np.array([END_ID], encoder.type).tobytes(), np.packbits(starts).tobytes()


def codes_of(ids: bytes, starts: bytes, kind: np.dtype) -> np.ndarray:
    """Symbols of a text as codes: twice the id, and one more at a word's begin."""
    own = np.frombuffer(ids, kind).astype(np.int64)
    return own * 2 + np.unpackbits(np.frombuffer(starts, np.uint8), count=len(own))


def codes_in_groups(ids: pa.Array, starts: pa.Array, kind: np.dtype) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows with the codes of their texts, one text after the other, and the
    sizes of these; up to ``GROUP_SYMBOLS`` symbols, or one text that has more."""
    many = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    ends, begin = np.cumsum(many), 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - many[begin] + GROUP_SYMBOLS, side="right")))
        rows, sizes = slice(begin, end), many[begin:end]
        own = np.frombuffer(b"".join(ids[rows].to_pylist()), kind).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(starts[rows].to_pylist()), np.uint8))
        held = -(-sizes // 8) * 8  # bits of each text, in whole bytes
        yield rows, own * 2 + bits[_places(np.cumsum(held) - held, sizes)], sizes
        begin = end


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of these ``sizes`` that begin at ``begins``."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def symbol_counts(encoded: DataFrame, path: str) -> attention.Symbols:
    """Counts over all rows to learn from. One row per symbol reaches the driver, at
    most two for each id of the vocabulary."""
    kind, possible = id_type(path), 2 * _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(possible, np.int64)
        for batch in batches:
            for _, codes, _ in codes_in_groups(batch.column(0), batch.column(1), kind):
                total += np.bincount(codes, minlength=possible)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    got = encoded.filter("_train").select("ids", "starts").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return attention.symbols(got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64), possible)


def _vocabulary(path: str) -> int:
    from weftspan.llm.tokens import _library

    return _library(path).get_vocab_size(with_added_tokens=True)


def windows_to_learn(batches: Iterator[pa.RecordBatch], s: attention.Symbols, kind: np.dtype, turn: int, parts: int) -> Iterator[np.ndarray]:
    """Windows of rows (_row, ids, starts) that round ``turn`` learns from: of ``parts``
    parts, told apart by a hash of row and place, that of the round. At most
    ``HELD_WINDOWS`` are given at once, whatever the length of a text."""
    first = int(s.indices(np.array([2 * END_ID + 1]))[0])
    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows, codes, sizes in codes_in_groups(batch.column(1), batch.column(2), kind):
            row, begins, of, own = attention.laid_out(s.indices(codes), sizes, s, first)
            if parts > 1:
                seeds = mix(numbers[rows].view(np.uint64) + np.uint64(1))
                begins = begins[mix(seeds[of] + own.astype(np.uint64)) % np.uint64(parts) == turn]
            cut = np.lib.stride_tricks.sliding_window_view(row, attention.WINDOW)
            while len(begins):
                room = HELD_WINDOWS - count
                held.append(cut[begins[:room]])
                count += len(held[-1])
                begins = begins[room:]
                if count == HELD_WINDOWS:
                    yield np.concatenate(held)
                    held, count = [], 0
    if held:
        yield np.concatenate(held)


def train(encoded: DataFrame, s: attention.Symbols, path: str) -> attention.Parameters:
    """Parameters after ``ROUNDS`` rounds of training in shards and averaging.

    Every window of every row to learn from is learned from: in one of the rounds, or in
    all where the corpus is small. A shard is what a task reads.
    """
    p = attention.start(s)
    learned = encoded.filter("_train").select("_row", "ids", "starts")
    blocks = F.ceil(F.octet_length("ids") / (id_type(path).itemsize * attention.SCORED))
    many = learned.agg(F.sum(blocks).alias("n")).first()["n"] or 0
    if not many:
        return p
    most = max(1, many // SHARD_WINDOWS)
    for turn in range(ROUNDS):
        parts = learned.coalesce(most).mapInArrow(_trainer(p, s, id_type(path), turn, many, most), "shard long, chunk int, n double, total binary")
        shards = most
        while shards > 1:
            parts = parts.withColumn("shard", F.expr(f"shard div {FAN_IN}")).groupBy("shard", "chunk").applyInPandas(_sum_parts, "shard long, chunk int, n double, total binary")
            shards = -(-shards // FAN_IN)
        got = parts.toPandas().sort_values("chunk")
        flat = np.concatenate([np.frombuffer(t, np.float64) / n for t, n in zip(got["total"], got["n"], strict=True)])
        p = attention.unpack(flat, len(s.counts), len(s.bounds) - 1)
    return p


def _trainer(p: attention.Parameters, s: attention.Symbols, kind: np.dtype, turn: int, many: int, shards: int):
    parts = ROUNDS if many > ROUNDS * LEAST_WINDOWS else 1
    passes = max(1, min(MOST_PASSES, LEAST_WINDOWS // many))
    batch = LARGE_BATCH if parts > 1 else BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.one_thread()
        fit = attention.Fit(p, s, RATE / (turn + 1), many * passes / (shards * parts * batch))
        rng, count = np.random.default_rng(1 + turn), 0
        for rows in windows_to_learn(batches, s, kind, turn, parts):
            count += len(rows)
            order = np.concatenate([rng.permutation(len(rows)) for _ in range(passes)])
            for begin in range(0, len(order), batch):
                fit.step(rows[order[begin : begin + batch]])
        if count:
            flat = attention.pack(fit.p).astype(np.float64) * count
            cut = [flat[b : b + CHUNK].tobytes() for b in range(0, len(flat), CHUNK)]
            shard = np.full(len(cut), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), float(count))), pa.array(cut, pa.binary())],
                names=["shard", "chunk", "n", "total"],
            )

    return run


def _sum_parts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Sum of up to ``FAN_IN`` parts."""
    group = group.sort_values("n", kind="stable")
    total = np.sum([np.frombuffer(t, np.float64) for t in group["total"]], axis=0)
    return pd.DataFrame({"shard": [key[0]], "chunk": [key[1]], "n": [group["n"].sum()], "total": [total.tobytes()]})


def _scored(encoded: DataFrame, p: attention.Parameters, s: attention.Symbols, path: str) -> DataFrame:
    """(_row, score): log10 probability of each row's symbols."""
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.one_thread()
        scorer = attention.Scorer(p, s)
        first = int(s.indices(np.array([2 * END_ID + 1]))[0])
        for batch in batches:
            found = [code_scores(scorer, codes, sizes, first) for _, codes, sizes in codes_in_groups(batch.column(1), batch.column(2), kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *found]))], names=["_row", "score"])

    return encoded.select("_row", "ids", "starts").mapInArrow(run, "_row long, score double")


def text_scores(scorer: attention.Scorer, texts: Iterator[np.ndarray], many: int, first: int) -> np.ndarray:
    """Log10 probability of each of ``many`` texts, given as codes."""
    held = list(texts)
    return code_scores(scorer, np.concatenate([np.zeros(0, np.int64), *held]), np.fromiter(map(len, held), np.int64, many), first)


def code_scores(scorer: attention.Scorer, codes: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """Log10 probability of texts of these ``sizes``, one after the other in ``codes``, in
    even batches of windows that may hold parts of several texts or a part of a long one."""
    if not len(sizes):
        return np.zeros(0)
    row, begins, of, _ = attention.laid_out(scorer.s.indices(codes), sizes, scorer.s, first)
    cut = np.lib.stride_tricks.sliding_window_view(row, attention.WINDOW)
    sums = [scorer.places(cut[begins[b : b + SCORED_WINDOWS]]).sum(1) for b in range(0, len(begins), SCORED_WINDOWS)]
    return np.bincount(of, np.concatenate(sums), len(sizes)) / np.log(10)


def score(docs: DataFrame, train_on: str, held_out: str, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``train_on`` and ``held_out`` are Boolean columns of ``docs``; nothing but the texts
    of rows with a true ``train_on`` (null: false) is learned from. A null text is an
    empty one: its end alone is a token. Texts of any length are read and scored whole,
    a window at a time. Each row is scored, so rows that repeat, or have no doc_id, get a
    row each, equal texts up to rounding the same score. Without training texts all
    symbols are equally likely, and the base score is 0. An empty table gives no row. No
    column is read but doc_id, text and the two named, so others cannot clash.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(
        F.col("doc_id").alias("_key"), F.coalesce(F.col(train_on), F.lit(False)).alias("_train"), F.col(held_out).alias("_held_out"), F.col("text").alias("_text")
    )
    base, rare = base_counts(rows, word_counts(rows))
    encoded = encode(rows, base, path)
    s = symbol_counts(encoded, path)
    scores = _scored(encoded, train(encoded, s, path), s, path)
    one = encoded.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("_row", F.col("r.rare").alias("hash"), F.col("r.rare_n").alias("n"))
    size = base.tokens + 0.5 * (base.kinds + 1)
    met = one.join(rare, "hash").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10((F.col("trained") + 0.5) / F.lit(size))).alias("_base"), F.sum(F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).alias("_known")
    )
    told = encoded.select("_row", "_key", "_held_out", "n_tokens", "known", "base")
    return told.join(scores, "_row").join(met, "_row", "left").select(
        F.col("_key").alias("doc_id"), F.col("_held_out").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(base.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )
