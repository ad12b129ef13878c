"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text: its words, pairs of neighbours, and skip-grams (pairs with
one or two words between), hashed to ``BUCKETS`` places; a feature counts once.
Learning is follow-the-regularised-leader with a learning rate per coordinate
and an L1 term that keeps most weights at exactly zero. The training rows are
dealt to shards of a bounded mean size; each shard is learned on its own and the
weights are averaged. Only non-zero weights are sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.hashing import Words, byte_table, mix
from weftspan.llm.language import bounded

BUCKETS = 1 << 22
SKIPS = (1, 2, 3)
EPOCHS = 5
TRAINING_DOCUMENTS, SHARD_DOCUMENTS = 16_000, 8_000
WHITE = b" \t\n\x0b\x0c\r"
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of every feature occurrence of several texts."""
    words = Words([t.decode().lower().encode() for t in texts], byte_table("plain"))
    h, doc = words.hash, words.doc
    docs, hashes = [doc], [mix(h + np.uint64(1))]
    for gap in SKIPS:
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:])
            docs.append(doc[:-gap][same])
            hashes.append(pair[same])
    buckets = np.concatenate(hashes) & np.uint64(BUCKETS - 1)
    return np.concatenate(docs), buckets.astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features, with one rate per coordinate."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + error * error


@dataclass
class Model:
    """Sorted buckets and their weights; ``bias`` is the constant's weight."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.buckets):
            doc, bucket = features(texts)
            known = self._known()[bucket]
            doc, bucket = doc[known], bucket[known]
            pairs = np.unique(doc * BUCKETS + bucket)
            at = np.searchsorted(self.buckets, pairs % BUCKETS)
            np.add.at(total, pairs // BUCKETS, self.weights[at])
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))

    def _known(self) -> np.ndarray:
        if getattr(self, "_mask", None) is None:
            self._mask = np.zeros(BUCKETS, bool)
            self._mask[self.buckets] = True
        return self._mask

    def __getstate__(self):
        return (self.buckets, self.weights, self.bias)

    def __setstate__(self, state):
        self.buckets, self.weights, self.bias = state


def learn(labelled: DataFrame, bound: int = TRAINING_DOCUMENTS, shard_documents: int = SHARD_DOCUMENTS, epochs: int = EPOCHS) -> Model:
    """Weights from (doc_id, text, label), with label 0 or 1 (others: ignored).

    At most about ``bound`` rows are used, chosen by doc_id. A shard holds
    ``shard_documents`` rows on average and goes through them in a fixed
    order, ``epochs`` times. At most ``BUCKETS`` pairs (bucket, weight) reach the
    driver. Without rows, or with one label only, the model is the constant.
    """
    usable = labelled.filter(F.col("label").isin(0, 1)).select(
        F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")
    )
    rows = bounded(usable, F.col("doc_id"), bound)
    shards = max(1, -(-rows.count() // shard_documents))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort([group["doc_id"].to_numpy(), np.fromiter((hash_of(i) for i in group["doc_id"]), np.uint64, len(group))])
        labels = group["label"].to_numpy()[order]
        texts = [(t or "").encode() for t in group["text"].to_numpy()[order]]
        ftrl, kept = Ftrl(BUCKETS + 1), []
        for begin in range(0, len(texts), 64):
            doc, bucket = features(texts[begin : begin + 64])
            pairs = np.unique(doc * BUCKETS + bucket)
            cut = np.searchsorted(pairs, np.arange(len(texts[begin : begin + 64]) + 1) * BUCKETS)
            kept += [np.append((pairs[a:b] % BUCKETS), BUCKETS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for _ in range(epochs):
            for at, label in zip(kept, labels, strict=True):
                ftrl.learn(at, float(label))
        found = ftrl.weights(slice(None))
        at = np.flatnonzero(found)
        return pd.DataFrame({"bucket": at, "weight": found[at]})

    parts = dealt.groupBy("_shard").applyInPandas(run, "bucket long, weight double")
    got = parts.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).orderBy("bucket").toPandas()
    bias = got.loc[got["bucket"] == BUCKETS, "weight"]
    got = got[got["bucket"] < BUCKETS]
    return Model(got["bucket"].to_numpy(np.int64), got["weight"].to_numpy(float), float(bias.iloc[0]) if len(bias) else 0.0)


def hash_of(key: int) -> int:
    return int(mix(np.array([key], np.int64).view(np.uint64))[0])


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``least``; columns as they are,
    whatever their names.

    A null text, or one of white space alone, has nothing to reject and stays. Texts
    are scored whole at any length, equal rows alike; a score of just ``least`` goes. An
    empty table stays empty. Arrow batches are cut and scored as they come, and kept
    rows go on as slices of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            keep = (model.scores(texts) < least) | np.fromiter((not t.strip(WHITE) for t in texts), bool, len(texts))
            yield part if keep.all() else part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``score`` of each row. A null or empty text has the constant's
    score; a text of any length is read whole; rows that repeat, or tie, each get a row of
    equal score, and an empty table gives none. Of the columns only ``keys`` and ``text``
    are read; a key may have any name but ``score``."""
    rows = docs.select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(model.scores(texts), pa.float64())], names=[*keys, "score"]
            )

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double")
