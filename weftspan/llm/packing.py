"""Packing of token sequences: first-fit decreasing in randomised groups.

Documents are cut at multiples of the capacity; full pieces fill a sequence
alone. All pieces are dealt at random (by a digest) to groups of a bounded mean
size, and each group is packed on its own: pieces in falling length, each into
the first open sequence with room. A tournament tree over the sequences' room
finds that sequence in logarithmic time. Groups never see each other, so the
work spreads over the cluster, and a group is large enough that its last,
partly filled sequences hardly count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.tokens import END_ID, default_tokenizer, encoder_of, id_type, widened

CAPACITY = 4096
#: Mean size of a group, by whichever is reached first.
GROUP_DOCUMENTS, GROUP_BYTES = 8_000, 16 << 20


class Tournament:
    """Room of bins in a complete binary tree; each inner node holds the larger
    room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """First bin with room for ``size``, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = left = had - size
        at = node
        while at > 1:
            other = room[at ^ 1]
            at >>= 1
            best = left if left > other else other
            if room[at] == best:
                break
            room[at] = left = best
        return node - self.leaves, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset in that bin of each item; sizes must not rise."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = [], []
    for size in sizes:
        b, had = tree.place(size)
        bins.append(b)
        offsets.append(capacity - had)
    return bins, offsets


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids as bytes) of each text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        width = encoder.type.itemsize
        for part, texts in pieces(batches, "text"):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = encoder.encode(text, end_id)
                n = len(ids) // width
                for s in range(0, n, capacity):
                    rows.append((key, s, min(capacity, n - s), n, ids[s * width : (s + capacity) * width]))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = "doc_id long, start long, length long, doc_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS, group_bytes: int = GROUP_BYTES, seed: int = 0, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` for (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit integers as bytes. A null or empty
    text has the end id only; a null doc_id is kept; rows that repeat a
    doc_id are packed each on its own; an empty table gives no pieces. Equal
    lengths are taken in (doc_id, start) order, and pieces are dealt to groups by these
    and their place in the input, so a run over the same files repeats exactly. A text of any
    length is encoded whole and cut into pieces. Only doc_id and text are read, so no
    other column clashes.
    """
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("held")).first()
    kind_of_ids = id_type(tokenizer or default_tokenizer())
    groups = max(1, -(-total["rows"] // group_documents), -(-(total["held"] or 0) // group_bytes))
    # The row's own number spreads rows that share a doc_id, or are equal altogether.
    digest = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("start"), F.monotonically_increasing_id())
    dealt = cut(docs, capacity, tokenizer, end_id).withColumn("_group", F.pmod(digest, F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), capacity)
        base = int(group["_group"].iloc[0])
        return group.drop(columns="_group").assign(
            ids=[widened(i, kind_of_ids) for i in group["ids"]], sequence_id=np.asarray(bins, np.int64) * groups + base, offset=np.asarray(offsets, np.int64)
        )

    kind = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(run, kind)
