"""Arrow batches cut into pieces of bounded size, and Python lists from them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

PIECE_BYTES = 1 << 18
#: Rows that are handed to Python at once where whole texts are read.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """For jobs that run within: at most ``rows`` rows in an Arrow batch, which Spark and
    the Python worker both hold whole. The session's own value is set again after."""
    before, rows = int(spark.conf.get(BATCH_ROWS)), rows or TEXT_ROWS
    spark.conf.set(BATCH_ROWS, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of each batch with the UTF-8 bytes of ``column`` (null: empty).

    A slice holds at most ``limit`` bytes of text, or one text that is longer.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_binary())
        begin, held, found = 0, 0, []
        for row in range(batch.num_rows):
            data = texts[row].as_py() or b""
            if found and held + len(data) > limit:
                yield batch.slice(begin, row - begin), found
                begin, held, found = row, 0, []
            found.append(data)
            held += len(data)
        if found:
            yield batch.slice(begin, batch.num_rows - begin), found


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of a table clashes with it."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
