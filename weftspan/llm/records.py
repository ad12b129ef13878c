"""Token ids in length-delimited binary records with checksums, and an index.

A file is a run of frames. All integers are little-endian::

    length   8 bytes   bytes of the payload
    check    4 bytes   masked CRC-32 of the 8 length bytes
    payload            doc_id (8 bytes signed), ids, each of 2 or 4 bytes
    check    4 bytes   masked CRC-32 of the payload
    newline  1 byte

A CRC is masked by rotating it right by 15 bits and adding a constant, so that
the checksum of data that holds checksums stays useful. Files are cut from the
documents in ascending doc_id order; names sort in that order. Spark's text
sink writes them, so any store that Spark writes to will do and a lost executor's
files are never half there. The index is a table beside the files: one row per
record with its file, offset and length, for reads in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.tokens import END_ID, default_tokenizer, encoder_of, id_type, widened

#: Fixed values of the format.
MASK_SHIFT, MASK_ADD = 15, 0xA282EAD8
HEAD, TAIL, KEY = "<QI", "<I", "<q"
HEAD_SIZE, TAIL_SIZE, KEY_SIZE = 12, 4, 8
FILE_BYTES = 128 << 20
#: Stands for a null doc_id, which sorts first.
NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_SHIFT) | (crc << (32 - MASK_SHIFT))) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int, ids: bytes) -> bytes:
    """One frame without its newline."""
    payload = struct.pack(KEY, doc_id) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked(length)) + payload + struct.pack(TAIL, masked(payload))


def open_frame(data, at: int) -> tuple[int, bytes, int]:
    """doc_id, ids, and offset of the next frame; raises on a wrong checksum."""
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"length checksum differs at offset {at}")
    begin = at + HEAD_SIZE
    payload = bytes(data[begin : begin + length])
    if len(payload) != length or masked(payload) != struct.unpack_from(TAIL, data, begin + length)[0]:
        raise ValueError(f"payload checksum differs at offset {at}")
    return struct.unpack_from(KEY, payload)[0], payload[KEY_SIZE :], begin + length + TAIL_SIZE + 1


def write_records(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID
) -> None:
    """Write ``folder/records`` and ``folder/index`` for (doc_id, text).

    Texts are dealt by doc_id ranges before they are encoded; each task encodes
    its range in order and writes one file, of about ``FILE_BYTES`` of text at most. A
    null text has the end id only. A null doc_id sorts first. Rows that repeat a doc_id
    each get a record, ordered by a digest of the text; they may fill several files. An empty table gives an empty index. A text
    of any length is one record. Only doc_id and text are read, so no other column clashes.
    """
    path = tokenizer or default_tokenizer()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), "text", F.xxhash64("text").alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    held = docs.agg(F.sum(F.octet_length("text")).alias("held")).first()["held"] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    order = ["doc_id", "_digest", "_row"]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part, texts in pieces(batches, "text"):
            frames = [
                frame(k, encoder.encode(t, end_id))
                for k, t in zip(part.column(0).to_pylist(), texts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    framed = ranged.mapInArrow(run, "frame binary")
    # A cast to string keeps the bytes as they are, and the sink writes them so.
    framed.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/records", lineSep="\n")
    build_index(docs.sparkSession, folder, path)


def build_index(spark: SparkSession, folder: str, tokenizer: str | None = None) -> None:
    """Walk the frames' lengths and write one index row per record."""
    width = id_type(tokenizer or default_tokenizer()).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in _contents(batches):
            at, rows = 0, []
            while at < len(data):
                length, check = struct.unpack_from(HEAD, data, at)
                if masked(bytes(data[at : at + 8])) != check:
                    raise ValueError(f"length checksum differs in {name} at {at}")
                size = HEAD_SIZE + length + TAIL_SIZE + 1
                rows.append((name, at, size, struct.unpack_from(KEY, data, at + HEAD_SIZE)[0], (length - KEY_SIZE) // width))
                at += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "offset", "size", "doc_id", "n_tokens"])

    kind = "file string, offset long, size long, doc_id long, n_tokens long"
    _files(spark, folder).mapInArrow(run, kind).write.parquet(f"{folder}/index")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield name, memoryview(content.as_buffer())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select("path", "content")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``, the ids of all records before each.

    Sums are taken within each file; only one row per file is ordered as a whole.
    """
    index = spark.read.parquet(f"{folder}/index")
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("_held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("file", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return index.withColumn("_inner", inner).join(shift, "file").select(
        *index.columns, (F.col("_before") + F.col("_inner")).alias("start")
    )


def read_frames(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """(file, offset, doc_id, ids as bytes) of every record, files read in place.

    Both checksums of every frame are tested. Ids are given as
    little-endian unsigned 32-bit integers.
    """
    kind = id_type(tokenizer or default_tokenizer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in _contents(batches):
            at, held, rows = 0, 0, []
            while at < len(data):
                doc_id, ids, after = open_frame(data, at)
                rows.append((name, at, doc_id, widened(ids, kind)))
                at, held = after, held + len(ids)
                if held > 4 << 20 or at >= len(data):
                    yield _rows(rows)
                    held, rows = 0, []

    out = _files(spark, folder).mapInArrow(run, "file string, offset long, doc_id long, ids binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids as bytes) of the records that ``index``, any choice of
    rows of ``read_index``, names."""
    asked = (index if index is not None else read_index(spark, folder)).select("file", "offset", "start")
    return read_frames(spark, folder).join(asked, ["file", "offset"]).select("doc_id", "start", "ids")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "offset", "doc_id", "ids"])
