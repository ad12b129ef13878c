"""A corpus from raw documents to packed token sequences.

Each stage reads what the one before kept, from Parquet, and returns the documents it
keeps in the columns of ``documents``; the last returns pieces of sequences. In every
stage: none drops a row for having a null; texts of any length are read whole; rows
that repeat, or tie, are treated alike unless the stage says otherwise; an empty table
runs through to an empty result; further columns, whatever their names, pass through
the first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from weftspan.llm.queries import table, toxicity_model
from weftspan.plans.storage import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels outside the held-out
    fold, scores below a half. A null or blank text stays; a score of just a half goes;
    equal texts go together."""
    return toxicity.without_toxic(docs, toxicity_model(spark, docs, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that an earlier near-equal line makes
    superfluous; n_chars is counted anew. A null text stays null, and a text may become
    empty. Of equal lines the first by doc_id (null before all), text digest and place
    stays; rows that repeat a doc_id and its text lose the same lines."""
    return line_dedup.dedup_lines(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id (null before all) of each group of near copies.
    Texts without words, null and empty ones among them, are in no group and stay; of rows
    that repeat a doc_id and its text one stays."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, judged by their text alone: a
    null or repeated doc_id changes nothing. Null and empty texts stay."""
    return decontaminate.remove_overlapping(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where its ids lie in the document and in a sequence. A null or
    empty text has its end id alone; long texts are cut; rows that repeat are packed each."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_class),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Model fits, MinHash and a tokenizer's merges have no SQL; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
