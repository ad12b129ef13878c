"""The registered queries of this package: each applies its operator to the
whole of its table and derives the columns that are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.llm import decontaminate, jaccard_join, language, lexical, line_dedup, merkle, nearest, packing, passages, records, scoring, site_style, toxicity
from weftspan.llm.merkle_sql import manifest_sql
from weftspan.plans.storage import scratch_path

FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def op1_site_style(spark: SparkSession, folder: str) -> DataFrame:
    pages = site_style.extract(table(spark, folder, "pages"), ["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece of a document: where it lies, and in which sequence."""
    packed = packing.pack(table(spark, folder, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op3_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as records and read back through the index."""
    out = scratch_path(spark, "records")
    records.write_records(table(spark, folder, "documents"), out)
    frames = records.read_frames(spark, out).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    # The digest is taken before rows meet the index, so that ids don't move.
    digests = frames.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    places = records.read_index(spark, out).select("file", "offset", "start")
    return digests.join(places, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.filter(fold() != 0))
    return language.predict(docs.withColumn("held_out", fold() == 0), profiles, ["doc_id", "held_out"])


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.Model:
    """Model of the labels outside the held-out fold. Rows whose doc_id has
    more than one label count with the larger."""
    labels = table(spark, folder, "labels").filter(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.learn(docs.select("doc_id", "text").join(labels, "doc_id"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, folder)
    scored = toxicity.score(docs.withColumn("held_out", fold() == 0), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = nearest.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class, set and number of links of every document."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = passages.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, and places of the lines removed, of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    report = line_dedup.line_report(docs)
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(line_dedup.NO_ID)).alias("_id"), F.xxhash64("text").alias("text_hash"))
    found = own.join(report.withColumnRenamed("doc_id", "_id"), ["_id", "text_hash"], "left")
    return found.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
    )


def op11_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Base score and model score of every document; one fold is not learned from."""
    held = F.coalesce(fold() == 1, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", held.alias("held"), (~held).alias("train"))
    return scoring.score(docs, "train", "held")


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, digest of the proof, and whether a row, tampered with where three
    divides the checksum of its doc_id, still folds to the root."""
    docs = table(spark, folder, "documents")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tampered = F.when(tampers, merkle.row_digest(text=merkle.lowered(F.col("text"))))
    leaves = docs.select("doc_id", "lang", merkle.row_digest().alias("leaf"), tampered.alias("tampered"))
    found = merkle.proofs(merkle.build(leaves, "lang", "doc_id", ["doc_id", "tampered"]))
    out = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_site_style, op2_packing, op3_token_records, op4_language, op5_decontamination, op6_toxicity, op7_nearest,
    op8_jaccard_join, op9_passages, op10_line_dedup, op11_scoring, op12_lexical, op13_merkle,
)}
SQL: dict[str, str] = {"op12_lexical": lexical.search_sql(), "op13_merkle": manifest_sql()}
