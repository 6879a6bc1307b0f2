"""Cleaning a corpus, stage by stage: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes the documents (doc_id, text, lang, and any other columns, whatever their names) that the one
before has written, and returns documents of the same columns; the last returns the packed pieces. Repeated
rows, null keys, null and empty texts and empty tables go through: a text without words is rejected by the
quality rules. A text of any length is handled in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperslip.llm import overlap, packing, quality, run_length_index, scratch, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language."""
    scratch.small_batches(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    judged = quality.judge(quality.measure(rows, key="row"))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles: the one of the smallest key, of equal keys the first.

    Candidates are the links of SimHash fingerprints; every one is checked by the whole shingle sets. At a
    similarity of 0.8 fingerprints lie 5 to 17 bits apart, so what they leave unlinked is searched exactly.
    """
    scratch.small_batches(spark)
    numbered = scratch.written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    rows = numbered.select(F.struct("row.doc_id", "at").alias("key"), "row.text")

    def candidates(texts: DataFrame) -> DataFrame:
        return simhash.linked_rows(simhash.fingerprints(texts, key="class", shingle=5), key="class")

    stay = overlap.components(rows, key="key", size=5, least=(4, 5), candidates=candidates).where("key = component").select("key.at")
    return numbered.join(stay, "at", "left_semi").select("row.*")


def _with_others(docs: DataFrame) -> DataFrame:
    """(doc_id, text, others): the columns that a stage leaves alone in one, so that their names clash with nothing."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))).alias("others"))


def _restored(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, from (doc_id, text, others); n_chars, if there is one, counts the new text."""
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return changed.select(*(c if c in ("doc_id", "text") else n_chars.get(c, F.col("others")[c]).alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier document, or the same one before, holds; what is blank then goes."""
    scratch.small_batches(spark)
    cut = run_length_index.repeated_passages(_with_others(docs), carry=("others",), whole_characters=True)
    return _restored(docs, cut.select("doc_id", F.col("kept").cast("string").alias("text"), "others").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    scratch.small_batches(spark)
    ratios = secrets.train(secrets.labelled_samples(docs))
    return _restored(docs, secrets.redact(secrets.scan(_with_others(docs), ratios)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset."""
    scratch.small_batches(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: No stage of this pipeline but the base rules can be written in SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = scratch.made()
        out = stage(spark, docs, sf_dir)
        path = scratch.kept_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        scratch.drop(spark, since)  # what the stage has written for itself
    return docs
