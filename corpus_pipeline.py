"""A training corpus from ``documents``: quality, near duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import mixing, near_dup, quality_knn, token_orc, winnowing
from pitchgrid.llm.common import load, words_of
from pitchgrid.llm.queries import tokenizer_path
from pitchgrid.shared import new_folder

#: Documents below this score are rejected.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes do not reject."""
    model = quality_knn.fit(docs, load(spark, sf_dir, "labels"))
    return quality_knn.score_documents(docs, model, "pipeline_quality").filter(F.col("pipeline_quality") >= LEAST_QUALITY).drop("pipeline_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make less than a twentieth."""
    return winnowing.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repetitions of documents that bring the sources to their target weights."""
    rows = docs.select("doc_id", "source", words_of(F.col("text")).alias("n_words"), F.struct("*").alias("document"))
    return mixing.repeated(mixing.mix_sources(rows, size=F.col("n_words")), ["document"]).select("document.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ORC; what is read back: a row a repetition with its place, length and checksum."""
    path = new_folder(spark, "corpus-tokens")
    token_orc.write_tokens(docs, path, tokenizer_path(), end_id=2)
    return token_orc.token_digest(token_orc.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token-id output", token_files),
]

#: The classifier, the similarity join and the tokenizer are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
