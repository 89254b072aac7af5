"""The corpus pipeline: quality, near-duplicates, contamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the
rows are written as Parquet and read again, and a stage's table goes once the next one is written.
Stages 1 to 4 return the columns of ``docs``; the last adds ``ids`` and ``round_trip``. Documents leave
by their id, in an anti-join with the ids that a stage rejects, so texts aren't shuffled while that set
is small.

Defined results: rows without an id stay; an id that occurs twice leaves with all its rows if any of
them is rejected; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm import decontaminate, jaccard_join, pii, piece_codec, quality_classifier
from facetmill.llm.common import discard, materialize, table

#: Up to so many rejected ids are sent to all executors; beyond, the anti-join shuffles.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    ids = materialize(rejected.select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from all labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).distinct()
    return _without(docs, quality_classifier.classify(docs, labels).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8, the one with
    the least id stays."""
    return _without(docs, jaccard_join.jaccard_components(docs, width=5, percent=80).where("component_id <> doc_id"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, also reworded, go."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of every text, and whether they decode to it."""
    return piece_codec.encode(docs, piece_codec.PieceModel.load(), check=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Trained models, latent search and token search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = materialize(out, f"stage-{i + 1}")
            discard(docs)
        docs = out
    return docs
