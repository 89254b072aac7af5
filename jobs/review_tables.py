"""Builds the review table that samples, extraction and evaluation start from.

Of reviews with equal texts the one of the least id stays, with the number of its copies and of the
sources that hold them. Each gets its length, its sentences, a stratum, and a split that follows the
text alone, so no text is in two splits whatever is added later. The table is partitioned by language
and split.

A rerun replaces the table by the same rows. With ``languages`` in the configuration, only these
languages' partitions are replaced.

    spark-submit jobs/review_tables.py --reviews IN/documents.parquet --labels IN/labels.parquet --out OUT
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from facetmill.functions import parsing as P  # noqa: E402
from facetmill.operators import gold, guards  # noqa: E402

log = logging.getLogger("jobs.review_tables")
CONFIG = Path(__file__).with_suffix(".json")


def read_config(spark: SparkSession, path: str | None = None) -> dict:
    """The configuration beside this file, with what the file at ``path`` (any of Spark's) changes."""
    own = json.loads(CONFIG.read_text())
    return own | (json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {})


def build(reviews: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """One row for each distinct text that isn't blank."""
    rows = reviews.select("doc_id", "text", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"), "source")
    rows = rows.where(F.length(P.strip(F.col("text"))) > 0).withColumn("review_md5", P.content_hash(F.col("text")))
    # Copies are counted on hashes, partly before the shuffle; only the texts that stay move, once.
    groups = rows.groupBy("review_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.count_distinct("source").alias("n_sources"))
    kept = rows.join(groups, ["doc_id", "review_md5"])
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stars = F.when(F.col("toxic") == 1, "1").otherwise("5")
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{config['seed']}:"), "review_md5").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    split = F.lit("train")
    for name, below in sorted(_bounds(config["percent"]).items(), key=lambda x: -x[1]):
        split = F.when(share < below, name).otherwise(split)
    return kept.join(marks, "doc_id", "left").select(
        "doc_id", "review_md5", "source", "n_copies", "n_sources",
        P.text_length(F.col("text")).alias("n_chars"), F.size(P.sentences(F.col("text"))).alias("n_sentences"),
        gold.stratum(F.col("text"), F.col("lang"), stars, home=config["home"], trivial=config["trivial_under"], long=config["long_over"]).alias("stratum"),
        "text", "lang", split.alias("split"),
    )


def _bounds(percent: dict[str, int]) -> dict[str, int]:
    out, total = {}, 0
    for name in sorted(percent):
        total += percent[name]
        out[name] = total
    return out


def run(spark: SparkSession, reviews: str, labels: str, out: str, config: dict | None = None) -> dict:
    """Reads and writes Parquet; gives what it logs."""
    config = config or read_config(spark)
    rows = guards.require_unique(spark.read.parquet(reviews), "doc_id")
    table = build(rows, spark.read.parquet(labels), config)
    only = config.get("languages")
    if only:
        table = table.where(F.col("lang").isin(*only))
    # Large partitions are cut into several files and small ones put together at run time.
    write = table.hint("rebalance", "lang", "split").write.mode("overwrite").partitionBy("lang", "split")
    write.option("partitionOverwriteMode", "dynamic" if only else "static").option("compression", "zstd").parquet(out)
    done = spark.read.parquet(out)
    counts = {f"{r['lang']}/{r['split']}": r["n"] for r in done.groupBy("lang", "split").agg(F.count("*").alias("n")).collect()}
    report = {"read": rows.count(), "wrote": sum(counts.values()), "partitions": counts}
    log.info("read %s rows of %s, %s holds %s rows in %s partitions: %s", report["read"], reviews, out, report["wrote"], len(counts), counts)
    return report


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name, what in (("--reviews", "Parquet of doc_id, text, lang, source"), ("--labels", "Parquet of doc_id, toxic"), ("--out", "folder of the table")):
        args.add_argument(name, required=True, help=what)
    args.add_argument("--config", help="JSON that changes the configuration beside this file")
    a = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("review_tables").getOrCreate()
    try:
        run(spark, a.reviews, a.labels, a.out, read_config(spark, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
