"""Follows a folder of review files and writes which text mentions which facet, with evidence.

A stream with a checkpoint: a run takes the files that came since the last one, until all are done, and
ends. A text that was met before, in this run or an earlier one, isn't read for facets again: its hash is
in the stream's state, so a run costs what is new, not what the table holds. A row names the text's
hash, which the review table has too, the facet, the number of sentences that mention it, and the
first of them. The table is partitioned by facet; files and checkpoint are committed together by the
file sink, so a run that was broken off goes on where it stopped, and one without new files adds none.

    spark-submit jobs/facet_mentions.py --reviews IN/documents.parquet --out OUT --checkpoint CHECKPOINT
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

log = logging.getLogger("jobs.facet_mentions")
CONFIG = Path(__file__).with_suffix(".json")
PROGRESS, STATE = "spark.sql.streaming.numRecentProgressUpdates", "spark.sql.streaming.stateStore.providerClass"
#: The state grows with the distinct texts; this store keeps it on disk, not in an executor's heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_config(spark: SparkSession, path: str | None = None) -> dict:
    """The configuration beside this file, with what the file at ``path`` (any of Spark's) changes."""
    own = json.loads(CONFIG.read_text())
    return own | (json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {})


def mentions(reviews: DataFrame, config: dict) -> DataFrame:
    """``review_md5``, ``n_mentions``, ``evidence`` and ``facet`` of each distinct text; works on a table and
    on a stream."""
    texts = reviews.where("text IS NOT NULL").select(P.content_hash(F.col("text")).alias("review_md5"), "text").dropDuplicates(["review_md5"])
    cut = texts.withColumn("sentences", P.sentences(F.col("text"), config["least_chars"])).drop("text")
    having = lambda pattern: F.filter("sentences", lambda s: F.rlike(s, F.lit(pattern)))
    each = [F.struct(F.lit(f).alias("facet"), having(p).alias("hits")) for f, p in sorted(config["facets"].items())]
    found = cut.select("review_md5", F.explode(F.filter(F.array(*each), lambda x: F.size(x["hits"]) > 0)).alias("m"))
    return found.select("review_md5", F.size("m.hits").alias("n_mentions"), F.col("m.hits")[0].alias("evidence"), "m.facet")


def _pattern(path: str) -> str:
    """A path that may be of one file, for a stream, which takes folders and patterns only."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, reviews: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes what is new in ``reviews`` and waits for the end; gives what it logs."""
    config = config or read_config(spark)
    own = {STATE: ROCKS, PROGRESS: str(1 << 20)}  # the progress of every batch counts
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(reviews))
        found = mentions(stream, config).observe("found", F.count(F.lit(1)).alias("rows"))
        writer = found.writeStream.format("parquet").partitionBy("facet").option("path", out).option("checkpointLocation", checkpoint)
        query = writer.option("compression", "zstd").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    metrics = [p["observedMetrics"].get("found") for p in progress]
    wrote = sum(m["rows"] for m in metrics if m)
    report = {"read": sum(p["numInputRows"] for p in progress), "wrote": wrote, "batches": len(progress)}
    log.info("read %s new rows of %s in %s batches, wrote %s mentions to %s", report["read"], reviews, report["batches"], wrote, out)
    return report


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name, what in (("--reviews", "Parquet files with a text column: a folder, pattern or file"), ("--out", "folder of the table"), ("--checkpoint", "folder of the stream's checkpoint")):
        args.add_argument(name, required=True, help=what)
    args.add_argument("--config", help="JSON that changes the configuration beside this file")
    a = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("facet_mentions").getOrCreate()
    try:
        run(spark, a.reviews, a.out, a.checkpoint, read_config(spark, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
