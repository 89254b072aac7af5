"""Resumable extraction as a stream: new review files in, log records out.

Each micro-batch drops reviews that are done, asks the model once for each new text, serves equal
texts from the log, and appends the successes. Failures go to a retry table and join every later batch
until they succeed, as a committed offset is never read again; ``retry_failed`` asks for them without
new files. The log itself is the state: nothing is kept in memory between batches, and a restart
continues from the checkpoint. Only the log's keys and hashes are read to tell what is done, and the
answers of texts that the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetmill.functions import parsing as P
from facetmill.operators import extraction as E
from facetmill.operators.guards import sent

ROW = "asin string, review_no int, text string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _waiting(spark: SparkSession, folder: str, log: DataFrame) -> DataFrame:
    """Reviews that failed and aren't done yet."""
    failed = _read(spark, f"{folder}/retry", ROW + ", batch long").drop("batch").dropDuplicates(["asin", "review_no"])
    return failed.join(log.select("asin", "review_no").distinct(), ["asin", "review_no"], "left_anti")


def _known(log: DataFrame, todo: DataFrame) -> DataFrame:
    """The part of the log that a batch (its reviews' keys and hashes) needs: its reviews and its texts."""
    keys = todo.select("asin", "review_no")
    texts = todo.select("review_md5").distinct()
    done = log.join(sent(keys, E.SENT), ["asin", "review_no"], "left_semi")
    same = log.join(sent(texts, E.SENT), "review_md5", "left_semi").select(*log.columns)
    return done.unionByName(same)


def process_batch(rows: DataFrame, batch_id: int, folder: str, chat: Callable[[str], str], workers: int | None = None, in_flight: int = 1) -> None:
    """One micro-batch. Done over, it gives the same log: its files carry the batch's number, and a
    batch that was committed finds its reviews done."""
    spark = rows.sparkSession
    log = _read(spark, f"{folder}/log", E.RECORD + ", batch long")
    log = log.where(log["batch"] != batch_id)
    rows = rows.select("asin", "review_no", "text").unionByName(_waiting(spark, folder, log))
    # One text of each review: keys and hashes say which, and are all that is shuffled to tell.
    hashed = rows.select("asin", "review_no", P.content_hash(F.col("text")).alias("review_md5"))
    todo = hashed.groupBy("asin", "review_no").agg(F.min("review_md5").alias("review_md5")).persist()
    known = _known(log, todo)
    planned = E.classify(todo, known).persist()
    _, judged = E.extract(rows, known, chat, workers, in_flight, planned)
    judged.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={batch_id}")
    planned.unpersist()
    todo.unpersist()
    judged = spark.read.parquet(f"{folder}/outcomes/batch={batch_id}")
    good = judged.where("outcome IN ('cached', 'extracted')").select("asin", "review_no", "review_md5", "aspects")
    good.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
    failed = E.with_texts(judged.where("outcome IN ('failed', 'failed_dupes')"), rows).select("asin", "review_no", "text")
    failed.write.mode("overwrite").parquet(f"{folder}/retry/batch={batch_id}")


def retry_failed(spark: SparkSession, folder: str, chat: Callable[[str], str], workers: int | None = None, in_flight: int = 1) -> int:
    """Asks again for what has failed, while no stream runs; how many reviews still fail. Its batches have
    negative numbers, so they don't meet the stream's."""
    done = _read(spark, f"{folder}/outcomes", "outcome string, batch long").agg(F.least(F.min("batch"), F.lit(0))).first()[0]
    batch = (done or 0) - 1
    process_batch(spark.createDataFrame([], ROW), batch, folder, chat, workers, in_flight)
    return _read(spark, f"{folder}/retry/batch={batch}", ROW).count()


def start(spark: SparkSession, source: str, folder: str, chat: Callable[[str], str], workers: int | None = None, in_flight: int = 1, files_per_batch: int = 100, available_now: bool = True) -> StreamingQuery:
    """Follows Parquet files of reviews in ``source``; by default until what is there is done."""
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda rows, n: process_batch(rows, n, folder, chat, workers, in_flight)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by time window and kind; rows later than the watermark are left out. Works on a stream
    and on a table."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")
