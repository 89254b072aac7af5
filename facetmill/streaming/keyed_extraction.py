"""Extraction as a stream whose memory is keyed state: no batch reads a log.

Texts are dealt by their hash to shards. A shard's state has the answer of each text met, the texts that
failed and the reviews that wait for them, so a batch costs what its own rows cost. Each text is asked
once; reviews with an equal text, now or later, get its answer. A text that failed is asked again when
another review brings it, or when its shard's timer is due, and the reviews that waited then get their rows.

Reviews without a key are left out; of rows with one key the first batch's counts; a null text is empty.
Equal texts of a task's batch travel as one row with many review keys, so a text that is everywhere costs
its shard a few rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from facetmill.functions import aspects as A
from facetmill.functions import parsing as P
from facetmill.operators.inflight import in_window
from facetmill.session import ship_package
from facetmill.streaming.extraction_stream import ROW

#: Fixed by a stream's first start, as the state is keyed by it.
SHARDS = 1024
KEYS = "asins array<string>, numbers array<int>"
ANSWERED = f"review_md5 string, {KEYS}, first boolean, answer string, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answer_error(answer: str | None) -> str | None:
    """What ``parse_model_output`` finds wrong with an answer, told where the answer comes in."""
    if answer is None:
        return "no answer"
    try:
        found = json.loads(answer)["aspects"]
    except (ValueError, TypeError, KeyError):
        return "no aspects"
    if not isinstance(found, list):
        return "no aspects"
    if any(not isinstance(a, dict) or a.get("facet") is None or a.get("polarity") not in A.POLARITIES for a in found):
        return "bad aspect"
    return "too many aspects" if len(found) > A.MAX_ASPECTS else None


class TextState(StatefulProcessor):
    """The answers and failures of one shard."""

    def __init__(self, chat: Callable[[str], str], in_flight: int, retry_ms: int):
        self.chat, self.in_flight, self.retry_ms = chat, in_flight, retry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "review_md5 string", "answer string")
        self.failed = handle.getMapState("failed", "review_md5 string", "text string, parts int")
        # One entry for each row that waits, so a text with many reviews is given out in pieces.
        self.waiting = handle.getMapState("waiting", "review_md5 string, part int", KEYS)

    def _asked(self, texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
        for (md5, _), answer, error in in_window(texts, lambda t: self.chat(t[1]), self.in_flight):
            wrong = f"{type(error).__name__}: {error}" if error is not None else answer_error(answer)
            if wrong is None:
                self.answers.updateValue((md5,), (answer,))
            yield md5, answer, wrong

    def _released(self, md5: str, answer: str, first: bool) -> Iterator[pd.DataFrame]:
        """The reviews that waited for a text, a piece at a time."""
        if not self.failed.containsKey((md5,)):
            return
        for part in range(self.failed.getValue((md5,))[1]):
            asins, numbers = self.waiting.getValue((md5, part))
            self.waiting.removeKey((md5, part))
            yield _frame([(md5, list(asins), list(numbers), first and part == 0, answer, None)])
        self.failed.removeKey((md5,))

    def _later(self, timerValues) -> None:
        # After this batch's time at least, or the timer would be due within the batch.
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, self.retry_ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        errors: dict[str, str] = {}
        for f in rows:
            new = {m: t for m, t in zip(f["review_md5"], f["text"]) if m not in errors and not self.answers.containsKey((m,))}
            fresh = set(new)
            for md5, answer, wrong in self._asked(iter(new.items())):
                if wrong is None:
                    yield from self._released(md5, answer, False)
                else:
                    errors[md5] = wrong
            out = []
            for md5, text, asins, numbers in zip(f["review_md5"], f["text"], f["asins"], f["numbers"]):
                asins, numbers, first = list(asins), [int(n) for n in numbers], md5 in fresh
                fresh.discard(md5)
                if md5 in errors:
                    parts = self.failed.getValue((md5,))[1] if self.failed.containsKey((md5,)) else 0
                    self.waiting.updateValue((md5, parts), (asins, numbers))
                    self.failed.updateValue((md5,), (text, parts + 1))
                    out.append((md5, asins, numbers, first, None, errors[md5]))
                else:
                    out.append((md5, asins, numbers, first, self.answers.getValue((md5,))[0], None))
            yield _frame(out)
        if errors:
            self._later(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        again = False
        for md5, answer, wrong in self._asked((k[0], v[0]) for k, v in self.failed.iterator()):
            if wrong is None:
                yield from self._released(md5, answer, True)
            again = again or wrong is not None
        if again:
            self._later(timerValues)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["review_md5", "asins", "numbers", "first", "answer", "error"], dtype=object)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each text of a batch, with the keys of its reviews."""
    for f in frames:
        if len(f):
            groups = f.groupby("review_md5", sort=False)
            yield groups.agg(text=("text", "first"), asins=("asin", list), numbers=("review_no", list)).reset_index()


def extraction(reviews: DataFrame, chat: Callable[[str], str], in_flight: int = 8, retry_ms: int = 60_000, shards: int = SHARDS) -> DataFrame:
    """asin, review_no, review_md5, aspects, error, outcome of each review of a stream (asin, review_no, text):
    extracted, cached, failed or failed_dupes. A review that waited has a second row once its text is answered."""
    ship_package(reviews.sparkSession)
    keyed = reviews.where("asin IS NOT NULL AND review_no IS NOT NULL").select("asin", "review_no", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.dropDuplicates(["asin", "review_no"]).withColumn("review_md5", P.content_hash(F.col("text")))
    packed = keyed.mapInPandas(_packed, f"review_md5 string, text string, {KEYS}")
    dealt = packed.withColumn("shard", F.pmod(F.xxhash64("review_md5"), F.lit(shards)))
    out = dealt.groupBy("shard").transformWithStateInPandas(TextState(chat, in_flight, retry_ms), ANSWERED, "Append", "ProcessingTime")
    each = out.select("*", F.posexplode(F.arrays_zip("asins", "numbers")).alias("place", "review"))
    asked = F.col("first") & (F.col("place") == 0)
    outcome = F.when(F.col("error").isNull(), F.when(asked, "extracted").otherwise("cached")).otherwise(F.when(asked, "failed").otherwise("failed_dupes"))
    aspects = A.parse_model_output(F.col("answer"))["aspects"]
    return each.select(F.col("review.asins").alias("asin"), F.col("review.numbers").alias("review_no"), "review_md5", aspects.alias("aspects"), "error", outcome.alias("outcome"))


def start(spark: SparkSession, source: str, folder: str, chat: Callable[[str], str], in_flight: int = 8, retry_ms: int = 60_000, files_per_batch: int = 100, every: str | None = None, shards: int = SHARDS) -> StreamingQuery:
    """Follows Parquet files of reviews in ``source``, outcomes into ``folder``/outcomes by outcome.

    Without ``every`` the query ends when what is there is done, and timers that are due act in its batches;
    with an interval it goes on, and they act without new files too.
    """
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = extraction(stream, chat, in_flight, retry_ms, shards).writeStream.format("parquet").partitionBy("outcome")
    writer = writer.option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    # State with timers asks for batch after batch without data, so a query that is to end has none of them.
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(bool(every)).lower()}
    before = spark.conf.getAll
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name in settings:
            spark.conf.set(name, before[name]) if name in before else spark.conf.unset(name)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"asin string, review_no int, review_md5 string, aspects array<{A.ASPECT}>, error string, outcome string"
    return spark.read.schema(schema).parquet(f"{folder}/outcomes")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each review that has its answer."""
    return outcomes(spark, folder).where("outcome IN ('extracted', 'cached')").select("asin", "review_no", "review_md5", "aspects")
