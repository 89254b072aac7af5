"""Aspect extraction through a pluggable model, resumable from an append-only log.

The model is any picklable function from a list of chat messages (or a text) to the model's answer.
Equal texts are asked once, answers already in the log are reused, failures aren't logged and so are
tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.functions import parsing as P
from facetmill.operators.guards import sent
from facetmill.operators.inflight import in_window
from facetmill.session import ship_package

#: Answers of a task that are given on together.
ANSWERS = 256
RECORD = f"asin string, review_no int, review_md5 string, aspects array<{A.ASPECT}>"


def read_log(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """Log records from JSON lines; blank and broken lines, and those without a key, are skipped.
    With ``order`` only the last record of each review stays."""
    parsed = lines.where(F.length(F.trim(value)) > 0).withColumn("__r", F.from_json(value, RECORD, {"mode": "PERMISSIVE"}))
    rows = parsed.where("__r.asin IS NOT NULL AND __r.review_no IS NOT NULL AND __r.review_md5 IS NOT NULL")
    if order is None:
        return rows.select("__r.*")
    last = F.row_number().over(Window.partitionBy("__r.asin", "__r.review_no").orderBy(F.desc(order)))
    return rows.withColumn("__n", last).where("__n = 1").select("__r.*")


def classify(rows: DataFrame, log: DataFrame) -> DataFrame:
    """asin, review_no, ``review_md5`` (of ``text``, unless ``rows`` has it) and ``plan`` of each row: skipped
    (done), cached (the answer to this text is known), first (to be asked) or duplicate (waits for the first).
    Texts go through no join, only keys and hashes do."""
    md5 = F.col("review_md5") if "review_md5" in rows.columns else P.content_hash(F.col("text"))
    keyed = rows.select("asin", "review_no", md5.alias("review_md5"))
    done = log.select("asin", "review_no", F.lit(True).alias("__done")).distinct()
    known = log.select("review_md5", F.lit(True).alias("__known")).distinct()
    keyed = keyed.join(done, ["asin", "review_no"], "left").join(known, "review_md5", "left")
    # The first review of each new text by a partial minimum, so a text that is everywhere is no hot task.
    firsts = keyed.where("__done IS NULL AND __known IS NULL").groupBy("review_md5").agg(F.min(F.struct("asin", "review_no")).alias("__first"))
    keyed = keyed.join(firsts, "review_md5", "left")
    turn = F.struct("asin", "review_no") == F.col("__first")
    plan = F.when(F.col("__done"), "skipped").when(F.col("__known"), "cached").when(turn, "first").otherwise("duplicate")
    return keyed.withColumn("plan", plan).drop("__done", "__known", "__first")


#: What tells a review's text from all others; so many at most are sent to the tasks, as the driver holds them.
TEXT_KEY, SENT = ["asin", "review_no", "review_md5"], 100_000


def with_texts(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (asin, review_no, text) that ``keys`` names by ``TEXT_KEY``, each once, with ``review_md5``. A
    text is shuffled once, and only if it is wanted where the keys are few enough to be sent."""
    keyed = rows.select("asin", "review_no", "text", P.content_hash(F.col("text")).alias("review_md5"))
    return keyed.join(sent(keys.select(TEXT_KEY), SENT), TEXT_KEY, "left_semi").dropDuplicates(TEXT_KEY)


def ask(rows: DataFrame, chat: Callable[[str], str], workers: int | None = None, in_flight: int = 1) -> DataFrame:
    """review_md5, aspects, error for each row's text. ``workers`` bounds the tasks that call the model at a
    time, ``in_flight`` the calls that each of them has open; an exception or an invalid answer is an error of
    its row. Answers are given on as they come."""
    ship_package(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (row for f in frames for row in zip(f["review_md5"], f["text"]))
        done: list[tuple] = []
        frame = lambda: pd.DataFrame(done, columns=["review_md5", "answer", "failed"], dtype=object)
        for (md5, _), answer, error in in_window(texts, lambda row: chat(row[1]), in_flight):
            done.append((md5, answer, None if error is None else f"{type(error).__name__}: {error}"))
            if len(done) == ANSWERS:
                yield frame()
                done = []
        yield frame()

    asked = rows.select("review_md5", "text")
    asked = asked.repartition(workers) if workers else asked
    out = asked.mapInPandas(run, "review_md5 string, answer string, failed string")
    parsed = A.parse_model_output(F.col("answer"))
    return out.select("review_md5", parsed["aspects"].alias("aspects"), F.coalesce("failed", F.when(F.col("answer").isNull(), "no answer"), parsed["error"]).alias("error"))


def extract(rows: DataFrame, log: DataFrame, chat: Callable[[str], str], workers: int | None = None, in_flight: int = 1, planned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New log records, and every row's outcome: skipped, cached, extracted, failed or failed_dupes.

    Both come from one call of the model, so persist or write the outcomes before using them twice. ``planned``
    is what ``classify`` gave for the rows that count, where it gave it before.
    """
    planned = classify(rows, log) if planned is None else planned
    fresh = ask(with_texts(planned.where("plan = 'first'"), rows), chat, workers, in_flight)
    # Of several answers to a text the last one is served: by ``batch`` where the log has it, then by review.
    age = F.struct(*[c for c in ("batch", "asin", "review_no") if c in log.columns])
    cache = log.groupBy("review_md5").agg(F.max_by("aspects", age).alias("known"))
    joined = planned.join(fresh, "review_md5", "left").join(cache, "review_md5", "left")
    outcome = (
        F.when(F.col("plan") == "skipped", "skipped")
        .when(F.col("plan") == "cached", "cached")
        .when(F.col("error").isNotNull(), F.when(F.col("plan") == "first", "failed").otherwise("failed_dupes"))
        .when(F.col("plan") == "first", "extracted")
        .otherwise("cached")
    )
    judged = joined.select("asin", "review_no", "review_md5", F.coalesce("known", "aspects").alias("aspects"), "error", outcome.alias("outcome"))
    return judged.where(F.col("outcome").isin("cached", "extracted")).select("asin", "review_no", "review_md5", "aspects"), judged


def outcome_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


def compact(log: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each review and aspect; a review without aspects keeps one row with nulls. With
    ``order`` the last record of a review wins."""
    if order:
        log = log.withColumn("__n", F.row_number().over(Window.partitionBy("asin", "review_no").orderBy(F.desc(order)))).where("__n = 1")
    rows = log.select("asin", "review_no", "review_md5", F.explode_outer("aspects").alias("a"))
    evidence = F.when(F.col("a").isNotNull(), F.coalesce("a.evidence", F.lit("")))
    return rows.select("asin", "review_no", F.col("a.facet").alias("facet"), F.col("a.polarity").alias("polarity"), evidence.alias("evidence"), "review_md5")


def product_aspects(review_aspects: DataFrame) -> DataFrame:
    """Counts of each product's facets by polarity."""
    return review_aspects.where("facet IS NOT NULL").groupBy("asin", "facet").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("polarity") == p).alias(f"n_{p}") for p in A.POLARITIES]
    )


def fetch_images(urls: DataFrame, fetch: Callable[[str, str], dict], workers: int = 8) -> DataFrame:
    """The manifest rows of product_id, url_small through an injected downloader; nothing raises, a
    missing answer has its own status."""
    ship_package(urls.sparkSession)
    columns = ["product_id", "status", "http", "bytes", "md5", "w", "h", "err"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, url in zip(f["product_id"], f["url_small"]):
                try:
                    row = fetch(key, url) or {"status": "none_returned"}
                except Exception as e:  # the row carries the failure
                    row = {"status": "exception", "err": str(e)[:80]}
                out.append({c: None for c in columns} | row | {"product_id": key})
            yield pd.DataFrame(out, columns=columns)

    schema = "product_id string, status string, http int, bytes long, md5 string, w int, h int, err string"
    return urls.select("product_id", "url_small").repartition(workers).mapInPandas(run, schema)
