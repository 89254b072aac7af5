"""Extraction whose memory is keyed state: answers, retries by timers, restarts, odd rows."""

import time

from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.streaming import keyed_extraction as K
from facetmill.streaming.extraction_stream import ROW

GOOD = '{"aspects":[{"facet":"fit","polarity":"positive"}]}'


def model(folder):
    """Notes each call; texts with 'boom' fail while the folder has no file named up."""

    def chat(text):
        import os
        import uuid

        with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        if "boom" in text and not os.path.exists(f"{folder}/up"):
            raise RuntimeError("down")
        return "not json" if text == "odd" else GOOD

    return chat


def calls(folder):
    return sorted(p.read_text() for p in folder.glob("call-*"))


def add(spark, source, data):
    spark.createDataFrame(data, ROW).coalesce(1).write.mode("append").parquet(source)


def seen(spark, folder):
    return sorted((r["asin"], r["review_no"], r["outcome"]) for r in K.outcomes(spark, folder).collect())


def test_answers_are_kept_between_runs(spark, tmp_path):
    source, folder, notes = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "notes"
    notes.mkdir()
    before = dict(spark.conf.getAll)

    def run():
        K.start(spark, source, folder, model(str(notes)), in_flight=2, retry_ms=1, shards=4).awaitTermination()

    add(spark, source, [("a", 1, "same"), ("a", 2, "same"), ("b", 1, "boom"), ("b", 2, "boom"), ("e", 1, "odd"), ("n", 1, None), (None, 7, "x")])
    run()
    first = seen(spark, folder)
    assert [o for *_, o in first].count("extracted") == 2 and ("n", 1, "extracted") in first
    assert sorted(o for a, _, o in first if a == "a") == ["cached", "extracted"]
    assert sorted(o for a, _, o in first if a == "b") == ["failed", "failed_dupes"]
    assert ("e", 1, "failed") in first and not any(a is None for a, *_ in first)
    assert calls(notes) == ["", "boom", "odd", "same"]
    run()  # nothing new
    assert seen(spark, folder) == first
    (notes / "up").touch()
    add(spark, source, [("c", 1, "same"), ("a", 1, "another text of a known review"), ("d", 1, "new"), ("n", 2, "")])
    run()
    more = seen(spark, folder)
    assert ("c", 1, "cached") in more and ("d", 1, "extracted") in more and ("n", 2, "cached") in more
    # The timer of the failed text was due: both reviews that waited have their rows, the text that
    # can't be answered was asked again, and no known text was.
    assert sorted(o for a, _, o in more if a == "b") == ["cached", "extracted", "failed", "failed_dupes"]
    assert calls(notes) == ["", "boom", "boom", "new", "odd", "odd", "same"]
    done = K.log(spark, folder).groupBy("asin", "review_no").count()
    assert {(r["asin"], r["review_no"], r["count"]) for r in done.collect()} == {(*k, 1) for k in [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("n", 1), ("n", 2)]}
    assert dict(spark.conf.getAll) == before


def test_timers_act_without_new_files(spark, tmp_path):
    source, folder, notes = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "notes"
    notes.mkdir()
    add(spark, source, [("b", n, "boom") for n in range(3)] + [("a", 1, "fine")])
    query = K.start(spark, source, folder, model(str(notes)), retry_ms=1, every="0 seconds", shards=4)
    try:
        end = time.time() + 90
        while time.time() < end and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.5)
        (notes / "up").touch()
        while time.time() < end and K.log(spark, folder).where("asin = 'b'").count() < 3:
            time.sleep(0.5)
    finally:
        query.stop()
    assert K.log(spark, folder).where("asin = 'b'").count() == 3
    assert K.log(spark, folder).where(F.col("aspects")[0]["facet"] == "fit").count() == 4


def test_answer_errors_agree_with_the_parser(spark):
    many = ",".join(['{"facet":"f","polarity":"positive"}'] * (A.MAX_ASPECTS + 1))
    answers = [GOOD, '{"aspects":[]}', "not json", "{}", "[]", "7", '{"aspects":7}', '{"aspects":null}', '{"aspects":[{"facet":"x","polarity":"great"}]}',
               '{"aspects":[{"facet":null,"polarity":"positive"}]}', '{"aspects":[{"polarity":"positive"}]}', '{"aspects":[null]}', f'{{"aspects":[{many}]}}', ""]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select("a", A.parse_model_output(F.col("a"))["error"].alias("e")).collect()
    assert {r["a"]: r["e"] is None for r in rows} == {a: K.answer_error(a) is None for a in answers}
