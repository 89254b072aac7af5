"""Files in and out, and the resumable stream."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from facetmill.operators import tables
from facetmill.plans import catalogue, file_queries
from facetmill.sources import readers, writers
from facetmill.streaming import extraction_stream as S


def record(asin, **more):
    return {"asin": asin, "locale": "us", "stars": "4.3 out of 5 stars", "ratings": "1,116 ratings", "category": ["A", "B"], "attrs": {"x": "1"}, "reviews": [{"stars": "5.0 out of 5 stars", "title": "t", "text": "good", "date": "Reviewed in the United States on May 1, 2021"}]} | more


def test_scrape(spark, tmp_path):
    lines = [json.dumps(record("p1")), "", json.dumps({"asin": "p2", "locale": "us", "reviews": []})]
    (tmp_path / "d.json.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    raw = readers.read_scrape(spark, str(tmp_path / "d.json.zst"))
    got = {r["asin"]: r for r in tables.product_rows(raw).collect()}
    assert abs(got["p1"]["stars"] - 4.3) < 1e-6 and got["p1"]["n_ratings"] == 1116 and got["p1"]["cat_top"] == "A"
    assert (got["p2"]["n_reviews"], got["p2"]["n_attrs"], got["p2"]["category"], got["p2"]["stars"]) == (0, 0, [], None)
    review = tables.review_rows(raw).collect()
    assert len(review) == 1 and review[0]["country"] == "the United States" and review[0]["text_len"] == 4
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        readers.read_scrape(spark, str(tmp_path / "bad.json")).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    writers.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        writers.write_table(df, str(tmp_path / "t"))
    writers.swap_table(spark.read.parquet(str(tmp_path / "t")).withColumn("v", F.lit("b")), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, "b")]
    writers.write_artifact({"version": "v1"}, str(tmp_path / "a"))
    assert readers.read_prompt(str(tmp_path / "a/v1.json"))["version"] == "v1"
    with pytest.raises(FileExistsError):
        writers.write_artifact({"version": "v1"}, str(tmp_path / "a"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img/p1.jpg").write_bytes(b"abc")
    assert readers.read_file_hashes(spark, str(tmp_path / "img")).first()["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    splits = spark.createDataFrame([("a", 1, "dev", "typical", "m")], "asin string, review_no int, split string, stratum string, review_md5 string")
    writers.write_manifest(splits, str(tmp_path / "m.json"), 0)
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).first()["split"] == "dev"
    (tmp_path / "run1.log").write_text("2024-01-01 10:00:00 start\nnoise\n2024-01-01 10:30:00 end\n")
    assert readers.read_log_stamps(spark, str(tmp_path / "run1.log")).count() == 2


def test_checkpoint(spark, tmp_path):
    good = {"asin": "a", "review_no": 1, "review_md5": "m", "aspects": [{"facet": "f", "polarity": "positive"}]}
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(good), "", json.dumps(good | {"aspects": []}), '{"asin": "b", "rev']))
    got = readers.read_checkpoint(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(got) == 1 and got[0]["aspects"] == []


def chat(text):
    if "boom" in text:
        raise RuntimeError("down")
    return '{"aspects":[{"facet":"fit","polarity":"positive"}]}'


def test_stream_resumes(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def add(data):
        spark.createDataFrame(data, S.ROW).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = S.start(spark, source, folder, chat)
        q.awaitTermination()
        return {(r["asin"], r["review_no"]) for r in spark.read.parquet(f"{folder}/log").collect()}

    add([("a", 1, "same"), ("a", 2, "same"), ("b", 1, "boom")])
    assert run() == {("a", 1), ("a", 2)}
    add([("c", 1, "same"), ("d", 1, "new")])
    assert run() == {("a", 1), ("a", 2), ("c", 1), ("d", 1)}
    outcomes = {(r["asin"], r["outcome"]) for r in spark.read.parquet(f"{folder}/outcomes").where("batch = 1").collect()}
    assert outcomes == {("c", "cached"), ("d", "extracted"), ("b", "failed")}


def test_windowed_counts(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:01:00", "x", 2.0), (2, "2024-01-01 00:04:00", "x", 3.0), (3, "2024-01-01 00:06:00", "x", 1.0)], "id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in S.windowed_counts(df).collect()) == [(1, 1.0), (2, 5.0)]


def test_gold_and_log_files(spark, tmp_path):
    kind = "asin string, review_no int, text string, stratum string, gold_aspects array<struct<facet:string,polarity:string>>, rationale string, split string"
    frozen = spark.createDataFrame([("a", 1, "t", "typical", [(" Fit ", "positive")], "", "dev"), ("b", 2, "u", "long", [], "", "test")], kind)
    writers.write_gold(frozen, str(tmp_path / "gold"))
    got = readers.read_gold(spark, str(tmp_path / "gold/split=dev")).collect()
    assert len(got) == 1 and got[0]["gold_aspects"][0]["facet"] == "fit"
    log = str(tmp_path / "log")
    for n in (1, 2):
        writers.append_log(spark.createDataFrame([("a", n, "m", [])], "asin string, review_no int, review_md5 string, aspects array<string>"), log)
    assert readers.read_checkpoint(spark, log).count() == 2
    (tmp_path / "s.csv").write_text('asin,review_no,note\na,1,"two\nlines"\nb,,\n')
    assert [tuple(r) for r in readers.read_sheet(spark, str(tmp_path / "s.csv")).orderBy("asin").collect()] == [("a", "1", "two\nlines"), ("b", "", "")]
    for name, rows in (("train", [(1, "x")]), ("test", [(2, "y")])):
        writers.write_table(spark.createDataFrame(rows, "query_id int, split string"), str(tmp_path / name))
    assert readers.read_judgments(spark, str(tmp_path / "train"), str(tmp_path / "test")).count() == 2
    assert readers.read_columns(spark, str(tmp_path / "train"), "split").columns == ["split"]


def fetch(key, url):
    if key == "p2":
        raise OSError("gone")
    return {"status": "ok", "http": 200, "bytes": 3, "md5": "m", "w": 1, "h": 1} if key == "p1" else None


def test_images(spark):
    from facetmill.operators import extraction

    urls = spark.createDataFrame([("p1", "u"), ("p2", "u"), ("p3", "u")], "product_id string, url_small string")
    got = {r["product_id"]: r["status"] for r in extraction.fetch_images(urls, fetch, 2).collect()}
    assert got == {"p1": "ok", "p2": "exception", "p3": "none_returned"}
    manifest = spark.createDataFrame([("p1", "skip", None), ("p2", "ok", "k")], "product_id string, status string, md5 string")
    files = spark.createDataFrame([("p1", bytearray(b"abc"))], "product_id string, content binary")
    assert {r["product_id"]: r["md5"] for r in tables.backfill_hashes(manifest, files).collect()} == {"p1": "900150983cd24fb0d6963f7d28e17f72", "p2": "k"}


def test_failure_packet(spark):
    from facetmill.operators import scores

    kind = "k int, aspects array<struct<facet:string,polarity:string>>"
    gold, pred = spark.createDataFrame([(1, [("a", "pos")]), (2, [("b", "pos")])], kind), spark.createDataFrame([(1, [("a", "pos")])], kind)
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "k int, text string")
    packet = writers.failure_packet(scores.example_scores(gold, pred, ["k"]), texts, ["k"], 1)
    assert "## 2  f1=0.0" in packet and "two" in packet and "one" not in packet.split("\n", 1)[1]


@pytest.mark.parametrize("name", ["stream_resumed", "stream_outcomes"])
def test_stream_source_is_not_squeezed_into_few_tasks(spark, tmp_path, monkeypatch, name):
    """A table of seven files is written by seven tasks, and read in one batch a run."""
    spark.range(70).selectExpr("id AS doc_id", "CAST(id AS string) AS text").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def started(spark, source, folder, chat, files_per_batch=100):
        seen.append((len(spark.read.parquet(source).inputFiles()), files_per_batch))
        raise InterruptedError

    monkeypatch.setattr(file_queries.extraction_stream, "start", started)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        with pytest.raises(InterruptedError):
            catalogue.queries()[name](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen == [(7, file_queries.FILES)]


def shuffled_bytes(spark):
    """What all stages so far have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    empty = spark.sparkContext._jvm.java.util.ArrayList
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty(), False, False, quantiles, empty())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("send", [True, False])
def test_a_text_is_shuffled_once_in_a_batch(spark, tmp_path, monkeypatch, send):
    """Keys and hashes say what is done, known, first or repeated; texts that don't compress show it. Where keys
    are too many to be sent, all are shuffled once more to find those that failed. A review that comes twice
    is one, and its text is asked once."""
    import random

    from facetmill.operators import extraction, guards

    sent = guards.sent if send else lambda small, rows=0: small
    monkeypatch.setattr(S, "sent", sent)
    monkeypatch.setattr(extraction, "sent", sent, raising=False)
    if not send:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(3)
        texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(10_000)) for _ in range(40)]
        data = [("a", i, t) for i, t in enumerate(texts)] + [("a", 0, texts[0]), ("b", 0, texts[0]), ("c", 0, "boom"), ("c", 1, "boom"), ("d", 0, "x"), ("d", 0, "y")]
        before = shuffled_bytes(spark)
        S.process_batch(spark.createDataFrame(data, S.ROW).repartition(3).localCheckpoint(), 0, str(tmp_path), chat)
        dealt = 40 * 30_000  # the repartition above
        assert shuffled_bytes(spark) - before - dealt < (1.5 if send else 2.5) * 40 * 30_000
        judged = spark.read.parquet(f"{tmp_path}/outcomes").groupBy("outcome").count()
        assert {tuple(r) for r in judged.collect()} == {("extracted", 41), ("cached", 1), ("failed", 1), ("failed_dupes", 1)}
        assert sorted((r["asin"], r["review_no"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/retry").collect()) == [("c", 0, "boom"), ("c", 1, "boom")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
