"""Fetching, calls in flight, one pass over a scrape, the order of log records."""

import os
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from facetmill.operators import extraction, guards, models, tables
from facetmill.operators.inflight import in_window
from facetmill.plans import catalog_queries
from facetmill.sources import fetching, readers, writers

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 5) + b"\x08\x02\0\0\0" + b"\0" * 40 + b"\0\0\0\0IEND\xaeB`\x82"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x01\x11\x00" + b"\0" * 20 + b"\xff\xd9"


def answering(*answers):
    left = list(answers)

    def session(url):
        a = left.pop(0) if len(left) > 1 else left[0]
        if isinstance(a, Exception):
            raise a
        return a

    return session


@pytest.mark.parametrize("answers,want", [
    ([(200, {}, PNG)], {"status": "ok", "http": 200, "w": 7, "h": 5, "bytes": len(PNG)}),
    ([(200, {}, JPEG)], {"status": "ok", "w": 40, "h": 30}),
    ([(404, {}, b"")], {"status": "http_error", "http": 404}),
    ([(400, {}, b"")], {"status": "http_error", "http": 400}),
    ([(200, {}, b"<html>nope</html>")], {"status": "not_image", "http": 200, "bytes": 17}),
    ([(200, {}, PNG[:40])], {"status": "not_image"}),
    ([(429, {"Retry-After": "0"}, b"")], {"status": "retry_exhausted", "http": 429}),
    ([(429, {"Retry-After": "0"}, b""), (200, {}, JPEG)], {"status": "ok"}),
    ([(503, {}, b"")], {"status": "retry_exhausted", "http": 503}),
    ([OSError("reset"), (200, {}, PNG)], {"status": "ok"}),
    ([(500, {}, b""), OSError("reset")], {"status": "exception", "http": 500, "err": "OSError: reset"}),
])
def test_what_becomes_of_a_url(answers, want):
    rests = []
    fields, body = fetching.fetch_one("u", answering(*answers), fetching.Patience(rest=rests.append))
    assert want.items() <= fields.items() and (body is not None) == (fields["status"] == "ok")
    assert len(rests) <= 5 and all(0 <= r <= 30 for r in rests)


def test_patience():
    rests = []
    p = fetching.Patience(rest=rests.append)
    for attempt, told in ((0, None), (3, "soon"), (9, None), (0, "7"), (0, "100"), (2, "-4")):
        p.after(attempt, told)
    assert 1 <= rests[0] < 2 and 8 <= rests[1] < 9 and rests[2:] == [30.0, 7.0, 30.0, 0.0]


def test_image_headers():
    assert fetching.image_size(b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0\0") == (3, 4)
    assert fetching.image_size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x13\0\0") == (10, 20)
    for bad in (b"", b"\xff\xd8", JPEG[:-2], b"\xff\xd8\xff\xd9", b"\xff\xd8" + b"\0" * 30 + b"\xff\xd9"):
        with pytest.raises(ValueError):
            fetching.image_size(bad)


def connect():
    def session(url):
        if url == "broken":
            raise OSError("gone")
        return {"png": (200, {}, PNG), "missing": (404, {}, b""), "html": (200, {}, b"<html>")}[url]

    return session


def no_rest(seconds):
    pass


def refuse():
    def session(url):
        raise AssertionError("asked for what is there")

    return session


def test_images_into_the_store(spark, tmp_path):
    rows = [(f"B{i:03d}", ("png", "missing", "html", "broken")[i % 4]) for i in range(40)]
    urls = spark.createDataFrame(rows, "product_id string, url_small string")
    quick = fetching.Patience(tries=2, rest=no_rest)
    first = {r.product_id: r for r in fetching.fetch_images(urls, connect, str(tmp_path), 3, 4, quick).collect()}
    assert len(first) == 40 and {r.status for r in first.values()} == {"ok", "http_error", "not_image", "exception"}
    assert first["B000"].md5 == __import__("hashlib").md5(PNG).hexdigest() and not list(tmp_path.rglob("*.part"))
    assert (tmp_path / "B0/00/B000.jpg").read_bytes() == PNG
    again = {r.product_id: r.status for r in fetching.fetch_images(urls.where("url_small = 'png'"), refuse, str(tmp_path), 2, 2, quick).collect()}
    assert set(again.values()) == {"skip"} and len(again) == 10
    # An empty file is no image that was fetched.
    (tmp_path / "B0/00/B000.jpg").write_bytes(b"")
    assert {r.status for r in fetching.fetch_images(urls.where("product_id = 'B000'"), connect, str(tmp_path), 1, 1, quick).collect()} == {"ok"}
    assert fetching.fetch_images(urls.limit(0), connect, str(tmp_path)).count() == 0


def test_a_bounded_window():
    taken, now, most, lock = [0], [0], [0], threading.Lock()

    def items():
        for i in range(200):
            taken[0] += 1
            yield i

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.001)
        with lock:
            now[0] -= 1
        if i % 50 == 7:
            raise KeyError(i)
        return i * 2

    given = 0
    seen = {}
    for item, result, error in in_window(items(), call, 5):
        given += 1
        assert taken[0] - given <= 4 * 5
        seen[item] = error or result
    assert len(seen) == 200 and most[0] <= 5 and isinstance(seen[57], KeyError) and seen[3] == 6
    assert list(in_window([], call, 3)) == []


def slow(text):
    time.sleep(0.05)
    if text == "text 3":
        raise ValueError("v" * 400)
    return '{"aspects":[]}'


def test_calls_in_flight(spark):
    rows = spark.createDataFrame([(f"m{i}", f"text {i}") for i in range(80)], "review_md5 string, text string").coalesce(1)
    extraction.ask(rows, slow, 1, 1).limit(1).collect()
    began = time.time()
    got = {r.review_md5: r.error for r in extraction.ask(rows, slow, 1, 16).collect()}
    assert time.time() - began < 0.05 * 80 and len(got) == 80
    assert got["m3"] == "ValueError: " + "v" * 400 and sum(e is not None for e in got.values()) == 1


def test_last_record_wins_whatever_the_sizes(spark, tmp_path):
    kind = "asin string, review_no int, review_md5 string, aspects array<struct<facet:string,polarity:string,evidence:string>>"
    record = lambda n, facet: ("a", n, "m", [(facet, "positive", "")])
    log = str(tmp_path / "log")
    writers.append_log(spark.createDataFrame([record(0, "old")], kind), log)
    writers.append_log(spark.createDataFrame([*[record(i, "x" * 50) for i in range(1, 500)], record(0, "new")], kind).coalesce(1), log)
    facet = lambda: {r.review_no: r.aspects[0].facet for r in readers.read_checkpoint(spark, log).collect()}
    assert facet()[0] == "new" and len(facet()) == 500
    writers.append_log(spark.createDataFrame([record(0, "newest"), record(1, "newest")], kind).repartition(3), log)
    got = facet()
    assert (got[0], got[1], got[2]) == ("newest", "newest", "x" * 50)
    # Within a file the last line; files of other writers by their time of change.
    plain = tmp_path / "other.jsonl"
    line = '{"asin":"a","review_no":0,"review_md5":"m","aspects":[{"facet":"%s","polarity":"positive","evidence":""}]}\n'
    plain.write_text("".join(line % f for f in ("one", "two")) + "{broken\n\n")
    assert readers.read_checkpoint(spark, str(plain)).first().aspects[0].facet == "two"
    older = tmp_path / "a" / "zz.jsonl"
    older.parent.mkdir()
    older.write_text(line % "older" * 400)
    os.utime(older, (1, 1))
    (tmp_path / "a" / "aa.jsonl").write_text(line % "younger")
    assert readers.read_checkpoint(spark, str(tmp_path / "a")).first().aspects[0].facet == "younger"


def test_the_last_answer_to_a_text_is_served(spark):
    rows = spark.createDataFrame([("b", 2, "t")], "asin string, review_no int, text string")
    md5 = "e358efa489f58062f10dd7316b65649e"
    log = [("a", 1, md5, [("old", "positive", "")], 5), ("a", 0, md5, [("new", "positive", "")], 9)]
    kind = extraction.RECORD + ", batch long"
    for order in (log, log[::-1]):
        _, judged = extraction.extract(rows, spark.createDataFrame(order, kind).coalesce(1), slow)
        assert judged.first().aspects[0].facet == "new"


def test_scrape_in_one_pass(spark, tmp_path):
    records = catalog_queries.records(spark, "/root/testdata/sf0.001")
    records.drop("ord").write.option("compression", "gzip").json(str(tmp_path / "in"))
    read = readers.read_scrape(spark, str(tmp_path / "in"))
    plan = tables.scrape_rows(read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1
    writers.write_scrape(read, str(tmp_path / "out"))
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(readers.read_scraped(spark, str(tmp_path / "out"), "product")) == as_rows(tables.product_rows(read))
    assert as_rows(readers.read_scraped(spark, str(tmp_path / "out"), "review").drop("ord")) == as_rows(tables.review_rows(read).drop("ord"))


def test_refused_fields(spark):
    body = {"model": "m", "reasoning_effort": "none", "temperature": 0, "think": False}
    assert models.unwanted(body, "Unknown field: reasoning_effort.") == {"reasoning_effort"}
    assert models.unwanted(body, "no reasoning, no temperature") == {"reasoning_effort", "temperature"}
    assert models.unwanted(body, "bad messages; rethink") == set() and models.unwanted({}, "temperature") == set()
    assert models.ANSWER_SCHEMA["additionalProperties"] is False and models.ANSWER_SCHEMA["properties"]["aspects"]["items"]["additionalProperties"] is False


def test_broadcast_by_bytes(spark):
    small = spark.createDataFrame([("x" * 100, i, [1, 2]) for i in range(50)], "t string, i int, a array<int>")
    sent = lambda *args: "broadcast" in guards.sent(small, *args)._jdf.queryExecution().toString().lower()
    assert sent() and not sent(10) and not sent(1000, 3000) and sent(1000, 10_000)
