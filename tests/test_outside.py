"""Model servers, workbooks, downloads, blob stores and table swaps."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from facetmill.operators import extraction, models
from facetmill.sources import readers, sheets, transfer, writers
from facetmill.streaming import extraction_stream as S


class Server:
    """Answers requests from a list of (status, text) and keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, body):
        self.asked.append((url, body))
        return self.answers.pop(0)


def said(content, native=False):
    return 200, json.dumps({"message": {"content": content}} if native else {"choices": [{"message": {"content": content}}]})


def test_completions_backend():
    server = Server(said("yes"))
    model = models.ChatModel(models.Settings(models.COMPLETIONS, "http://h/v1/", "m", "there/m", {"think": False}), "sys", (("u", "a"),), server)
    assert model("text") == "yes"
    url, body = server.asked[0]
    assert url == "http://h/v1/chat/completions" and body["model"] == "there/m" and body["chat_template_kwargs"] == {"think": False}
    assert [m["role"] for m in body["messages"]] == ["system", "user", "assistant", "user"] and body["response_format"]["json_schema"]["schema"] == models.ANSWER_SCHEMA


def test_one_more_try_without_the_unknown_field():
    server = Server((400, "unknown field reasoning_effort"), said("ok"))
    model = models.ChatModel(models.Settings(models.COMPLETIONS, "http://h", "m"), "s", post=server)
    assert model("t") == "ok"
    first, second = (body for _, body in server.asked)
    assert {k: v for k, v in first.items() if k != "reasoning_effort"} == second and "reasoning_effort" in first
    for answers in ([(400, "reasoning"), (400, "reasoning")], [(400, "bad messages")], [(500, "reasoning")]):
        server = Server(*answers)
        with pytest.raises(models.ModelError):
            models.ChatModel(models.Settings(models.COMPLETIONS, "http://h", "m"), "s", post=server)("t")
        assert not server.answers


def test_native_backend():
    server = Server(said("yes", True))
    assert models.ChatModel(models.Settings(model="m"), "s", post=server)("t") == "yes"
    url, body = server.asked[0]
    assert url.endswith("/api/chat") and "response_format" not in body and body["options"] == {"temperature": 0}


def test_settings():
    env = {"FACETMILL_BACKEND": "completions", "FACETMILL_ENDPOINT": "http://e", "FACETMILL_TEMPLATE_OPTIONS": '{"a": 1}', "OTHER": "x"}
    got = models.Settings.from_env(env=env)
    assert (got.backend, got.endpoint, got.model, got.template_options) == ("completions", "http://e", "", {"a": 1})
    assert models.Settings.from_env(env={}) == models.Settings()
    with pytest.raises(ValueError):
        models.Settings.from_env(env={"FACETMILL_BACKEND": "pigeon"})


def post_short(url, body):
    text = body["messages"][-1]["content"]
    return (500, "no") if text == "boom" else said('{"aspects":[]}')


def test_model_on_executors_and_failures_told(spark):
    model = models.ChatModel(models.Settings(models.COMPLETIONS, "http://h", "m"), "s", post=post_short)
    rows = spark.createDataFrame([("a", 1, "fine"), ("b", 2, "boom"), ("c", 3, "boom")], "asin string, review_no int, text string")
    _, judged = extraction.extract(rows, spark.createDataFrame([], extraction.RECORD), model)
    told = []
    assert models.each_failure(judged, lambda *x: told.append(x)) == 2
    assert sorted(t[:2] for t in told) == [("b", 2), ("c", 3)] and all("status 500" in t[2] for t in told)


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    rows = spark.createDataFrame([("a\x01<&", 3, "typical", "x", "t", "two\nlines  "), ("b", 10, "long", None, "", "\u65e5")], "asin string, review_no int, stratum string, country string, product_title string, text string")
    sheets.write_sheet(rows, path, "first line\nsecond")
    got = readers.read_sheet(spark, path).orderBy("asin").collect()
    assert [r["asin"] for r in got] == ["a<&", "b"] and got[0]["review_no"] == "3" and got[0]["text"] == "two\nlines  " and got[1]["country"] == "" and got[0].__fields__ == sheets.COLUMNS
    assert sheets.read_cells(path, "instructions") == [["first line"], ["second"]]
    xml = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert 'sqref="J2:J3"><formula1>"skip,unsure"' in xml and 'sqref="I2:I3"><formula1>"x"' in xml
    with pytest.raises(ValueError):
        sheets.read_cells(path, "nothing")
    assert [sheets._name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_workbook_with_shared_strings(tmp_path):
    path = str(tmp_path / "o.xlsx")
    sheets.write_workbook(path, {"gold": f'<worksheet xmlns="{sheets._MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>'})
    with zipfile.ZipFile(path, "a") as out:
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets._MAIN}"><si><t>no</t></si><si><r><t>ye</t></r><r><t>s</t></r></si></sst>')
    assert sheets.read_cells(path) == [["yes", "", "2.5"]]


def test_download(tmp_path):
    data = bytes(range(200)) * 5
    asked = []

    def fetch(method, url, headers, ranges=True):
        asked.append((method, headers))
        start = int(headers["Range"][6:-1]) if ranges and "Range" in headers else 0
        return 206 if start else 200, {"Content-Length": str(len(data))}, iter([data[start : start + 300], data[start + 300 :]] if method == "GET" else [])

    target = tmp_path / "d" / "f.bin"
    assert transfer.download("u", str(target), fetch).read_bytes() == data
    n = len(asked)
    transfer.download("u", str(target), fetch)
    assert [m for m, _ in asked[n:]] == ["HEAD"]
    for ranges in (True, False):
        target.write_bytes(data[:250])
        assert transfer.download("u", str(target), lambda *a, r=ranges: fetch(*a, ranges=r)).read_bytes() == data
    with pytest.raises(OSError):
        transfer.download("u", str(tmp_path / "g"), lambda *a: (404, {}, iter([])))


def test_swap_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    value = lambda: spark.read.parquet(path).first()["v"]
    writers.write_table(frame(1), path)
    (tmp_path / "t").rename(tmp_path / "t.aside")  # a swap that ended between the two moves
    assert writers.restore_table(spark, path) and value() == 1
    (tmp_path / "t").rename(tmp_path / "t.aside")
    writers.swap_table(frame(2), path)
    assert value() == 2 and not (tmp_path / "t.aside").exists()
    writers.swap_table(spark.read.parquet(path).select((F.col("v") + 1).alias("v")), path)
    assert value() == 3 and not writers.restore_table(spark, path)


def test_manifest_is_for_samples(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "MAX_SAMPLE", 2)
    rows = spark.range(3).selectExpr("'a' AS asin", "CAST(id AS INT) AS review_no", "'dev' AS split", "'s' AS stratum", "'m' AS review_md5")
    with pytest.raises(ValueError):
        writers.write_manifest(rows, str(tmp_path / "m.json"), 0)


def test_typed_logs(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"asin":"a","review_no":1,"draft":"x: pos"}\n{"draft":"lost"}\n')
    assert [tuple(r) for r in readers.read_drafts(spark, str(tmp_path / "d.jsonl")).collect()] == [("a", 1, "x: pos")]
    (tmp_path / "r.jsonl").write_text('{"tag":"e1","parent":null,"facet_f1":0.5,"accepted":true}\n{"tag":"e2","parent":"e1","facet_f1":0.6}\n')
    assert {r["tag"]: r["facet_f1"] for r in readers.read_rounds(spark, str(tmp_path / "r.jsonl")).collect()} == {"e1": 0.5, "e2": 0.6}


def flaky(text):
    import os

    if "boom" in text and not os.path.exists(text.split()[1]):
        raise RuntimeError("down")
    return '{"aspects":[]}'


def test_failures_are_asked_again_without_new_files(spark, tmp_path):
    source, folder, flag = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "up"
    spark.createDataFrame([("a", 1, "fine"), ("b", 1, f"boom {flag}"), ("c", 1, f"boom {flag}")], S.ROW).coalesce(1).write.parquet(source)
    S.start(spark, source, folder, flaky).awaitTermination()
    assert S.retry_failed(spark, folder, flaky) == 2 and S.retry_failed(spark, folder, flaky) == 2
    flag.write_text("")
    assert S.retry_failed(spark, folder, flaky) == 0
    log = spark.read.parquet(f"{folder}/log")
    assert sorted((r["asin"], r["review_no"]) for r in log.collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert S.retry_failed(spark, folder, flaky) == 0 and spark.read.parquet(f"{folder}/log").count() == 3
