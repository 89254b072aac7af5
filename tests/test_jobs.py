"""The runnable jobs: growing input, reruns, odd rows, command lines, restored settings."""

import hashlib
import json
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from facetmill.operators.guards import DuplicateKeyError
from jobs import facet_mentions, review_tables

SF = "/root/testdata/sf0.001"
REVIEWS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, toxic int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_mentions(texts, config):
    out = []
    for text in {t for t in texts if t is not None}:
        cut = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", text)]
        cut = [s for s in cut if len(s) >= config["least_chars"]]
        for facet, pattern in config["facets"].items():
            hits = [s for s in cut if re.search(pattern, s)]
            if hits:
                out.append((hashlib.md5(text.encode()).hexdigest(), len(hits), hits[0], facet))
    return sorted(out, key=repr)


def test_mentions_follow_growing_input(spark, tmp_path):
    config = facet_mentions.read_config(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    settings = {k: spark.conf.get(k, None) for k in (facet_mentions.STATE, facet_mentions.PROGRESS)}
    docs.where("doc_id < 120").coalesce(3).write.parquet(source)
    first = facet_mentions.run(spark, source, out, mark)
    assert first["read"] == 120 and first["wrote"] == spark.read.parquet(out).count() > 0
    assert rows(spark.read.parquet(out)) == plain_mentions([r.text for r in docs.where("doc_id < 120").collect()], config)
    files = sorted(p.name for p in Path(out).rglob("*.parquet"))
    assert facet_mentions.run(spark, source, out, mark) == {"read": 0, "wrote": 0, "batches": 0}
    assert sorted(p.name for p in Path(out).rglob("*.parquet")) == files
    # New rows, a text that was met before, and no text.
    more = docs.where("doc_id >= 120").unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(spark.createDataFrame([(20_000, None)], "doc_id long, text string"))
    more.coalesce(2).write.mode("append").parquet(source)
    second = facet_mentions.run(spark, source, out, mark, config | {"files_per_batch": 1})
    # Of the row without a text the scan may tell by its statistics alone.
    assert second["read"] - (docs.count() - 120 + 5) in (0, 1) and second["batches"] >= 1
    assert set(files) < {p.name for p in Path(out).rglob("*.parquet")}
    facet_mentions.run(spark, source, f"{tmp_path}/whole", f"{tmp_path}/mark2")
    assert rows(spark.read.parquet(out)) == rows(spark.read.parquet(f"{tmp_path}/whole")) == plain_mentions([r.text for r in docs.collect()], config)
    assert settings == {k: spark.conf.get(k, None) for k in settings}
    assert {p.name for p in Path(out).iterdir() if p.is_dir() and p.name.startswith("facet=")} <= {f"facet={f}" for f in config["facets"]}


def test_mentions_after_a_broken_run(spark, tmp_path):
    """A run that stops before its commit leaves nothing that a reader sees, and the next one does its work."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    docs.coalesce(2).write.parquet(source)
    facet_mentions.run(spark, source, out, mark)
    want = rows(spark.read.parquet(out))
    # The batch's commits are lost; its files are there.
    for p in (f"{mark}/commits/0", f"{out}/_spark_metadata/0"):
        Path(p).unlink()
        Path(p).parent.joinpath(f".{Path(p).name}.crc").unlink(missing_ok=True)
    facet_mentions.run(spark, source, out, mark)
    assert rows(spark.read.parquet(out)) == want


@pytest.fixture()
def made(spark, tmp_path):
    a, b = "a " * 30 + "! Second sentence is here.", "b " * 2000
    data = [(1, a, "en", "s"), (2, a, "de", "t"), (3, a, "en", "t"), (4, b, "de", "s"), (5, None, "en", "s"), (6, " \n", "en", "s"), (7, "short", None, None), (8, "c " * 50, "", "s"), (9, "d " * 50, "en", "s")]
    spark.createDataFrame(data, REVIEWS).withColumn("split", F.lit("x")).write.parquet(f"{tmp_path}/reviews")
    spark.createDataFrame([(9, 1), (9, 1), (1, 0), (77, 1)], LABELS).write.parquet(f"{tmp_path}/labels")
    return tmp_path


def test_review_table(spark, made):
    out, args = f"{made}/out", (f"{made}/reviews", f"{made}/labels")
    report = review_tables.run(spark, *args, out)
    got = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [1, 4, 7, 8, 9] and report["read"] == 9 and report["wrote"] == 5
    assert (got[1].n_copies, got[1].n_sources, got[1].n_sentences) == (3, 2, 2)
    assert {i: (r.lang, r.stratum) for i, r in got.items()} == {1: ("en", "typical"), 4: ("de", "long"), 7: ("und", "trivial"), 8: ("und", "foreign"), 9: ("en", "low_star")}
    want = rows(spark.read.parquet(out))
    assert review_tables.run(spark, *args, out) == report and rows(spark.read.parquet(out)) == want
    # A later row with a known text changes no split; only the named language is replaced.
    spark.createDataFrame([(0, got[1].text, "en", "u"), (10, "e " * 40, "de", "u")], REVIEWS).withColumn("split", F.lit("x")).write.mode("append").parquet(args[0])
    review_tables.run(spark, *args, out, review_tables.read_config(spark) | {"languages": ["en"]})
    new = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(new) == [0, 4, 7, 8, 9] and new[0].split == got[1].split and new[0].n_copies == 4


def test_review_table_splits_follow_texts(spark, tmp_path):
    out = f"{tmp_path}/out"
    review_tables.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", out)
    for r in spark.read.parquet(out).collect():
        share = int(hashlib.md5(f"reviews-1:{r.review_md5}".encode()).hexdigest()[:8], 16) % 100
        assert r.split == ("dev" if share < 10 else "test" if share < 20 else "train") and r.n_chars == len(r.text)


def test_review_table_refuses_repeated_ids(spark, made):
    spark.createDataFrame([(1, "x", "en", "s")], REVIEWS).withColumn("split", F.lit("x")).write.mode("append").parquet(f"{made}/reviews")
    with pytest.raises(DuplicateKeyError):
        review_tables.run(spark, f"{made}/reviews", f"{made}/labels", f"{made}/out")


def test_empty_inputs(spark, tmp_path):
    spark.createDataFrame([], REVIEWS).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/l")
    assert facet_mentions.run(spark, f"{tmp_path}/r", f"{tmp_path}/m", f"{tmp_path}/c")["wrote"] == 0
    guard = review_tables.build(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/l"), review_tables.read_config(spark))
    assert guard.count() == 0


def test_command_lines(tmp_path):
    """Each job as its own process with a configuration of its own."""
    root = Path(review_tables.__file__).resolve().parents[1]
    shutil.copy(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    (tmp_path / "config.json").write_text(json.dumps({"facets": {"any": "[a-z]"}}))
    args = [sys.executable, f"{root}/jobs/facet_mentions.py", "--reviews", f"{tmp_path}/documents.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/config.json"]
    said = subprocess.run(args, check=True, capture_output=True, text=True, timeout=300, cwd=tmp_path).stderr
    assert "wrote" in said and (tmp_path / "out/facet=any").is_dir()
    args = [sys.executable, f"{root}/jobs/review_tables.py", "--reviews", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--out", f"{tmp_path}/tables"]
    said = subprocess.run(args, check=True, capture_output=True, text=True, timeout=300, cwd=tmp_path).stderr
    assert "read 200 rows" in said and list((tmp_path / "tables").glob("lang=*/split=train/*.parquet"))
