"""License scan, quality rules and personal data against plain versions, with odd inputs."""

import itertools
import time

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm import license_scan, oracles, pii, quality_rules

ODD = [
    None,
    "",
    " \t\n",
    "!!! ### $$$",
    "Released under the MIT License. Under-the-MIT-license! x Apache License, Version 2.0; CC BY-NC 4.0 cc.by.nc",
    "under the mit under the mit license",
    "apache license version 20",
    "This work is licensed under the GNU General Public License, version 3.",
    "a@b.co_x@d.com a@b a.@x.y.z 1.2.3.4.5.6.7.8 256.1.1.1 000.01.1.1 999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 +1 (706) 555-3138 +12 call +4915112345678",
    "1" * 5000,
    "x" * 20000 + "@y.z " + "9 " * 3000,
    "IBAN DE89 3704 0044 0532 0130 00 account; DE88 3704 0044 0532 0130 00; token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
    "one two three four five six one two three four five six",
    "l\nl\n\nl\n \nm",
    "é ñ ü 日本語 😀 \x00\x1f\x7f",
    "word " * 4000,
    "\n".join(license_scan.TEMPLATES[0][1].upper()[i : i + 60] for i in range(0, 900, 60)),  # wrapped inside words
    "Copyright 2001\n" + license_scan.TEMPLATES[0][1].replace(" the ", " THE\n * "),
    license_scan.GNU.format("Lesser General Public License", "3") + " under the m\u0130t l\u0131cense; \u212aey",
    "not a license: the gnu public broadcast, general version 3 of the creative apache " * 50,
    "token abc " + "0123456789abcdef" * 2 + " filler" * 8 + " commit " + "fedcba9876543210" * 3 + " ssn 123-45-6789, 900-12-3456 call 321-54-9876x " + "GB82WEST12345698765432",
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 7, "extra") for i, t in enumerate(ODD)]
    data += [(100 + i, ODD[4], "de", "s", 7, "extra") for i in range(3)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words int, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def text_of(i):
    return ODD[4] if i >= 100 else ODD[i]


def twin(docs, sql):
    """The rows of a SQL twin over a DataFrame's documents."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def same(got, want):
    cell = lambda v: round(float(v), 9) if isinstance(v, (int, float)) else v
    rows = lambda x: sorted((tuple(cell(r[c]) for c in sorted(want[0])) for r in x), key=str)
    assert rows(got) == rows(want)


def test_license(docs, empty):
    got = license_scan.scan(docs).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence(text_of(r["doc_id"])), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    same(got, twin(docs, oracles.license_sql()))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert "gpl-3" in labels[7] and labels[6] == "" and labels[0] == "" and labels[17] == "" and labels[18] == "mit" and "lgpl" in labels[19] and labels[20] == ""
    assert license_scan.scan(empty).count() == 0


def test_license_places_grow_with_the_text(spark):
    text = "Released under the MIT License and under the Apache License, Version 2.0 or some. "
    docs = lambda n: spark.createDataFrame([(1, text * n)], "doc_id long, text string").coalesce(1)
    license_scan.scan(docs(10)).collect()
    took = []
    for n in (500, 4000):
        began = time.perf_counter()
        r = license_scan.scan(docs(n)).first()
        took.append(time.perf_counter() - began)
        assert (r["n_base"], r["labels"], r["last_word"]) == (2 * n, "apache-2,mit", 15 * n - 7)
    assert took[1] < 20 * max(took[0], 0.5)


def test_rules(docs, empty):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        want = brute.rules(text_of(r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r
        assert not (r["base_failed"] and r["kept"])
    base = quality_rules.judge(docs).drop("kept", "distance2")
    same(base.collect(), twin(docs, oracles.rules_base_sql()))
    assert quality_rules.judge(empty).count() == 0


def test_rules_against_plain_estimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "").otherwise("src"))
    rows = docs.collect()
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    dims = len(quality_rules.VECTOR)
    scale = quality_rules.SUBSET / quality_rules.chi2_cdf(quality_rules.chi2_quantile(quality_rules.SUBSET, dims), dims + 2)
    d2 = brute.outliers([(r["text"], f"{r['lang']}/{r['source']}", r["lang"]) for r in rows], list(quality_rules.VECTOR.values()), quality_rules.SUBSET, quality_rules.STEPS, quality_rules.PSEUDO, scale, quality_rules.REST)
    cutoff = quality_rules.chi2_quantile(1 - quality_rules.ALPHA, dims)
    for r, d in zip(rows, d2):
        got = found[r["doc_id"]]
        assert abs(got["distance2"] - d) < 1e-6 * max(d, 1), r["doc_id"]
        assert got["kept"] == (not brute.rules(r["text"])[-1] and d <= cutoff)
    assert 0 < sum(r["kept"] for r in found.values()) < len(rows)


def test_rules_least_determinant(spark):
    """In small groups the determinant is that of the best of all halves, found by trying each."""
    rng = np.random.default_rng(5)
    dims, ridge = len(quality_rules.VECTOR), np.diag(np.array(list(quality_rules.VECTOR.values())) ** 2)
    scale = quality_rules.SUBSET / quality_rules.chi2_cdf(quality_rules.chi2_quantile(quality_rules.SUBSET, dims), dims + 2)
    lost = []
    for case in range(4):
        clean, far = rng.normal(size=(9, dims)) * 0.3, rng.normal(size=(5, dims)) + 3 + case
        z = np.concatenate([clean, far])
        least = min(np.linalg.slogdet(scale * np.cov(z[list(half)].T, bias=True) + ridge)[1] for half in itertools.combinations(range(14), 7))
        rows = spark.createDataFrame([("=x", "=y", x.tolist()) for x in z], "g_lang string, g_source string, z array<double>")
        model, _ = quality_rules.estimates(rows)
        lost.append(model.first()["logdet"] - least)
        assert model.count() == 1 and all(d["d2"] > 20 for d in quality_rules.outliers(rows).collect() if d["z"][0] in far[:, 0])
    assert max(lost) < 1.0, lost  # rows of one histogram cell go together, so a half may hold a few more


def test_rules_reject_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 3) % 97}{j}" for j in range(60 + i % 40)) + ".", "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{j}###" for j in range(60)), "en", "s") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_chi2():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_pii(docs, empty):
    got = pii.find(docs).collect()
    for r in got:
        text = text_of(r["doc_id"])
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) == brute.pii(text), r["doc_id"]
        said = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in said if k not in pii.BASE] == brute.more_spans(text)
        assert r["n_spans"] == len(said) and all(0 <= float(x) <= 1 for x in r["scores"].split(",") if x) and len(r["scores"].split(",")) == max(len(said), 1)
    same([{c: r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")} for r in got], twin(docs, oracles.pii_base_sql()))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[12].count("iban") == 1 and "secret" in spans[12] and spans[21].count("secret") == 1 and spans[21].count("ssn") == 2
    assert pii.find(empty).count() == 0


def test_pii_with_many_matches(spark):
    """Places by lots of matches are those of one running sum, and time grows with the text."""
    one = "mail a@b.example from 10.0.0.1, card 4111 1111 1111 1111 or call +1 (706) 555-3138; "
    docs = lambda n: spark.createDataFrame([(1, one * n)], "doc_id long, text string").coalesce(1)
    pii.find(docs(2)).collect()
    took = []
    for n in (1000, 8000):
        began = time.perf_counter()
        r, text = pii.find(docs(n)).first(), pii.redact(docs(n)).first()["text"]
        took.append(time.perf_counter() - began)
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) == brute.pii(one * n)
        assert text == "mail [EMAIL] from [IP], card [CARD] or call [PHONE]; " * n
    assert took[1] < 20 * max(took[0], 0.5)


def test_redact(spark, docs):
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {i: brute.redacted(text_of(i)) for i in got}
    assert got[0] is None and got[1] == "" and "555" not in got[9] and "[PHONE]" in got[9] and got[14] == ODD[14]
    assert pii.redact(docs).columns == docs.columns


def test_sample_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence(texts[r["doc_id"]])
    for r in pii.find(docs).collect():
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) == brute.pii(texts[r["doc_id"]])
