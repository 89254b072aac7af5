"""Facets matched by meaning: threshold pairs, the encoder's canary, scores."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from facetmill.operators import dense, scores, semantic

from test_retrieval import vectors


def letters(texts):
    """An encoder: letter pairs of the text without its last two letters."""
    out = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        s = f" {t[:-2]} "
        for a, b in zip(s, s[1:]):
            out[i, (ord(a) * 31 + ord(b)) % 64] += 1
    return out.tolist()


def broken(texts):
    return np.random.default_rng().normal(size=(len(texts), 64)).tolist()


def hollow(texts):
    return np.full((len(texts), 4), np.nan).tolist()


@pytest.mark.parametrize("block,cells,threshold", [(2048, 256, 0.8), (16, 5, 0.99), (7, 1, 0.5), (40, 30, 0.999999)])
def test_threshold_pairs_against_plain(spark, block, cells, threshold):
    rows = [(i, v) for i, v in vectors(250) if v is not None]
    x = dense.unit(np.array([v for _, v in rows], np.float64))
    s = x @ x.T
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] < rows[j][0] and s[i, j] >= threshold}
    df = spark.createDataFrame([*rows, (999, None)], "id long, v array<float>").repartition(3)
    got = [(r.a, r.b) for r in semantic.threshold_pairs(df, threshold, "id", "v", cells, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert semantic.threshold_pairs(df.limit(0), threshold, "id", "v").count() == 0


def test_every_facet_is_encoded_once_and_checked(spark):
    facets = spark.createDataFrame([("fit",), ("fit",), ("fitting",), (None,)], "facet string").repartition(3)
    assert semantic.facet_vectors(facets, letters).count() == 2
    for wrong in (broken, hollow):
        with pytest.raises(PythonException, match="EncoderError"):
            many = spark.createDataFrame([(f"f{i}",) for i in range(600)], "facet string").coalesce(1)
            semantic.facet_vectors(many, wrong)


def test_scores_by_meaning(spark):
    kind = "asin string, review_no int, aspects array<struct<facet:string,polarity:string>>"
    gold = spark.createDataFrame([("a", 1, [("sizing", "positive"), ("colour", "negative")]), ("b", 1, [("price", "neutral")]), ("c", 1, []), ("d", 1, [("warmth", "positive")])], kind)
    pred = spark.createDataFrame([("a", 1, [("sizer", "positive"), ("coloxx", "positive"), ("weight", "negative")]), ("b", 1, [("price", "neutral"), ("pricey", "positive")]), ("c", 1, [("fit", "positive")])], kind)
    got = {r.asin: (r.tp, r.fp, r.fn, r.polarity_hits, list(r.fp_facets)) for r in semantic.semantic_scores(gold, pred, ["asin", "review_no"], letters, 0.65).collect()}
    # "sizing" meets "sizer", "colour" meets "coloxx" with another polarity; one gold facet is taken once.
    assert got == {"a": (2, 1, 0, 1, ["weight"]), "b": (1, 1, 0, 1, ["pricey"]), "c": (0, 1, 0, 0, ["fit"]), "d": (0, 0, 1, 0, [])}
    exact = {r.asin: r.tp for r in scores.example_scores(gold, pred, ["asin", "review_no"]).collect()}
    assert exact == {"a": 0, "b": 1, "c": 0, "d": 0}
