"""Column functions on literal strings."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.functions import parsing as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("number, want", [("0", 0.0), ("2.7", 2.7), ("5", 5.0), ("3.25", 3.25), ("..", None), ("1.0.0", None)])
def test_stars(spark, number, want):
    """One number in the phrasing of each marketplace."""
    for text in (f"{number} out of 5", f"rated {number}  out of\u00a05 by all", f"{number.replace('.', ',')} de 5", f"5つ星のうち {number}", f"5 つ星のうち{number}"):
        got = one(spark, text, P.parse_stars)
        assert got is None if want is None else abs(got - want) < 1e-6, text


def test_stars_without_a_number(spark):
    for text in (None, "", "five of five", "out of 5", "5つ星のうち [2.7]", "2.7 von 5"):
        assert one(spark, text, P.parse_stars) is None, text
    # A comma ends an English number; the first phrasing that fits decides.
    assert abs(one(spark, "2,7 out of 5", P.parse_stars) - 7.0) < 1e-6
    assert abs(one(spark, "1,5 de 5, 2.5 out of 5", P.parse_stars) - 2.5) < 1e-6


@pytest.mark.parametrize("n", [0, 7, 902, 30_415, 2_000_001])
def test_ratings(spark, n):
    """One count in the phrasing of each marketplace, with its separator."""
    comma, dot = f"{n:,}", f"{n:,}".replace(",", ".")
    for text in (f"{comma} ratings", f"{comma} rating", f"all {comma} global ratings", f"{comma} reviews", f"{comma} global review", f"{dot} valoraciones", f"{dot} valoracione", f"{dot} calificaciones", f"{comma}個の評価", f"{comma} 件のグローバル評価"):
        assert one(spark, text, P.parse_ratings) == n, text


def test_ratings_without_a_count(spark):
    for text in (None, "", "ratings", "many ratings", ",, ratings", "99999999999 ratings"):
        assert one(spark, text, P.parse_ratings) is None, text


D = dt.datetime


@pytest.mark.parametrize(
    "text, country, date",
    [
        ("Reviewed in Brazil 🇧🇷n on July 4, 2020", "Brazil", D(2020, 7, 4)),
        ("Reviewed in New Zealand 🇳🇿 on December 31, 2018", "New Zealand", D(2018, 12, 31)),
        ("Reviewed in Ireland 29 February 2020", "Ireland", D(2020, 2, 29)),
        ("Reviewed in Ireland on 29 February 2021", "Ireland", None),
        ("Revisado en Chile el 1 de setiembre de 2017", "Chile", D(2017, 9, 1)),
        ("Comentado en Perú 🇵🇪 el 40 de mayo de 2017", "Perú", None),
        ("Comentado en Cuba el 5 de 09 de 2020", "Cuba", None),
        ("2016年12月1日に台湾でレビュー済み", "台湾", D(2016, 12, 1)),
        ("Reviewed in Kenya on Dec 1, 2016", "Kenya", None),
        ("Reviewed in Sweden on May 2, 2019", "Swede", D(2019, 5, 2)),
        ("", None, None),
        (None, None, None),
        ("on May 2, 2019", None, None),
    ],
)
def test_review_date(spark, text, country, date):
    got = one(spark, text, P.parse_review_date)
    assert (got["country"], got["date"]) == (country, date)


def test_strict_country(spark):
    assert one(spark, "Reviewed in Sweden on May 2, 2019", lambda c: P.parse_review_date(c, True))["country"] == "Sweden"
    assert one(spark, "Reviewed in Taiwan 🇹🇼n on May 2, 2019", lambda c: P.parse_review_date(c, True))["country"] == "Taiwan"


def test_image_url_and_path(spark):
    url = one(spark, "https://a.b/images/I/71x+Y._AC_US500_.jpg", P.canonical_image_url)
    assert url == "https://m.media-amazon.com/images/I/71x+Y._SL256_.jpg"
    assert one(spark, url, P.canonical_image_url) == url
    assert one(spark, "https://a.b/images/G/v.png", P.canonical_image_url) is None
    assert one(spark, "B00ABC", lambda c: P.shard_path(c, "img")) == "img/B0/0A/B00ABC.jpg"


def test_text_helpers(spark):
    assert one(spark, None, P.text_length) == 0 and one(spark, "añ😀", P.text_length) == 3
    assert one(spark, "é😀", P.content_hash) == hashlib.md5("é😀".encode()).hexdigest()
    assert one(spark, "abc", P.stable_uuid) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc"))
    assert one(spark, " a b c d", lambda c: P.word_shingles(c, 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: P.word_shingles(c, 3)) == []
    assert one(spark, "Short. This one is long enough! Yes", P.sentences) == ["This one is long enough!"]
    assert one(spark, "a\x01b\n", P.strip_control) == "ab\n"


@pytest.mark.parametrize(
    "cell, aspects, errors",
    [
        ("Zip \t Pull: NEU; strap : +", [("zip pull", "neutral"), ("strap", "positive")], []),
        (" NONE", [], []),
        (" - ", [], []),
        (" \n", None, []),
        (None, None, []),
        (";;", [], []),
        ("a : b : 0; lace; :neg; sole: fine", [("a : b", "neutral")], [("undivided", "lace"), ("unnamed", ":neg"), ("unrated", "sole: fine")]),
    ],
)
def test_cells(spark, cell, aspects, errors):
    got = one(spark, cell, A.parse_cell)
    assert (None if got["aspects"] is None else [tuple(a) for a in got["aspects"]]) == aspects
    assert [tuple(e) for e in got["errors"]] == errors
    if not errors:
        again = one(spark, cell, lambda c: A.parse_cell(A.format_cell(A.parse_cell(c)["aspects"])))["aspects"]
        assert [tuple(a) for a in again] == (aspects or [])


def test_model_output(spark):
    f = lambda t: one(spark, t, A.parse_model_output)
    assert [tuple(a) for a in f('{"aspects":[{"facet":" Fit ","polarity":"positive"}]}')["aspects"]] == [("fit", "positive", "")]
    assert f('{"aspects":[]}')["aspects"] == [] and f('{"aspects":[{"facet":"x"}]}')["error"] == "bad aspect"
    assert f("{broken")["error"] == "no aspects" and f('{"aspects":[{"facet":"x","polarity":"great"}]}')["error"] == "bad aspect"
    assert one(spark, "hi", lambda c: A.chat_messages(F.lit("sys"), [("u", "a")], c))[3]["content"] == "hi"


def match(spark, pred, gold):
    kind = "array<struct<facet:string,polarity:string>>"
    row = spark.createDataFrame([(pred, gold)], f"p {kind}, g {kind}").select(A.greedy_match(F.col("p"), F.col("g")).alias("m")).first()["m"]
    return row


def test_greedy_match(spark):
    m = match(spark, [("a", "neg"), ("a", "pos"), ("a", "pos")], [("a", "pos"), ("a", "neg")])
    assert (m["tp"], m["fp"], m["fn"], m["polarity_hits"]) == (2, 1, 0, 0)
    assert m["fp_facets"] == ["a"] and len(m["polarity_errors"]) == 2
    m = match(spark, None, [("a", "pos"), ("b", "pos")])
    assert (m["tp"], m["fp"], m["fn"], m["fn_facets"]) == (0, 0, 2, ["a", "b"])
    m = match(spark, [("a", "pos")], [])
    assert (m["tp"], m["fp"], m["fn"]) == (0, 1, 0)
    assert match(spark, [("b", "pos")], [("a", "pos"), ("b", "pos")])["fn_facets"] == ["a"]
