"""Operators on small tables."""

import random
import math
import hashlib
import pytest
from pyspark.sql import functions as F

from facetmill.operators import buckets, extraction, gold, guards, inspect, ranking, scores, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_buckets(spark):
    data = [("p1", ["A", "B", "C"], 600), ("p2", ["A", "B", "D"], 600), ("p3", ["A", "E"], 300), ("p4", ["F"], 100), ("p5", [], 50)]
    df = spark.createDataFrame(data, "product_id string, category array<string>, n_reviews int")
    got = {r["product_id"]: r["bucket"] for r in buckets.assign_buckets(df, 1000).collect()}
    assert got == {"p1": ["A", "B"], "p2": ["A", "B"], "p3": ["A"], "p4": ["__global__"], "p5": ["__global__"]}
    low = {r["product_id"]: r["bucket"] for r in buckets.assign_buckets(df, 200).collect()}
    assert low["p3"] == ["A", "E"] and low["p1"] == ["A", "B", "C"]
    levels = {r["level"]: r for r in buckets.level_statistics(df, 3).collect()}
    assert levels[1]["buckets"] == 3 and levels[3]["buckets"] == 5


def build_inputs(spark, dup=False):
    j = spark.createDataFrame([(1, "q", "a", "us", 1, "E", "train"), (1, "q", "b", "us", 1, "Z", "train"), (2, "r", "c", "us", 0, "S", "test"), (3, "s", "a", "es", 1, "I", "test")], "query_id int, query string, product_id string, product_locale string, small_version int, esci_label string, split string")
    c = spark.createDataFrame([("a", "us", "A"), ("b", "us", "B"), ("c", "us", "C"), ("a", "es", "AA")], "product_id string, product_locale string, product_title string")
    m = [("a", "us"), ("c", "us")] + ([("a", "us")] if dup else [])
    s = spark.createDataFrame([(*x, "t", "x", ["k"], "k", 4.0, 1, 2, "1", "u", 0) for x in m], "asin string, locale string, type string, template string, category array<string>, cat_top string, stars float, n_ratings int, n_reviews int, price string, image string, n_attrs int")
    return j, c, s


def test_build(spark):
    j, c, s = build_inputs(spark)
    products = tables.build_products(j, c, s)
    assert [r["product_id"] for r in products.collect()] == ["a"]
    assert rows(tables.build_qrels(j, products).select("query_id", "product_id", "gain")) == [(1, "a", 1.0)]
    reviews = spark.createDataFrame([("a", 5.0, "t", "x"), ("z", 1.0, "t", "y")], "asin string, stars double, title string, text string")
    out = tables.build_reviews(reviews, products)
    assert out.columns == ["asin", "rev_stars", "rev_title", "text"] and out.count() == 1
    with pytest.raises(guards.DuplicateKeyError):
        tables.build_products(*build_inputs(spark, dup=True))


def test_numbering_keeps_gaps(spark):
    df = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, " \t"), ("a", 2, 0, "y"), ("b", 3, 0, None)], "asin string, ord long, pos int, text string")
    assert rows(tables.number_reviews(df).select("asin", "review_no")) == [("a", 0), ("a", 2)]


def test_numbering_of_hot_keys(spark):
    """Keys that are numbered by ranges, the null key too, have the numbers that a plain count gives."""
    keys = ["hot"] * 300 + [None] * 60 + ["b"] * 3 + ["c"]
    data = [(k, (i * 7919) % 1009, i % 3, " " if i % 5 == 0 else f"t{i}", i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "asin string, ord long, pos int, text string, place int").repartition(6)
    want = []
    for k in set(keys):
        mine = sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])
        want += [(*r, i) for i, r in enumerate(mine) if r[3].strip()]
    for hot_rows in (50, 1000):
        got = tables.number_reviews(df, hot_rows=hot_rows)
        assert got.columns == [*df.columns, "review_no"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tables.number_reviews(df.limit(0), hot_rows=50).count() == 0


def test_placeholders(spark):
    data = [("p1", "ok", "m"), ("p2", "skip", "m"), ("p3", "http_error", "m"), ("p4", "ok", "m"), ("p5", "ok", "u"), ("p6", "ok", None)]
    out = tables.mark_placeholders(spark.createDataFrame(data, "product_id string, status string, md5 string"), 3)
    got = {r["product_id"]: (r["cluster_size"], r["is_placeholder"], r["usable"]) for r in out.collect()}
    assert got["p1"] == (4, True, False) and got["p5"] == (1, False, True) and got["p6"] == (0, False, True)


def test_gold_splits(spark):
    data = [(f"a{i % 200}", i, "x" * (10 if i % 17 == 0 else 500 if i % 13 == 0 else 100) + str(i), "Australia" if i % 11 == 0 else gold.HOME, str(1 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(data, "asin string, review_no int, text string, country string, stars string")
    df = df.withColumn("stratum", gold.stratum(F.col("text"), F.col("country"), F.col("stars")))
    out = gold.gold_splits(df, 50, 60, "7")
    got = out.collect()
    test, dev = {r["asin"] for r in got if r["split"] == "test"}, [r for r in got if r["split"] == "dev"]
    assert len([r for r in got if r["split"] == "test"]) == 60 and len(dev) == 50
    assert not test & {r["asin"] for r in dev} and {r["stratum"] for r in dev} == set(gold.STRATA)
    assert sorted(map(tuple, got)) == sorted(map(tuple, gold.gold_splits(df.repartition(7), 50, 60, "7").collect()))
    with pytest.raises(ValueError):
        gold.gold_splits(df, 50, 401)


def test_sheet(spark):
    cols = "asin string, review_no string, flag string, reviewed string, gold_aspects string, draft_aspects string"
    sheet = spark.createDataFrame([("a", "1", "", "x", "fit: pos", "fit: neg; size: pos"), ("a", "2", "unsure", "x", "", ""), ("a", "3", "", "OK", "", ""), ("a", "4", "", "yes", "fit: x", ""), ("a", "5", "bad", "x", "none", ""), ("b", "1", "", "x", "none", ""), ("a", "6", "", "", "none", "")], cols)
    manifest = spark.createDataFrame([("a", i, "dev") for i in range(1, 7)], "asin string, review_no int, split string")
    judged = gold.judge_sheet(sheet, manifest)
    assert {(r["asin"], r["review_no"]): r["outcome"] for r in judged.collect()} == {("a", 1): "frozen", ("a", 2): "unsure", ("a", 3): "blank_gold", ("a", 4): "parse_error", ("a", 5): "bad_flag", ("b", 1): "not_in_manifest", ("a", 6): "unreviewed"}
    a = gold.agreement(judged.where("outcome = 'frozen'")).first()
    assert (a["rows_compared"], a["rows_unchanged"], a["facets_added"], a["facets_removed"], a["polarity_changed"]) == (1, 0, 0, 1, 1)


def chat(text):
    if "boom" in text:
        raise RuntimeError("down")
    return '{"aspects":[{"facet":"fit","polarity":"positive","evidence":"e"}]}' if "fit" in text else '{"aspects":[]}'


def test_extraction(spark):
    df = spark.createDataFrame([("a", 1, "fit ok"), ("a", 2, "fit ok"), ("b", 1, "boom"), ("b", 2, "boom"), ("c", 1, "plain"), ("d", 1, "old")], "asin string, review_no int, text string")
    empty = spark.createDataFrame([], extraction.RECORD)
    log = extraction.extract(df.where("asin = 'd'"), empty, chat)[0]
    log = spark.createDataFrame(log.collect(), extraction.RECORD)
    more = df.unionByName(spark.createDataFrame([("e", 1, "old")], df.schema))
    new, judged = extraction.extract(more, log, chat)
    counts = {r["outcome"]: r["n"] for r in extraction.outcome_counts(judged).collect()}
    assert counts == {"extracted": 2, "cached": 2, "failed": 1, "failed_dupes": 1, "skipped": 1}
    table = extraction.compact(log.unionByName(new))
    assert {(r["asin"], r["review_no"], r["facet"]) for r in table.collect()} == {("a", 1, "fit"), ("a", 2, "fit"), ("c", 1, None), ("d", 1, None), ("e", 1, None)}


def test_log_lines(spark):
    good = '{"asin":"a","review_no":1,"review_md5":"m","aspects":[]}'
    lines = spark.createDataFrame([(1, good), (2, ""), (3, '{"asin":"a","rev'), (4, good.replace('"m"', '"n"'))], "o int, value string")
    assert [r["review_md5"] for r in extraction.read_log(lines, "value", "o").collect()] == ["n"]


def test_scores_defaults(spark):
    kind = "k int, aspects array<struct<facet:string,polarity:string>>"
    g = spark.createDataFrame([(1, []), (2, [("a", "pos")])], kind)
    p = spark.createDataFrame([(3, [("z", "pos")])], kind)
    ex = scores.example_scores(g, p, ["k"])
    assert {r["k"]: r["f1"] for r in ex.collect()} == {1: 1.0, 2: 0.0}
    m = scores.micro_scores(ex).first()
    assert (m["facet_precision"], m["facet_recall"], m["facet_f1"], m["polarity_accuracy"]) == (0.0, 0.0, 0.0, None)


def test_ranking(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 0.0), (1, 2, 2.0, 1.0), (2, 1, 1.0, 0.0)], "q int, d int, s double, g double")
    got = ranking.ndcg(df, "q", [F.desc("s")], "g").collect()
    assert len(got) == 1 and abs(got[0]["ndcg"] - 1 / 1.5849625) < 1e-6
    assert len(ranking.factorial_cells(["a", "b", "c"])) == 7


def test_facet_vocabulary_drops_close_ones(spark):
    data = [("b", "size", [1.0, 0.0])] * 3 + [("b", "sizing", [0.99, 0.05])] * 2 + [("b", "color", [0.0, 1.0])]
    df = spark.createDataFrame(data, "bucket string, facet string, v array<double>")
    got = ranking.facet_vocabulary(df, "bucket", "facet", "v").orderBy("place").collect()
    assert [r["facet"] for r in got] == ["size", "color"]


def test_schema_profile(spark):
    df = spark.createDataFrame([('{"a":1,"b":""}',), ('{"a":"x","b":null}',), ('{"c":[]}',)], "j string")
    got = {r["key"]: (r["present_pct"], r["filled_pct"], r["types"]) for r in inspect.schema_profile(df, "j").collect()}
    assert got["a"] == (66.6667, 66.6667, "bigint,string") and got["b"][1] == 0.0 and got["c"][:2] == (33.3333, 0.0)


def test_merge_drafts(spark):
    sheet = spark.createDataFrame([("a", 1, "", ""), ("a", 2, "old", "keep: pos")], "asin string, review_no int, draft_aspects string, gold_aspects string")
    drafts = spark.createDataFrame([("a", 1, "x: pos"), ("a", 2, "y: neg")], "asin string, review_no int, draft string")
    assert rows(gold.merge_drafts(sheet, drafts)) == [("a", 1, "x: pos", "x: pos"), ("a", 2, "y: neg", "keep: pos")]


def test_bm25_whole_queries(spark, tmp_path):
    """Against brute force: all words of the items count, also where two texts share short ones only."""
    import math
    import re
    from collections import Counter

    from facetmill.plans import catalogue

    docs = {1: "The cat sat on the mat.", 2: "A dog and a cat, wonderful animals", 3: "wonderful weather", 4: ""}
    items = {7: "the cat or the dog", 8: "wonderful mat", 9: "of it"}
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame([*rows.items()], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    split = {k: re.findall("[a-z]+", t.lower()) for k, t in docs.items()}
    mean = sum(map(len, split.values())) / len(split)
    want = {}
    for item, text in items.items():
        for word in set(re.findall("[a-z]+", text.lower())):
            df = sum(word in w for w in split.values())
            for doc, w in split.items():
                if tf := Counter(w)[word]:
                    part = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    want[item, doc] = want.get((item, doc), 0) + part
    got = {(r["item_id"], r["doc_id"]): r["bm25"] for r in catalogue.queries()["bm25_all_words"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and (7, 1) in got and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def plain_bm25(docs, items):
    """Brute force; rows of one id and length count as one document, as the SQL of the query groups them."""
    from collections import Counter

    held = {}
    for d, w in docs:
        if w is not None:
            held.setdefault((d, len(w)), Counter()).update(w)
    sizes = [len(w) for _, w in docs if w is not None]
    out = {}
    for item, words in items:
        for word in set(words or ()):
            df = sum(word in c for c in held.values())
            for (d, size), c in held.items():
                if c[word]:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    out[item, d] = out.get((item, d), 0) + idf * c[word] * 2.2 / (c[word] + 1.2 * (0.25 + 0.75 * size * len(sizes) / sum(sizes)))
    return out


@pytest.mark.parametrize("block, cells, twice", [(20_000, 1 << 20, False), (2, 3, False), (3, 7, True)])
def test_bm25_shuffles_no_pairs(spark, monkeypatch, block, cells, twice):
    """A document is scored where it is read; null and empty ones, words of no query, blocks of queries and ids
    that come twice."""
    monkeypatch.setattr(ranking, "BM25_QUERIES", block, raising=False)
    monkeypatch.setattr(ranking, "BM25_CELLS", cells, raising=False)
    rng = random.Random(5)
    some = lambda: [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]
    docs = [(i, some()) for i in range(60)] + [(60, None), (61, []), (62, ["z"])]
    if twice:
        docs += [(1, docs[1][1]), (2, ["a", "b"]), (2, ["c", "b"])]
    items = [(f"q{i}", some()) for i in range(7)] + [("none", []), ("null", None)]
    d = spark.createDataFrame(docs, "id int, w array<string>").repartition(3)
    q = spark.createDataFrame(items, "q string, w array<string>")
    got = ranking.bm25(d, q, "id", "w", "q", "w")
    want = plain_bm25(docs, items)
    rows_ = got.collect()
    assert len(rows_) == len(want) and all(abs(r["bm25"] - want[r["q"], r["id"]]) < 1e-9 for r in rows_)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert twice or "hashpartitioning" not in plan
    assert ranking.bm25(d, q.where("q = ''"), "id", "w", "q", "w").collect() == []
    assert ranking.bm25(d.where("id < 0"), q, "id", "w", "q", "w").collect() == []


def test_bootstrap_against_plain_draws(spark):
    units = [(i * 7 % 50, i, 0.5 * i) for i in range(50)]
    df = spark.createDataFrame(units, "k int, n_hits int, d double").repartition(5)
    got = {r["b"]: r for r in scores.bootstrap(df, ["k"], ["n_hits", "d"], 40, 3).collect()}
    ordered = sorted(units)
    for b in range(40):
        at = scores.draws(b, 50, 3)
        assert (got[b]["n"], got[b]["n_hits"]) == (50, sum(ordered[i][1] for i in at)) and abs(got[b]["d"] - sum(ordered[i][2] for i in at)) < 1e-9
    assert len({tuple(scores.draws(b, 50)) for b in range(40)}) == 40
    assert scores.bootstrap(df.where("k < 0"), ["k"], ["d"], 5).count() == 0
    spread = [scores.draws(b, 1000).tolist() for b in range(200)]
    mean = [len(set(x)) / 1000 for x in spread]  # with replacement 1 - 1/e of the units are drawn
    assert abs(sum(mean) / 200 - 0.632) < 0.01 and abs(sum(map(sum, spread)) / 200_000 - 499.5) < 5


def test_interval(spark):
    df = spark.range(1000).select((F.col("id") * 17 % 1000).cast("double").alias("v"))
    r = scores.interval(df, "v", 1000).first()
    assert (r["lo"], r["hi"]) == (25.0, 975.0) and abs(r["lo_i"] - 24.975) < 1e-9


def test_spearman_by_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(guards, "RANGES", 5)
    rng = random.Random(1)
    data = [(rng.choice([1.5, 2.5, float(i % 40)]), float(rng.randint(0, 300))) for i in range(500)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(data, "a double, b double")

    def ranks(values):
        s = sorted(values)
        return [s.index(v) + (s.count(v) + 1) / 2 for v in values]

    pairs = [p for p in data if None not in p]
    x, y = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert abs(scores.spearman(df, "a", "b").first()["spearman"] - want) < 1e-9


def test_star_curve(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 0.0), (2, 0.0), (3, 0.5)], "star int, v double")
    assert tuple(scores.star_curve(df, "star", "v").first()) == (3, True, 0.5)
    assert scores.star_curve(df.withColumn("v", -F.col("v")), "star", "v").first()["monotone"] is False
    assert scores.star_curve(df.where("star = 1"), "star", "v").first()["monotone"] is True


def test_contained_shingles_against_search(spark):
    items = {1: "One two  three four five", 2: "two three four five six", 3: "a b", 4: "x ONE two three four y"}
    docs = {1: "say everyone two three four fiver", 2: "one two three\nfour five", 3: "ONE TWO THREE FOUR FIVE SIX", 4: "two three", 5: None}
    frame = lambda d, k: spark.createDataFrame([*d.items()], f"{k} long, text string")
    got = {(r["e"], r["doc_id"]): r["shared"] for r in inspect.contained_shingles(frame(items, "e"), frame(docs, "doc_id"), 4, "e").collect()}
    want = {}
    for i, t in items.items():
        w = t.lower().split()
        for run in {" ".join(w[j : j + 4]) for j in range(len(w) - 3)}:
            for d, text in docs.items():
                if text and run in text.lower():
                    want[i, d] = want.get((i, d), 0) + 1
    assert got == want and (1, 1) in got and (1, 2) not in got


def test_max_sim_vectors(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    data = [(i, i % 3, [float(i), float(-i % 5)]) for i in range(12)]
    df = spark.createDataFrame(data, "id int, item int, v array<double>")
    got = {(r["qid"], r["item"]): r["max_sim"] for r in ranking.max_sim_vectors(df, df.where("id < 5"), "item", "v", "id", "v", part="id").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, item): max(dot(qv, v) for i, it, v in data if it == item and i != q) for q, _, qv in data[:5] for item in range(3)}
    assert got == want
    whole = ranking.max_sim_vectors(df, df.where("id = 0"), "item", "v", "id", "v")
    assert whole.count() == 3 and ranking.max_sim_vectors(df, df.where("id < 0"), "item", "v", "id", "v").count() == 0


def test_factorial_effects(spark):
    cells = spark.createDataFrame([("a", 0.5), ("a+b", 0.6), ("a+c", 0.55), ("a+b+c", 0.7), ("b", 0.1)], "cell string, ndcg double")
    got = {(r["kind"], r["term"]): round(r["effect"], 6) for r in ranking.factorial_effects(cells, ("a",), ("b", "c")).collect()}
    assert got == {("marginal", "b"): 0.1, ("marginal", "c"): 0.05, ("interaction", "b+c"): 0.05}


def test_payload_filter(spark):
    df = spark.createDataFrame([("x", 1.0, 5), ("y", 2.0, 9), (None, 3.0, 9)], "brand string, price double, n_ratings int")
    count = lambda **f: df.where(ranking.payload_filter(**f)).count()
    assert (count(), count(equal={"brand": "x"}), count(equal={"brand": ["x", "y"]}), count(at_least={"n_ratings": 6}, at_most={"price": 2.5, "n_ratings": None})) == (3, 1, 2, 1)


def test_guards():
    assert guards.refuse_prefix("run3") == "run3"
    with pytest.raises(ValueError):
        guards.refuse_prefix("v3")


def test_scaling_arms_are_nested(spark):
    out = inspect.scaling_arms(spark.range(300), ["id"])
    arms = {a: {r["id"] for r in out.where(F.col("arm") == a).collect()} for a in (25, 50, 75, 100)}
    assert arms[25] < arms[50] < arms[75] < arms[100] and len(arms[100]) == 300 and 40 < len(arms[25]) < 110


def test_cells_are_ranked_without_dealing_rows_anew(spark):
    """Items that a channel lacks, equal scores, several rows of an item, against plain Python; rows dealt by
    query are shuffled no more but for the totals."""
    rng = random.Random(4)
    rows = [(q, i, c, float(rng.randint(0, 4)), {0: 1.0, 1: 0.1}.get((q * 7 + i * 3) % 5, 0.0)) for q in range(30) for i in range(rng.randint(1, 14)) for c in "abc" if rng.random() < 0.6 for _ in range(rng.choice((1, 1, 2)))]
    cells = {"a": ("a",), "b+c": ("b", "c"), "all": ("a", "b", "c"), "blind": (), "none": ("z",)}
    df = spark.createDataFrame(rows, "q int, item int, channel string, score double, gain double").repartition("q")
    out = ranking.cell_scores(df, cells, "q", "item", "gain", 3, "5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    want, gain = {}, {(q, i): g for q, i, _, _, g in rows}
    for name, names in cells.items():
        found = []
        for q in range(30):
            at = {}
            for c in names:
                mine = sorted([r for r in rows if r[0] == q and r[2] == c], key=lambda r: (-r[3], r[1]))
                for n, r in enumerate(mine, 1):
                    at.setdefault(r[1], []).append(1 / (60 + n))
            if names:
                order = sorted(at, key=lambda i: (-round(sum(at[i]) / len(at[i]), 12), i))
            else:
                order = sorted({i for p, i in gain if p == q}, key=lambda i: hashlib.md5(f"5:{q}:{i}".encode()).hexdigest())
            dcg = lambda gains: sum(g / math.log2(n + 1) for n, g in enumerate(gains[:3], 1))
            gains = [gain[q, i] for i in order]
            if sum(gains) > 0:
                found.append(dcg(gains) / dcg(sorted(gains, reverse=True)))
        if found:
            want[name] = (round(sum(found) / len(found), 9), len(found))
    assert {r.cell: (round(r.ndcg, 9), r.queries) for r in out.collect()} == want and "none" not in want
    assert plan.count("Exchange hashpartitioning") <= 1 and "Generate explode" not in plan
