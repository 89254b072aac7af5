"""Search through indexes against plain scans."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from facetmill.operators import dense, lexical, multivector, ranking
from facetmill.plans import catalogue


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = ["the", "of"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(120)]
    pick = lambda: words[min(int(rng.expovariate(0.06)), len(words) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "The THE, the!"), *[(n + 3 + j, docs[7][1]) for j in range(30)], (n + 40, "of " * 3000)]
    queries = [(q, " ".join(pick() for _ in range(rng.randint(1, 12)))) for q in range(20)] + [(90, "unheardof"), (91, None), (92, docs[7][1]), (93, "the of")]
    return docs, queries


def plain_bm25(docs, queries, k, k1=1.2, b=0.75):
    split = lambda t: re.findall("[a-z]+", (t or "").lower())
    held = {i: split(t) for i, t in docs}
    average = sum(map(len, held.values())) / len(held)
    tf = {i: Counter(w) for i, w in held.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = set()
    for q, t in queries:
        score = Counter()
        for w in dict.fromkeys(split(t)):
            rarity = math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in tf.items():
                if c[w]:
                    score[i] += rarity * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(held[i]) / average))
        best = sorted(((round(s, 6), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(q, i, r, round(s, 5)) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("parts,block,shard,first,k", [(1, 256, 16_384, 16, 10), (7, 4, 20, 3, 5), (3, 1, 8, 2, 1), (5, 16, 50, 4, 400)])
def test_lexical_search_against_plain(spark, parts, block, shard, first, k):
    docs, queries = corpus()
    df, asked = spark.createDataFrame(docs, "id long, text string").repartition(parts), spark.createDataFrame(queries, "q long, text string")
    index = lexical.build_index(df, "id", "text", block=block, shard_docs=shard)
    got = lexical.search(index, asked, "q", "text", k, first)
    assert {(r.qid, r.doc, r["rank"], round(r.score, 5)) for r in got.collect()} == plain_bm25(docs, queries, k)


def test_lexical_words_of_queries_only(spark, monkeypatch):
    docs, queries = corpus(120)
    df, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    only = spark.createDataFrame([(w,) for _, t in queries for w in (t or "").split()], "word string")
    index = lexical.build_index(df, "id", "text", only)
    assert {r.word for r in index.blocks.select("word").distinct().collect()} <= {w for _, t in queries for w in (t or "").lower().split()} | {""} | {"the", "of"}
    monkeypatch.setattr(lexical, "QUERIES", 7)  # several blocks of queries
    got = lexical.search(index, asked, "q", "text", 4)
    assert {(r.qid, r.doc, r["rank"], round(r.score, 5)) for r in got.collect()} == plain_bm25(docs, queries, 4)
    assert lexical.search(index, asked.limit(0), "q", "text", 4).count() == 0
    none = lexical.build_index(df.limit(0), "id", "text")
    assert lexical.search(none, asked, "q", "text", 4).count() == 0


def test_lexical_blocks_are_left_out():
    """A threshold and falling impacts spare blocks, of a frequent word nearly all."""
    n, block, rng = 20_000, 128, np.random.default_rng(0)
    sizes = rng.uniform(50, 150, n)
    weigh = lambda tf, size: lexical.impact(tf, size, 100.0, 1.2, 0.75)

    def blocks(at, tf):
        u = weigh(tf.astype(float), sizes[at])
        order = np.lexsort((at, -u))
        at, tf, u = at[order].astype(np.int32), tf[order].astype(float), u[order]
        return [(float(u[i]), at[i : i + block], tf[i : i + block]) for i in range(0, len(at), block)]

    rare = rng.choice(n, 200, replace=False)
    held = {"rare": blocks(rare, rng.integers(1, 9, 200)), "the": blocks(np.arange(n), rng.integers(1, 4, n))}
    for words, most in (([("the", 0.01)], 6), ([("rare", 4.0)], 2), ([("rare", 4.0), ("the", 0.01)], 159), ([("the", 2.0), ("rare", 0.5)], 120)):
        place, score, read = lexical.best_of_shard(held, sizes, words, 5, 0.0, weigh)
        full = np.zeros(n)
        for w, r in words:
            for _, at, tf in held[w]:
                full[at] += r * weigh(tf, sizes[at])
        want = np.round(np.sort(full)[::-1][:5], 6)
        assert (np.sort(score)[::-1][:5] == want).all() and set(np.argsort(-full)[:5]) <= set(place) and read <= most
        assert lexical.best_of_shard(held, sizes, words, 5, float(want[-1]), weigh)[2] <= read


def vectors(n=600, width=16, groups=12, seed=4):
    """Clustered vectors with copies, near copies, a vector of zeros and one without a vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.4
    x[10:40] = x[9]
    x[50:60] = x[49] + rng.normal(size=(10, width)) * 1e-7
    x[70] = 0
    return [(i, None if i == 71 else v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def plain_nearest(rows, queries, k, own=False):
    held = [(i, np.array(v, np.float64)) for i, v in rows if v is not None]
    x = dense.unit(np.array([v for _, v in held]))
    out = {}
    for q, v in queries:
        if v is None:
            continue
        s = np.round(x @ dense.unit(np.array([v], np.float64))[0], 6) + 0.0
        best = sorted(((-a, i) for a, (i, _) in zip(s.tolist(), held) if not own or i != q))[:k]
        out[q] = [i for _, i in best]
    return out


def found_by(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.item)
    return out


@pytest.mark.parametrize("parts,lists,probes,k,block", [(1, 12, 2, 5, 1024), (8, 5, 1, 7, 16), (3, 1, 4, 40, 64), (4, 50, 3, 1, 8)])
def test_dense_index_against_plain(spark, parts, lists, probes, k, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, v array<float>")
    index = dense.build_index(df.repartition(parts), "id", "v", lists, block=block)
    for own in (False, True):
        found, report = dense.search(index, df, df.where("id % 20 = 9 OR id IN (70, 71)"), "id", "v", k, probes, exclude_self=own)
        assert found_by(found) == plain_nearest(rows, [(i, v) for i, v in rows if i % 20 == 9 or i in (70, 71)], k, own)
        shares = [r.share for r in report.collect()]
        assert len(shares) == 31 and max(shares) <= 1
        if lists == 12:  # clustered vectors: angles tell most lists apart
            assert sorted(shares)[len(shares) // 2] < 0.5


def test_dense_index_probed_only(spark):
    """The approximate search on clustered vectors: recall and share of a few lists."""
    rows = vectors(2000, 32, 25)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    index = dense.build_index(df, "id", "v", 25)
    queries = df.where("id % 20 = 1")
    found, report = dense.search(index, df, queries, "id", "v", 10, probes=4, exact=False)
    got, want = found_by(found), plain_nearest(rows, [(i, v) for i, v in rows if i % 20 == 1], 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9 and np.mean([r.share for r in report.collect()]) < 0.5


def test_dense_index_empty(spark):
    df = spark.createDataFrame(vectors(100), "id long, v array<float>")
    index = dense.build_index(df, "id", "v")
    assert dense.search(index, df, df.limit(0), "id", "v", 3)[0].count() == 0
    none = dense.build_index(df.limit(0), "id", "v")
    assert none.n == 0


def test_dense_top_k_is_the_same_in_any_partitions(spark):
    """Cosines equal to six digits: ties go by item before any cut."""
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 1e-5 * i]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [found_by(ranking.dense_top_k(df.repartition(p), df.where("id = 0"), 2, "id", "v", "id", "v", exclude_self=True)) for p in (1, 3, 8)]
    assert got == [{0: [1, 2]}] * 3


@pytest.mark.parametrize("parts,cells,k,together", [(1, 16, 3, 1024), (6, 1, 4, 10), (3, 40, 50, 1024), (3, 5, 7, 0)])
def test_multivector_against_plain(spark, monkeypatch, parts, cells, k, together):
    """Ragged items, one with a third of all vectors, queries of one to four vectors."""
    rng = np.random.default_rng(5)
    rows = [(v is None, i, v) for i, v in vectors(400)]
    item = lambda i: "huge" if i % 3 == 0 else f"i{i % 23}" if i % 2 else f"j{int(rng.integers(0, 60))}"
    rows = [(item(i), v) for _, i, v in rows] + [("none", None), (None, [0.0] * 16)]
    monkeypatch.setattr(multivector, "TOGETHER", together)
    queries = [(q, rng.normal(size=16).tolist()) for q in range(12) for _ in range(1 + q % 4)]
    df = spark.createDataFrame(rows, "item string, v array<double>").repartition(parts)
    asked = spark.createDataFrame(queries, "q int, v array<double>")
    summary = multivector.summarise(df, "item", "v", cells)
    want, held = {}, {}
    for i, v in rows:
        if v is not None and i is not None:
            held.setdefault(i, []).append(v)
    for q in range(12):
        x = np.array([v for p, v in queries if p == q])
        score = {i: round(float((x @ np.array(v).T).max(1).sum()), 6) for i, v in held.items()}
        want[q] = [i for i, _ in sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]]
    assert found_by(multivector.search(summary, df, asked, "q", "v", k)) == want
    assert multivector.search(summary, df, asked.limit(0), "q", "v", k).count() == 0


def test_multivector_scores_few_items(spark):
    """On clustered items the upper bounds leave most of them unscored."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(200) for _ in range(5)]
    df = spark.createDataFrame(rows, "item int, v array<double>")
    summary = multivector.summarise(df, "item", "v", 40)
    x = centres[:8] + rng.normal(size=(8, 16)) * 0.1
    first = np.arange(8)
    low = multivector._bounds(summary, x, first, list(range(8)), 3, None, ("int", "int")).toPandas()
    floors = np.array([low[low.q == q].bound.nlargest(3).min() for q in range(8)])
    reached = sum(len(r.asked) for r in multivector._bounds(summary, x, first, list(range(8)), 3, floors, ("int", "int")).collect())
    assert 8 * 3 <= reached < 0.3 * 8 * 200


def test_scores_round_as_they_stand_in_binary(spark):
    rows = spark.createDataFrame([(1.02005,), (1.15555,), (1.09965,), (-1.02005,), (0.25,), (None,)], "x double")
    got = [r[0] for r in rows.select(ranking.rounded(rows.x, 4)).collect()]
    want = [duckdb.sql(f"SELECT round({x if x is not None else 'NULL'}::DOUBLE, 4)").fetchall()[0][0] for (x,) in rows.collect()]
    assert got == want and got[0] == 1.02  # F.round gives 1.0201


def test_late_interaction_equals_its_sql_to_the_digit(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(catalogue.oracle_sql()["late_interaction_topk"]).fetchall()
    got = catalogue.queries()["late_interaction_topk"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want)
