"""Importance resampling and BPE coding against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from facetmill.llm import bpe_codec, importance, queries
from facetmill.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_importance(docs, target, most=1, buckets=10_000, percent=10, least=20):
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    found = [[zlib.crc32(x.encode()) % buckets for x in runs(brute.words_of(t))] for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(zlib.crc32(x.encode()) % buckets for y in target for x in runs(brute.words_of(y)))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for (i, text), f in zip(docs, found):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute.words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_importance_against_plain(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    got = rows(queries.op11_importance_resampling(spark, SF))
    assert got == sorted(plain_importance(docs, target), key=str) and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("most", [1, 3])
def test_importance_odd_rows(spark, most, monkeypatch):
    monkeypatch.setattr(importance, "WINDOW", 50)
    rng = random.Random(5)
    word = lambda: rng.choice(["A", "zwei", "ÄÖ", "x9", "naïve", "字", "the", "of"])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "--", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(None, None), (None, text(30)), (50, ""), (51, "!?"), (52, text(5000)), (53, "y" * 400), (54, "one two " * 50), (54, "one two " * 50), (54, "one two " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS score", "'k' AS rank", "0 AS __row_", "'de' AS lang")
    out = importance.resample(df, spark.createDataFrame([("of the x9",), (None,)], "text string"), most=most, percent=60, least_words=20)
    assert rows(out) == sorted(plain_importance(docs, ["of the x9", None], most, percent=60), key=str)
    assert {"lang", "__row_"} <= set(out.columns) and "text" not in out.columns


def test_importance_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    (r,) = importance.resample(some, none, percent=100).collect()
    assert (r.n_features, r.rank) == (40, 1)


def test_importance_parts_and_windows(spark):
    texts = ["a b c d e f g " * k for k in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = importance.bucket_counts(df.coalesce(1), buckets=64, most=4)
    assert (importance.bucket_counts(df.repartition(70), buckets=64, most=4) == want).all()
    for w in (1, 7, 100):
        found = [list(importance.features(t.encode(), 64, 4, w)) for t in texts]
        assert (sum(np.bincount(x, minlength=64) for f in found for x, _ in f) == want).all()
        assert [sum(k for _, k in f) for f in found] == [len(t.split()) for t in texts]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_codec.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def model():
    return bpe_codec.BpeModel.load().prepare()


def ids_of(texts, model, window=1 << 20):
    return [np.frombuffer(x, np.int32).tolist() for x in bpe_codec.encode_texts([t.encode() for t in texts], model, window)]


def test_bpe_against_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.op12_bpe_codec(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aesté'lvtrdm \n　 \x1ć̸=5٣İß")), max_size=40), max_size=8), st.sampled_from([3, 40, 1 << 20]))
def test_bpe_any_text(texts, window):
    library, model = Tokenizer.from_file(bpe_codec.DEFAULT_MODEL), _model()
    assert ids_of(texts, model, window) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _model(held=[]):
    if not held:
        held.append(bpe_codec.BpeModel.load().prepare())
    return held[0]


def test_bpe_special_and_long(library, model, monkeypatch):
    end = "<|endoftext|>"
    texts = [f"a{end}'ll b", f"{end}{end}", f"x{end}́y {end} z", f"<|startoftext|>A <|END{end}", "a" * 20_000, "ab1" * 3000, "é" * 5000, "don't " * 4000, "１２ ½ x　y　", "　", "q　w e"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(texts, model) == want and ids_of(texts, model, 100) == want
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 5)
    assert ids_of(texts + texts, model, 100) == want + want and len(model.stretches) < 50


def test_bpe_forced_boundaries(model, library):
    """No token has a forced pair inside; fragments cut there give the ids of the whole word."""
    vocab = library.get_vocab()
    letters = bpe_codec._byte_letters()
    for t in random.Random(1).sample(sorted(vocab), 3000):
        if t in model.special or t == "</w>":
            continue
        raw = t.removesuffix("</w>")
        s = [model.byte_of[ord(c)] for c in raw]
        follows = s[1:-1] + [s[-1] + 256 * t.endswith("</w>")] if len(s) > 1 else []
        assert not any(model.forced[a, b] for a, b in zip(s, follows))
    assert len(set(letters.values())) == 256
    word = b"tzqxoffice"
    found, of = bpe_codec.fragments(np.frombuffer(word, np.uint8).astype(np.int64), np.array([len(word)]), model)
    assert len(found) > 1 and set(of) == {0}
    assert [i for f in found for i in bpe_codec.merge(f, model)] == library.encode(word.decode()).ids
    assert bpe_codec.merge_short(found, model) == [np.array(bpe_codec.merge(f, model), np.int32).tobytes() for f in found]


def test_bpe_columns(spark, library):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, " \n", 2), (4, "Hi <|endoftext|>", 3), (4, "Hi <|endoftext|>", 3)], "doc_id long, text string, ids int")
    m = bpe_codec.BpeModel.load()
    out = bpe_codec.decode(bpe_codec.encode(df, m), m).orderBy("doc_id").collect()
    assert [r.ids for r in out] == [None, [], [], library.encode("Hi <|endoftext|>").ids, library.encode("Hi <|endoftext|>").ids]
    assert [r.decoded for r in out] == [None, "", "", "hi</w> <|endoftext|>", "hi</w> <|endoftext|>"]
    odd = spark.createDataFrame([([-1, 320, 10**8, None],)], "ids array<int>")
    assert bpe_codec.decode(odd, m).first().decoded == library.decode([320])
    assert bpe_codec.codec_report(df.limit(0), m).count() == 0
