"""Substring deduplication, Jaccard join, components, decontamination."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm import common, components, decontaminate, jaccard_join, substring_dedup


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, id string, start int")


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(12)]
    out = dict(enumerate(base))
    for i in range(60):  # near copies, shared passages, repeats inside a text
        b = base[i % 5].split()
        for _ in range(i % 7):
            b[rng.randrange(len(b))] = word()
        out[100 + i] = " ".join(b)
    for i in range(20):
        out[200 + i] = " ".join(word() for _ in range(30)) + " " + base[7][:450] + " " + " ".join(word() for _ in range(i))
    out[300], out[301], out[302], out[303], out[304] = None, "", "  ", "one two", "ONE two"
    out[305] = "ab" * 600
    out[306] = base[1] + "\n" + base[1]
    out[307] = base[0].upper()
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.mark.parametrize("classes", [0, 3, 2000])
def test_dedup(spark, texts, monkeypatch, classes):
    monkeypatch.setattr(substring_dedup, "LOT_CLASSES", classes)
    monkeypatch.setattr(substring_dedup, "LOT_BYTES", 5000)
    if classes < 4:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
        monkeypatch.setattr(substring_dedup, "HOT", 5)
    columns = "n_bytes n_removed n_spans kept_sha256 n_shared".split()
    for length, mark in ((60, 60), (60, 33), (400, 256)):
        want = brute.dedup(texts, length, mark)
        rows = substring_dedup.deduplicate(frame(spark, texts), length=length, mark=mark).collect()
        assert {r["doc_id"]: tuple(r[c] for c in columns) for r in rows} == want


def test_dedup_rows_without_ids(spark):
    """Rows without a key, and a key on several texts, are judged like any other row."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    one, two = text(120), text(120)
    rows = [(None, text(50) + one + text(20)), (2, text(9) + one + text(60)), (None, two + text(80)), (None, text(70) + two), (7, text(150)), (7, text(30) + one), (8, text(150)), (8, None), (9, "short"), (None, "short")]
    rows += [(None, text(200))] * 2 + [(11, text(200))] * 2
    want = brute.dedup(dict(enumerate(t for _, t in rows)), 400, 288)
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), mark=288).collect()
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_shared"]) for r in got], key=key) == sorted([(k, *want[i]) for i, (k, _) in enumerate(rows)], key=key)
    assert sum(r["n_removed"] > 0 for r in got) == 9


def test_dedup_kept_text(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(700))
    got = substring_dedup.deduplicate(spark.createDataFrame([(1, "head " + text), (2, text + " tail"), (3, "é" * 100)], "doc_id long, text string"), length=650, kind="text").collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: "head ", 2: " tail", 3: "é" * 100}


def test_dedup_pieces_of_long_texts(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    text = np.frombuffer(texts[306].encode(), np.uint8)
    parts = list(substring_dedup.stretches(text, 60))
    assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] == len(text) - 59


def test_matching_statistics():
    rng = random.Random(1)
    made = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(12)]
    for texts in ([b"abcabcabc", b"xabcabcy", b"abc", b"", b"zzzz"], made, [b"a" * 90, b"a" * 40]):
        for longest, least in ((1, 1), (2, 1), (8, 3), (8, 8), (30, 9), (70, 24)):
            whole = Counter(t[i : i + n] for t in texts for n in range(least, longest + 1) for i in range(len(t) - n + 1))
            for text, found in zip(texts, substring_dedup.matching_statistics(texts, list(map(len, texts)), longest, least)):
                for i in range(len(text)):
                    true = max([n for n in range(least, longest + 1) if i + n <= len(text) and whole[text[i : i + n]] > 1], default=0)
                    assert min(found[i], longest) == true if true else found[i] < least


def test_matches_start_at_places_only():
    """Texts that overlap in their document: what follows a text's places isn't found in the next one."""
    text = bytes(np.random.default_rng(3).integers(97, 123, 300).astype(np.uint8))
    parts = [text[:160], text[100:260], text[200:]]
    assert all((m < 9).all() for m in substring_dedup.matching_statistics(parts, [100, 100, 100], 50, 9))
    found = substring_dedup.matching_statistics([*parts, text[150:260]], [100, 100, 100, 100], 50, 9)
    assert (found[1][50:] >= 50).all() and (found[2][:11] >= 50).all() and (found[3] >= 50).sum() == 61


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduplicate(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, {1: "a b c d e f"}), bench).count() == 0


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, texts, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts), width=width, percent=percent).collect()}
    assert got == brute.components(texts, width, percent)


def found(spark, texts, width, percent):
    rows = jaccard_join.jaccard_components(frame(spark, texts), width=width, percent=percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("width, percent", [(3, 80), (1, 60), (2, 100)])
def test_jaccard_large_components(spark, texts, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 200)
    assert found(spark, texts, width, percent) == brute.components(texts, width, percent)


def test_jaccard_family(spark, monkeypatch):
    """A family of near copies about one text, some too far from it but near to others, and strangers
    that share the crowded signatures."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(150):
        w = list(base)
        for j in range(i % 6):
            w[(i * 7 + j * 11) % 60] = f"x{i}y{j}"
        texts[i] = " ".join(w)
    for i in range(150, 170):
        texts[i] = " ".join(base[:25] + [f"z{rng.random()}" for _ in range(60)])
    monkeypatch.setattr(jaccard_join, "CROWDED", 5)
    want = brute.components(texts, 1, 80)
    assert found(spark, texts, 1, 80) == want and len({c for _, c in want.values()}) > 15
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "LOT", 200)
    assert found(spark, texts, 1, 80) == want


def test_jaccard_common_lines(spark, monkeypatch):
    """Documents that share lines, and copies of some: candidates put most of them in one component, but
    what meets doesn't grow with its square. Some hold little but common words, in crowds of their own."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "CROWDED", 4)
    monkeypatch.setattr(jaccard_join, "COMMON_TOKENS", 0)
    lots = []

    def written(df, name):
        out = common.materialize(df, name)
        if name == "lots":
            lots.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", written)
    lines = [[f"line{k}word{i}" for i in range(12)] for k in range(8)]
    for n in (150, 300):
        rng, texts = random.Random(6), {}
        for i in range(n):
            words = [*sum(rng.sample(lines, 2), []), *(f"own{i}.{j}" for j in range(rng.randint(20, 40)))]
            texts[i] = " ".join(words)
            if i % 5 == 0:
                texts[n + i] = " ".join([*words[:-2], f"new{i}"])
        for i in range(40):
            words = texts[3 * n + i - 1].split()[:-1] if i % 4 == 3 else [*lines[i % 2], *(f"rest{j}" for j in rng.sample(range(50), 30))]
            texts[3 * n + i] = " ".join(words)
        want = brute.components(texts, 1, 80)
        assert found(spark, texts, 1, 80) == want and len({c for _, c in want.values()}) < n + 40
    assert len(lots) == 2 and lots[1] < 2 * lots[0] + 20, lots


def test_jaccard_ids_of_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, one), (5, two), (1, two), (7, one + " more"), (3, two + " more"), (9, "alone here"), (5, one), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [(-1, 38, 1), (1, 38, 1), (3, 39, 1), (5, 38, 1), (5, 38, 1), (5, 38, 1), (7, 39, 1), (9, 1, 9)]


@pytest.mark.parametrize("deletions", [False, True])
def test_pigeonhole_loses_nothing(monkeypatch, deletions):
    """Sets at the threshold have the evidence they need, whatever tokens are called common."""
    rng = np.random.default_rng(5)
    plain = jaccard_join.allotment
    if deletions:  # all but one segment by their one-deletion neighbourhoods
        monkeypatch.setattr(jaccard_join, "allotment", lambda band, percent: (1, -(-(sum(plain(band, percent)) - 1) // 2)))
    jaccard_join._plans.clear()
    for percent in (60, 80, 90):
        for _ in range(400):
            n = int(rng.integers(1, 200))
            base = rng.integers(0, 1 << 62, n + 60).astype(np.uint64)
            keep = int(rng.integers(0, n + 1))
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:keep], base[n : n + int(rng.integers(0, 60))]]))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            common = np.unique(rng.choice(base, n // 2))
            shared = np.intersect1d(jaccard_join.signatures(a, percent, common), jaccard_join.signatures(b, percent, common))
            assert (1 / (shared & np.uint64(15)).astype(float)).sum() > 0.999
    jaccard_join._plans.clear()


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    monkeypatch.setattr(components, "HUB", 5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 200)
    rng = random.Random(2)
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (7, 7), (12, 10), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(1000, 1001 + i) for i in range(50)] + [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x} and got[140] == 100 and 7 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_say_when_unfinished(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))


def test_sums_by_levels(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 3)
    parts = [(i, np.array([float(i), 1.0]).tobytes()) for i in range(40) if i % 5]
    rows = spark.createDataFrame(parts, "lot int, part binary")
    assert common.sum_arrays(rows, 2).tolist() == [float(sum(i for i, _ in parts)), 32.0]
    assert common.sum_arrays(rows.where("lot < 0"), 2).tolist() == [0.0, 0.0]


def test_contaminated(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfghklmnpr") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    vocabulary = [word() for _ in range(3000)]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {i: passage(rng.randint(15, 50)) for i in range(30)}
    docs = {i: passage(rng.randint(5, 400)) for i in range(150)}
    want = set()
    for i in range(0, 150, 5):
        words, item = docs[i].split(), i % 30
        at = rng.randint(0, len(words))
        said = items[item].split()
        if i % 2:  # reworded: every sixth word is another
            said = [w if j % 6 else rng.choice(vocabulary) for j, w in enumerate(said)]
        docs[i] = " ".join(words[:at] + said + words[at:])
        want.add((i, item))
    docs |= {900: None, 901: "", 902: items[3].upper()}
    want.add((902, 3))
    bench = spark.createDataFrame([*items.items(), (77, None), (78, ""), (79, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want), (want - got, got - want)


def test_contaminated_by_short_items(spark, monkeypatch):
    """Items under five words against plain search: at both ends of texts, repeated, of equal beginnings; a
    phrase that goes on into the next text doesn't count."""
    items = {1: "Alpha", 2: "alpha BETA", 3: "alpha beta", 4: "beta gamma delta", 5: "alpha beta gamma eps", 6: "eps eps", 7: "", 8: None, 9: "..."}
    rng = random.Random(8)
    docs = {i: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "other"]) for _ in range(rng.randint(0, 9))) for i in range(200)}
    docs |= {500: None, 501: "", 502: "alpha", 503: "alpha, beta; gamma-eps.", 504: "beta"}
    padded = {i: f" {' '.join(re.findall('[a-z]+', (t or '').lower()))} " for i, t in docs.items()}
    said = {i: " ".join((t or "").lower().strip(".").split()) for i, t in items.items()}
    want = {(d, i) for d, t in padded.items() for i, p in said.items() if p and f" {p} " in t}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    for block in (500, 1):  # all items in a scan, or two at a time
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        monkeypatch.setattr(decontaminate, "BLOCKS", 8 if block > 1 else 2)
        got = decontaminate.contaminated(frame(spark, docs).repartition(3), bench).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
        assert all(r["cosine"] == r["lcs_share"] == 1.0 for r in got)
    assert decontaminate.contaminated(frame(spark, {1: "x"}).limit(0), bench).count() == 0


def test_contaminated_by_common_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfghklmnpr") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    vocabulary = sorted({word() for _ in range(4000)})
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {i: passage(n) for i, n in enumerate((200, 600, 120, 40))} | {9 + i: passage(30) for i in range(20)}
    docs, want = {}, set()
    for i in range(300):  # a third of the documents hold each of the long items, at any place
        docs[i] = passage(rng.randint(20, 90))
        if i % 3 == 0:
            docs[i] = " ".join([passage(rng.randint(0, 60)), items[i // 3 % 4], docs[i]]).strip()
            want.add((i, i // 3 % 4))
    for i in range(300, 400):
        docs[i] = " ".join([passage(rng.randint(1, 40)), items[0], passage(20), items[1], passage(9), items[2]])
        want |= {(i, 0), (i, 1), (i, 2)}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == want, (len(want - got), len(got - want))


def test_contaminated_recall(spark, monkeypatch):
    """Against exact search: short and long items, items of common words only, several blocks of items,
    long documents, repeated rows, copies cut and reworded."""
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfghklmnpr") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    vocabulary = sorted({word() for _ in range(2500)})
    common_words = vocabulary[:40]  # in every document
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {i: passage(n) for i, n in enumerate((5, 6, 8, 11, 15, 20, 23, 25, 30, 40, 60, 90, 14, 18, 35))}
    items |= {50 + i: " ".join(rng.sample(common_words, n)) for i, n in enumerate((8, 14, 22, 30))}
    docs = {}
    for i in range(240):
        text = [passage(rng.randint(10, 120)), " ".join(rng.sample(common_words, 12)), passage(rng.randint(0, 30))]
        if i % 2 == 0:
            said = items[rng.choice(list(items))].split()
            if i % 4 == 0 and len(said) > 12:
                said = [w if rng.random() < 0.85 else rng.choice(vocabulary) for w in said]
            text.insert(rng.randint(0, 3), " ".join(said))
        docs[i] = " ".join(text)
    docs[500] = " ".join([passage(4000), items[9], passage(4000), items[50]])
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    rows = spark.createDataFrame([*docs.items(), (500, docs[500]), (None, items[8])], "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("cosine", F.lit(1))
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows.repartition(6), bench).collect()]
    want = brute.leaks(docs, items)
    got = {x for x in found if x[0] is not None}
    assert found.count((500, 9)) == 2 and (None, 8) in found and got <= want, got - want
    for kind in ([i for i in items if i < 50 and len(items[i].split()) < 24], [i for i in items if i < 50 and len(items[i].split()) >= 24], [i for i in items if i >= 50]):
        true = {x for x in want if x[1] in kind}
        assert len(true & got) >= 0.9 * len(true) > 5, (kind, true - got)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))], [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(a, b) == table[-1][-1]


def test_rows_without_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other words here"), (None, "lonely one here"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert len(got) == 6 and got.count((1, 118, 1)) == 2 and (-1, 118, 1) in got and (2, 1, 2) in got and (-1, 1, None) in got and (-1, 0, None) in got
    cut = [(r["doc_id"], r["n_removed"] == r["n_bytes"] > 0) for r in substring_dedup.deduplicate(docs).collect()]
    assert len(cut) == 6 and cut.count((1, True)) == 2 and (2, False) in cut and (None, False) in cut
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(30, 60)))], "item_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in decontaminate.contaminated(docs, bench).collect()) == [-1, 1, 1]


def test_space_and_weights_come_from_no_sample(spark):
    """Which documents would fall into a sample, by their ids, changes nothing: frequencies count all documents,
    the space is the items' own."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    hashed = lambda t: decontaminate.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    blocks = [(list(range(90)), [hashed(text(30)) for _ in range(90)])]
    docs = [text(int(n)) for n in rng.integers(1, 120, 60)]
    found = []
    for first in (0, 10_000):  # as if of very many documents
        rows = spark.createDataFrame([(first + i, t) for i, t in enumerate(docs)], "id long, text string").repartition(5)
        (model,) = decontaminate._models(rows, blocks, 10_000)
        found.append(model)
    a, b = found
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.space, b.space) and np.array_equal(a.least, b.least)
    x = np.zeros((90, len(a.idf)))
    row, term, weight = a._rows(np.concatenate(a.items), np.cumsum([0] + [len(w) for w in a.items]), False)
    np.add.at(x, (row, term), weight)
    held = np.linalg.norm(x @ a.space) ** 2
    assert held > 0.9 * (np.linalg.svd(x)[1][: decontaminate.RANK] ** 2).sum()
