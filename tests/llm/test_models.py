"""Language identification, quality classifier, piece codec, HTML extraction, the pipeline."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from facetmill.llm import common, html_extract, kernels, language_id, piece_codec, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "de"), (6, "日本", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5)) and got[6]["lang_pred"] in ("en", "de")
    nothing = language_id.train(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.where("doc_id < 0"), model).count() == 0


def test_language_long_and_repeated(spark):
    german, english = "der schnelle Hund läuft über die Straße und bellt. ", "the quick dog runs over the street and barks. "
    rows = [(i, (german if i % 2 else english) * (1 + i % 7), "de" if i % 2 else "en") for i in range(60)] + [(None, english, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(7))
    model = language_id.train(docs)
    assert sorted(model.members) == ["germanic"]
    long = [(1, german * 30_000), (2, english * 30_000), (2, english * 30_000), (3, english + "#" * 500_000)]
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(long, "doc_id long, text string"), model).collect())
    assert [g[:2] for g in got] == [(1, "de"), (2, "en"), (2, "en"), (3, "en")] and got[1] == got[2]
    assert language_id.identify(docs, model).columns == ["doc_id", "lang_pred", "score"]


def test_language_machines_against_plain_descent():
    """The accelerated solver reaches the least cost that plain gradient steps find."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=80) * 0.2 > 0.1, 1, -1).astype(np.float32)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def cost(w, b):
        return (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 1e-2 / 2 * w @ w

    w, b = np.zeros(6), 0.0
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight * y
        w, b = w - 0.1 * (1e-2 * w - 2 * slack @ x), b + 0.1 * 2 * slack.sum()
    assert cost(*language_id.svm(x, y, 1e-2)) < cost(w, b) + 1e-4


def test_language_every_label(spark):
    rows = [(i, f"{c}{c}{d}{d} {d}{c}{c}{d} {c}{d}{c}{c}", f"x{c}{d}") for i, (c, d) in enumerate((c, d) for c in "abcdefghijklmnop" for d in "abcdefghijklmnop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert sorted(model.members) == sorted(f"own:{r[2]}" for r in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in got) >= 0.9 * len(got)


def test_quality_odd(spark):
    docs = spark.createDataFrame([(1, "fine words here.", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "### $$$", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (4, 0), (4, 7)], "doc_id long, label int")
    assert quality_classifier.classify(docs, some).count() == 4
    assert quality_classifier.classify(docs.where("doc_id < 0"), some).count() == 0


def test_quality_against_plain_matrices(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    known = {r["doc_id"]: r["label"] for r in labels.collect()}
    buf, offs = kernels.column(pa.record_batch([pa.array([t for _, t in texts], pa.string())], ["text"]))
    stats = quality_classifier.statistics(buf, offs)

    class Scorer(quality_classifier.Scorer):
        ridge, bins = quality_classifier.RIDGE, quality_classifier.BINS

    model, x, fit, w = brute.ridge_scores(stats, [known.get(i) for i, _ in texts], Scorer)
    for parts, fan in ((1, 32), (9, 2)):  # in one sum or in levels
        monkeypatch.setattr(common, "FAN_IN", fan)
        shuffled = docs.repartition(parts, "doc_id").withColumn("score", F.lit("clash"))
        got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(shuffled, labels.repartition(parts)).collect()}
        # A run of bins of one mean is a block; between the blocks' weighted centres scores are interpolated.
        blocks = [np.flatnonzero(np.isclose(fit, v)) for v in sorted(set(fit.round(9)))]
        centres, means = [np.average(x[b], weights=w[b]) for b in blocks], [fit[b[0]] for b in blocks]
        for (i, _), want in zip(texts, np.clip(np.interp(model.raw(stats), centres, means), 0, 1)):
            assert abs(got[i] - want) < 1e-6, i
        if parts == 1:
            first = got
    assert all(abs(first[i] - got[i]) < 1e-6 for i in got)


def test_quality_weights(spark):
    """Summed by partitions, the ridge weights are those of one plain solve."""
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(300, len(quality_classifier.STATS)))
    label = (stats[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int").repartition(7)
    model = quality_classifier.fit(rows)

    class Scorer(quality_classifier.Scorer):
        ridge, bins = quality_classifier.RIDGE, quality_classifier.BINS

    plain, x, fit, w = brute.ridge_scores(stats, label, Scorer)
    assert np.allclose(model.weight, plain.weight, atol=1e-6)
    assert np.allclose(np.interp(x, *model.steps), np.interp(x, *quality_classifier.pooled_adjacent_violators(x, fit, w)))


def test_quality_long_and_repeated(spark):
    long = "Some quite ordinary words, put down in a row.\n" * 20_000
    docs = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "### ||| $$$ " * 1000), (None, "words")], "doc_id long, text string").withColumn("stats", F.lit("clash")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(1, 1), (3, 0), (2, 1), (2, 1)], "doc_id long, label int")
    got = sorted((r["doc_id"] or -1, r["score"], r["predicted"]) for r in quality_classifier.classify(docs, labels).collect())
    assert len(got) == 5 and got[1][1:] == got[2][1:] == got[3][1:] and all(0 <= s <= 1 for _, s, _ in got) and got[4][2] == 0
    one = quality_classifier.statistics_table(docs.where("doc_id = 1")).first()["stats"]
    assert one[0] == np.log1p(len(long)) and one[1] == np.log1p(len(long.split()))


def test_isotonic():
    x, y = quality_classifier.pooled_adjacent_violators(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel.load()


def encoded(texts, model):
    buf, offs = kernels.column(pa.record_batch([pa.array(texts, pa.string())], ["text"]))
    ids, bounds = piece_codec.encode_batch(buf, offs, model)
    data, ends = piece_codec.decode_batch(ids, bounds, model)
    assert np.array_equal(data, buf) and np.array_equal(ends, offs)
    return [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))]


def score(ids, model):
    """The score of ids: pieces by their own, each character given as bytes by the unknown's."""
    by_id = {i: s for s, i in model.pieces.values()}
    value = {i: b for b, i in enumerate(model.byte_ids.tolist())}
    return sum(by_id[i] if i in by_id else model.unknown * (not 0x80 <= value[i] < 0xC0) for i in ids)


def close(ids, data, model):
    want = brute.best_score(data, model.pieces, model.unknown)
    assert abs(score(ids, model) - want) <= 1e-9 * abs(want) + 1e-6, data[:40]


TEXTS = ["", "a", " ", "  two  spaces ", "the cat sat on the mat", "über straße çà", "日本語 mixed ▁ mark\n\ttabs", "x" * 300, "ab" * 40 + "é" * 50, "😀\u0000\x7f", "\n\n\n"]


LONG = ["ab" * 3000 + " end", "\u00e9\u65e5" * 700 + "x" * 900, "".join(chr(0x4E00 + i * 37 % 20000) for i in range(1500)), " ".join(f"word{i}ing" for i in range(800))]


def test_codec(model):
    texts = TEXTS + LONG
    for text, ids in zip(texts, encoded(texts, model)):
        data = (" " + text).encode() if text else b""
        assert ids == list(piece_codec.stream_viterbi(data, model)), text
        close(ids, data, model)


def test_codec_window_is_bounded(model):
    """Scores are kept for one window, backpointers until the paths meet, which takes little on text."""
    longest = max(model.longest, 4)
    for data, open_end in ((("ab" * 5000).encode(), 200), (LONG[1].encode(), 200), ((" " + LONG[3]).encode(), 200), (b"a" * 60_000, 70_000)):
        search, ids, widest = piece_codec.stream_viterbi(data, model), [], 0
        for i in search:
            ids.append(i)
            held = search.gi_frame.f_locals
            assert len(held["best"]) <= longest + 4
            widest = max(widest, len(held["step"]))
        assert b"".join(bytes(model.flat[model.bounds[i] : model.bounds[i + 1]]) for i in ids) == data
        assert widest <= open_end, (data[:10], widest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_codec_round_trip(texts):
    model = piece_codec.PieceModel.load()
    for text, ids in zip(texts, encoded(texts, model)):
        data = (" " + text).encode() if text else b""
        assert ids == list(piece_codec.stream_viterbi(data, model))
        close(ids, data, model)


def test_codec_tables(spark, model):
    docs = spark.createDataFrame([(1, "hello wörld", 5), (2, None, 5), (3, "", 5), (4, "hello wörld", 5)], "doc_id long, text string, ids int")
    out = piece_codec.encode(docs, model, check=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["ids"] is None and got[3]["ids"] == [] and got[1]["ids"] == got[4]["ids"] and all(r["round_trip"] for r in got.values())
    back = {r["doc_id"]: r["decoded"] for r in piece_codec.decode(out, model).collect()}
    assert back == {1: "hello wörld", 2: None, 3: "", 4: "hello wörld"}
    assert piece_codec.encode(docs.where("doc_id < 0"), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div><main><article class="post"><header><h1>T &amp; x</h1></header>
<p>One <b>two</b>
 three<br>four<p class="ad">buy<p>five &lt;6 &amp;amp; &#233;<ul><li>k<li>m</ul><aside>rel</aside><form><label>q</label></form><script>if(a<b){"</p>"}</script></article>
<section id="comments"><article class="comment"><p>no</p></article></section></main><footer>f</footer>"""


def test_html_page():
    assert html_extract.main_text(PAGE, [], frozenset()) == "T & x\nOne two three four\nfive <6 &amp; é\nk\nm"
    assert html_extract.main_text("plain <b>text</b> only", [], frozenset()) == "plain text only"
    assert html_extract.main_text("<p>a < b & c<", [], frozenset()) == "a < b & c<"
    odd = '<p title="5" tall">a</p><p x="1>2">b</p><p>ok</p><a href="open>text</a><!-- x > y --><p>d</p><!-- open'
    assert html_extract.main_text(odd, [], frozenset()) == "a\nb\nok\nd"  # a block that is all link is a menu
    for broken in ('<a href="', '<a b="c" ', "<p>", "<div>"):  # linear, however broken
        html_extract.main_text(broken * 50_000, [], frozenset())


def test_html_wrappers(spark):
    page = lambda i, n: f"<html><body><div class=top>My site</div><div class=x><div class=box>{''.join(f'<p>Paragraph {i} {j} with words</p>' for j in range(n))}</div></div><div class=bottom>All rights</div></body></html>"
    data = [(i, f"http://a.example/{i}", page(i, 2 + i % 3)) for i in range(8)]
    data += [(50, "http://a.example/50", data[0][2]), (51, None, "<p>lone</p>"), (52, "http://b.example/", None), (53, "x", ""), (54, "http://c.example", "<script>only</script>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(data)
    assert got[1]["text"] == "\n".join(f"Paragraph 1 {j} with words" for j in range(3)) and got[50]["text"] == got[0]["text"]
    assert got[51]["text"] == "lone" and [got[i]["text"] for i in (52, 53, 54)] == ["", "", ""] and got[1]["n_chars"] == len(got[1]["text"])
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0


def test_wrapper_expression():
    trees = [html_extract.Wrapper(html_extract._page_tree(html_extract.parse(p)), [i]) for i, p in enumerate(["<body><h1>a</h1><p>x</p><p>y</p></body>", "<body><h1>b</h1><p>z</p><div>d</div></body>"])]
    whole = html_extract.Wrapper()
    for t in trees:
        whole.add(t)
    assert whole.expression() == "<body><h1>#</>(<p>#</>)+(<div>'d'</>)?</>"


def sites(spark, *hosts):
    """The main texts of the pages of some hosts."""
    rows = [(1000 * h + i, f"http://h{h}.example/{i}", page) for h, pages in enumerate(hosts) for i, page in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [[got[1000 * h + i] for i in range(len(pages))] for h, pages in enumerate(hosts)]


def words(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_html_wrapper_decides(spark):
    follow = [f"<body><article><h1>Title {i}</h1><p>{words(i)}</p><p>{words(i + 50)}</p><p>Follow us</p><div class=zz>Standing words</div></article></body>" for i in range(7)]
    teasers = [f"<body><div class=b><p>{words(i)}</p></div><article><p><a href=x>More {i}</a></p></article><article><p><a href=y>Else {i}</a></p></article></body>" for i in range(7)]
    once = [f"<body><p>{words(i)}</p>{'<div class=k>Once only</div>' if i == 3 else ''}<ul><li>{words(i + 50)}</ul></body>" for i in range(7)]
    same = [f"<body><article><p>{words(1)}</p></article><p>{i}</p></body>" for i in range(7)]
    got = sites(spark, follow, teasers, teasers[:2], once, same)
    assert got[0] == [f"Title {i}\n{words(i)}\n{words(i + 50)}" for i in range(7)]
    assert got[1] == [words(i) for i in range(7)]
    assert got[2] == ["More 0\nElse 0", "More 1\nElse 1"]  # no wrapper to tell: element names
    assert got[3][3] == f"{words(3)}\nOnce only\n{words(53)}"  # text of one page is no constant
    assert got[4] == [words(1)] * 7  # copies of one article are no frame


def test_html_constants_are_whole_texts(spark):
    lead = "This standing lead opens every page of the site. " * 6
    pages = [f"<body><div class=t>{lead}</div><main><div>{lead}{words(i)}</div></main><div class=z>{lead}end</div></body>" for i in range(7)]
    plain = [p.replace("main>", "div>") for p in pages]
    assert sites(spark, pages, plain) == [[f"{lead}{words(i)}" for i in range(7)]] * 2


def test_html_wide_pages(spark):
    slug = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    page = "<body><div class=t>My site</div><div id={}><p>{}</p></div><div class=z>All rights</div></body>"
    named, numbered = ([page.format(x(i), words(i)) for i in range(n)] for n, x in ((450, slug), (450, "node-{}".format)))
    long = ["<body>" + "".join(f"<h3>T{i} {j}</h3><p>{words(1000 * i + j)}</p>" for j in range(150)) + "<div class=z>All rights</div></body>" for i in range(6)]
    got = sites(spark, named[:100], named, numbered, long)
    assert got[0] == [words(i) for i in range(100)] and got[1] == got[2] == [words(i) for i in range(450)]
    assert all(t.endswith(words(1000 * i + 149)) for i, t in enumerate(got[3]))
    nodes = [html_extract._page_tree(html_extract.parse(p), i) for i, p in enumerate(named)]
    whole, text = html_extract.Wrapper(), sum(map(html_extract._whole, nodes))
    for i, n in enumerate(nodes):
        whole.add(html_extract.Wrapper(n, [i]))
    assert len(whole.root[4][0][4]) <= html_extract.WIDTH and html_extract._whole(whole.root) == text
    content, _, fit = whole.rules()
    assert fit and content == ["body", "* div.t div.z"]
    tree = html_extract._page_tree(html_extract.parse(long[0]), 0)
    assert html_extract._whole(tree) == sum(len(b.text) for b in html_extract.parse(long[0]))


def made_site(rng, n):
    """Pages of a made site without semantic tags, with the main text that was put in."""
    lead, ad = (" ".join(f"{c}{rng.random()}" for _ in range(rng.randint(2, 30))) for c in "ls")
    frame = [f"<div class=k{i}>{' '.join(f'f{i}x{j}' for j in range(rng.randint(2, 9)))}</div>" for i in range(rng.randint(2, 6))]
    cut = rng.randint(1, len(frame) - 1)
    pages, texts = [], []
    for i in range(n):
        inner, said = [], []
        for j in range(rng.randint(3, 9)):
            text = " ".join(f"p{i}x{j}x{k}" for k in range(rng.randint(8, 40)))
            tag = rng.choice(["p", "p", "h2", "blockquote"])
            inner.append(f"<{tag}>{text}</{tag}>")
            said.append(text)
        at = rng.randint(0, len(inner))
        inner.insert(at, f"<p class=standing>{lead}</p>")
        rare = f"<div class=r>{ad}</div>" if i % 3 else ""
        pages.append(f"<body>{''.join(frame[:cut])}<div class=q><div class=t>{''.join(inner)}</div></div>{rare}{''.join(frame[cut:])}</body>")
        texts.append("\n".join(said))
    return pages, texts


def test_html_against_plain_counts(spark):
    """What differs from page to page inside the block that holds most of it, found by plain counting."""
    rng = random.Random(4)
    rows, want = [], {}
    for site in range(6):
        pages, texts = made_site(rng, 24)
        standing = brute.standing_blocks([html_extract.parse(p) for p in pages], html_extract.LEAST_PAGES)
        for i, (page, text) in enumerate(zip(pages, texts)):
            key = 100 * site + i
            rows.append((key, f"http://s{site}.example/{i}", page))
            want[key] = text
            assert "\n".join(b.text for b in html_extract.parse(page) if (b.path, b.text) not in standing) == text
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5, 13):  # the same pages in other partitions and orders
        got = {r["page_id"]: r["text"] for r in html_extract.extract(frame.orderBy(F.xxhash64("page_id", F.lit(parts))).repartition(parts)).collect()}
        assert got == want
    wrappers = {parts: sorted(map(tuple, html_extract.infer(frame.repartition(parts).withColumn("host", F.split("url", "/")[2])).collect())) for parts in (1, 7)}
    normal = lambda rows: [(h, html_extract.Wrapper.load(w).expression()) for h, w in rows]
    assert normal(wrappers[1]) == normal(wrappers[7]) and len(wrappers[1]) == 6


def test_html_bounded_tasks(spark, monkeypatch):
    """Tasks that send their wrappers early, and ranges of hashes, change nothing."""
    rng = random.Random(5)
    pages, texts = made_site(rng, 60)
    monkeypatch.setattr(html_extract, "HELD_NODES", 40)
    assert sites(spark, pages, pages[:30]) == [texts, texts[:30]]


def test_html_sample(spark):
    rows = queries.op2_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 50 and all("track(" not in r["text"] and "<" not in r["text"].replace("<", "", r["html"].count("&lt;")) for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    judged = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, labels).collect()}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == {k for k, p in judged.items() if p == 1} and first.columns == docs.columns
    groups = brute.components({k: texts[k] for k, p in judged.items() if p == 1}, 5, 80)
    second = corpus_pipeline.near_duplicates(spark, first, SF)
    kept = {k for k, (_, c) in groups.items() if c == k}
    assert {r["doc_id"] for r in second.collect()} == kept and second.columns == docs.columns
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    third = corpus_pipeline.contamination(spark, second, SF)
    kept -= {t for t, _ in brute.leaks({k: texts[k] for k in kept}, items)}
    assert {r["doc_id"] for r in third.collect()} == kept and third.columns == docs.columns
    fourth = corpus_pipeline.personal_data(spark, third, SF)
    assert fourth.columns == docs.columns and {r["doc_id"]: r["text"] for r in fourth.collect()} == {k: brute.redacted(texts[k]) for k in kept}
    assert set(out) == kept and 0.5 * len(texts) < len(kept) < len(texts)
    model = piece_codec.PieceModel.load()
    for k, r in out.items():
        text = brute.redacted(texts[k])
        assert r["text"] == text and r["n_chars"] == len(text) and r["round_trip"]
        assert r["ids"] == list(piece_codec.stream_viterbi((" " + text).encode() if text else b"", model))


def test_pipeline_repeated_ids(spark, tmp_path):
    """An id on several rows leaves with all of them; an id on other texts is judged by each."""
    good, bad = "A plain sentence about the weather, with nothing else in it. ", "### $$$ ||| !!! ### "
    say = lambda k: good + " ".join(f"{w}{k}" for w in ("rain", "sun", "wind", "snow", "fog", "hail", "mist"))
    docs = spark.createDataFrame([(1, say(1)), (1, say(1)), (2, say(2)), (2, bad * 9), (3, say(3)), (4, bad * 9), (5, say(3) + " again"), (None, say(1))], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no document holds anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r["doc_id"] or -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert 4 not in got and 2 not in got and got.count(1) == 2 and got.count(-1) == 1 and 3 in got


def test_pipeline_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "mail a@b.example now and call", "en", "s", 29, 1), (3, "mail a@b.example now and call", "en", "s", 29, 1)], "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for name, n in (("some", 4), ("none", 0)):
        docs.limit(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == n
        assert all("a@b" not in (r["text"] or "") for r in got)


def test_pipeline_decodes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello world"), (2, "wörld"), (3, None), (4, "")], "doc_id long, text string")
    assert [r["round_trip"] for r in corpus_pipeline.token_ids(spark, docs, SF).collect()] == [True] * 4
    model = piece_codec.PieceModel.load()
    model.flat = np.where(model.flat == ord("h"), ord("j"), model.flat).astype(model.flat.dtype)  # decodes wrongly
    monkeypatch.setattr(piece_codec.PieceModel, "load", classmethod(lambda cls: model))
    assert {r["doc_id"]: r["round_trip"] for r in corpus_pipeline.token_ids(spark, docs, SF).collect()} == {1: False, 2: True, 3: True, 4: True}
