"""Queries over ranking and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators import dense, lexical, multivector, ranking, semantic
from facetmill.plans.registry import Registry, table

R = Registry()
query = R.query

#: Orders with their lines as judged candidates; the grade follows the quantity.
_GRADED_SQL = """g AS (SELECT l_orderkey AS query_id, l_linenumber AS item, max(l_extendedprice) AS score, max(CASE WHEN l_quantity > 40 THEN 1.0 WHEN l_quantity > 25 THEN 0.1 WHEN l_quantity > 10 THEN 0.01 ELSE 0.0 END) AS gain FROM lineitem GROUP BY 1, 2)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    gain = F.when(q > 40, 1.0).when(q > 25, 0.1).when(q > 10, 0.01).otherwise(0.0)
    keys = [F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_extendedprice").alias("score"), F.max(gain).alias("gain"))


def _ndcg_sql(order: str, out: str) -> str:
    return f"""WITH {_GRADED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS r, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM g),
n AS (SELECT query_id, sum(gain / log2(r + 1)) AS dcg, sum(gain / log2(i + 1)) AS ideal FROM r GROUP BY 1) {out}"""


@query(_ndcg_sql("score DESC, item", "SELECT query_id, round(dcg / ideal, 6) AS ndcg FROM n WHERE ideal > 0"))
def ndcg_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.ndcg(graded(spark, sf_dir), "query_id", [F.desc("score"), F.col("item")], "gain")
    return out.select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_ndcg_sql("score DESC, item", "SELECT query_id, round(sum(gain / log2(r + 1)) FILTER (r <= 3) / sum(gain / log2(i + 1)) FILTER (i <= 3), 6) AS ndcg FROM r GROUP BY 1 HAVING sum(gain) > 0"))
def ndcg_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.ndcg(graded(spark, sf_dir), "query_id", [F.desc("score"), F.col("item")], "gain", 3)
    return out.select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_ndcg_sql("md5('7:' || query_id || ':' || item), item", "SELECT round(avg(dcg / ideal), 6) AS floor, count(*) AS queries FROM n WHERE ideal > 0"))
def random_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.ndcg(graded(spark, sf_dir), "query_id", [P.hash_order("7", F.col("query_id"), F.col("item")), F.col("item")], "gain")
    return out.agg(F.round(F.avg("ndcg"), 6).alias("floor"), F.count("*").alias("queries"))


@query(f"""WITH {_GRADED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM g)
SELECT query_id, count(*) AS relevant, round(count(CASE WHEN rank <= 1 THEN 1 END) / count(*), 6) AS recall_1, round(count(CASE WHEN rank <= 3 THEN 1 END) / count(*), 6) AS recall_3 FROM r WHERE gain >= 0.1 GROUP BY 1""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded(spark, sf_dir)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item")))
    out = ranking.recall_at(ranked, rows.where("gain >= 0.1"), "query_id", "item", (1, 3))
    return out.select("query_id", "relevant", F.round("recall_1", 6).alias("recall_1"), F.round("recall_3", 6).alias("recall_3"))


@query(f"""WITH {_GRADED_SQL} SELECT query_id, count(*) AS candidates, round(avg(CASE WHEN gain = 1.0 THEN 1 ELSE 0 END), 6) AS frac_e, round(quantile_cont(score, 0.5), 4) AS median_score FROM g GROUP BY 1""")
def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("candidates"), F.round(F.avg((F.col("gain") == 1.0).cast("int")), 6).alias("frac_e"), F.round(F.percentile("score", 0.5), 4).alias("median_score"))


@query("""WITH c AS (SELECT o_custkey AS q, o_orderkey AS item, 'price' AS channel, o_totalprice AS score FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'date', epoch(o_orderdate) FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, item) AS r FROM c), n AS (SELECT q, count(DISTINCT channel) AS n FROM c GROUP BY 1)
SELECT q, item, round(sum(1.0 / (60 + r)) / any_value(n), 8) AS rrf FROM r JOIN n USING (q) GROUP BY 1, 2""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    price = orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), F.lit("price").alias("channel"), F.col("o_totalprice").alias("score"))
    date = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), F.lit("date").alias("channel"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("score"))
    return ranking.rrf(price.unionByName(date), "q", "item").select("q", "item", F.round("rrf", 8).alias("rrf"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT qid, vec_id AS item, round(list_dot_product(v, embedding)::DOUBLE / sqrt(list_dot_product(v, v)::DOUBLE * list_dot_product(embedding, embedding)::DOUBLE), 3) AS score FROM q, embeddings WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS rank FROM s) SELECT qid, rank, score FROM r WHERE rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = ranking.dense_top_k(rows, rows.where("vec_id % 100 = 0"), 5, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    return out.select("qid", "rank", F.round("score", 3).alias("score"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), s AS (
  SELECT qid, vec_id AS item, round(list_dot_product(v, embedding)::DOUBLE / sqrt(list_dot_product(v, v)::DOUBLE * list_dot_product(embedding, embedding)::DOUBLE), 3) AS score FROM q, e WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS rank FROM s) SELECT qid, rank, score FROM r WHERE rank <= 10""")
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors through the inverted file of codes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = dense.build_index(rows, "vec_id", "embedding")
    out, _ = dense.search(index, rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, exclude_self=True)
    return out.select("qid", "rank", F.round("score", 3).alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v) / (x.n * y.n), 5) AS cosine FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.4""")
def facet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors, standing for facets, that a matcher by meaning accepts."""
    out = semantic.threshold_pairs(table(spark, sf_dir, "embeddings"), 0.4, "vec_id", "embedding")
    return out.select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)
SELECT qid, label AS product, round(max(list_dot_product(v, embedding)::DOUBLE), 3) AS max_sim FROM q, embeddings e WHERE e.vec_id <> qid GROUP BY 1, 2""")
def max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0")
    out = ranking.max_sim_vectors(rows, queries, "label", "embedding", "vec_id", "embedding", part="vec_id")
    return out.select("qid", F.col("item").alias("product"), F.round("max_sim", 3).alias("max_sim"))


@query("""WITH p AS (SELECT vec_id % 150 AS product, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 <> 0), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, product, round(max(list_dot_product(q.v, p.v)), 6) AS score FROM q, p GROUP BY 1, 2)
SELECT qid, product, round(score, 4) AS max_sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, product) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def max_sim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five products whose best review vector is nearest to each query."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.where("vec_id % 100 <> 0").select((F.col("vec_id") % 150).alias("product"), "embedding")
    summary = multivector.summarise(parts, "product", "embedding")
    out = multivector.search(summary, parts, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return out.select("qid", F.col("item").alias("product"), ranking.rounded(F.col("score"), 4).alias("max_sim"), "rank")


@query("""WITH p AS (SELECT vec_id // 8 AS item, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id // 100 AS qid, vec_id AS token, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 < 4),
m AS (SELECT qid, token, item, max(list_dot_product(q.v, p.v)) AS m FROM q, p GROUP BY ALL), s AS (SELECT qid, item, round(sum(m), 6) AS score FROM m GROUP BY ALL)
SELECT qid, item, round(score, 4) AS late, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def late_interaction_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items of eight token vectors each with the greatest sum of maxima for queries of four."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select(F.floor(F.col("vec_id") / 8).alias("item"), "embedding")
    queries = rows.where("vec_id % 100 < 4").select(F.floor(F.col("vec_id") / 100).alias("q"), "embedding")
    out = multivector.search(multivector.summarise(parts, "item", "embedding"), parts, queries, "q", "embedding", 5)
    return out.select("qid", "item", ranking.rounded(F.col("score"), 4).alias("late"), "rank")


_BM25_SQL = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark),
terms AS (SELECT item_id, unnest(w) AS word FROM q), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(w) AS dl, word, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (word) JOIN terms USING (word), s GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 4) AS bm25, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10"""


@query(_BM25_SQL)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item, all words of the items and whole texts."""
    asked = table(spark, sf_dir, "benchmark")
    only = asked.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    index = lexical.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", only)
    out = lexical.search(index, asked, "item_id", "text", 10)
    return out.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"), ranking.rounded(F.col("score"), 4).alias("bm25"), "rank")


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark),
terms AS (SELECT item_id, unnest(w) AS word FROM q), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(w) AS dl, word, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS bm25 FROM tf JOIN df USING (word) JOIN terms USING (word), s GROUP BY 1, 2""")
def bm25_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.split(F.lower("text"), "[^a-z]+")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(split, lambda w: w != "").alias("w"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.filter(split, lambda w: w != "").alias("q"))
    return ranking.bm25(docs, asked, "doc_id", "w", "item_id", "q").select("item_id", "doc_id", F.round("bm25", 4).alias("bm25"))


@query("""WITH m AS (SELECT label AS bucket, 'f' || (vec_id % 20) AS facet, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, facet) AS place FROM m)
SELECT bucket, facet, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""")
def facet_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("vec_id") % 20
    axis = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i == number, 1.0).otherwise(0.0))
    mentions = table(spark, sf_dir, "embeddings").select(F.col("label").alias("bucket"), F.concat(F.lit("f"), number.cast("string")).alias("facet"), axis.alias("v"))
    return ranking.facet_vocabulary(mentions, "bucket", "facet", "v")


@query("""WITH c AS (SELECT o_orderkey AS q, count(*) AS n, avg(l_quantity) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT round(corr(ln(n), s), 6) AS corr FROM c""")
def rows_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("s"))
    return items.agg(F.round(F.corr(F.log("n"), "s"), 6).alias("corr"))


@query("""WITH p AS (SELECT l_partkey AS item, l_linenumber AS token, l_suppkey AS q, l_quantity AS s FROM lineitem) SELECT q, item, sum(m) AS late FROM (SELECT q, item, token, max(s) AS m FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("token"), F.col("l_suppkey").alias("q"), F.col("l_quantity").alias("s"))
    return ranking.late_interaction(pairs, "q", "token", "item", "s")


_CHANNELS = {"price": "l_extendedprice", "tax": "-l_tax", "quantity": "l_quantity"}


@query("""WITH g AS (SELECT l_orderkey AS q, l_partkey AS item, max(CASE WHEN l_discount > 0.07 THEN 1.0 WHEN l_discount > 0.04 THEN 0.1 ELSE 0.0 END) AS gain, max(l_extendedprice) AS price, max(-l_tax) AS tax, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
c AS (SELECT q, item, gain, 'price' AS channel, price AS score FROM g UNION ALL SELECT q, item, gain, 'tax', tax FROM g UNION ALL SELECT q, item, gain, 'quantity', quantity FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, item) AS r FROM c),
cells AS (SELECT unnest(['price', 'quantity', 'tax', 'price+quantity', 'price+tax', 'quantity+tax', 'price+quantity+tax']) AS cell),
f AS (SELECT cell, q, item, any_value(gain) AS gain, round(avg(1.0 / (60 + r)), 12) AS s FROM r JOIN cells ON list_contains(string_split(cell, '+'), channel) GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY cell, q ORDER BY s DESC, item) AS r, row_number() OVER (PARTITION BY cell, q ORDER BY gain DESC) AS i FROM f),
n AS (SELECT cell, q, sum(CASE WHEN r <= 10 THEN gain / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END) AS ndcg FROM p GROUP BY 1, 2 HAVING sum(gain) > 0)
SELECT cell, round(avg(ndcg), 6) AS ndcg_10, count(*) AS queries FROM n GROUP BY 1""")
def factorial_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.factorial_scores(_scored(spark, sf_dir), sorted(_CHANNELS), "q", "item", "gain", 10)
    return out.select("cell", F.round("ndcg", 6).alias("ndcg_10"), "queries")


@query("""WITH p AS (SELECT l_orderkey AS q, l_partkey AS item, max(l_extendedprice) AS s1, max(l_quantity) AS s2 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s1 DESC, item) AS r FROM p), b AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY s2 DESC, item) AS rank FROM a WHERE r <= 3) SELECT q, item, rank FROM b WHERE rank <= 2""")
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    items = table(spark, sf_dir, "lineitem")
    pairs = items.join(small, items.l_partkey == small.p_partkey, "left_semi").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("s1"), F.max("l_quantity").alias("s2"))
    return ranking.two_stage(pairs, "q", "item", "s1", "s2", 3, 2)


_CELLS_SQL = """g AS (SELECT l_orderkey AS q, l_partkey AS item, max(CASE WHEN l_discount > 0.07 THEN 1.0 WHEN l_discount > 0.04 THEN 0.1 ELSE 0.0 END) AS gain, max(l_extendedprice) AS price, max(-l_tax) AS tax, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
c AS (SELECT q, item, gain, 'price' AS channel, price AS score FROM g UNION ALL SELECT q, item, gain, 'tax', tax FROM g UNION ALL SELECT q, item, gain, 'quantity', quantity FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY q, channel ORDER BY score DESC, item) AS r FROM c),
cells AS (SELECT unnest(['price', 'quantity', 'tax', 'price+quantity', 'price+tax', 'quantity+tax', 'price+quantity+tax']) AS cell),
f AS (SELECT cell, q, item, any_value(gain) AS gain, round(avg(1.0 / (60 + r)), 12) AS s FROM r JOIN cells ON list_contains(string_split(cell, '+'), channel) GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY cell, q ORDER BY s DESC, item) AS r, row_number() OVER (PARTITION BY cell, q ORDER BY gain DESC) AS i FROM f),
n AS (SELECT cell, q, sum(CASE WHEN r <= 10 THEN gain / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END) AS ndcg FROM p GROUP BY 1, 2 HAVING sum(gain) > 0),
m AS (SELECT cell, avg(ndcg) AS ndcg, count(*) AS queries FROM n GROUP BY 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each order with their scores in three channels, dealt by order once for all that follows."""
    gain = F.when(F.col("l_discount") > 0.07, 1.0).when(F.col("l_discount") > 0.04, 0.1).otherwise(0.0)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item"), gain.alias("gain"), *[F.expr(e).alias(c) for c, e in _CHANNELS.items()])
    rows = lines.repartition("q").groupBy("q", "item").agg(*[F.max(c).alias(c) for c in ("gain", *_CHANNELS)])
    return rows.select("q", "item", "gain", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("score")) for c in _CHANNELS])))


@query(f"""WITH {_CELLS_SQL}, v AS (SELECT max(ndcg) FILTER (cell = 'price') AS p, max(ndcg) FILTER (cell = 'price+quantity') AS pq, max(ndcg) FILTER (cell = 'price+tax') AS pt, max(ndcg) FILTER (cell = 'price+quantity+tax') AS pqt FROM m)
SELECT 'marginal' AS kind, 'quantity' AS term, round(pq - p, 6) AS effect FROM v UNION ALL SELECT 'marginal', 'tax', round(pt - p, 6) FROM v UNION ALL SELECT 'interaction', 'quantity+tax', round(pqt - pq - pt + p, 6) FROM v""")
def factorial_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ranking.factorial_scores(_scored(spark, sf_dir), sorted(_CHANNELS), "q", "item", "gain", 10)
    out = ranking.factorial_effects(cells, ("price",), ("quantity", "tax"))
    return out.select("kind", "term", F.round("effect", 6).alias("effect"))


LADDER = [("random", ()), ("lexical", ("price",)), ("dense", ("quantity",)), ("fields", ("price", "quantity")), ("with_reviews", ("price", "quantity", "tax"))]


@query(f"""WITH {_CELLS_SQL}, x AS (SELECT q, item, gain, row_number() OVER (PARTITION BY q ORDER BY md5('0:' || q || ':' || item), item) AS r, row_number() OVER (PARTITION BY q ORDER BY gain DESC) AS i FROM g),
y AS (SELECT q, sum(CASE WHEN r <= 10 THEN gain / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END) AS ndcg FROM x GROUP BY 1 HAVING sum(gain) > 0),
l AS (SELECT 0 AS rung, 'random' AS system, avg(ndcg) AS ndcg, count(*) AS queries FROM y UNION ALL SELECT 1, 'lexical', ndcg, queries FROM m WHERE cell = 'price' UNION ALL SELECT 2, 'dense', ndcg, queries FROM m WHERE cell = 'quantity'
  UNION ALL SELECT 3, 'fields', ndcg, queries FROM m WHERE cell = 'price+quantity' UNION ALL SELECT 4, 'with_reviews', ndcg, queries FROM m WHERE cell = 'price+quantity+tax')
SELECT rung, system, round(ndcg, 6) AS ndcg, queries FROM l""")
def baseline_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ladder(_scored(spark, sf_dir), LADDER, "q", "item", "gain", 10).withColumn("ndcg", F.round("ndcg", 6))


@query("""WITH p AS (SELECT l_suppkey AS q, l_partkey AS item, l_linenumber AS review, l_quantity AS s FROM lineitem), e AS (SELECT q, item, review, max(s) AS m, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT q, item, max(m) AS max_sim, round(max(m) / (1 + ln(sum(n))), 6) AS by_log, round(avg(m), 6) AS mean_of_max FROM e GROUP BY 1, 2""")
def row_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("review"), F.col("l_quantity").alias("s"))
    out = ranking.row_corrections(pairs, "q", "item", "review", "s")
    return out.select("q", "item", "max_sim", F.round("by_log", 6).alias("by_log"), F.round("mean_of_max", 6).alias("mean_of_max"))


@query("""WITH h AS (SELECT p_partkey, p_brand, p_size, p_retailprice, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(p_partkey AS VARCHAR))) AS d FROM part),
v AS (SELECT l_partkey, round(avg(l_quantity), 6) AS a, round(avg(l_discount), 6) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(d, 17, 1))::INTEGER % 4), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id, p_brand AS brand,
  p_retailprice AS text_1, CAST(p_size AS DOUBLE) AS text_2, l_partkey IS NOT NULL AS has_review, a AS review_1, b AS review_2 FROM h LEFT JOIN v ON l_partkey = p_partkey""")
def product_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    text = part.select("p_partkey", F.array("p_retailprice", F.col("p_size").cast("double")).alias("vector"))
    review = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array(F.round(F.avg("l_quantity"), 6), F.round(F.avg("l_discount"), 6)).alias("vector"))
    out = ranking.product_points(part, "p_partkey", ["p_brand", "p_type"], {"text": text, "review": review})
    at = lambda c, i, name: F.get(F.col(c), F.lit(i)).alias(name)
    return out.select("p_partkey", "id", F.col("payload.p_brand").alias("brand"), at("text", 0, "text_1"), at("text", 1, "text_2"), F.col("review").isNotNull().alias("has_review"), at("review", 0, "review_1"), at("review", 1, "review_2"))


@query("""WITH b AS (SELECT min(p_brand) AS lo, max(p_brand) AS hi FROM part) SELECT p_partkey, p_brand, p_size, p_retailprice FROM part, b WHERE p_brand IN (lo, hi) AND p_size >= 10 AND p_retailprice <= 1500""")
def payload_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brands = part.agg(F.min("p_brand").alias("lo"), F.max("p_brand").alias("hi")).first()
    asked = ranking.payload_filter({"p_brand": [brands["lo"], brands["hi"]], "p_type": None}, {"p_size": 10}, {"p_retailprice": 1500})
    return part.where(asked).select("p_partkey", "p_brand", "p_size", "p_retailprice")


QUERIES, ORACLE = R.queries, R.oracle
