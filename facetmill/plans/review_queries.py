"""Queries over reviews: numbering, deduplication, samples, extraction logs, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.functions import parsing as P
from facetmill.operators import extraction, gold, inspect, tables
from facetmill.plans.registry import Registry, table
from facetmill.streaming import extraction_stream

R = Registry()
query = R.query

#: Documents stand in for reviews: groups of five ids are products, ids are the file order.
REVIEWS_SQL = """reviews AS (SELECT 'p' || CAST(doc_id // 5 AS VARCHAR) AS asin, doc_id, text, lang AS country, source FROM documents)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    asin = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5).cast("long").cast("string"))
    return table(spark, sf_dir, "documents").select(asin.alias("asin"), "doc_id", "text", F.col("lang").alias("country"), "source")


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS review_no FROM documents WHERE length(trim(text)) > 0")
def reviews_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.number_reviews(table(spark, sf_dir, "documents"), "source", ("doc_id",)).select("doc_id", "source", "review_no")


@query("SELECT doc_id, md5(text) AS review_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dedup_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [F.col("doc_id")]).select("doc_id", "review_md5")


@query("""SELECT doc_id, CASE WHEN length(text) < 40 THEN 'trivial' WHEN length(text) > 3000 THEN 'long' WHEN lang <> 'en' THEN 'foreign' WHEN toxic = 1 THEN 'low_star' ELSE 'typical' END AS stratum
FROM documents LEFT JOIN labels USING (doc_id)""")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stars = F.when(F.col("toxic") == 1, "1").otherwise("5")
    return docs.select("doc_id", gold.stratum(F.col("text"), F.col("lang"), stars, home="en", long=3000).alias("stratum"))


_STRATUM_SQL = "CASE WHEN length(text) < 40 THEN 'trivial' WHEN length(text) > 3000 THEN 'long' WHEN country <> 'en' THEN 'foreign' ELSE 'typical' END"


@query(f"""WITH {REVIEWS_SQL}, d AS (SELECT *, {_STRATUM_SQL} AS stratum, md5('0:' || asin || ':' || doc_id) AS h FROM reviews QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1),
test AS (SELECT * FROM d ORDER BY h, asin, doc_id LIMIT 60),
pool AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, asin, doc_id) AS r FROM d WHERE asin NOT IN (SELECT asin FROM test)),
even AS (SELECT * FROM pool WHERE r <= 10),
more AS (SELECT * FROM pool WHERE r > 10 AND stratum = 'typical' ORDER BY h, asin, doc_id LIMIT (SELECT 50 - count(*) FROM even))
SELECT asin, doc_id, stratum, 'test' AS split FROM test UNION ALL SELECT asin, doc_id, stratum, 'dev' FROM even UNION ALL SELECT asin, doc_id, stratum, 'dev' FROM more""")
def gold_split_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.dedup_content(reviews(spark, sf_dir), "text", [F.col("doc_id")])
    rows = rows.withColumn("stratum", gold.stratum(F.col("text"), F.col("country"), F.lit(None).cast("string"), home="en", long=3000))
    return gold.gold_splits(rows, 50, 60, "0", "asin", ("asin", "doc_id")).select("asin", "doc_id", "stratum", "split")


@query("""SELECT doc_id AS product_id, CAST(count(*) OVER (PARTITION BY md5(text)) AS INTEGER) AS cluster_size, count(*) OVER (PARTITION BY md5(text)) > 2 AS is_placeholder,
  count(*) OVER (PARTITION BY md5(text)) <= 2 AND doc_id % 7 <> 0 AS usable FROM documents""")
def manifest_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 7 == 0, "http_error").when(F.col("doc_id") % 7 == 1, "skip").otherwise("ok")
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("product_id"), status.alias("status"), F.md5("text").alias("md5"))
    return tables.mark_placeholders(manifest, 2).select(F.col("product_id").cast("long").alias("product_id"), "cluster_size", "is_placeholder", "usable")


@query("""WITH c AS (SELECT md5(text) AS m, count(*) AS size FROM documents GROUP BY 1)
SELECT t AS threshold, CAST(sum(CASE WHEN size > t THEN size ELSE 0 END) AS BIGINT) AS placeholder_rows, CAST(sum(CASE WHEN size > t THEN 1 ELSE 0 END) AS BIGINT) AS placeholder_clusters,
  CAST(sum(CASE WHEN size > t THEN 0 ELSE size END) AS BIGINT) AS kept_rows FROM c, (VALUES (1), (2), (5), (10), (50), (100)) AS l(t) GROUP BY 1""")
def cluster_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cluster_sweep(table(spark, sf_dir, "documents").select(F.md5("text").alias("md5")), [1, 2, 5, 10, 50, 100])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1")
    return tables.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), done, ["doc_id"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def manifest_upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return tables.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "event_id")


@query("""WITH l AS (SELECT 'u' || user_id AS asin, CAST(event_id % 3 AS INTEGER) AS review_no, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) = 1)
SELECT asin, review_no, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS facet, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'positive' END AS polarity FROM l
UNION ALL SELECT asin, review_no, 'second', 'negative' FROM l WHERE event_id % 5 = 1""")
def checkpoint_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    aspect = lambda f, p: F.struct(f.alias("facet"), F.lit(p).alias("polarity"), F.lit("").alias("evidence"))
    five = F.col("event_id") % 5
    one = aspect(F.col("event_type"), "positive")
    aspects = F.when(five == 0, F.array().cast(f"array<{A.ASPECT}>")).when(five == 1, F.array(one, aspect(F.lit("second"), "negative"))).otherwise(F.array(one))
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asin"), (F.col("event_id") % 3).cast("int").alias("review_no"), F.lit("").alias("review_md5"), aspects.alias("aspects"), "event_id")
    return extraction.compact(log, "event_id").select("asin", "review_no", "facet", "polarity")


@query("""WITH r AS (SELECT d.doc_id, md5(text) AS m, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT *, m IN (SELECT m FROM r WHERE done) AS known, row_number() OVER (PARTITION BY m, done ORDER BY doc_id) AS k FROM r)
SELECT CASE WHEN done THEN 'skipped' WHEN known THEN 'cached' WHEN k = 1 THEN 'first' ELSE 'duplicate' END AS plan, count(*) AS n FROM p GROUP BY 1""")
def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.lit("a").alias("asin"), F.col("doc_id").alias("review_no"), "text")
    log = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_no")), "review_no", "left_semi").withColumn("review_md5", F.md5("text"))
    return extraction.classify(rows, log).groupBy("plan").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS n_messages, string_agg(role || '=' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1""")
def messages_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), turns.alias("t"))
    return out.select("conv_id", "n_messages", F.array_join(F.transform("t", lambda m: F.concat(m["role"], F.lit("="), m["text"])), "|").alias("messages"))


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 4) AS p25,
  round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.75), 4) AS p75, round(quantile_cont(n_chars, 0.95), 4) AS p95, max(n_chars) AS max FROM documents GROUP BY 1""")
def describe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.describe(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("""WITH p AS (SELECT source, doc_id // 5 AS asin, avg(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS f FROM documents GROUP BY 1, 2)
SELECT source, count(*) AS products, round(avg(f), 6) AS mean_foreign, round(max(f), 6) AS max_foreign, count(CASE WHEN f > 0 THEN 1 END) AS with_foreign FROM p GROUP BY 1""")
def locale_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.foreign_fraction(reviews(spark, sf_dir), "source", "asin", F.col("country") != "en")


@query("""SELECT lang, 'k' AS key, 100.0::DOUBLE AS present_pct, 100.0::DOUBLE AS filled_pct, 'bigint' AS types FROM (SELECT DISTINCT event_type AS lang FROM events)""")
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.schema_profile(table(spark, sf_dir, "events").withColumnRenamed("event_type", "lang"), "props", "lang")


@query("""WITH e AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT user_id, round(date_sub('second', a, b) / 60.0, 1) AS minutes FROM e WHERE round(date_sub('second', a, b) / 60.0, 1) > 1""")
def loop_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.log_minutes(table(spark, sf_dir, "events"), "user_id", "ts", "ts").select("user_id", "minutes")


@query("""SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'))) AS s FROM documents) WHERE length(s) >= 15 GROUP BY 1""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", P.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


_SHINGLES_SQL = """SELECT DISTINCT {key}, list_aggregate(w[i:i+7], 'string_agg', ' ') AS s FROM (
  SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 8)"""


@query(f"""WITH a AS ({_SHINGLES_SQL.format(key='item_id', table='benchmark')}), b AS ({_SHINGLES_SQL.format(key='doc_id', table='documents')})
SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (s) GROUP BY 1, 2""")
def contamination_8gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.shared_shingles(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 8, "item_id", "doc_id")


@query(f"""WITH a AS ({_SHINGLES_SQL.format(key='item_id', table='benchmark')})
SELECT item_id, doc_id, count(*) AS shared FROM a, documents WHERE contains(lower(text), s) GROUP BY 1, 2""")
def contamination_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.contained_shingles(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 8, "item_id", "doc_id")


@query("""SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT (source, lang)) AS pairs, count(DISTINCT text) AS texts,
  count(CASE WHEN lang = 'en' THEN 1 END) AS english, count(CASE WHEN length(text) >= 400 THEN 1 END) AS long_texts FROM documents""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("source", "lang").alias("pairs"), F.count_distinct("text").alias("texts"),
        F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.length("text") >= 400).alias("long_texts"),
    )


@query("""SELECT parser, count(*) AS n, round(100.0 * count(v) / count(*), 4) AS parsed_pct FROM (
  SELECT 'stars' AS parser, CASE WHEN text LIKE '%out of 5%' THEN 1 END AS v FROM documents UNION ALL SELECT 'any', 1 FROM documents) GROUP BY 1""")
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return inspect.parse_rates(docs, {"stars": P.parse_stars(F.col("text")), "any": F.lit(1)})


@query("SELECT event_type AS series, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def series_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_documents,
  (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_labels""")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.overlap(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "documents", "labels")


@query("""WITH e AS (SELECT event_type, count(*) AS n, date_sub('second', min(ts), max(ts)) AS s FROM events GROUP BY 1) SELECT event_type, n, round(s / n, 6) AS seconds_each, round(s / n * 1000000 / 86400.0, 4) AS days_for_million FROM e""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.throughput(table(spark, sf_dir, "events"), "event_type", "ts", 1_000_000).withColumnRenamed("days", "days_for_million")


@query("""SELECT bucket, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS bucket FROM documents) GROUP BY 1""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE length(text) END AS text_len FROM documents")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.text_length(F.when(F.col("doc_id") % 9 != 0, F.col("text"))).alias("text_len"))


@query("""WITH s AS (SELECT DISTINCT doc_id // 5 AS product, trim(unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*'))) AS s FROM documents WHERE lang = 'en')
SELECT 'p' || product AS asin, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s WHERE length(s) >= 15 GROUP BY 1""")
def product_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.product_sentences(reviews(spark, sf_dir), "asin", "text", F.col("country") == "en")
    return found.groupBy("asin").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query("""SELECT unnest([25, 50, 75, 100]) AS arm, unnest([count(*) FILTER (h < 25), count(*) FILTER (h < 50), count(*) FILTER (h < 75), count(*)]) AS n FROM (SELECT ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % 100 AS h FROM documents)""")
def scaling_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.scaling_arms(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).groupBy("arm").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 50")
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.page_after(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 20, 50)


@query("""SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction_stream.windowed_counts(table(spark, sf_dir, "events"))
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES, ORACLE = R.queries, R.oracle
