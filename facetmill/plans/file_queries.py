"""Queries that write files into the shared folder and read them back: sources, sinks and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.operators import extraction
from facetmill.plans import catalog_queries as C
from facetmill.plans.registry import Registry, table
from facetmill.session import scratch
from facetmill.sources import readers, writers
from facetmill.streaming import extraction_stream, keyed_extraction

R = Registry()
query = R.query


def _scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through gzip JSON lines."""
    path = scratch(spark, "scrape")
    C.records(spark, sf_dir).drop("ord").write.option("compression", "gzip").json(path)
    return readers.read_scrape(spark, path)


@query(C.PRODUCT_ROWS_SQL)
def scrape_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.show_products(_scraped(spark, sf_dir))


@query(C.REVIEW_ROWS_SQL)
def scrape_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.show_reviews(_scraped(spark, sf_dir))


@query("""SELECT asin, 'product' AS kind, count(*) AS n, CAST(sum(len_) AS BIGINT) AS chars FROM (SELECT 'A' || p_partkey AS asin, length(p_name) AS len_ FROM part) GROUP BY 1
UNION ALL SELECT 'A' || p_partkey, 'review', count(*), CAST(sum(length('text 4 of ' || p_name)) AS BIGINT) FROM part, (VALUES (0), (1)) AS l(pos) WHERE p_partkey % 3 = 0 GROUP BY 1""")
def scrape_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and reviews from one pass over the scrape."""
    path = scratch(spark, "dual")
    writers.write_scrape(_scraped(spark, sf_dir), path)
    products = readers.read_scraped(spark, path, "product").select("asin", F.lit("product").alias("kind"), F.length("title").alias("c"))
    reviews = readers.read_scraped(spark, path, "review").select("asin", F.lit("review").alias("kind"), F.col("text_len").alias("c"))
    return products.unionByName(reviews).groupBy("asin", "kind").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


_COMMIT = "CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 10 < 9 THEN 1 ELSE 2 END"


@query(f"""WITH r AS (SELECT 'u' || user_id AS asin, CAST(event_id % 7 AS INTEGER) AS review_no, {_COMMIT} AS c, max(event_id) AS e FROM events GROUP BY ALL)
SELECT asin, review_no, 'e' || max_by(e, c) AS facet FROM r GROUP BY 1, 2""")
def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends to the log, a large one between small ones, with broken and blank lines after them; of
    each review the record of the last append is read."""
    path = scratch(spark, "log")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(user.alias("asin"), (F.col("event_id") % 7).cast("int").alias("review_no"), F.expr(_COMMIT).alias("c")).agg(F.max("event_id").alias("e"))
    aspects = F.array(F.struct(F.concat(F.lit("e"), F.col("e").cast("string")).alias("facet"), F.lit("positive").alias("polarity"), F.lit("").alias("evidence")))
    for c in range(3):
        writers.append_log(rows.where(F.col("c") == c).select("asin", "review_no", F.lit("m").alias("review_md5"), aspects.alias("aspects")), path)
    rows.select(F.when(F.col("e") % 2 == 0, "").otherwise('{"asin": "u1", "rev').alias("value")).write.text(f"{path}/commit=0")
    return readers.read_checkpoint(spark, path).select("asin", "review_no", F.col("aspects")[0]["facet"].alias("facet"))


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen gold rows as JSON lines, a folder for each split, read back split by split."""
    path = scratch(spark, "gold")
    aspects = F.array(F.struct(F.lit(" Fit ").alias("facet"), F.lit("positive").alias("polarity")))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("asin"), F.col("doc_id").cast("int").alias("review_no"), "text", F.lit("typical").alias("stratum"), aspects.alias("gold_aspects"), F.lit("").alias("rationale"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("dev").alias("split"))
    writers.write_gold(docs, path)
    read = [readers.read_gold(spark, f"{path}/split={s}").where("gold_aspects[0].facet = 'fit'").select(F.lit(s).alias("split"), "text") for s in ("test", "dev")]
    return read[0].unionByName(read[1]).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT n_nationkey, n_name || '!' AS name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zstd table replaced by one made from it."""
    path = scratch(spark, "table")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    writers.write_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    writers.swap_table(readers.read_columns(spark, path, "n_nationkey", "n_name", "n_regionkey").join(regions, "n_regionkey"), path)
    return readers.read_columns(spark, path, "n_nationkey", "n_name", "r_name").select("n_nationkey", F.concat("n_name", F.lit("!")).alias("name"), "r_name")


@query("SELECT n_name AS product_id, md5(n_name) AS md5, sha256(n_name) AS sha256, length(n_name) AS bytes FROM nation")
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sharded store of one file a nation, and the files' hashes."""
    path = scratch(spark, "blobs")
    blobs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("product_id"), F.col("n_name").cast("binary").alias("content"))
    writers.write_blobs(blobs, path).count()
    return readers.read_file_hashes(spark, path).select("product_id", "md5", "sha256", "bytes")


@query("""SELECT event_type AS series, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1""")
def log_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files with stamped lines and others, a folder for each series."""
    path = scratch(spark, "stamps")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf_dir, "events")
    lines = rows.select("event_type", F.explode(F.array(F.concat(stamp, F.lit(" seen")), F.lit("no stamp here"))).alias("value"))
    lines.write.partitionBy("event_type").text(path)
    return readers.read_log_stamps(spark, path).groupBy("series").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


#: Files of a micro-batch, more than any table here has: one batch a run, as the SQL of the streams counts.
FILES = 1 << 20


def answer(text: str) -> str:
    """A model that stands for others: fails on short texts, finds one aspect in long ones."""
    if len(text) < 60:
        raise RuntimeError("too short")
    return '{"aspects":[{"facet":"fit","polarity":"positive","evidence":"e"}]}' if len(text) > 1000 else '{"aspects":[]}'


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
SELECT CASE WHEN n < 60 AND k = 1 THEN 'failed' WHEN n < 60 THEN 'failed_dupes' WHEN k = 1 THEN 'extracted' ELSE 'cached' END AS outcome, count(*) AS n, count(CASE WHEN n > 1000 THEN 1 END) AS with_aspects FROM d GROUP BY 1""")
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as reviews through the resumable stream, in one micro-batch."""
    source, folder = scratch(spark, "reviews"), scratch(spark, "extraction")
    table(spark, sf_dir, "documents").select(F.lit("a").alias("asin"), F.col("doc_id").cast("int").alias("review_no"), "text").write.parquet(source)
    extraction_stream.start(spark, source, folder, answer, files_per_batch=FILES).awaitTermination()
    judged = spark.read.parquet(f"{folder}/outcomes")
    return judged.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.size("aspects") > 0).alias("with_aspects"))


@query("""SELECT count(*) AS reviews, count(*) FILTER (length(text) >= 60) AS done, count(*) FILTER (length(text) < 60) AS waiting FROM documents""")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream stopped after half of the files and started again: every review is done once, or waits."""
    source, folder = scratch(spark, "reviews"), scratch(spark, "extraction")
    docs = table(spark, sf_dir, "documents").select(F.lit("a").alias("asin"), F.col("doc_id").cast("int").alias("review_no"), "text")
    for half in (0, 1):
        docs.where(F.col("review_no") % 2 == half).write.mode("append").parquet(source)
        extraction_stream.start(spark, source, folder, answer, files_per_batch=FILES).awaitTermination()
    extraction_stream.retry_failed(spark, folder, answer)
    log = spark.read.parquet(f"{folder}/log").groupBy("asin", "review_no").agg(F.count("*").alias("times"))
    seen = docs.select("asin", "review_no").join(log, ["asin", "review_no"], "left")
    return seen.agg(F.count("*").alias("reviews"), F.count_if(F.col("times") == 1).alias("done"), F.count_if(F.col("times").isNull()).alias("waiting"))


@query("""WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS m, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT n, row_number() OVER (PARTITION BY m ORDER BY doc_id % 2, doc_id) AS k, row_number() OVER (PARTITION BY m, doc_id % 2 ORDER BY doc_id) AS k_half FROM d)
SELECT CASE WHEN n < 60 AND k_half = 1 THEN 'failed' WHEN n < 60 THEN 'failed_dupes' WHEN k = 1 THEN 'extracted' ELSE 'cached' END AS outcome, count(*) AS n, count(CASE WHEN n > 1000 THEN 1 END) AS with_aspects FROM r GROUP BY 1""")
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over growing input whose memory is keyed state: texts of the first are known in the second,
    texts that failed are asked again when they come again."""
    source, folder = scratch(spark, "reviews"), scratch(spark, "extraction")
    docs = table(spark, sf_dir, "documents").select(F.lit("a").alias("asin"), F.col("doc_id").cast("int").alias("review_no"), "text")
    for half in (0, 1):
        docs.where(F.col("review_no") % 2 == half).write.mode("append").parquet(source)
        keyed_extraction.start(spark, source, folder, answer).awaitTermination()
    judged = keyed_extraction.outcomes(spark, folder)
    return judged.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.size("aspects") > 0).alias("with_aspects"))


@query("""SELECT 'p' || (doc_id // 5) AS asin, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS n_positive, count(*) FILTER (doc_id % 2 = 1) AS n_negative FROM documents GROUP BY 1""")
def product_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    polarity = F.when(F.col("doc_id") % 2 == 0, "positive").otherwise("negative")
    aspects = F.array(F.struct(F.lit("fit").alias("facet"), polarity.alias("polarity"), F.lit("e").alias("evidence"))).cast(f"array<{A.ASPECT}>")
    log = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5).cast("long").cast("string")).alias("asin"), F.col("doc_id").alias("review_no"), F.lit("m").alias("review_md5"), aspects.alias("aspects"))
    return extraction.product_aspects(extraction.compact(log)).select("asin", "n", "n_positive", "n_negative")


QUERIES, ORACLE = R.queries, R.oracle
