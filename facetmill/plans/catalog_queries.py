"""Queries over the catalogue side: parsing, scoped joins, buckets, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators import buckets, guards, inspect, tables
from facetmill.plans.registry import Registry, table

R = Registry()
query = R.query

#: A bucket needs so many reviews for each row of ``part``: scales the floor with the table.
FLOOR_SQL = "(SELECT greatest(1, count(*) // 5) FROM part)"

PRODUCTS_SQL = """products AS (
  SELECT p_partkey AS product_id, [p_type, p_brand, p_name] AS category, coalesce(n, 0) AS n_reviews
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products with a category path; line items as their reviews."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_reviews"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.array("p_type", "p_brand", "p_name").alias("category"))
    return part.join(counts, part.product_id == counts.l_partkey, "left").select("product_id", "category", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


def floor_of(spark: SparkSession, sf_dir: str) -> int:
    return max(1, table(spark, sf_dir, "part").count() // 5)


_ASSIGN_SQL = f"""{PRODUCTS_SQL}, nodes AS (
  SELECT prefix, sum(n_reviews) AS total FROM (
    SELECT category[1:d] AS prefix, n_reviews FROM products, (VALUES (1), (2), (3)) AS l(d)) GROUP BY 1),
assigned AS (
  SELECT product_id, max(CASE WHEN total >= {FLOOR_SQL} THEN d ELSE 0 END) AS depth FROM (
    SELECT product_id, d, category[1:d] AS prefix FROM products, (VALUES (1), (2), (3)) AS l(d)) x JOIN nodes USING (prefix) GROUP BY 1)"""


@query(f"WITH {_ASSIGN_SQL} SELECT product_id, CASE WHEN depth = 0 THEN '__global__' ELSE array_to_string(category[1:depth], ' > ') END AS bucket, depth FROM assigned JOIN products USING (product_id)")
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = buckets.assign_buckets(products(spark, sf_dir), floor_of(spark, sf_dir))
    return out.select("product_id", F.array_join("bucket", " > ").alias("bucket"), "depth")


@query(f"WITH {_ASSIGN_SQL} SELECT depth, count(*) AS n FROM assigned GROUP BY 1")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.depth_histogram(buckets.assign_buckets(products(spark, sf_dir), floor_of(spark, sf_dir)))


@query(f"""WITH {PRODUCTS_SQL}, b AS (
  SELECT d AS level, category[1:d] AS bucket, sum(n_reviews) AS reviews, count(*) AS products
  FROM products, (VALUES (1), (2), (3), (4), (5), (6)) AS l(d) GROUP BY 1, 2)
SELECT level, count(*) AS buckets, CAST(floor(quantile_cont(reviews, 0.5)) AS BIGINT) AS median_reviews, CAST(floor(quantile_cont(reviews, 0.25)) AS BIGINT) AS p25_reviews,
  round(100.0 * sum(CASE WHEN reviews < 1000 THEN products ELSE 0 END) / sum(products), 4) AS pct_products_under_1000,
  round(100.0 * sum(CASE WHEN reviews < 5000 THEN products ELSE 0 END) / sum(products), 4) AS pct_products_under_5000
FROM b GROUP BY 1""")
def bucket_stats_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.level_statistics(products(spark, sf_dir))


@query(f"""WITH {PRODUCTS_SQL} SELECT d - 1 AS depth, count(DISTINCT category[d]) AS "values", count(*) AS products
FROM products, (VALUES (1), (2), (3)) AS l(d) GROUP BY 1""")
def values_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.values_by_depth(products(spark, sf_dir))


_STARS_SQL = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5
  WHEN 0 THEN CAST(l_quantity / 10 AS VARCHAR) || ' out of 5 stars'
  WHEN 1 THEN replace(CAST(l_quantity / 10 AS VARCHAR), '.', ',') || ' de 5 estrellas'
  WHEN 2 THEN '5つ星のうち' || CAST(l_quantity / 10 AS VARCHAR)
  WHEN 3 THEN 'no rating' ELSE NULL END AS s FROM lineitem"""


@query(f"""SELECT l_orderkey, l_linenumber, round(CAST(CASE
  WHEN regexp_matches(s, '([\\d.]+)\\s+out of\\s+5') THEN try_cast(regexp_extract(s, '([\\d.]+)\\s+out of\\s+5', 1) AS FLOAT)
  WHEN regexp_matches(s, '([\\d,]+)\\s+de\\s+5') THEN try_cast(replace(regexp_extract(s, '([\\d,]+)\\s+de\\s+5', 1), ',', '.') AS FLOAT)
  WHEN regexp_matches(s, '5\\s*つ星のうち\\s*([\\d.]+)') THEN try_cast(regexp_extract(s, '5\\s*つ星のうち\\s*([\\d.]+)', 1) AS FLOAT) END AS DOUBLE), 4) AS stars FROM ({_STARS_SQL})""")
def parse_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("l_quantity") / 10).cast("string")
    kind = F.col("l_linenumber") % 5
    text = F.when(kind == 0, F.concat(number, F.lit(" out of 5 stars"))).when(kind == 1, F.concat(F.regexp_replace(number, r"\.", ","), F.lit(" de 5 estrellas"))).when(kind == 2, F.concat(F.lit("5つ星のうち"), number)).when(kind == 3, "no rating")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.parse_stars(text).cast("double"), 4).alias("stars"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' global ratings'
  WHEN 1 THEN '2.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' valoraciones' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || '個の評価' ELSE 'none yet' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '([\\d,]+)\\s+(?:global\\s+)?ratings?') THEN try_cast(replace(regexp_extract(s, '([\\d,]+)\\s+(?:global\\s+)?ratings?', 1), ',', '') AS INTEGER)
  WHEN regexp_matches(s, '([\\d.]+)\\s+valoraciones?') THEN try_cast(replace(regexp_extract(s, '([\\d.]+)\\s+valoraciones?', 1), '.', '') AS INTEGER)
  WHEN regexp_matches(s, '([\\d,]+)\\s*個の評価') THEN try_cast(replace(regexp_extract(s, '([\\d,]+)\\s*個の評価', 1), ',', '') AS INTEGER) END AS n_ratings FROM t""")
def parse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("1,"), small, F.lit(" global ratings"))).when(kind == 1, F.concat(F.lit("2."), small, F.lit(" valoraciones"))).when(kind == 2, F.concat(F.col("o_orderkey").cast("string"), F.lit("個の評価"))).otherwise("none yet")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.parse_ratings(text).alias("n_ratings"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'the United States' WHEN 1 THEN 'the United Kingdom' WHEN 2 THEN '日本' END AS country,
  CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS review_date FROM orders""")
def parse_review_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("Reviewed in the United States 🇺🇸n on "), F.date_format(d, "MMMM d, yyyy")))
        .when(kind == 1, F.concat(F.lit("Reviewed in the United Kingdom 🇬🇧 on "), F.date_format(d, "d MMMM yyyy")))
        .when(kind == 2, F.concat(F.date_format(d, "yyyy年M月d日"), F.lit("に日本でレビュー済み")))
        .otherwise("no date")
    )
    out = P.parse_review_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", out["country"].alias("country"), F.date_format(out["date"], "yyyy-MM-dd").alias("review_date"))


@query("""SELECT p_partkey AS product_id, 'https://m.media-amazon.com/images/I/' || p_partkey || '+x._SL256_.jpg' AS url_small FROM part WHERE p_partkey % 3 <> 0""")
def image_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://m.media-amazon.com/images/I/"), key, F.lit("+x._AC_US500_.jpg"))).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("https://x.example/images/I/"), key, F.lit("+x.jpg"))).otherwise("https://x.example/images/G/video.png")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), url.alias("image"))
    return tables.images_to_fetch(rows).select("product_id", "url_small")


@query("SELECT p_partkey, 'img/' || substr(p_name, 1, 2) || '/' || substr(p_name, 3, 2) || '/' || p_name || '.jpg' AS path FROM part")
def shard_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.shard_path(F.col("p_name"), "img").alias("path"))


@query("""SELECT p_partkey AS product_id, p_name AS product_title, p_brand AS product_brand, n AS n_reviews FROM part
JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def catalog_join_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    judged = items.join(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), items.l_orderkey == orders.o_orderkey)
    judgments = judged.select(F.col("l_partkey").alias("product_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("small_version"), F.col("o_orderpriority").alias("product_locale"))
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_title"), F.col("p_brand").alias("product_brand"))
    meta = items.groupBy(F.col("l_partkey").alias("asin")).agg(F.count("*").alias("n_reviews"))
    left, right = guards.require_unique(catalog, "product_id"), guards.require_unique(meta, "asin")
    scope = tables.in_scope(judgments, 1, ("1-URGENT", "2-HIGH"))
    return left.join(right, left.product_id == right.asin).drop("asin").join(scope.select("product_id"), "product_id", "left_semi")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def one_to_one_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""SELECT o_orderkey AS query_id, o_custkey AS product_id, g AS esci_label, CASE g WHEN 'E' THEN 1.0 WHEN 'S' THEN 0.1 WHEN 'C' THEN 0.01 WHEN 'I' THEN 0.0 END::DOUBLE AS gain
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'E' WHEN '2-HIGH' THEN 'S' WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'I' ELSE 'X' END AS g FROM orders)
WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def qrels_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for v in ("1-URGENT", "E", "2-HIGH", "S", "3-MEDIUM", "C", "4-NOT SPECIFIED", "I")]), F.col("o_orderpriority")), F.lit("X"))
    judgments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query"), F.col("o_custkey").alias("product_id"), grade.alias("esci_label"), F.lit("train").alias("split"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("small_version"), F.lit("us").alias("product_locale"))
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("product_id"))
    return tables.build_qrels(judgments, owners).select("query_id", "product_id", "esci_label", "gain")



@query("""SELECT 1 + (o_orderkey % 3) AS step_key, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY 1""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.shares(table(spark, sf_dir, "orders").select((1 + F.col("o_orderkey") % 3).alias("step_key")), "step_key")


@query("""SELECT unnest([1, 2, 3]) AS step, unnest(['catalog', 'with_reviews', 'with_20_reviews']) AS name, unnest([a, b, c]) AS n, unnest([100.0, round(100.0 * b / a, 4), round(100.0 * c / a, 4)])::DOUBLE AS pct
FROM (SELECT count(*) AS a, count(n) AS b, count(CASE WHEN n >= 20 THEN 1 END) AS c FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)""")
def coverage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.funnel(products(spark, sf_dir), {"catalog": F.lit(True), "with_reviews": F.col("n_reviews") > 0, "with_20_reviews": F.col("n_reviews") >= 20})


@query("""WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name)) AS d FROM part)
SELECT p_partkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(d, 17, 1))::INTEGER % 4), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""")
def stable_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.stable_uuid(F.col("p_name")).alias("point_id"))


@query("SELECT l_orderkey, l_returnflag, count(*) AS n, count(DISTINCT l_linestatus) AS labels FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT l_linestatus) > 1")
def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.collisions(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus")


@query("""SELECT count(*) AS products, round(avg(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END), 6) AS first_is_top FROM part""")
def first_is_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.when(key % 20 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    rows = table(spark, sf_dir, "part").select(path.alias("category"), F.when(key % 20 == 10, F.lit("elsewhere")).otherwise(F.col("p_type")).alias("cat_top"))
    return buckets.first_is_top(rows).select("products", F.round("first_is_top", 6).alias("first_is_top"))


@query("""SELECT p_partkey, p_type AS first, len(w) AS n, array_to_string(w[1:2], '/') AS head FROM (SELECT p_partkey, p_type, [p_type, p_brand, p_name] AS w FROM part)""")
def list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array("p_type", "p_brand", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", P.first_or_null(path).alias("first"), F.size(path).cast("long").alias("n"), F.array_join(F.slice(path, 1, 2), "/").alias("head"))


@query("""SELECT p_partkey, lower(p_type) AS facet, lower(p_type) || ' x' AS squeezed, chr(9) || p_name AS stripped FROM part""")
def text_tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        P.normalize_facet(F.concat(F.lit(" \u00a0"), F.upper(kind), F.lit("\t "))).alias("facet"),
        P.collapse_spaces(P.normalize_facet(F.concat(kind, F.lit(" \n\t X ")))).alias("squeezed"),
        P.strip_control(F.concat(F.lit("\x01\t"), F.col("p_name"), F.lit("\x1f"))).alias("stripped"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(o_orderkey AS DOUBLE) END AS number FROM orders""")
def numbers_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.col("o_totalprice").cast("string")).when(kind == 1, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).when(kind == 2, "n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.to_number(text).alias("number"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw scrape records, with two reviews for every third; ``ord`` is their order."""
    key = F.col("p_partkey")
    review = lambda n: F.struct(F.lit(f"{n}.0 out of 5 stars").alias("stars"), F.lit("t").alias("title"), F.concat(F.lit(f"text {n} of "), F.col("p_name")).alias("text"), F.lit("Reviewed in Canada on May 1, 2021").alias("date"))
    reviews = F.when(key % 3 == 0, F.array(review(4), review(2))).when(key % 3 == 1, F.array().cast("array<struct<stars:string,title:string,text:string,date:string>>"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("A"), key.cast("string")).alias("asin"), F.lit("product").alias("type"), F.lit("us").alias("locale"), F.lit("t").alias("template"), F.col("p_name").alias("title"),
        F.when(key % 2 == 0, "4.5 out of 5 stars").alias("stars"), F.concat((key % 900 + 1).cast("string"), F.lit(" ratings")).alias("ratings"),
        F.when(key % 5 != 0, F.array("p_type", "p_brand")).alias("category"), F.col("p_retailprice").cast("string").alias("price"), F.lit("u").alias("image"),
        F.when(key % 7 != 0, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).alias("attrs"), F.lit("d").alias("description"), reviews.alias("reviews"), key.alias("ord"),
    )


PRODUCT_ROWS_SQL = """SELECT 'A' || p_partkey AS asin, CASE WHEN p_partkey % 2 = 0 THEN 4.5 END::DOUBLE AS stars, CAST(p_partkey % 900 + 1 AS INTEGER) AS n_ratings, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS n_reviews,
  CASE WHEN p_partkey % 7 <> 0 THEN 2 ELSE 0 END AS n_attrs, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS cat_top, CASE WHEN p_partkey % 5 <> 0 THEN p_type || '/' || p_brand ELSE '' END AS path FROM part"""
REVIEW_ROWS_SQL = """SELECT 'A' || p_partkey AS asin, pos, CASE pos WHEN 0 THEN 4.0 ELSE 2.0 END::DOUBLE AS stars, length('text 4 of ' || p_name) AS text_len, 'Canada' AS country, '2021-05-01' AS date FROM part, (VALUES (0), (1)) AS l(pos) WHERE p_partkey % 3 = 0"""


def show_products(rows: DataFrame) -> DataFrame:
    out = tables.product_rows(rows)
    return out.select("asin", F.col("stars").cast("double").alias("stars"), "n_ratings", "n_reviews", "n_attrs", "cat_top", F.array_join("category", "/").alias("path"))


def show_reviews(rows: DataFrame) -> DataFrame:
    out = tables.review_rows(rows)
    return out.select("asin", "pos", F.col("stars").cast("double").alias("stars"), "text_len", "country", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(PRODUCT_ROWS_SQL)
def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_products(records(spark, sf_dir))


@query(REVIEW_ROWS_SQL)
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_reviews(records(spark, sf_dir))


QUERIES, ORACLE = R.queries, R.oracle
