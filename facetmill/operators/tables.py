"""Ingest and dataset building: typed projections, scoped joins, review numbering, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators.guards import numbered, require_unique, sent

#: The gain of each relevance grade.
GAIN = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}


def _product_columns() -> list[Column]:
    category = F.coalesce("category", F.array().cast("array<string>"))
    return [
        *map(F.col, ("asin", "type", "locale", "template", "title")),
        P.parse_stars(F.col("stars")).alias("stars"),
        P.parse_ratings(F.col("ratings")).alias("n_ratings"),
        F.coalesce(F.size(F.coalesce("reviews", F.array())), F.lit(0)).cast("int").alias("n_reviews"),
        F.coalesce(F.size(F.map_keys("attrs")), F.lit(0)).cast("int").alias("n_attrs"),
        P.first_or_null(category).alias("cat_top"),
        *map(F.col, ("price", "image", "description")),
        category.alias("category"),
    ]


def _review_columns(review: Column, pos: Column) -> list[Column]:
    origin = P.parse_review_date(review["date"])
    return [
        *map(F.col, ("asin", "locale", "ord")),
        pos.alias("pos"),
        P.parse_stars(review["stars"]).alias("stars"),
        review["title"].alias("title"),
        F.coalesce(review["text"], F.lit("")).alias("text"),
        P.text_length(review["text"]).alias("text_len"),
        origin["country"].alias("country"),
        origin["date"].alias("date"),
    ]


def product_rows(records: DataFrame) -> DataFrame:
    """Raw scrape records as typed product rows; a missing list is empty, its first element null."""
    return records.select(*_product_columns())


def review_rows(records: DataFrame) -> DataFrame:
    """One row for each inline review, with its record's locale, ``ord`` and position, which make
    later numbering independent of partitions."""
    out = records.select("asin", "locale", "ord", F.posexplode("reviews").alias("pos", "r"))
    return out.select(*_review_columns(F.col("r"), F.col("pos")))


def scrape_rows(records: DataFrame) -> DataFrame:
    """Product and review rows of a scrape as one table of ``kind``, ``product`` and ``review``, so that both
    come from one pass: a record is read and parsed once. Of the two structs the other kind's is null."""
    kinds = [f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in make(records).schema)}>" for make in (product_rows, review_rows)]
    row = lambda kind, product, review: F.struct(F.lit(kind).alias("kind"), product.cast(kinds[0]).alias("product"), review.cast(kinds[1]).alias("review"))
    product = row("product", F.struct(*_product_columns()), F.lit(None))
    reviews = F.transform(F.coalesce("reviews", F.array()), lambda r, i: row("review", F.lit(None), F.struct(*_review_columns(r, i))))
    return records.select(F.inline(F.concat(F.array(product), reviews)))


def in_scope(judgments: DataFrame, version: int = 1, locales: tuple[str, ...] = ("us",)) -> DataFrame:
    return judgments.where((F.col("small_version") == version) & F.col("product_locale").isin(*locales))


def build_products(judgments: DataFrame, catalog: DataFrame, scraped: DataFrame, version: int = 1, locales: tuple[str, ...] = ("us",)) -> DataFrame:
    """Catalog rows with their scrape metadata, for products that the scoped judgments name. Keys
    must be unique on both sides within the locales, scoped or not."""
    left = require_unique(catalog.where(F.col("product_locale").isin(*locales)).drop("product_locale"), "product_id")
    meta = scraped.where(F.col("locale").isin(*locales)).select("asin", "type", "template", "category", "cat_top", "stars", "n_ratings", "n_reviews", "price", "image", "n_attrs")
    right = require_unique(meta, "asin")
    wanted = in_scope(judgments, version, locales).select("product_id")
    return left.join(right, left.product_id == right.asin).drop("asin").join(wanted, "product_id", "left_semi")


def gain_of(label: Column, gains: dict[str, float] | None = None) -> Column:
    """The gain of a grade; null for one that isn't known."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in (gains or GAIN).items() for v in kv]), label)


def build_qrels(judgments: DataFrame, products: DataFrame, version: int = 1, locales: tuple[str, ...] = ("us",)) -> DataFrame:
    rows = in_scope(judgments, version, locales).join(products.select("product_id"), "product_id", "left_semi")
    return rows.select("query_id", "query", "product_id", "esci_label", "split", gain_of(F.col("esci_label")).alias("gain"))


def build_reviews(reviews: DataFrame, products: DataFrame) -> DataFrame:
    rows = reviews.join(products.select(F.col("product_id").alias("asin")), "asin", "left_semi")
    return rows.withColumnsRenamed({"stars": "rev_stars", "title": "rev_title"})


#: A key with more rows than this is numbered by ranges, in many tasks.
HOT_ROWS = 1_000_000


def number_reviews(reviews: DataFrame, key: str = "asin", order: tuple[str, ...] = ("ord", "pos"), text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``review_no`` from 0 in file order; blank texts go only afterwards, so numbers have gaps.

    Rows are numbered key by key. The rows of a hot key are sorted by ranges of its order instead and a
    range's first number is the count of the ranges before it, so no task sorts a key of any size. Both
    give the same numbers where ``order`` has no ties."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    crowded = reviews.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select("__hot")
    if not crowded.take(1):
        out = reviews.withColumn("review_no", number.cast("int"))
    else:
        hot = sent(crowded)
        same = F.col(key).eqNullSafe(F.col("__hot"))
        calm = reviews.join(hot, same, "left_anti").withColumn("review_no", number.cast("int"))
        placed = numbered(reviews.join(hot, same, "left_semi"), [F.col(key), *[F.col(c) for c in order]], "__place")
        first = placed.groupBy(F.col(key).alias("__hot")).agg(F.min("__place").alias("__first"))
        counted = placed.join(sent(first), same).withColumn("review_no", (F.col("__place") - F.col("__first")).cast("int"))
        out = calm.unionByName(counted.select(*reviews.columns, "review_no"))
    return out.where(F.length(P.strip(F.coalesce(F.col(text), F.lit("")))) > 0)


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (descending order keeps the last)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup_content(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first row of each distinct text, with ``review_md5``."""
    return keep_one(rows.withColumn("review_md5", P.content_hash(F.col(text))), ["review_md5"], order)


def upsert(previous: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Both tables with the latest row of each key."""
    return keep_one(previous.unionByName(new, allowMissingColumns=True), [key], [F.desc(sequence)])


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def images_to_fetch(products: DataFrame, px: int = 256) -> DataFrame:
    urls = products.select("product_id", F.col("image").alias("url")).where(F.length(P.strip(F.col("url"))) > 0)
    return urls.withColumn("url_small", P.canonical_image_url(F.col("url"), px)).where("url_small IS NOT NULL")


def mark_placeholders(manifest: DataFrame, cluster_max: int = 10, root: str = "") -> DataFrame:
    """Images shared by more than ``cluster_max`` products are placeholders. Every status counts;
    rows without a hash are in no cluster."""
    sizes = manifest.where("md5 IS NOT NULL").groupBy("md5").agg(F.count("*").cast("int").alias("cluster_size"))
    out = manifest.join(sizes, "md5", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0)))
    out = out.withColumn("is_placeholder", F.col("cluster_size") > cluster_max)
    return out.withColumn("path", P.shard_path(F.col("product_id"), root)).withColumn("usable", F.col("status").isin("ok", "skip") & ~F.col("is_placeholder"))


def backfill_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` (product_id, content) supplies the hashes of rows whose download was skipped."""
    found = files.select("product_id", F.md5("content").alias("__md5"))
    return manifest.join(found, "product_id", "left").withColumn("md5", F.when((F.col("status") == "skip") & F.col("md5").isNull(), F.col("__md5")).otherwise(F.col("md5"))).drop("__md5")


def cluster_sweep(manifest: DataFrame, thresholds: list[int], hash_column: str = "md5") -> DataFrame:
    """How many rows each threshold would keep and flag."""
    sizes = manifest.where(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("size").agg((F.count("*") * F.col("size")).alias("rows"), F.count("*").alias("clusters"))
    each = sizes.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    over = F.col("size") > F.col("threshold")
    return each.groupBy("threshold").agg(
        F.sum(F.when(over, F.col("rows")).otherwise(0)).alias("placeholder_rows"),
        F.sum(F.when(over, F.col("clusters")).otherwise(0)).alias("placeholder_clusters"),
        F.sum(F.when(over, 0).otherwise(F.col("rows"))).alias("kept_rows"),
    )


def collisions(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """Groups with several rows and more than one label."""
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    return out.where("n > 1 AND labels > 1")


def product_sentences(reviews: DataFrame, product: str, text: str, wanted: Column | None = None) -> DataFrame:
    """The distinct sentences of each product's reviews, of those rows that ``wanted`` (a language, say) keeps."""
    rows = reviews if wanted is None else reviews.where(wanted)
    return rows.select(product, F.explode(P.sentences(F.col(text))).alias("sentence")).distinct()
