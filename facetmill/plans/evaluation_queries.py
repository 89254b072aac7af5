"""Queries over evaluation: aspect cells, matching, scores, intervals, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import aspects as A
from facetmill.operators import gold, scores
from facetmill.plans.registry import Registry, table

R = Registry()
query = R.query

#: Cells that stand for annotations, by document id.
CELLS = ["Battery Life : pos; size: NEG", "none", "", "a:b: neu;; weight:+ ;", "no colon; : pos; fit: meh", " - ", "x  y\tz: negative"]
_CELL_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {c!r}" for i, c in enumerate(CELLS)).replace("\\t", "\t") + " END"
_ITEMS_SQL = f"""cells AS (SELECT doc_id, regexp_replace({_CELL_SQL}, '^\\s+|\\s+$', '', 'g') AS cell FROM documents),
items AS (SELECT doc_id, i, regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS item FROM (SELECT doc_id, string_split(cell, ';') AS parts, unnest(range(1, len(string_split(cell, ';')) + 1)) AS i FROM cells WHERE lower(cell) NOT IN ('', 'none', '-'))),
parsed AS (SELECT doc_id, i, item, regexp_replace(lower(regexp_replace(regexp_extract(item, '^(.*):([^:]*)$', 1), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS facet,
  lower(regexp_replace(regexp_extract(item, '^(.*):([^:]*)$', 2), '^\\s+|\\s+$', '', 'g')) AS pol FROM items WHERE item <> ''),
checked AS (SELECT *, CASE WHEN pol IN ('pos', 'positive', '+') THEN 'positive' WHEN pol IN ('neg', 'negative', '-') THEN 'negative' WHEN pol IN ('neu', 'neutral', '0') THEN 'neutral' END AS polarity FROM parsed),
judged AS (SELECT doc_id, string_agg(CASE WHEN facet <> '' AND polarity IS NOT NULL THEN facet || '=' || polarity END, '|' ORDER BY i) AS good, count(CASE WHEN facet = '' OR polarity IS NULL THEN 1 END) AS errors FROM checked GROUP BY 1)"""


def _cell() -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("doc_id") % 7 + 1).cast("int"))


@query(f"""WITH {_ITEMS_SQL} SELECT doc_id, cell = '' AS blank, CASE WHEN cell = '' THEN NULL ELSE coalesce(good, '') END AS aspects, coalesce(errors, 0) AS errors FROM cells LEFT JOIN judged USING (doc_id)""")
def aspects_dsl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents").select("doc_id", A.parse_cell(_cell()).alias("p"))
    shown = F.array_join(F.transform("p.aspects", lambda a: F.concat_ws("=", a["facet"], a["polarity"])), "|")
    return parsed.select("doc_id", F.col("p.aspects").isNull().alias("blank"), shown.alias("aspects"), F.size("p.errors").cast("long").alias("errors"))


@query(f"""WITH {_ITEMS_SQL}, shown AS (SELECT doc_id, string_agg(facet || ': ' || CASE polarity WHEN 'positive' THEN 'pos' WHEN 'negative' THEN 'neg' ELSE 'neu' END, '; ' ORDER BY i) AS s FROM checked WHERE facet <> '' AND polarity IS NOT NULL GROUP BY 1)
SELECT doc_id, coalesce(s, 'none') AS cell FROM documents LEFT JOIN shown USING (doc_id)""")
def aspects_dsl_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.format_cell(A.parse_cell(_cell())["aspects"]).alias("cell"))


# Aspects that stand for gold and prediction: facets are digits of the id, one pair can repeat.
_GOLD_SQL = "[{'f': 'a' || (doc_id % 3), 'p': 'positive'}, {'f': 'b' || (doc_id % 4), 'p': 'negative'}, {'f': 'a' || (doc_id % 5), 'p': 'neutral'}]"
_PRED_SQL = "[{'f': 'a' || (doc_id % 5), 'p': 'positive'}, {'f': 'b' || (doc_id % 2), 'p': 'negative'}]"


def _pairs(*items: tuple[str, int, str]):
    return F.array(*[F.struct(F.concat(F.lit(name), (F.col("doc_id") % mod).cast("string")).alias("facet"), F.lit(p).alias("polarity")) for name, mod, p in items])


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold aspects of every document; predictions for those whose id doesn't divide by 11."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.select("doc_id", _pairs(("a", 3, "positive"), ("b", 4, "negative"), ("a", 5, "neutral")).alias("aspects"))
    predicted = docs.where("doc_id % 11 <> 0").select("doc_id", _pairs(("a", 5, "positive"), ("b", 2, "negative")).alias("aspects"))
    return scores.example_scores(labelled, predicted, ["doc_id"])


# Greedy matching of two predictions against three gold aspects, written out: a prediction of `a`
# takes the first equal gold `a`, and `b` has one place only, so the order plays no other part.
_EXAMPLES_SQL = """e AS (SELECT doc_id, doc_id % 11 <> 0 AS has,
  CASE WHEN doc_id % 3 = doc_id % 5 THEN 1 ELSE 3 END AS a_place, doc_id % 2 = doc_id % 4 AS b_hit FROM documents),
s AS (SELECT doc_id, CASE WHEN has THEN 1 + CAST(b_hit AS INTEGER) ELSE 0 END AS tp, CASE WHEN has THEN 1 - CAST(b_hit AS INTEGER) ELSE 0 END AS fp,
  CASE WHEN has THEN 2 - CAST(b_hit AS INTEGER) ELSE 3 END AS fn, CASE WHEN has THEN CAST(a_place = 1 AS INTEGER) + CAST(b_hit AS INTEGER) ELSE 0 END AS ph FROM e),
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s),
f AS (SELECT doc_id, tp, fp, fn, ph AS polarity_hits, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4)::DOUBLE AS f1 FROM x)"""


@query(f"WITH {_EXAMPLES_SQL} SELECT doc_id, tp, fp, fn, polarity_hits, f1 FROM f")
def greedy_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).select("doc_id", "tp", "fp", "fn", "polarity_hits", "f1")


_MICRO_SQL = """round(sum(tp) / (sum(tp) + sum(fp)), 4) AS facet_precision, round(sum(tp) / (sum(tp) + sum(fn)), 4) AS facet_recall,
  round(2 * (sum(tp) / (sum(tp) + sum(fp))) * (sum(tp) / (sum(tp) + sum(fn))) / ((sum(tp) / (sum(tp) + sum(fp))) + (sum(tp) / (sum(tp) + sum(fn)))), 4) AS facet_f1,
  round(sum(polarity_hits) / sum(tp), 4) AS polarity_accuracy"""


@query(f"WITH {_EXAMPLES_SQL} SELECT {_MICRO_SQL}, count(*) AS n_reviews FROM f")
def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.micro_scores(examples(spark, sf_dir))


@query(f"WITH {_EXAMPLES_SQL} SELECT doc_id, f1, fp, fn FROM f ORDER BY f1, fp + fn DESC, doc_id LIMIT 20")
def worst_n_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.worst(examples(spark, sf_dir), 20, ["doc_id"]).select("doc_id", "f1", "fp", "fn")


@query(f"WITH {_EXAMPLES_SQL} SELECT 'b' || (doc_id % 2) AS facet, count(*) AS n FROM f WHERE fp > 0 GROUP BY 1 ORDER BY n DESC, facet LIMIT 15")
def fp_fn_top_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.top_facets(examples(spark, sf_dir), "fp_facets")


@query("""WITH g AS (SELECT doc_id, ['a' || (doc_id % 3), 'b' || (doc_id % 4)] AS gold, ['a' || (doc_id % 5), 'b' || (doc_id % 2)] AS draft, doc_id % 13 = 0 AS other FROM documents WHERE doc_id % 11 <> 0)
SELECT count(*) AS rows_compared, count(CASE WHEN gold = draft AND NOT other THEN 1 END) AS rows_unchanged,
  CAST(sum(len(list_filter(gold, lambda x: NOT list_contains(draft, x)))) AS BIGINT) AS facets_added, CAST(sum(len(list_filter(draft, lambda x: NOT list_contains(gold, x)))) AS BIGINT) AS facets_removed,
  count(CASE WHEN other AND gold[1] = draft[1] THEN 1 END) AS polarity_changed FROM g""")
def annotation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda name, mod, p: F.struct(F.concat(F.lit(name), (F.col("doc_id") % mod).cast("string")).alias("facet"), p.alias("polarity"))
    said = F.when(F.col("doc_id") % 13 == 0, "neutral").otherwise("positive")
    docs = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    rows = docs.select("doc_id", F.array(item("a", 3, F.lit("positive")), item("b", 4, F.lit("negative"))).alias("gold"), F.array(item("a", 5, said), item("b", 2, F.lit("negative"))).alias("draft"))
    return gold.agreement(rows)


_SHEET_SQL = """CASE WHEN doc_id % 17 = 0 THEN 'not_in_manifest' WHEN doc_id % 13 = 0 THEN 'bad_flag' WHEN doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'unreviewed'
  WHEN doc_id % 7 = 2 THEN 'blank_gold' WHEN doc_id % 7 = 4 THEN 'parse_error' ELSE 'frozen' END"""


@query(f"SELECT {_SHEET_SQL} AS outcome, count(*) AS n FROM documents GROUP BY 1")
def sheet_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    flag = F.when(F.col("doc_id") % 13 == 0, "maybe").when(F.col("doc_id") % 11 == 0, " Skip").otherwise("")
    sheet = docs.select(F.lit("a").alias("asin"), F.col("doc_id").cast("string").alias("review_no"), flag.alias("flag"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("X ").alias("reviewed"), _cell().alias("gold_aspects"), F.lit("").alias("draft_aspects"))
    manifest = docs.where("doc_id % 17 <> 0").select(F.lit("a").alias("asin"), F.col("doc_id").cast("int").alias("review_no"), F.lit("dev").alias("split"))
    return gold.judge_sheet(sheet, manifest).groupBy("outcome").agg(F.count("*").alias("n"))


#: Resamples of each bootstrap.
TIMES = 10_000
_DRAWS_SQL = f"""n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS m FROM f),
h0 AS (SELECT b, m, (b * {scores.BY_SAMPLE} + i * {scores.BY_PLACE}) % {scores.MODULUS} AS h FROM range({TIMES}) AS r(b), n),
h1 AS (SELECT b, m, (h * h + h + 12345) % {scores.MODULUS} AS h FROM h0),
h2 AS (SELECT b, m, (h * h + 3 * h + 6789) % {scores.MODULUS} AS h FROM h1),
draws AS (SELECT b, h * m // {scores.MODULUS} AS i FROM h2)"""
_INTERVAL_SQL = f"""SELECT max(CASE WHEN r = {int(0.025 * TIMES) + 1} THEN v END) AS lo, max(CASE WHEN r = {int(0.975 * TIMES) + 1} THEN v END) AS hi, round(quantile_cont(v, 0.025), 6) AS lo_i, round(quantile_cont(v, 0.975), 6) AS hi_i
FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM sampled)"""


# The resampled units are reviews, each with its counts.
@query(f"""WITH {_EXAMPLES_SQL}, {_DRAWS_SQL},
sampled AS (SELECT b, round(2 * (sum(tp) / (sum(tp) + sum(fp))) * (sum(tp) / (sum(tp) + sum(fn))) / ((sum(tp) / (sum(tp) + sum(fp))) + (sum(tp) / (sum(tp) + sum(fn)))), 4) AS v FROM draws JOIN n USING (i) GROUP BY 1) {_INTERVAL_SQL}""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = scores.bootstrap(examples(spark, sf_dir), ["doc_id"], ["tp", "fp", "fn", "polarity_hits"], TIMES)
    out = scores.interval(scores.micro_scores(samples, "b"), "facet_f1", TIMES)
    return out.select("lo", "hi", F.round("lo_i", 6).alias("lo_i"), F.round("hi_i", 6).alias("hi_i"))


# Queries are customers; the paired difference of each is between two rates over its orders.
@query(f"""WITH f AS (SELECT o_custkey AS doc_id, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) - avg(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS d FROM orders GROUP BY 1),
{_DRAWS_SQL}, sampled AS (SELECT b, round(sum(d) / any_value(m), 6) AS v FROM draws JOIN n USING (i) GROUP BY 1), c AS ({_INTERVAL_SQL})
SELECT lo, hi, lo > 0 OR hi < 0 AS significant FROM c""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.avg((F.col("o_orderstatus") == "F").cast("int")) - F.avg((F.col("o_orderpriority") < "3").cast("int"))
    deltas = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(delta.alias("d"))
    samples = scores.bootstrap(deltas, ["o_custkey"], ["d"], TIMES).select("b", F.round(F.col("d") / F.col("n"), 6).alias("v"))
    out = scores.interval(samples, "v", TIMES)
    return out.select("lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@query("""WITH t AS (SELECT n_name AS test, round(0.001 + 0.04 * n_nationkey / 25, 6) AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS n FROM t)
SELECT test, p, round(least(1.0, max((n - r + 1) * p) OVER (ORDER BY p, test)), 6) AS holm, round(least(1.0, min(n * p / r) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def holm_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "nation").select(F.col("n_name").alias("test"), F.round(0.001 + 0.04 * F.col("n_nationkey") / 25, 6).alias("p"))
    return scores.holm_bh(tests).select("test", "p", F.round("holm", 6).alias("holm"), F.round("bh", 6).alias("bh"))


@query("""WITH d AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), r AS (
  SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM d)
SELECT round(corr(ra, rb), 6) AS spearman FROM r""")
def star_crosscheck_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return scores.spearman(rows, "a", "b").select(F.round("spearman", 6).alias("spearman"))


@query("""SELECT l_linenumber AS stars, round(avg(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END), 6) AS polarity, count(*) AS n FROM lineitem GROUP BY 1""")
def star_crosscheck_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("stars")).agg(F.round(F.avg(sign), 6).alias("polarity"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_linenumber AS star, avg(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS v FROM lineitem GROUP BY 1), s AS (SELECT v - lag(v) OVER (ORDER BY star) AS step FROM m)
SELECT count(*) AS levels, min(step) >= 0 AS monotone, round(min(step), 6) AS least_step FROM s""")
def star_crosscheck_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("star"), sign.alias("sign"))
    return scores.star_curve(rows, "star", "sign").select("levels", "monotone", F.round("least_step", 6).alias("least_step"))


#: Model answers that stand for many, by document id: good, without polarity, broken, too long, of an unknown polarity, empty.
ANSWERS = [
    '{"aspects":[{"facet":" Fit ","polarity":"positive","evidence":"e"}]}',
    '{"aspects":[{"facet":"x"}]}',
    "{broken",
    '{"aspects":[' + ",".join(['{"facet":"a","polarity":"neutral","evidence":""}'] * 7) + "]}",
    '{"aspects":[{"facet":"x","polarity":"great","evidence":""}]}',
    '{"aspects":[]}',
]


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 5 THEN 0 END AS n_aspects, CASE doc_id % 6 WHEN 0 THEN 'fit' END AS facet,
  CASE doc_id % 6 WHEN 1 THEN 'bad aspect' WHEN 2 THEN 'no aspects' WHEN 3 THEN 'too many aspects' WHEN 4 THEN 'bad aspect' END AS error FROM documents""")
def model_output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("doc_id") % len(ANSWERS) + 1).cast("int"))
    out = table(spark, sf_dir, "documents").select("doc_id", A.parse_model_output(answer).alias("p"))
    number = F.when(F.col("p.aspects").isNotNull(), F.size("p.aspects"))
    return out.select("doc_id", number.alias("n_aspects"), F.get(F.col("p.aspects"), F.lit(0))["facet"].alias("facet"), F.col("p.error").alias("error"))


@query("""SELECT doc_id AS review_no, CASE WHEN doc_id % 3 = 0 THEN 'new: pos' WHEN doc_id % 2 = 0 THEN 'old: neg' ELSE '' END AS draft_aspects,
  CASE WHEN doc_id % 4 = 0 THEN 'kept: pos' WHEN doc_id % 3 = 0 THEN 'new: pos' ELSE ' ' END AS gold_aspects FROM documents""")
def drafts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("a").alias("asin"), F.col("doc_id").alias("review_no"))
    sheet = docs.select("asin", "review_no", F.when(F.col("review_no") % 2 == 0, "old: neg").otherwise("").alias("draft_aspects"), F.when(F.col("review_no") % 4 == 0, "kept: pos").otherwise(" ").alias("gold_aspects"))
    drafts = docs.where("review_no % 3 = 0").select("asin", "review_no", F.lit("new: pos").alias("draft"))
    return gold.merge_drafts(sheet, drafts).drop("asin")


@query("""SELECT user_id, max(value) AS best, arg_max(event_id, value) AS at FROM events GROUP BY 1""")
def best_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal best values the first event, as a plain scan meets it."""
    known = F.col("event_id").isNotNull() & F.col("value").isNotNull()
    first = F.max(F.when(known, F.struct("value", F.bitwise_not("event_id").alias("id"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.bitwise_not(first["id"]).alias("at"))


@query("""SELECT o_orderkey, CAST(regexp_extract(tag, '(\\d+)$', 1) AS INTEGER) AS round FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'v2' ELSE chr(CAST(97 + o_orderkey % 3 AS INTEGER)) || 'e' || (o_orderkey % 50) END AS tag, o_orderstatus FROM orders)
WHERE (tag = 'v2' OR regexp_full_match(tag, 'ae\\d+')) AND o_orderstatus = 'F'""")
def loop_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    tag = F.when(key % 10 == 0, "v2").otherwise(F.concat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (key % 3 + 1).cast("int")), F.lit("e"), (key % 50).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag"), "o_orderstatus")
    rows = rows.where(((F.col("tag") == "v2") | F.col("tag").rlike(r"^ae\d+$")) & (F.col("o_orderstatus") == "F"))
    return rows.select("o_orderkey", F.regexp_extract("tag", r"(\d+)$", 1).try_cast("int").alias("round"))


QUERIES, ORACLE = R.queries, R.oracle
