"""The runnable jobs as queries: each runs twice into one new folder, whose whole output is the result."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from facetmill.plans.registry import Registry
from facetmill.session import shared_dir
from jobs import facet_mentions, review_tables

R = Registry()
query = R.query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TABLES = json.loads(review_tables.CONFIG.read_text())
_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: length(s) >= {least})"


@query(f"""WITH r AS (SELECT doc_id, text, coalesce(nullif(lang, ''), 'und') AS lang, source, md5(text) AS review_md5 FROM documents WHERE regexp_matches(text, '[^\\s]')),
g AS (SELECT review_md5, min(doc_id) AS doc_id, count(*) AS n_copies, count(DISTINCT source) AS n_sources FROM r GROUP BY 1),
k AS (SELECT *, ('0x' || substr(md5('{_TABLES["seed"]}:' || review_md5), 1, 8))::BIGINT % 100 AS share FROM r JOIN g USING (doc_id, review_md5) LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT doc_id, review_md5, source, n_copies, n_sources, length(text) AS n_chars, len({_SENTENCES.format(least=15)}) AS n_sentences,
  CASE WHEN length(text) < {_TABLES["trivial_under"]} THEN 'trivial' WHEN length(text) > {_TABLES["long_over"]} THEN 'long' WHEN lang <> '{_TABLES["home"]}' THEN 'foreign' WHEN toxic = 1 THEN 'low_star' ELSE 'typical' END AS stratum,
  text, lang, CASE WHEN share < {_TABLES["percent"]["dev"]} THEN 'dev' WHEN share < {_TABLES["percent"]["dev"] + _TABLES["percent"]["test"]} THEN 'test' ELSE 'train' END AS split FROM k""")
def job1_review_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "review-tables")
    for _ in range(2):
        review_tables.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return spark.read.parquet(out)


_MENTIONS = json.loads(facet_mentions.CONFIG.read_text())


@query(f"""WITH t AS (SELECT md5(text) AS review_md5, {_SENTENCES.format(least=_MENTIONS["least_chars"])} AS sentences FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
h AS ({" UNION ALL ".join(f"SELECT review_md5, '{f}' AS facet, list_filter(sentences, lambda s: regexp_matches(s, '{p}')) AS hits FROM t" for f, p in sorted(_MENTIONS["facets"].items()))})
SELECT review_md5, len(hits) AS n_mentions, hits[1] AS evidence, facet FROM h WHERE len(hits) > 0""")
def job2_facet_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "facet-mentions")
    for _ in range(2):
        facet_mentions.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table")


QUERIES, ORACLE = R.queries, R.oracle
