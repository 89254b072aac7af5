"""Readers: compressed JSON lines, tolerant logs, gold files, manifests, file bytes, log stamps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import parsing as P
from facetmill.operators.extraction import read_log
from facetmill.sources.sheets import read_sheet_xlsx

#: The fields of a raw scrape record.
SCRAPE_SCHEMA = (
    "asin string, type string, locale string, template string, title string, stars string, ratings string, category array<string>, "
    "price string, image string, attrs map<string,string>, description string, reviews array<struct<stars:string,title:string,text:string,date:string>>"
)


def read_scrape(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of (zstd or gzip) JSON lines with ``ord``, their place in the file. A broken line
    raises; without ``strict`` it is kept in ``_corrupt_record``.

    A compressed file is one partition, so ``ord`` follows the lines; repartition afterwards.
    """
    schema = SCRAPE_SCHEMA + ("" if strict else ", _corrupt_record string")
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).withColumn("ord", F.monotonically_increasing_id())


def read_scraped(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one kind, ``product`` or ``review``, that ``write_scrape`` wrote."""
    return spark.read.parquet(f"{path}/kind={kind}").select(f"{kind}.*")


def read_judgments(spark: SparkSession, *paths: str) -> DataFrame:
    """All judgment files one after another, by column name."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The extraction log, last record of each review; broken lines are skipped.

    Records come in the order of their files' commits (``append_log``; files of other writers by their time
    of change), within a commit by file name, and within a file by place: neither the sizes of files nor how
    they are dealt to tasks matter.
    """
    at = F.col("_metadata.file_path")
    commit = F.nullif(F.regexp_extract(at, r"/commit=(\d+)/", 1), F.lit("")).cast("long")
    place = [F.coalesce(commit, F.unix_micros("_metadata.file_modification_time")).alias("commit"), at.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.struct(*place).alias("ord"))
    return read_log(lines, "value", "ord")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    schema = "asin string, review_no int, text string, stratum string, gold_aspects array<struct<facet:string,polarity:string>>, rationale string"
    tidy = F.transform("gold_aspects", lambda a: F.struct(P.normalize_facet(a["facet"]).alias("facet"), a["polarity"].alias("polarity")))
    return spark.read.schema(schema).json(path).withColumn("gold_aspects", tidy)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "seed int, n int, rows array<struct<asin:string,review_no:int,split:string,stratum:string,review_md5:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("rows"))


def read_file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``product_id`` (the file's name), md5, sha256 and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(name.alias("product_id"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_log_stamps(spark: SparkSession, path: str) -> DataFrame:
    """``series`` (the folder's ``event_type`` or other partition value, else the file's name), ``ts`` and
    ``ord`` of lines that start with a time stamp."""
    at = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(at, r"/[^/=]+=([^/]+)/[^/]+$", 1), F.lit(""))
    name = F.coalesce(F.url_decode(folder), F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", name.alias("series"), F.monotonically_increasing_id().alias("ord"))
    stamp = F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1)).cast("timestamp_ntz")
    return lines.select("series", stamp.alias("ts"), "ord").where("ts IS NOT NULL")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An annotation sheet, a workbook or CSV, all cells text and blanks empty."""
    if path.endswith(".xlsx"):
        return read_sheet_xlsx(spark, path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.fillna("")


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts of annotation cells, JSON lines; those without a key are skipped."""
    rows = spark.read.schema("asin string, review_no int, draft string").json(path)
    return rows.where("asin IS NOT NULL AND review_no IS NOT NULL")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """The state log of an optimisation loop, JSON lines: ``tag``, its ``parent``, and scores on dev rows."""
    kind = "tag string, parent string, facet_f1 double, polarity_accuracy double, accepted boolean, minutes double"
    return spark.read.schema(kind).json(path).where("tag IS NOT NULL")


def read_prompt(path: str) -> dict:
    """A versioned prompt artifact, JSON or (where a YAML library is installed) YAML; the version inside must
    be the file's name."""
    import json

    text = Path(path).read_text()
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: reading YAML needs a YAML library; JSON artifacts need none") from e
        doc = yaml.safe_load(text)
    else:
        doc = json.loads(text)
    if doc.get("version") != Path(path).stem:
        raise ValueError(f"{path} says version {doc.get('version')!r}")
    return doc
