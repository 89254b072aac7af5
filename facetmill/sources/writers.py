"""Writers: zstd Parquet, append logs, gold files by split, manifests, immutable artifacts, packets."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators.scores import worst
from facetmill.operators.tables import scrape_rows


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 5_000_000) -> None:
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_scrape(records: DataFrame, path: str) -> None:
    """Products and reviews of a scrape, a folder for each kind, in one pass over the records and one commit."""
    scrape_rows(records).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def append_log(records: DataFrame, path: str) -> None:
    """Adds records as JSON lines, in a folder named by its time of commit, which orders appends. Each call
    commits files of its own, so a crash loses no earlier record and leaves no half line before a later one.
    One writer at a time: appends in the same microsecond have no order."""
    records.write.mode("errorifexists").json(f"{path}/commit={time.time_ns() // 1000}")


def write_gold(frozen: DataFrame, path: str) -> None:
    """Frozen rows as JSON lines, a folder for each split."""
    frozen.write.partitionBy("split").json(path)


#: Rows of a sampled set that are written as one file, at most.
MAX_SAMPLE = 1_000_000


def write_manifest(splits: DataFrame, path: str, seed: int) -> None:
    """The sampled set, some hundred rows, as one JSON file."""
    rows = [r.asDict() for r in splits.select("asin", "review_no", "split", "stratum", "review_md5").limit(MAX_SAMPLE + 1).collect()]
    if len(rows) > MAX_SAMPLE:
        raise ValueError(f"more than {MAX_SAMPLE} rows aren't a sample for one file")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"seed": seed, "n": len(rows), "rows": rows}, indent=1))


def write_blobs(blobs: DataFrame, root: str, key: str = "product_id", content: str = "content", suffix: str = ".jpg") -> DataFrame:
    """Stores each row's bytes in a sharded folder, and gives ``key`` and ``path``. Each task writes its own
    rows through the file system of ``root``, a file under another name first, so none is ever half there."""
    from facetmill.functions.parsing import shard_path
    from facetmill.session import ship_package

    ship_package(blobs.sparkSession)
    named = blobs.select(key, F.col(content).alias("content"), shard_path(F.col(key), root, suffix).alias("path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at + ".part") as out:
                    out.write(data)
                store.move(at + ".part", at)
            yield f[[key, "path"]]

    return named.mapInPandas(run, f"{key} {blobs.schema[key].dataType.simpleString()}, path string")


def write_artifact(doc: dict, folder: str) -> Path:
    """A prompt artifact under its version; an existing one is never overwritten."""
    target = Path(folder) / f"{doc['version']}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("x") as f:
        json.dump(doc, f, indent=1, ensure_ascii=False)
    return target


def swap_table(df: DataFrame, path: str) -> None:
    """Replaces a table that ``df`` may be read from: write beside it, move the old one aside, move the new
    one in, delete the old one. A crash leaves the old table at its place or aside; the next swap, or
    ``restore_table``, puts it back first."""
    spark = df.sparkSession
    restore_table(spark, path)
    new, aside, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.staged", f"{path}.aside", path))
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.staged")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        restore_table(spark, path)
        raise OSError(f"{path}.staged can't be moved in")
    fs.delete(aside, True)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a broken swap left aside; whether there was one."""
    aside, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.aside", path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(aside):
        return False
    if fs.exists(target):  # the new one was in already
        fs.delete(aside, True)
        return False
    return bool(fs.rename(aside, target))


def failure_packet(examples: DataFrame, texts: DataFrame, keys: list[str], n: int = 20) -> str:
    """Markdown of the n worst examples with their texts."""
    if n > 1000:
        raise ValueError("a packet is for reading; ask for 1000 examples at most")
    rows = texts.join(F.broadcast(worst(examples, n, keys)), keys, "right")
    lines = [f"# {n} worst examples by facet F1"]
    for r in rows.orderBy("f1", F.desc(F.col("fp") + F.col("fn")), *keys).collect():
        lines += [f"## {'#'.join(str(r[k]) for k in keys)}  f1={r['f1']} (fp={r['fp']} fn={r['fn']})", f"text: {r['text']}", f"false: {r['fp_facets']}", f"missed: {r['fn_facets']}", f"polarity: {r['polarity_errors']}"]
    return "\n".join(lines)
