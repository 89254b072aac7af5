"""Shared plumbing of the corpus operators: table access, the shared folder, Arrow batch bounds."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.session import delete_path, shared_dir, ship_package

#: Rows and bytes of one Arrow batch handed to a Python worker; the bytes bound the worker's memory.
BATCH_ROWS = 10_000
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: ship the package, keep Arrow batches small (texts may be long)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _leave_none() -> None:
    for spark, path in list(_written.values()):
        delete_path(spark, path)


_written: dict[str, tuple[SparkSession, str]] = {}
atexit.register(_leave_none)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor. They go with ``discard``, or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facetmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._facetmill_table = path
    _written[path] = spark, path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once all that was read from them is written too."""
    for t in tables:
        path = getattr(t, "_facetmill_table", None)
        if path in _written:
            delete_path(*_written.pop(path))


#: Bytes of keys that ``join_hot`` sends to all executors at most.
BROADCAST_BYTES = 16 << 20


def join_hot(big: DataFrame, small: DataFrame, on: list[str], hot: Column, each: int = 64) -> DataFrame:
    """``big`` joined with ``small``, a written table of one row (of ``each`` bytes) a key, in which few
    keys are ``hot``.

    A small table is sent to all tasks; of a larger one the hot keys are, so the rows of a hot key stay
    spread. Should even these be too many to send, run-time skew splitting is what is left.
    """
    if small.count() * each <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on)
    if not 0 < small.where(hot).count() * each <= BROADCAST_BYTES:
        return big.join(small, on)
    return big.join(small.where(~hot), on).unionByName(big.join(F.broadcast(small.where(hot)), on))


#: Arrays that one task adds up.
FAN_IN = 32


def sum_arrays(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the arrays of doubles in ``parts`` (lot int, part binary of ``width`` doubles), where
    lots number the partitions that made them. Levels of ``FAN_IN`` arrays a task, added one after
    another in the order of their lots: so memory is a task's few arrays whatever the number of
    partitions, and the sum is the same each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, total = None, np.zeros(width)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lot", "part"])
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lot is not None and at // FAN_IN != lot:
                    yield row()
                    total = np.zeros(width)
                lot = at // FAN_IN
                total += np.frombuffer(part.as_buffer(), np.float64)
        if lot is not None:
            yield row()

    tables = [materialize(parts, "sums")]
    last = tables[0].agg(F.max("lot")).first()[0]
    while last is not None and last >= FAN_IN:
        dealt = tables[-1].repartition(F.floor(F.col("lot") / FAN_IN)).sortWithinPartitions("lot")
        tables.append(materialize(dealt.mapInArrow(run, "lot int, part binary"), "sums"))
        last //= FAN_IN
    total = np.zeros(width)
    for r in tables[-1].orderBy("lot").toLocalIterator():
        total += np.frombuffer(bytes(r["part"]))
    discard(*tables)
    return total


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
