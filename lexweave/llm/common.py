"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a Python worker handles at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are left out at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def id_crc(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id's text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fold(column: str, modulus: int) -> Column:
    return id_crc(column) % modulus


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local session, as in tests, gets one of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder.rstrip("/")


#: The folder of this process below each scratch folder, removed when the process ends.
RUN = f"lexweave-{uuid.uuid4().hex}"
_roots: dict[str, SparkSession] = {}


@atexit.register
def _remove_roots() -> None:
    for root, spark in _roots.items():
        if spark.sparkContext._jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_scopes: list[list[DataFrame]] = []


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    _roots[root := f"{scratch_dir(spark)}/{RUN}"] = spark
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*settled: DataFrame) -> None:
    """Removes tables that settle() wrote and nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables settled inside are removed at the end, but for those put into the list that this gives."""
    _scopes.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        for df in _scopes.pop():
            if any(df is k for k in kept):
                if _scopes:
                    _scopes[-1].append(df)
            else:
                discard(df)


#: Rows that go to a Python worker at a time; bounds what executor and worker hold of long texts.
BATCH = 1024


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches; a size that the session sets below BATCH stays.

    Spark reads the size when a plan runs, which may be long after this returns, so the session keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, BATCH)
    return df.mapInArrow(fn, schema)


def map_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """mapInArrow over slices of at most SLICE rows, so that long texts don't pile up in a worker."""
    columns = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(at, SLICE))
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict({c: out[c] for c in columns})

    return map_batches(df, run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[str], bool]) -> DataFrame:
    """The rows, with all columns, whose text (null: empty) is to be kept; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                yield piece.filter(pa.array([keep(t or "") for t in piece.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, run, df.schema)
