"""Folders in any store that Spark reads: scratch space, names, listings."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A path's scheme and host.
_STORE = r"^[a-zA-Z][\w+.-]*:(//[^/]*)?"
_RUN = f"lexweave-files-{uuid.uuid4().hex}"
_roots: dict[str, SparkSession] = {}


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = store(spark, path)
    return system.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob matches; none where nothing does."""
    system, where = store(spark, pattern)
    return sorted(x.getPath().toString() for x in system.globStatus(where) or ())


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, where = store(spark, new)
    system.mkdirs(where.getParent())
    if not system.rename(store(spark, old)[1], where):
        raise OSError(f"can't move {old} to {new}")


@atexit.register
def _remove() -> None:
    for root, spark in _roots.items():
        if spark.sparkContext._jsc is not None:
            system, where = store(spark, root)
            system.delete(where, True)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one in spark.checkpoint.dir, removed when the process ends. Only a local session has
    one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    _roots[root := f"{base.rstrip('/')}/{_RUN}"] = spark
    return f"{root}/{uuid.uuid4().hex}"


def listed(spark: SparkSession, folder: str, depth: int = 1, glob: str | None = None) -> DataFrame:
    """(path, length) of the files at most ``depth`` levels down, the folder's own files being the first; no file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.sub(_STORE, "", folder).rstrip("/").count("/")
    slashes = F.length(F.regexp_replace(F.regexp_replace("path", _STORE, ""), "[^/]", ""))
    return reader.load(folder).select("path", "length").where(slashes - base <= depth)


def write_named(rows: DataFrame, folder: str) -> None:
    """Text files of given names from (name, value), a name perhaps with folders; the names are few (files, not rows)."""
    spark = rows.sparkSession
    parts = f"{folder}.parts"
    rows.select(F.hex(F.encode("name", "UTF-8")).alias("name"), "value").repartition("name").write.partitionBy("name").text(parts)
    for path in matching(spark, f"{parts}/name=*/part-*"):
        name = bytes.fromhex(re.search(r"/name=([^/]*)/", path).group(1)).decode()
        rename(spark, path, f"{folder}/{name}")
