"""Stored tables: folders on shared storage, bucketed tables, committed stages,
tables that are replaced whole.

Paths go through Hadoop's file system, so any store works. Whatever is only of
use to one application lies in ``scratch`` and is deleted when that ends.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

POINTER = "_current"
AUTO_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
KEPT_VERSIONS = 2            # the current one, and the one that readers may still be in
CODEC = "zstd"               # of the intermediate tables


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _path(spark, path)
    return fs.exists(jpath)


def delete(spark: SparkSession, path: str) -> None:
    jpath, fs = _path(spark, path)
    fs.delete(jpath, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder (none where it is missing)."""
    jpath, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    jpath, fs = _path(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new."""
    jvm = spark._jvm
    target, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration()).rename(part, target, options)


_SCRATCH: dict[str, tuple[SparkSession, str]] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, on shared storage."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = (spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-scratch/{app}")
    return _SCRATCH[app][1]


def drop_scratch() -> None:
    """Delete the intermediate tables of the applications that still run."""
    for app, (spark, folder) in list(_SCRATCH.items()):
        if spark._jsc is not None and spark.sparkContext._jsc is not None:
            delete(spark, folder)
        del _SCRATCH[app]


atexit.register(drop_scratch)


def _table_name(path: str) -> str:
    return "tillroll_" + hashlib.sha1(path.encode()).hexdigest()[:24]


def buckets(spark: SparkSession) -> int:
    """Buckets of a stored table: as many as shuffles have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(df: DataFrame, path: str, bucket: str | None = None, tag: str | None = None,
          row: str | None = None) -> DataFrame:
    """Store ``df`` under ``path`` and read it back.

    With ``bucket`` the rows are bucketed and sorted by that column, so a later join
    on it needs no shuffle of this side; rows that are dealt by it already do not
    move. With ``tag`` (a column of few values) they lie in a folder per value and a
    reader that asks for one value opens no file of the others. With ``row`` each
    row of a true ``tag`` gets a number of its own, drawn by the task that writes it,
    so it is unique among the committed rows.
    """
    spark = df.sparkSession
    if bucket is None:
        w = df.write.mode("overwrite").option("compression", CODEC)
        (w.partitionBy(tag) if tag else w).parquet(path)
        return spark.read.parquet(path)
    n = buckets(spark)
    dealt = df.repartition(n, bucket)
    if row:
        dealt = dealt.withColumn(row, F.when(F.col(tag), F.monotonically_increasing_id()))
    w = dealt.write.mode("overwrite").option("compression", CODEC).option("path", path)
    # Rows read from buckets keep to these, so a task writes few of them.
    auto = spark.conf.get(AUTO_SCAN)
    spark.conf.set(AUTO_SCAN, "false")
    try:
        (w.partitionBy(tag) if tag else w).bucketBy(n, bucket).sortBy(bucket).saveAsTable(_table_name(path))
    finally:
        spark.conf.set(AUTO_SCAN, auto)
    return spark.table(_table_name(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write`` stored; another application finds its rows without
    the buckets, which its catalog does not know."""
    name = _table_name(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def keep(df: DataFrame, name: str, bucket: str | None = None, tag: str | None = None,
         row: str | None = None) -> DataFrame:
    """``df`` stored in the application's scratch folder."""
    return write(df, f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}", bucket, tag, row)


def input_digest(frames: dict[str, DataFrame]) -> str | None:
    """Digest of the tables' files (path, length, time of change) and of what is
    computed from them; None where a table does not come from files alone."""
    seen = []
    for name, df in sorted(frames.items()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        files = sorted(df.inputFiles())
        if not files or "LocalRelation" in plan or "LogicalRDD" in plan:
            return None
        seen.append(f"{name} {re.sub('#[0-9]+L?', '', plan)}")
        for f in files:
            jpath, fs = _path(df.sparkSession, f)
            status = fs.getFileStatus(jpath)
            seen.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]


class Stages:
    """Stages of a batch run, each committed once its table is stored.

    ``folder`` belongs to one set of inputs and parameters (``digest``). A stage
    counts when its manifest, written in one step after the table, names that
    digest; a rerun reads such stages and goes on at the first that is missing.
    ``computed`` lists the stages this run had to compute.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: str):
        self.spark, self.folder, self.digest = spark, folder, digest
        self.computed: list[str] = []

    def manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.folder}/{name}.json")
        return json.loads(text) if text else None

    def get(self, name: str, make: Callable[[], DataFrame], bucket: str | None = None,
            tag: str | None = None, row: str | None = None) -> DataFrame:
        done, path = self.manifest(name), f"{self.folder}/{name}"
        if done is None or done["digest"] != self.digest:
            write(make(), path, bucket, tag, row)
            self.computed.append(name)
            replace_text(self.spark, f"{self.folder}/{name}.json", json.dumps(
                {"stage": name, "digest": self.digest, "bucket": bucket, "tag": tag}))
        return read(self.spark, path)

    def drop(self) -> None:
        delete(self.spark, self.folder)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create-table-as-select in place of an earlier table.

    The rows go to a version folder of their own; when all are written, the
    pointer file is switched by one rename. A reader sees the old table or the
    new one, and a failed write leaves the old one as it is.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(f"{path}/{version}")
    except Exception:
        delete(spark, f"{path}/{version}")
        raise
    old = json.loads(read_text(spark, f"{path}/{POINTER}") or '{"versions": []}')["versions"]
    versions = [version, *old][:KEPT_VERSIONS]
    replace_text(spark, f"{path}/{POINTER}", json.dumps({"versions": versions}))
    for name in old[KEPT_VERSIONS - 1:]:
        delete(spark, f"{path}/{name}")


def current_version(spark: SparkSession, path: str) -> str:
    """Folder of the table's current version (``path`` itself where it has none)."""
    pointer = read_text(spark, f"{path}/{POINTER}")
    return f"{path}/{json.loads(pointer)['versions'][0]}" if pointer else path
