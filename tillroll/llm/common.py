"""Helpers shared by the corpus operators: staging, links, bounded groups."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their
    Python workers can import it wherever they run (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="tillroll-"), "tillroll_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs run in here hand at most ``rows`` rows at once to a Python worker, so that
    an executor holds few whole texts outside its heap."""
    old = spark.conf.get(BATCH_ROWS)
    if not 0 < int(old) <= rows:
        spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, old)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Actions run in here delete their shuffle files when they end."""
    old = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, old)


def shared_path(spark, name: str) -> str:
    """A fresh folder under the folder the session's ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, page_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of any executor and
    is read, not recomputed, by every consumer. Pages of ``page_rows`` rows let
    a reader of a range of the column that ``df`` is sorted by skip the others.
    """
    path = shared_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    if page_rows:
        out = out.option("parquet.page.row.count.limit", page_rows)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark, path: str) -> None:
    """Remove a staged folder through Hadoop's file system (any store)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``edges(u, v)``: undirected links between long ids, repeats and loops
    allowed. Returns ``(node, component)``. Alternates the large-star and
    small-star steps, each one aggregate and one join on the node, until no
    link changes; every round is written to the shared folder. Node degrees
    enter only through a map-side combined ``min`` and through joins that
    adaptive execution may split, so a hub never gathers in one task.
    """
    spark = edges.sparkSession
    canon = (edges.where("u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur, sig = _staged_round(canon)
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        nxt, new_sig = _staged_round(_small_star(_large_star(cur)))
        if new_sig == sig:
            break
        cur, sig = nxt, new_sig
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()) \
        if sig[0] else spark.createDataFrame([], "node long, component long")


def _staged_round(df: DataFrame):
    got = stage(df, "links")
    row = got.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return got, (row["n"], row["h"])


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the node's smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, F.col("u") == F.col("n"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its lower neighbours are linked to the lowest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    moved = (e.join(low, F.col("u") == F.col("n")).where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return (moved.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
            .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct())
