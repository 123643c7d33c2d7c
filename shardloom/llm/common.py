"""Shared plumbing of the training-data operators: staged tables, Arrow batch
bounds, row identity and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; bounds the worker's memory when a
#: batch happens to hold only very long texts.
BATCH_ROWS = 256


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` whose worker, which is used again, gives
    the memory that it has freed back to the system at the end of each task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python operators run afterwards."""
    spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """The same for what runs inside; the session's own bound comes back."""
    own = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine (``local``) that names none gets one of its
    own; on a cluster executors would each write to their own disk.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="shardloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


_scopes: list[list[DataFrame]] = []


@contextmanager
def collected_stages(into: list[DataFrame]) -> Iterator[None]:
    """Note the tables that are staged inside, so that they can be released."""
    _scopes.append(into)
    try:
        yield
    finally:
        _scopes.remove(into)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a copy that outlives a lost executor. Use
    :func:`release` to delete a staged table that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shardloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    for scope in _scopes:
        scope.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no pending query reads."""
    for t in tables:
        path = getattr(t, "staged_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores appended while a column has it already."""
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, prefix: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b).

    Alternating large-star and small-star rounds: each round is a grouped
    minimum and one equi-join, hubs are pre-aggregated before the shuffle, and
    every round is staged so that no lineage piles up. ``component`` is the
    smallest node reachable. Nodes without links do not appear.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(low, "u")
        if large:
            out = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{prefix}-edges")
    before = mark(edges)
    while before[0]:
        new = stage(star(star(edges, True), False), f"{prefix}-edges")
        after = mark(new)
        release(edges)
        edges, done, before = new, after == before, after
        if done:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
