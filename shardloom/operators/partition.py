"""Partition ids, histograms, offsets, slots, placement and balance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u64 import FNV_OFFSET, FNV_PRIME, HASHES, TWO64, log2_of


def with_pid(df: DataFrame, key: str | Column, p: int, hash_name: str = "fib32") -> DataFrame:
    """The rows with ``pid``, their key's partition."""
    return df.withColumn("pid", HASHES[hash_name](F.col(key) if isinstance(key, str) else key, p))


def histogram(df: DataFrame, key: str, p: int, hash_name: str = "fib32") -> DataFrame:
    """(pid, cnt) of all ``p`` partitions, empty ones too; null keys count nowhere."""
    counts = with_pid(df.filter(F.col(key).isNotNull()).select(key), key, p, hash_name).groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"))
    every = df.sparkSession.range(p).select(F.col("id").cast("int").alias("pid"))
    return every.join(counts, "pid", "left").select("pid", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def offsets(hist: DataFrame) -> DataFrame:
    """(pid, cnt, begin, end): exclusive prefix sums over the P rows of a histogram."""
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("cnt").over(before), F.lit(0))
    return hist.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("cnt"))


def worker_offsets(df: DataFrame, key: str, worker: str, p: int) -> DataFrame:
    """(pid, worker, cnt, begin): where each worker writes, partition by partition."""
    counts = with_pid(df, key, p).groupBy("pid", worker).agg(F.count(F.lit(1)).alias("cnt"))
    before = Window.orderBy("pid", worker).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("begin", F.coalesce(F.sum("cnt").over(before), F.lit(0)))


def scatter(df: DataFrame, key: str, order: list[str], p: int) -> DataFrame:
    """The rows with ``pid`` and ``slot``: a stable scatter into contiguous
    partitions. Each partition is ordered on its own; only the P offsets are joined."""
    rows = with_pid(df.filter(F.col(key).isNotNull()), key, p)
    begin = offsets(histogram(df, key, p)).select("pid", "begin")
    within = Window.partitionBy("pid").orderBy(*(order or [key]))
    placed = rows.withColumn("_r", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(begin), "pid").withColumn("slot", F.col("begin") + F.col("_r")).drop("_r", "begin")


def place(df: DataFrame, key: str, p: int) -> DataFrame:
    """The rows in ``p`` physical partitions, number pid for partition pid."""
    return with_pid(df, key, p).repartitionById(p, "pid")


def balance(hist: DataFrame) -> DataFrame:
    """One row: min, max, mean, max_over_mean, cov, gini, chi2_dof, entropy_norm, empty."""
    rank, every = Window.orderBy("cnt", "pid").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = hist.withColumn("cum", F.sum("cnt").over(rank)).withColumn("n", F.sum("cnt").over(every)).withColumn("p", F.count(F.lit(1)).over(every))
    share = F.col("cnt") / F.col("n")
    mean = F.col("n") / F.col("p")
    return rows.agg(
        F.min("cnt").alias("min_cnt"),
        F.max("cnt").alias("max_cnt"),
        F.avg("cnt").alias("mean_cnt"),
        (F.max("cnt") / F.avg("cnt")).alias("max_over_mean"),
        (F.stddev_pop("cnt") / F.avg("cnt")).alias("cov"),
        ((F.max("p") + 1.0) / F.max("p") - 2.0 * F.sum("cum") / (F.max("p") * F.max("n"))).alias("gini"),
        (F.sum((F.col("cnt") - mean) * (F.col("cnt") - mean) / mean) / (F.max("p") - 1)).alias("chi2_dof"),
        (-F.sum(F.when(F.col("cnt") > 0, share * F.log2(share)).otherwise(0.0)) / F.log2(F.max("p"))).alias("entropy_norm"),
        F.count_if(F.col("cnt") == 0).alias("empty"),
    )


def hash_quality(df: DataFrame, key: str, p: int, names: list[str] | None = None) -> DataFrame:
    """(hash, balance columns) for several partition hashes, in one pass over the keys."""
    names = list(HASHES) if names is None else names
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"))
    pids = F.explode(F.array(*[F.struct(F.lit(h).alias("hash"), HASHES[h](F.col("_k"), p).alias("pid")) for h in names]))
    counts = keys.select(pids.alias("x")).groupBy("x.hash", "x.pid").agg(F.count(F.lit(1)).alias("cnt"))
    every = df.sparkSession.createDataFrame([(h,) for h in names], "hash string").select("hash", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("pid"))
    hist = every.join(counts, ["hash", "pid"], "left").select("hash", "pid", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    by = Window.partitionBy("hash")
    rows = hist.withColumn("cum", F.sum("cnt").over(by.orderBy("cnt", "pid").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("cnt").over(by))
    share, mean = F.col("cnt") / F.col("n"), F.col("n") / p
    return rows.groupBy("hash").agg(
        F.max("n").alias("n"),
        (F.max("cnt") / F.avg("cnt")).alias("max_exp"),
        F.min("cnt").alias("min_cnt"),
        (F.stddev_pop("cnt") / F.avg("cnt")).alias("cov"),
        ((p + 1.0) / p - 2.0 * F.sum("cum") / (F.max("n") * p)).alias("gini"),
        (F.sum((F.col("cnt") - mean) * (F.col("cnt") - mean) / mean) / (p - 1)).alias("chi2_dof"),
        (-F.sum(F.when(F.col("cnt") > 0, share * F.log2(share)).otherwise(0.0)) / F.log2(F.lit(float(p)))).alias("entropy_norm"),
        F.count_if(F.col("cnt") == 0).alias("empty"),
    )


def skew_profile(hist: DataFrame) -> DataFrame:
    """One row: mean_load, max_load, max_over_mean, gini."""
    return balance(hist).select(F.col("mean_cnt").alias("mean_load"), F.col("max_cnt").alias("max_load"), "max_over_mean", "gini")


def dest_major(df: DataFrame, p: int, ranks: int, pid: str = "pid") -> DataFrame:
    """The rows with ``dest`` rank, ``lp`` and the permuted id of their partition."""
    check_ranks(p, ranks)
    dest, lp = F.pmod(pid, F.lit(ranks)), F.floor(F.col(pid) / ranks).cast("int")
    return df.withColumns({"dest": dest, "lp": lp, "perm": dest * (p // ranks) + lp})


def first_partitions(df: DataFrame, key: str, p: int, keep: int) -> DataFrame:
    return with_pid(df, key, p).filter(F.col("pid") < keep)


def check_ranks(p: int, ranks: int) -> None:
    """Partitions that can be dealt to ranks in turn: a power of two, at least
    one for each rank and as many for every rank."""
    log2_of(p)
    if ranks < 1 or p < ranks or p % ranks:
        raise ValueError(f"{p} partitions cannot be dealt evenly to {ranks} ranks")


def exchange_counts(df: DataFrame, key: str, source: str, p: int, ranks: int, hash_name: str = "fib32") -> DataFrame:
    """(source, dest, cnt): how many rows each source rank sends to each
    destination, all pairs of ranks, zeros too; null keys are not sent."""
    check_ranks(p, ranks)
    sent = with_pid(df.filter(F.col(key).isNotNull()).select(key, F.col(source).cast("int").alias("source")), key, p, hash_name)
    counts = sent.groupBy("source", F.pmod("pid", F.lit(ranks)).alias("dest")).agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.sequence(F.lit(0), F.lit(ranks - 1))
    every = df.sparkSession.range(1).select(F.explode(rank).alias("source")).select("source", F.explode(rank).alias("dest"))
    return every.join(counts, ["source", "dest"], "left").select("source", "dest", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def received_layout(df: DataFrame, key: str, p: int, ranks: int, hash_name: str = "fib32") -> DataFrame:
    """(dest, lp, cnt, begin): the partitions that each rank holds after the
    exchange, by local number, with their place among its rows."""
    rows = dest_major(histogram(df, key, p, hash_name), p, ranks)
    before = Window.partitionBy("dest").orderBy("lp").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("dest", "lp", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("begin"))


def pid_fold(df: DataFrame, order: str = "i", pid: str = "pid") -> DataFrame:
    """(checksum): the FNV-1a fold of pids in order. The rows are sorted in
    ranges, in parallel; the fold is not associative, so one task goes over the
    packed pids at last, block by block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([b.column(0).to_numpy().astype("<i8").tobytes()], pa.binary())], ["part", "n", "pids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = FNV_OFFSET
        for b in batches:
            for raw in b.column(2).to_pylist():
                for v in np.frombuffer(raw, "<i8").tolist():
                    h = (h ^ v) * FNV_PRIME % TWO64
        yield pa.RecordBatch.from_arrays([pa.array([f"{h:016x}"])], ["checksum"])

    blocks = df.select(F.col(pid).cast("long").alias("v"), order).orderBy(order).select("v").mapInArrow(packed, "part long, n long, pids binary")
    return blocks.repartition(1).sortWithinPartitions("part", "n").mapInArrow(run, "checksum string")
