"""Hot partitions: detection, splitting and salting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u64 import wrapping
from .partition import histogram, offsets


def weights(r: DataFrame, s: DataFrame, r_key: str, s_key: str, p: int) -> DataFrame:
    """(pid, r_cnt, s_cnt, weight) of all partitions."""
    a = histogram(r, r_key, p).withColumnRenamed("cnt", "r_cnt")
    b = histogram(s, s_key, p).withColumnRenamed("cnt", "s_cnt")
    return a.join(b, "pid").withColumn("weight", F.col("r_cnt") + F.col("s_cnt"))


def hot_partitions(w: DataFrame, workers: int, factor: int = 8) -> DataFrame:
    """(…, hot, splits): a partition above ``factor`` times the integer mean is
    hot; it is split in weight / mean parts, at least 2 and at most ``workers``."""
    mean = F.floor(F.sum("weight").over(Window.partitionBy()) / F.count(F.lit(1)).over(Window.partitionBy()))
    hot = (F.col("weight") > factor * F.col("mean")) & F.lit(workers > 1)
    parts = F.greatest(F.lit(2), F.least(F.when(F.col("mean") > 0, F.floor(F.col("weight") / F.col("mean"))).otherwise(1), F.lit(workers)))
    return w.withColumn("mean", mean).withColumn("hot", hot).withColumn("splits", F.when(F.col("hot"), parts).otherwise(1).cast("int"))


def split_ranges(split: DataFrame) -> DataFrame:
    """(pid, part, lo, hi): ranges of ceil(n / splits) probe rows; empty ones do not appear."""
    begin = offsets(split.select("pid", F.col("s_cnt").alias("cnt"))).select("pid", "begin", "end")
    rows = split.select("pid", "splits", "s_cnt").join(begin, "pid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    chunk = F.ceil(F.col("s_cnt") / F.col("splits"))
    return rows.withColumn("lo", F.col("begin") + F.col("part") * chunk).withColumn("hi", F.least(F.col("end"), F.col("lo") + chunk)).filter("lo < hi").select("pid", "part", "lo", "hi")


def salted_join_count(r: DataFrame, s: DataFrame, r_key: str, s_key: str, salts: int) -> DataFrame:
    """(join_count) with the probe side salted and the build side's counts
    copied to each salt: for joins that need the rows of hot keys themselves.
    The count is modulo 2^64, as a bit pattern."""
    build = r.filter(F.col(r_key).isNotNull()).groupBy(F.col(r_key).alias("key")).agg(F.count(F.lit(1)).alias("rc"))
    build = build.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    probe = s.select(F.col(s_key).alias("key"), F.pmod(F.xxhash64(*s.columns), F.lit(salts)).cast("int").alias("salt"))
    pairs = probe.join(build, ["key", "salt"])
    with wrapping(pairs.sparkSession):
        return pairs.agg(F.coalesce(F.sum("rc"), F.lit(0)).alias("join_count"))
