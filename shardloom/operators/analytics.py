"""Aggregates, windows and fits over result tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u64 import np_splitmix


def summary(value: str) -> list[Column]:
    """median, mean, population and sample deviation, min, max, sum and count of a column."""
    return [F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("n")]


def upper_median(value: str) -> Column:
    """Element n div 2 of the sorted values, from 0. Exact, so it holds a group's values."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def dedup_by_median(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per group with the medians of its measures."""
    return df.groupBy(*keys).agg(*(F.median(v).alias(v) for v in values))


def most_frequent(value: str) -> Column:
    """The mode, the least of ties."""
    return F.mode(value, True)


def best_by_distinct(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the group with the most distinct values, the first of ties."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n_distinct")).orderBy(F.desc("n_distinct"), group).limit(1)


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row per key: the first, or last, in the given order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_r = 1").drop("_r")


def first_ratio(df: DataFrame, groups: list[str], order: str, value: str, name: str = "ratio") -> DataFrame:
    """The rows with the group's first value in order over their own."""
    return df.withColumn(name, F.first(value).over(Window.partitionBy(*groups).orderBy(order)) / F.col(value))


def fill_forward(df: DataFrame, order: str, value: str, groups: list[str]) -> DataFrame:
    """The rows with nulls of a column replaced by the last value before them in their group."""
    so_far = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def speedup_against(df: DataFrame, keys: list[str], impl: str, base: str, value: str) -> DataFrame:
    """The rows of other implementations with their speedup against ``base`` at
    the same keys, by one conditional aggregate in place of a self-join."""
    at = Window.partitionBy(*keys)
    reference = F.max(F.when(F.col(impl) == base, F.col(value))).over(at)
    return df.withColumn("speedup", reference / F.col(value)).filter((F.col(impl) != base) & F.col("speedup").isNotNull())


def with_baseline(df: DataFrame, base: DataFrame, key: str, default: float) -> DataFrame:
    """A lookup with a default: left join on a small table of baselines (key, t_seq)."""
    return df.join(base, key, "left").withColumn("t_seq", F.coalesce("t_seq", F.lit(default)))


def reindex(df: DataFrame, keys: list[int], key: str) -> DataFrame:
    """A row for every listed key, nulls where there is none."""
    every = df.sparkSession.createDataFrame([(k,) for k in keys], f"{key} {dict(df.dtypes)[key]}")
    return every.join(df, key, "left")


def join_rounded(a: DataFrame, b: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Equi-join on a rounded double."""
    r = F.round(F.col(key), digits)
    return a.withColumn("_k", r).drop(key).join(b.withColumn("_k", r).drop(key), "_k").withColumnRenamed("_k", key)


def shares(df: DataFrame, groups: list[str], value: str, name: str = "share") -> DataFrame:
    """The rows with their percentage of the group's sum."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*groups)) * 100)


def critical_path(df: DataFrame, run: list[str], phases: list[str]) -> DataFrame:
    """The slowest rank of every phase."""
    return df.groupBy(*run).agg(*(F.max(p).alias(p) for p in phases))


def serial_share(df: DataFrame, groups: list[str], order: str, serial: str, total: str) -> DataFrame:
    """The rows with the cumulative serial time as a fraction of the cumulative total."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("serial_share", F.sum(serial).over(w) / F.sum(total).over(w))


def amdahl_fit(df: DataFrame, groups: list[str], p: str, s: str) -> DataFrame:
    """(groups, f, r2): least-squares serial fraction in [0, 1] of each group's
    few measured (workers, speedup) points."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        workers, speed = pdf[p].to_numpy(float), pdf[s].to_numpy(float)
        error = lambda f: float(((speed - 1 / (f + (1 - f) / workers)) ** 2).sum())
        grid = np.linspace(0, 1, 1001)
        at = int(np.argmin([error(f) for f in grid]))
        lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, 1000)]
        golden = (5**0.5 - 1) / 2
        for _ in range(80):
            a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
            lo, hi = (lo, b) if error(a) < error(b) else (a, hi)
        f = (lo + hi) / 2
        spread = float(((speed - speed.mean()) ** 2).sum())
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in groups), f, 1 - error(f) / spread if spread else float("nan")]], columns=[*groups, "f", "r2"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), "f double", "r2 double"])
    return df.select(*groups, p, s).groupBy(*groups).applyInPandas(fit, schema)


def amdahl_error(df: DataFrame, p: str, s: str, fractions: list[float]) -> DataFrame:
    """(f, error): sum of squared errors of the bound at each fraction."""
    rows = df.select(p, s, F.explode(F.array(*map(F.lit, fractions))).alias("f"))
    gap = F.col(s) - 1 / (F.col("f") + (1 - F.col("f")) / F.col(p))
    return rows.groupBy("f").agg(F.sum(gap * gap).alias("error"))


def hockney_fit(df: DataFrame, size: str, latency: str, bandwidth: str, small: int = 64, large: int = 4 << 20) -> DataFrame:
    """One row: alpha, the mean latency of small messages, and bw, the median bandwidth of large ones."""
    return df.agg(F.avg(F.when(F.col(size) <= small, F.col(latency))).alias("alpha"), F.median(F.when(F.col(size) >= large, F.col(bandwidth))).alias("bw"))


def probe_counts(spark, alphas: list[float], slots: int = 1 << 16) -> DataFrame:
    """(alpha, n_keys, mean_probes, knuth, lines, kb): linear probing at each
    load, simulated slot by slot; one task per load, bounded by the table."""
    if slots & (slots - 1) or slots < 4:
        raise ValueError("the slots must be a power of two, at least 4")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alpha = float(pdf["alpha"].iloc[0])
        n = int(alpha * slots)
        keys = (np_splitmix(np.arange(n, dtype=np.uint64)) & np.uint64(0x3FFFFFFF)).tolist()
        table = [-1] * slots
        for k in keys:
            at = k & (slots - 1)
            while table[at] not in (-1, k):
                at = (at + 1) & (slots - 1)
            table[at] = k
        probes, touched = 0, set()
        for k in keys:
            at = k & (slots - 1)
            while True:
                probes += 1
                touched.add(at // 4)
                if table[at] in (-1, k):
                    break
                at = (at + 1) & (slots - 1)
        return pd.DataFrame([[alpha, n, probes / max(n, 1), 0.5 * (1 + 1 / (1 - alpha)), len(touched), len(touched) * 64 / 1024]], columns=["alpha", "n_keys", "mean_probes", "knuth", "lines", "kb"])

    rows = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    return rows.groupBy("alpha").applyInPandas(run, "alpha double, n_keys long, mean_probes double, knuth double, lines long, kb double")
