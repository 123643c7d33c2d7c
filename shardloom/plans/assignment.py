"""Which worker gets which partition."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u64 import as_long, splitmix64, unsigned
from ..operators.partition import check_ranks


def lpt_order(w: DataFrame) -> DataFrame:
    """(…, position): heaviest first, ties by pid."""
    return w.withColumn("position", F.row_number().over(Window.orderBy(F.desc("weight"), "pid")) - 1)


def submission_order(w: DataFrame, order: str = "lpt", seed: int = 1234) -> DataFrame:
    """(…, position) in which partitions are handed out: ``lpt`` heaviest first,
    ``natural`` by number, ``random`` by the mixed number, one order a seed."""
    if order == "lpt":
        return lpt_order(w)
    if order == "natural":
        by = F.col("pid")
    elif order == "random":
        by = unsigned(splitmix64(F.col("pid").cast("long").bitwiseXOR(F.lit(as_long(seed)))))
    else:
        raise ValueError(f"no submission order {order}")
    return w.withColumn("position", F.row_number().over(Window.orderBy(by)) - 1)


def cyclic(w: DataFrame, workers: int) -> DataFrame:
    return w.withColumn("worker", F.pmod("pid", F.lit(workers)).cast("int"))


def block(w: DataFrame, workers: int, p: int) -> DataFrame:
    return w.withColumn("worker", F.floor(F.col("pid").cast("long") * workers / p).cast("int"))


def modulo_plan(w: DataFrame, ranks: int, p: int) -> DataFrame:
    """(…, dest, lp, perm) with partitions dealt in turn."""
    check_ranks(p, ranks)
    dest, lp = F.pmod("pid", F.lit(ranks)).cast("int"), F.floor(F.col("pid") / ranks).cast("int")
    return w.withColumns({"dest": dest, "lp": lp, "perm": dest * (p // ranks) + lp})


def least_loaded(weights: list[tuple[int, int]], ranks: int) -> list[tuple[int, int, int, int]]:
    """(pid, dest, lp, perm) by longest processing time first: each partition,
    heaviest first, goes to the least loaded rank, the lowest of equals."""
    loads = [(0, r) for r in range(ranks)]
    taken = [0] * ranks
    placed = []
    for pid, weight in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, r = heapq.heappop(loads)
        placed.append((pid, r, taken[r]))
        taken[r] += 1
        heapq.heappush(loads, (load + weight, r))
    base = [sum(taken[:r]) for r in range(ranks)]
    return [(pid, r, lp, base[r] + lp) for pid, r, lp in sorted(placed)]


def greedy_plan(w: DataFrame, ranks: int) -> DataFrame:
    """(…, dest, lp, perm) by :func:`least_loaded`. The plan is sequential over
    the P partition weights, which is all that reaches the driver."""
    rows = least_loaded([(r[0], r[1]) for r in w.select("pid", "weight").collect()], ranks)
    return w.join(F.broadcast(w.sparkSession.createDataFrame(rows, "pid int, dest int, lp int, perm int")), "pid")


def rank_volumes(plan: DataFrame, rank: str = "dest") -> DataFrame:
    """(rank, volume) of each rank that gets partitions."""
    return plan.groupBy(F.col(rank).alias("rank")).agg(F.sum("weight").alias("volume"), F.count(F.lit(1)).alias("partitions"))


def imbalance(plan: DataFrame, ranks: int, rank: str = "dest") -> DataFrame:
    """One row: recv_max, recv_mean, imbalance, max_part_frac over ``ranks`` ranks."""
    v = rank_volumes(plan, rank)
    heaviest = plan.agg(F.max("weight").alias("m"))
    total = v.agg(F.max("volume").alias("recv_max"), (F.sum("volume") / ranks).alias("recv_mean"), F.sum("volume").alias("t"))
    both = total.withColumn("k", F.lit(1)).join(heaviest.withColumn("k", F.lit(1)), "k")
    return both.select("recv_max", "recv_mean", (F.col("recv_max") / F.col("recv_mean")).alias("imbalance"), (F.col("m") * ranks / F.col("t")).alias("max_part_frac"))


def place_by_plan(df: DataFrame, plan: DataFrame, ranks: int) -> DataFrame:
    """The rows, with ``pid``, in the physical partition of their rank."""
    return df.join(F.broadcast(plan.select("pid", "dest")), "pid").repartitionById(ranks, "dest")
