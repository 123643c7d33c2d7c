"""Equi-joins that report their size and two checksums, not their pairs.

All three outputs depend on the key and the number of its pairs only, so both
sides are counted by key before they meet: no pair is ever made, a hot key is
combined before the shuffle, and the mixer runs once per distinct key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.u64 import A64, as_long, splitmix_column, unsigned_string, wrapping
from .partition import with_pid

HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")


def key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): multiplicities; null keys join with nothing and are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias(name))


def _triple(matched: DataFrame) -> DataFrame:
    """Pairs and checksums of (key, rc, sc), modulo 2^64 all the way: every task
    sums its own keys, in generated code, and only the sums meet."""
    with wrapping(matched.sparkSession):
        mixed = matched.select((F.col("rc") * F.col("sc")).alias("m"), splitmix_column(F.col("key")).alias("x"), splitmix_column(F.col("key").bitwiseXOR(F.lit(as_long(A64)))).alias("y"))
        sums = mixed.agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("c1"), F.sum(F.col("y") * F.col("m")).alias("c2"))
    text = lambda c: unsigned_string(F.coalesce(c, F.lit(0).cast("long")))
    return sums.select(text(F.col("n")).alias("join_count"), text(F.col("c1")).alias("checksum1"), text(F.col("c2")).alias("checksum2"))


def matches(r: DataFrame, s: DataFrame, r_key: str, s_key: str, hint: str | None = None) -> DataFrame:
    """(key, rc, sc): keys on both sides with their multiplicities.

    Without a hint both relations are counted in one aggregation of their union:
    one exchange, no build side and no sort. A hint asks for a join of the two
    sides' counts by that strategy.
    """
    if hint:
        return key_counts(r, r_key, "rc").hint(hint).join(key_counts(s, s_key, "sc"), "key").select("key", "rc", "sc")
    side = lambda df, key, left: df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lit(left).alias("left"))
    both = side(r, r_key, True).unionAll(side(s, s_key, False))
    return both.groupBy("key").agg(F.count_if("left").alias("rc"), F.count_if(~F.col("left")).alias("sc")).filter("rc > 0 and sc > 0")


def join_triple(r: DataFrame, s: DataFrame, r_key: str, s_key: str, hint: str | None = None) -> DataFrame:
    """One row (join_count, checksum1, checksum2) of the inner equi-join, as
    unsigned decimal strings modulo 2^64; empty inputs give zeros."""
    return _triple(matches(r, s, r_key, s_key, hint))


def naive_triple(r: DataFrame, s: DataFrame, r_key: str, s_key: str, hint: str | None = "shuffle_replicate_nl") -> DataFrame:
    """The same by making every pair; for checks on small inputs."""
    left = r.select(F.col(r_key).cast("long").alias("key"))
    right = s.select(F.col(s_key).cast("long").alias("key"))
    pairs = (left.hint(hint) if hint else left).join(right, "key").select("key", F.lit(1).cast("long").alias("rc"), F.lit(1).cast("long").alias("sc"))
    return _triple(pairs)


def partition_joins(r: DataFrame, s: DataFrame, r_key: str, s_key: str, p: int, hash_name: str = "fib32", hint: str | None = None) -> DataFrame:
    """(pid, n_keys, join_count): the join partition by partition, counts modulo
    2^64 as bit patterns; partitions without matches do not appear."""
    m = with_pid(matches(r, s, r_key, s_key, hint), "key", p, hash_name)
    with wrapping(m.sparkSession):
        return m.groupBy("pid").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("rc") * F.col("sc")).alias("join_count"))


def ablation(r: DataFrame, s: DataFrame, r_key: str, s_key: str, p: int, hashes: list[str], strategies: list[str]) -> DataFrame:
    """(hash, strategy, partitions, join_count) of the same join under every
    partition hash and join strategy: the partitions differ, the count does not."""
    one = lambda h, x: partition_joins(r, s, r_key, s_key, p, h, x).agg(F.lit(h).alias("hash"), F.lit(x).alias("strategy"), F.count(F.lit(1)).alias("partitions"), F.sum("join_count").alias("join_count"))
    return reduce(DataFrame.unionAll, [one(h, x) for h in hashes for x in strategies])


def remapped_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, plan: DataFrame, p: int, hash_name: str = "fib32") -> DataFrame:
    """(rank, received, join_count, checksum1, checksum2): the join under a plan
    (pid, dest, weight) that says which rank gets which partition, rank by rank.

    Keys are counted before they are dealt, so a rank gets one row for each of
    its keys and not its ``received`` rows. Counts and checksums of the ranks
    add up, modulo 2^64, to those of :func:`join_triple` under any plan.
    """
    m = with_pid(matches(r, s, r_key, s_key), "key", p, hash_name).join(F.broadcast(plan.select("pid", "dest")), "pid")
    with wrapping(m.sparkSession):
        mixed = m.select(F.col("dest").alias("rank"), (F.col("rc") * F.col("sc")).alias("m"), splitmix_column(F.col("key")).alias("x"), splitmix_column(F.col("key").bitwiseXOR(F.lit(as_long(A64)))).alias("y"))
        sums = mixed.groupBy("rank").agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("c1"), F.sum(F.col("y") * F.col("m")).alias("c2"))
    got = plan.groupBy(F.col("dest").alias("rank")).agg(F.sum("weight").alias("received"))
    text = lambda c: unsigned_string(F.coalesce(c, F.lit(0).cast("long")))
    return got.join(sums, "rank", "left").select("rank", "received", text(F.col("n")).alias("join_count"), text(F.col("c1")).alias("checksum1"), text(F.col("c2")).alias("checksum2"))


def same_triples(triples: dict[str, DataFrame]) -> DataFrame:
    """One row (variants, different, equal, join_count, checksum1, checksum2):
    whether all ways to join came to one triple; the least if they did not."""
    rows = reduce(DataFrame.unionAll, [t.select(F.struct("join_count", "checksum1", "checksum2").alias("t")) for t in triples.values()])
    out = rows.agg(F.count(F.lit(1)).alias("variants"), F.count_distinct("t").alias("different"), F.min("t").alias("t"))
    return out.select("variants", "different", (F.col("different") == 1).alias("equal"), "t.*")


def semi_keys(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """Rows of ``s`` whose key occurs in ``r``."""
    return s.join(r.select(F.col(r_key).alias("_k")).distinct(), F.col(s_key) == F.col("_k"), "left_semi")


def first_difference(a: DataFrame, b: DataFrame, index: str, value: str) -> DataFrame:
    """The first index at which two columns differ, with both values; no row if they are equal."""
    x, y = a.select(F.col(index).alias("i"), F.col(value).alias("a")), b.select(F.col(index).alias("i"), F.col(value).alias("b"))
    return x.join(y, "i", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).orderBy("i").limit(1)
