"""The engine's queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import benchmarks as bm
from .functions import u64
from .operators import analytics as an
from .operators import join as jn
from .operators import partition as pt
from .operators import skew as sk
from .plans import assignment as pl
from .sources import generators as gen
from .sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- SQL of the exact arithmetic


def sql_fib32(k: str, p: int, fold: bool = True, low_bits: bool = False) -> str:
    lg = u64.log2_of(p)
    folded = f"xor({k} & 4294967295, {k} >> 32)" if fold else f"({k} & 4294967295)"
    product = f"CAST((CAST({folded} AS UHUGEINT) * {u64.A32}) % 4294967296 AS UBIGINT)"
    return f"CAST({product} & {p - 1} AS INTEGER)" if low_bits else f"CAST({product} >> {32 - lg} AS INTEGER)"


_TWO64 = f"CAST('{u64.TWO64}' AS UHUGEINT)"


def sql_mix(z: str) -> str:
    times = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * CAST('{c}' AS UHUGEINT)) % {_TWO64} AS UBIGINT)"
    z = times(f"xor({z}, {z} >> 30)", u64.MIX1)
    z = times(f"xor({z}, {z} >> 27)", u64.MIX2)
    return f"xor({z}, {z} >> 31)"


def sql_splitmix(k: str) -> str:
    return sql_mix(f"CAST((CAST({k} AS UHUGEINT) + CAST('{u64.A64}' AS UHUGEINT)) % {_TWO64} AS UBIGINT)")


def sql_triple(r: str, r_key: str, s: str, s_key: str) -> str:
    """Every term is reduced before the sum: the engine would sum UHUGEINT as double."""
    term = lambda h: f"CAST((CAST({h} AS UHUGEINT) * m) % {_TWO64} AS HUGEINT)"
    total = lambda x: f"CAST(coalesce(sum({x}), 0) % CAST('{u64.TWO64}' AS HUGEINT) AS VARCHAR)"
    return f"""
WITH r AS (SELECT CAST({r_key} AS UBIGINT) AS k, count(*) AS n FROM {r} WHERE {r_key} IS NOT NULL GROUP BY k),
s AS (SELECT CAST({s_key} AS UBIGINT) AS k, count(*) AS n FROM {s} WHERE {s_key} IS NOT NULL GROUP BY k),
j AS (SELECT k, CAST(r.n AS UHUGEINT) * CAST(s.n AS UHUGEINT) AS m FROM r JOIN s USING (k)),
h AS (SELECT m, {sql_splitmix("k")} AS h1, {sql_splitmix(f"xor(k, CAST('{u64.A64}' AS UBIGINT))")} AS h2 FROM j)
SELECT {total("CAST(m AS HUGEINT)")} AS join_count, {total(term("h1"))} AS checksum1, {total(term("h2"))} AS checksum2 FROM h
"""


# ---- joins


@query("join_triple", sql_triple("orders", "o_custkey", "events", "user_id"))
def join_triple(spark, d):
    return jn.join_triple(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id")


@query("join_triple_fk", sql_triple("orders", "o_orderkey", "lineitem", "l_orderkey"))
def join_triple_fk(spark, d):
    return jn.join_triple(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("join_triple_self", sql_triple("lineitem", "l_suppkey", "lineitem", "l_suppkey"))
def join_triple_self(spark, d):
    t = table(spark, d, "lineitem")
    return jn.join_triple(t, t, "l_suppkey", "l_suppkey")


for _hint in jn.HINTS[:3]:

    def _hinted(spark, d, hint=_hint):
        return jn.join_triple(table(spark, d, "part"), table(spark, d, "lineitem"), "p_partkey", "l_partkey", hint)

    query(f"join_hint_{_hint}", sql_triple("part", "p_partkey", "lineitem", "l_partkey"))(_hinted)


@query("join_naive", sql_triple("supplier", "s_suppkey", "nation", "n_nationkey"))
def join_naive(spark, d):
    """Every pair, for checks: both tables are small dimensions."""
    return jn.naive_triple(table(spark, d, "supplier"), table(spark, d, "nation"), "s_suppkey", "n_nationkey")


@query("join_per_partition", f"""
WITH r AS (SELECT o_custkey AS k, count(*) AS rc FROM orders GROUP BY k), s AS (SELECT user_id AS k, count(*) AS sc FROM events GROUP BY k)
SELECT {sql_fib32("k", P)} AS pid, count(*) AS n_keys, CAST(sum(rc * sc) AS BIGINT) AS join_count FROM r JOIN s USING (k) GROUP BY 1""")  # fmt: skip
def join_per_partition(spark, d):
    return jn.partition_joins(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", P)


@query("semi_keys", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY user_id")
def semi_keys(spark, d):
    return jn.semi_keys(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def sql_rank_triples(plan: str, p: int) -> str:
    """The triple rank by rank under a plan (pid, dest, weight); zeros for ranks without matches."""
    term = lambda h: f"CAST((CAST({h} AS UHUGEINT) * m) % {_TWO64} AS HUGEINT)"
    total = lambda x: f"CAST(coalesce(sum({x}), 0) % CAST('{u64.TWO64}' AS HUGEINT) AS VARCHAR)"
    return f"""
WITH RECURSIVE plan AS ({plan}),
r AS (SELECT CAST(o_custkey AS UBIGINT) AS k, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY k),
s AS (SELECT CAST(user_id AS UBIGINT) AS k, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY k),
j AS (SELECT k, {sql_fib32("k", p)} AS pid, CAST(r.n AS UHUGEINT) * CAST(s.n AS UHUGEINT) AS m FROM r JOIN s USING (k)),
h AS (SELECT pid, m, {sql_splitmix("k")} AS h1, {sql_splitmix(f"xor(k, CAST('{u64.A64}' AS UBIGINT))")} AS h2 FROM j),
v AS (SELECT dest, CAST(sum(weight) AS BIGINT) AS received FROM plan GROUP BY dest),
t AS (SELECT dest, {total("CAST(m AS HUGEINT)")} AS join_count, {total(term("h1"))} AS checksum1, {total(term("h2"))} AS checksum2 FROM h JOIN plan USING (pid) GROUP BY dest)
SELECT dest AS rank, received, coalesce(join_count, '0') AS join_count, coalesce(checksum1, '0') AS checksum1, coalesce(checksum2, '0') AS checksum2 FROM v LEFT JOIN t USING (dest)
"""


_SAME = sql_triple("supplier", "s_suppkey", "nation", "n_nationkey")


@query("same_triples", f"SELECT CAST(4 AS BIGINT) AS variants, CAST(1 AS BIGINT) AS different, true AS equal, join_count, checksum1, checksum2 FROM ({_SAME})")
def same_triples(spark, d):
    r, s = table(spark, d, "supplier"), table(spark, d, "nation")
    ways = {"counted": None, **{h: h for h in jn.HINTS[:2]}}
    triples = {n: jn.join_triple(r, s, "s_suppkey", "n_nationkey", h) for n, h in ways.items()}
    return jn.same_triples(triples | {"every pair": jn.naive_triple(r, s, "s_suppkey", "n_nationkey")})


def _sql_ablation(h: str, pid: str) -> str:
    return f"SELECT '{h}' AS hash, count(DISTINCT pid) AS partitions, CAST(sum(m) AS BIGINT) AS join_count FROM (SELECT {pid} AS pid, rc * sc AS m FROM r JOIN s USING (k))"


@query("join_ablation", f"""
WITH r AS (SELECT o_custkey AS k, count(*) AS rc FROM orders GROUP BY k), s AS (SELECT user_id AS k, count(*) AS sc FROM events GROUP BY k)
SELECT hash, strategy, partitions, join_count FROM (SELECT unnest(['shuffle_hash', 'merge']) AS strategy), ({_sql_ablation("mod", "k & 15")} UNION ALL {_sql_ablation("fib32", sql_fib32("k", 16))})""")  # fmt: skip
def join_ablation(spark, d):
    return jn.ablation(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", 16, ["mod", "fib32"], ["shuffle_hash", "merge"])


@query("salted_join", "SELECT CAST(sum(rc * sc) AS BIGINT) AS join_count FROM (SELECT l_suppkey k, count(*) rc FROM lineitem GROUP BY 1) JOIN (SELECT l_partkey k, count(*) sc FROM lineitem GROUP BY 1) USING (k)")
def salted_join(spark, d):
    t = table(spark, d, "lineitem")
    return sk.salted_join_count(t, t.select("l_partkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_partkey", 8)


@query("first_difference", "SELECT l_orderkey AS i, a, b FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(sum(l_quantity + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM lineitem GROUP BY 1) WHERE a <> b ORDER BY 1 LIMIT 1")
def first_difference(spark, d):
    t = table(spark, d, "lineitem")
    a = t.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("v"))
    b = t.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)).alias("v"))
    return jn.first_difference(a, b, "l_orderkey", "v")


# ---- hashes and partitions


@query("partition_hash", f"SELECT l_orderkey, l_linenumber, {sql_fib32('l_orderkey', P)} AS pid FROM lineitem")
def partition_hash(spark, d):
    return pt.with_pid(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", P)


@query("hash_variants", f"SELECT o_orderkey, {sql_fib32('o_orderkey', 256)} AS fib32, {sql_fib32('o_orderkey', 256, low_bits=True)} AS fib32_lowbits, CAST(o_orderkey & 255 AS INTEGER) AS mod, CAST(CAST((CAST(o_orderkey AS UHUGEINT) * CAST('{u64.A64}' AS UHUGEINT)) % {_TWO64} AS UBIGINT) >> 56 AS INTEGER) AS fib64, {sql_fib32('o_orderkey', 256, fold=False)} AS mult32_nofold FROM orders")
def hash_variants(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(h(F.col("o_orderkey"), 256).alias(n) for n, h in u64.HASHES.items()))


@query("splitmix", f"SELECT c_custkey, CAST({sql_splitmix('CAST(c_custkey AS UBIGINT)')} AS VARCHAR) AS h FROM customer")
def splitmix(spark, d):
    return table(spark, d, "customer").select("c_custkey", u64.unsigned_string(u64.splitmix64("c_custkey")).alias("h"))


@query("slots", "SELECT o_custkey, CAST(o_custkey & 1023 AS INTEGER) AS slot, count(*) AS n FROM orders GROUP BY 1, 2")
def slots(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", u64.mod(F.col("o_custkey"), 1024).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def sql_hist(t: str, k: str, p: int) -> str:
    return f"SELECT CAST(q.pid AS INTEGER) AS pid, count(h.pid) AS cnt FROM (SELECT unnest(range(0, {p})) AS pid) q LEFT JOIN (SELECT {sql_fib32(k, p)} AS pid FROM {t}) h USING (pid) GROUP BY 1"


@query("partition_histogram", sql_hist("lineitem", "l_orderkey", P))
def partition_histogram(spark, d):
    return pt.histogram(table(spark, d, "lineitem"), "l_orderkey", P)


@query("partition_offsets", f'SELECT pid, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin", CAST(sum(cnt) OVER (ORDER BY pid) AS BIGINT) AS "end" FROM ({sql_hist("lineitem", "l_orderkey", P)})')
def partition_offsets(spark, d):
    return pt.offsets(pt.histogram(table(spark, d, "lineitem"), "l_orderkey", P))


@query("worker_offsets", f'SELECT pid, worker, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY pid, worker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin" FROM (SELECT {sql_fib32("l_partkey", 16)} AS pid, l_returnflag AS worker, count(*) AS cnt FROM lineitem GROUP BY 1, 2)')
def worker_offsets(spark, d):
    t = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("worker"))
    return pt.worker_offsets(t, "l_partkey", "worker", 16)


@query("scatter_slots", f"SELECT o_orderkey, pid, row_number() OVER (ORDER BY pid, o_orderkey) - 1 AS slot FROM (SELECT o_orderkey, {sql_fib32('o_orderkey', 16)} AS pid FROM orders)")
def scatter_slots(spark, d):
    return pt.scatter(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ["o_orderkey"], 16)


@query("placement", f"SELECT {sql_fib32('o_custkey', 16)} AS pid, 1 AS n_places, count(*) AS n FROM orders GROUP BY 1")
def placement(spark, d):
    """Each partition lies in one physical partition, the one of its number."""
    rows = pt.place(table(spark, d, "orders").select("o_custkey"), "o_custkey", 16).withColumn("at", F.spark_partition_id())
    return rows.groupBy("pid").agg(F.count_distinct("at").cast("int").alias("n_places"), F.count(F.lit(1)).alias("n"))


def sql_balance(hist: str, p: int, by: str = "") -> str:
    over = "PARTITION BY hash" if by else ""
    return f"""
SELECT {by} max(n) AS n, round(max(cnt) / avg(cnt), 9) AS max_exp, min(cnt) AS min_cnt, round(stddev_pop(cnt) / avg(cnt), 9) AS cov,
  round(({p} + 1.0) / {p} - 2.0 * CAST(sum(cum) AS DOUBLE) / (CAST(max(n) AS DOUBLE) * {p}), 9) AS gini,
  round(sum((cnt - n / {p}) * (cnt - n / {p}) / (n / {p})) / ({p} - 1), 6) AS chi2_dof,
  round(-sum(CASE WHEN cnt > 0 THEN cnt / n * log2(cnt / n) ELSE 0.0 END) / log2({p}), 9) AS entropy_norm,
  count(*) FILTER (cnt = 0) AS empty
FROM (SELECT *, sum(cnt) OVER ({over} ORDER BY cnt, pid ROWS UNBOUNDED PRECEDING) AS cum, CAST(sum(cnt) OVER ({over}) AS BIGINT) AS n FROM ({hist}))
{"GROUP BY hash" if by else ""}"""


_HASH_SQL = {"fib32": sql_fib32("l_orderkey", 64), "fib32_lowbits": sql_fib32("l_orderkey", 64, low_bits=True), "mod": "CAST(l_orderkey & 63 AS INTEGER)", "fib64": f"CAST(CAST((CAST(l_orderkey AS UHUGEINT) * CAST('{u64.A64}' AS UHUGEINT)) % {_TWO64} AS UBIGINT) >> 58 AS INTEGER)", "mult32_nofold": sql_fib32("l_orderkey", 64, fold=False)}
_HASH_HIST = " UNION ALL ".join(f"SELECT '{h}' AS hash, q.pid, count(x.pid) AS cnt FROM (SELECT unnest(range(0, 64)) AS pid) q LEFT JOIN (SELECT {e} AS pid FROM lineitem) x USING (pid) GROUP BY 1, 2" for h, e in _HASH_SQL.items())


@query("hash_quality", sql_balance(_HASH_HIST, 64, "hash,"))
def hash_quality(spark, d):
    q = pt.hash_quality(table(spark, d, "lineitem"), "l_orderkey", 64)
    return q.select("hash", "n", F.round("max_exp", 9).alias("max_exp"), "min_cnt", F.round("cov", 9).alias("cov"), F.round("gini", 9).alias("gini"), F.round("chi2_dof", 6).alias("chi2_dof"), F.round("entropy_norm", 9).alias("entropy_norm"), "empty")


@query("skew_profile", f"SELECT avg(cnt) AS mean_load, max(cnt) AS max_load, round(max(cnt) / avg(cnt), 9) AS max_over_mean, round((SELECT sum(abs(a.cnt - b.cnt)) FROM h a, h b) / (2.0 * {P} * {P} * avg(cnt)), 9) AS gini FROM h".replace("SELECT avg", f"WITH h AS ({sql_hist('lineitem', 'l_partkey', P)}) SELECT avg", 1))
def skew_profile(spark, d):
    s = pt.skew_profile(pt.histogram(table(spark, d, "lineitem"), "l_partkey", P))
    return s.select("mean_load", "max_load", F.round("max_over_mean", 9).alias("max_over_mean"), F.round("gini", 9).alias("gini"))


@query("dest_major", f"SELECT pid, cnt, pid % 4 AS dest, pid // 4 AS lp, (pid % 4) * {P // 4} + pid // 4 AS perm FROM ({sql_hist('lineitem', 'l_orderkey', P)})")
def dest_major(spark, d):
    return pt.dest_major(pt.histogram(table(spark, d, "lineitem"), "l_orderkey", P), P, 4)


@query("first_partitions", f"SELECT o_orderkey, pid FROM (SELECT o_orderkey, {sql_fib32('o_orderkey', P)} AS pid FROM orders) WHERE pid < 8")
def first_partitions(spark, d):
    return pt.first_partitions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", P, 8)


@query("exchange_counts", f"SELECT CAST(a.s AS INTEGER) AS source, CAST(b.d AS INTEGER) AS dest, count(x.source) AS cnt FROM (SELECT unnest(range(0, 4)) AS s) a CROSS JOIN (SELECT unnest(range(0, 4)) AS d) b LEFT JOIN (SELECT o_orderkey % 4 AS source, {sql_fib32('o_custkey', P)} % 4 AS dest FROM orders) x ON x.source = a.s AND x.dest = b.d GROUP BY 1, 2")
def exchange_counts(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.pmod("o_orderkey", F.lit(4)).alias("rank"))
    return pt.exchange_counts(rows, "o_custkey", "rank", P, 4)


@query("received_layout", f'SELECT dest, lp, cnt, CAST(coalesce(sum(cnt) OVER (PARTITION BY dest ORDER BY lp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin" FROM (SELECT CAST(pid % 4 AS INTEGER) AS dest, CAST(pid // 4 AS INTEGER) AS lp, cnt FROM ({sql_hist("events", "user_id", P)}))')
def received_layout(spark, d):
    return pt.received_layout(table(spark, d, "events"), "user_id", P, 4)


@query("pid_fold", f"""
SELECT lower(lpad(hex(CAST(list_reduce(list(CAST(pid AS UHUGEINT) ORDER BY i), lambda h, v: (xor(h, v) * CAST('{u64.FNV_PRIME}' AS UHUGEINT)) % {_TWO64}, CAST('{u64.FNV_OFFSET}' AS UHUGEINT)) AS UBIGINT)), 16, '0')) AS checksum
FROM (SELECT o_orderkey AS i, {sql_fib32("o_orderkey", 256)} AS pid FROM orders)""")  # fmt: skip
def pid_fold(spark, d):
    rows = pt.with_pid(table(spark, d, "orders").select(F.col("o_orderkey").alias("i")), "i", 256)
    return pt.pid_fold(rows)


# ---- skew and plans

_WEIGHTS = f"SELECT a.pid, a.cnt AS r_cnt, b.cnt AS s_cnt, a.cnt + b.cnt AS weight FROM ({sql_hist('orders', 'o_custkey', P)}) a JOIN ({sql_hist('events', 'user_id', P)}) b USING (pid)"
_HOT = f"SELECT *, CAST(sum(weight) OVER () // {P} AS BIGINT) AS mean FROM ({_WEIGHTS})"
_SPLIT = f"SELECT *, weight > 2 * mean AS hot, CAST(CASE WHEN weight > 2 * mean THEN greatest(2, least(weight // mean, 8)) ELSE 1 END AS INTEGER) AS splits FROM ({_HOT})"


def _weights(spark, d):
    return sk.weights(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", P)


@query("hot_partitions", _SPLIT)
def hot_partitions(spark, d):
    return sk.hot_partitions(_weights(spark, d), workers=8, factor=2)


@query("hot_split_ranges", f"""
WITH s AS ({_SPLIT}), o AS (SELECT pid, splits, s_cnt, sum(s_cnt) OVER (ORDER BY pid) - s_cnt AS b FROM s),
x AS (SELECT pid, CAST(k AS INTEGER) AS part, CAST(b + k * ceil(s_cnt / splits) AS BIGINT) AS lo, CAST(least(b + s_cnt, b + (k + 1) * ceil(s_cnt / splits)) AS BIGINT) AS hi
      FROM (SELECT *, unnest(range(0, splits)) AS k FROM o))
SELECT * FROM x WHERE lo < hi""")
def hot_split_ranges(spark, d):
    return sk.split_ranges(sk.hot_partitions(_weights(spark, d), workers=8, factor=2))


@query("lpt_order", f"SELECT pid, weight, row_number() OVER (ORDER BY weight DESC, pid) - 1 AS position FROM ({_WEIGHTS})")
def lpt_order(spark, d):
    return pl.lpt_order(_weights(spark, d).select("pid", "weight"))


@query("assign_cyclic", f"SELECT pid, weight, CAST(pid % 6 AS INTEGER) AS worker FROM ({_WEIGHTS})")
def assign_cyclic(spark, d):
    return pl.cyclic(_weights(spark, d).select("pid", "weight"), 6)


@query("assign_block", f"SELECT pid, weight, CAST(pid * 6 // {P} AS INTEGER) AS worker FROM ({_WEIGHTS})")
def assign_block(spark, d):
    return pl.block(_weights(spark, d).select("pid", "weight"), 6, P)


@query("assign_modulo", f"SELECT pid, weight, CAST(pid % 4 AS INTEGER) AS dest, CAST(pid // 4 AS INTEGER) AS lp, CAST((pid % 4) * {P // 4} + pid // 4 AS INTEGER) AS perm FROM ({_WEIGHTS})")
def assign_modulo(spark, d):
    return pl.modulo_plan(_weights(spark, d).select("pid", "weight"), 4, P)


@query("assign_greedy", f"""
WITH RECURSIVE w AS ({_WEIGHTS}), o AS (SELECT pid, weight, row_number() OVER (ORDER BY weight DESC, pid) AS n FROM w),
g(n, pid, dest, loads, lp, taken) AS (
  SELECT 0, -1, 0, [CAST(0 AS HUGEINT), 0, 0, 0], 0, [0, 0, 0, 0]
  UNION ALL
  SELECT o.n, o.pid, d, [CASE WHEN i = d THEN loads[i + 1] + o.weight ELSE loads[i + 1] END FOR i IN range(0, 4)],
         taken[d + 1], [CASE WHEN i = d THEN taken[i + 1] + 1 ELSE taken[i + 1] END FOR i IN range(0, 4)]
  FROM (SELECT *, list_position(loads, list_min(loads)) - 1 AS d FROM g) g JOIN o ON o.n = g.n + 1),
c AS (SELECT dest, count(*) AS k FROM g WHERE n > 0 GROUP BY dest), b AS (SELECT dest, sum(k) OVER (ORDER BY dest) - k AS base FROM c)
SELECT pid, weight, CAST(dest AS INTEGER) AS dest, CAST(lp AS INTEGER) AS lp, CAST(base + lp AS INTEGER) AS perm
FROM g JOIN o USING (pid) JOIN b USING (dest)""")
def assign_greedy(spark, d):
    return pl.greedy_plan(_weights(spark, d).select("pid", "weight"), 4)


_RANDOM = sql_splitmix("xor(CAST(pid AS UBIGINT), CAST(1234 AS UBIGINT))")


@query("submission_orders", f"SELECT pid, weight, row_number() OVER (ORDER BY weight DESC, pid) - 1 AS lpt, CAST(pid AS BIGINT) AS natural_order, row_number() OVER (ORDER BY {_RANDOM}) - 1 AS random_order FROM ({_WEIGHTS})")
def submission_orders(spark, d):
    w = _weights(spark, d).select("pid", "weight")
    position = lambda o, name: pl.submission_order(w, o).select("pid", F.col("position").cast("long").alias(name))
    return w.join(position("lpt", "lpt"), "pid").join(position("natural", "natural_order"), "pid").join(position("random", "random_order"), "pid")


_MODULO = f"SELECT pid, CAST(pid % 4 AS INTEGER) AS dest, weight FROM ({_WEIGHTS})"


@query("remapped_join_modulo", sql_rank_triples(_MODULO, P))
def remapped_join_modulo(spark, d):
    plan = pl.modulo_plan(_weights(spark, d).select("pid", "weight"), 4, P)
    return jn.remapped_join(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", plan, P)


@query("remapped_join_greedy", sql_rank_triples(f"SELECT pid, dest, weight FROM ({ORACLES['assign_greedy']})", P))
def remapped_join_greedy(spark, d):
    plan = pl.greedy_plan(_weights(spark, d).select("pid", "weight"), 4)
    return jn.remapped_join(table(spark, d, "orders"), table(spark, d, "events"), "o_custkey", "user_id", plan, P)


@query("rank_volume", f"SELECT CAST(pid % 4 AS INTEGER) AS rank, CAST(sum(weight) AS BIGINT) AS volume, count(*) AS partitions FROM ({_WEIGHTS}) GROUP BY 1")
def rank_volume(spark, d):
    return pl.rank_volumes(pl.modulo_plan(_weights(spark, d).select("pid", "weight"), 4, P))


@query("rank_imbalance", f"SELECT CAST(max(v) AS BIGINT) AS recv_max, CAST(sum(v) AS DOUBLE) / 4 AS recv_mean, round(max(v) / (sum(v) / 4), 9) AS imbalance, round(max(m) * 4 / sum(v), 9) AS max_part_frac FROM (SELECT sum(weight) AS v, max(weight) AS m FROM ({_WEIGHTS}) GROUP BY pid % 4)")
def rank_imbalance(spark, d):
    i = pl.imbalance(pl.modulo_plan(_weights(spark, d).select("pid", "weight"), 4, P), 4)
    return i.select("recv_max", "recv_mean", F.round("imbalance", 9).alias("imbalance"), F.round("max_part_frac", 9).alias("max_part_frac"))


# ---- generators


_DRAW = f"CAST((CAST(42 AS UHUGEINT) + CAST('{u64.A64}' AS UHUGEINT) * CAST(i + 1 AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


@query("gen_uniform", f"SELECT i, CAST({sql_mix(_DRAW)} % 1000 AS BIGINT) AS key FROM (SELECT unnest(range(0, 10000)) AS i)")
def gen_uniform(spark, d):
    return gen.uniform(spark, 10000, 42, 1000)


def sql_draw(seed: int, k: str) -> str:
    """Draw number k, from 1, of the splitmix64 stream."""
    return sql_mix(f"CAST((CAST({seed} AS UHUGEINT) + CAST('{u64.A64}' AS UHUGEINT) * CAST({k} AS UHUGEINT)) % {_TWO64} AS UBIGINT)")


def _sql_hot(seed: int, max_key: int, p: int, hot: int) -> str:
    """(n, key, k): the first ``hot`` keys drawn that lie in different partitions, and their draws."""
    return f"""SELECT row_number() OVER (ORDER BY k) - 1 AS n, key, k FROM (SELECT key, k FROM (SELECT key, k, row_number() OVER (PARTITION BY {sql_fib32("key", p)} ORDER BY k) AS r
FROM (SELECT k, {sql_draw(seed, "k")} % {max_key} AS key FROM (SELECT unnest(range(1, 5000)) AS k))) WHERE r = 1 ORDER BY k LIMIT {hot})"""


@query("gen_skewed", f"""
WITH hot AS ({_sql_hot(42, 1000, 16, 4)}), used AS (SELECT max(k) AS u FROM hot),
d AS (SELECT i, {sql_draw(42, "u + 1 + 2 * i")} AS coin, {sql_draw(42, "u + 2 + 2 * i")} AS x FROM (SELECT unnest(range(0, 10000)) AS i), used)
SELECT i, CAST(CASE WHEN coin % 1000000 < 900000 THEN hot.key ELSE x % 1000 END AS BIGINT) AS key FROM d JOIN hot ON n = x % 4""")  # fmt: skip
def gen_skewed(spark, d):
    return gen.skewed(spark, 10000, 42, 1000, 16, 0.9, 4)


@query("gen_shared_hot", f"""
WITH hot AS ({_sql_hot(gen.SHARED_HOT_SEED, 1000, 16, 4)}), d AS (SELECT i, {sql_draw(42, "i + 1")} AS x FROM (SELECT unnest(range(0, 10000)) AS i))
SELECT i, CAST(CASE WHEN CAST(x >> 40 AS DOUBLE) / 16777216 < 0.9 THEN hot.key ELSE x % 1000 END AS BIGINT) AS key FROM d JOIN hot ON n = (x >> 8) % 4""")  # fmt: skip
def gen_shared_hot(spark, d):
    return gen.shared_hot(spark, 10000, 42, 1000, 16, 0.9, 4)


def _sql_xoshiro(n: int, seed: int) -> str:
    """The sequential definition, state by state."""
    times = lambda x, k: f"CAST((CAST({x} AS UHUGEINT) * {k}) % {_TWO64} AS UBIGINT)"
    turn = lambda x, k: f"({times(x, 1 << k)} | ({x} >> {64 - k}))"
    return f"""
WITH RECURSIVE s(i, a, b, c, d) AS (
  SELECT 0, {", ".join(sql_draw(seed, str(k)) for k in range(1, 5))} UNION ALL
  SELECT i + 1, xor(a, xor(d, b)), xor(b, xor(c, a)), xor(xor(c, a), {times("b", 1 << 17)}), {turn("xor(d, b)", 45)} FROM s WHERE i < {n - 1}),
x AS (SELECT i, {times("b", 5)} AS y FROM s), z AS (SELECT i, {times(turn("y", 7), 9)} AS v FROM x)
SELECT CAST(i AS BIGINT) AS i, CASE WHEN v >= 9223372036854775808 THEN CAST(CAST(v AS HUGEINT) - {u64.TWO64} AS BIGINT) ELSE CAST(v AS BIGINT) END AS key FROM z"""


@query("gen_xoshiro", _sql_xoshiro(5000, 42))
def gen_xoshiro(spark, d):
    return gen.xoshiro(spark, 5000, 42)


@query("gen_distributions")
def gen_distributions(spark, d):
    from functools import reduce

    return reduce(DataFrame.unionAll, [gen.distribution(spark, n, 2000).select(F.lit(n).alias("dist"), "i", "key") for n in gen.DISTRIBUTIONS])


#: Published results of generated joins: the join must reproduce them.
@query("join_generated", "SELECT '40179' AS join_count, '11118602631294229433' AS checksum1, '15339275744729819729' AS checksum2")
def join_generated(spark, d):
    return jn.join_triple(gen.uniform(spark, 10_000, 7, 5000), gen.uniform(spark, 20_000, gen.second_seed(7), 5000), "key", "key")


@query("join_generated_skewed", "SELECT '8' AS join_count, '14288878883941118028' AS checksum1, '10127366633300503530' AS checksum2")
def join_generated_skewed(spark, d):
    return jn.join_triple(gen.skewed(spark, 200, 42, 100, 16, 0.9, 4), gen.skewed(spark, 400, gen.second_seed(42), 100, 16, 0.9, 4), "key", "key")


# ---- aggregates and windows


@query("key_counts", "SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def key_counts(spark, d):
    return jn.key_counts(table(spark, d, "events"), "user_id", "n")


_R = lambda c, n=6: F.round(c, n).alias(c)


@query("group_stats", "SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(stddev_samp(value), 6) AS std_samp, min(value) AS min, max(value) AS max, round(sum(value), 3) AS sum, count(value) AS n FROM events GROUP BY event_type")
def group_stats(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(*an.summary("value"))
    return s.select("event_type", _R("median"), _R("mean"), _R("std_pop"), _R("std_samp"), "min", "max", _R("sum", 3), "n")


@query("upper_median", "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def upper_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(an.upper_median("value").alias("upper_median"))


@query("best_of", "SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS best, arg_min(l_orderkey * 10 + l_linenumber, (l_extendedprice, l_orderkey, l_linenumber)) AS at FROM lineitem GROUP BY 1, 2")
def best_of(spark, d):
    t = table(spark, d, "lineitem")
    at = F.min_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.min("l_extendedprice").alias("best"), at.alias("at"))


@query("dedup_by_median", "SELECT l_suppkey, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def dedup_by_median(spark, d):
    m = an.dedup_by_median(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"])
    return m.select("l_suppkey", _R("l_quantity"), _R("l_extendedprice"))


@query("mode_per_group", "SELECT l_returnflag, min(l_quantity) AS mode FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def mode_per_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(an.most_frequent("l_quantity").alias("mode"))


@query("most_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def most_distinct(spark, d):
    return an.best_by_distinct(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("max_throughput", "SELECT l_suppkey, round(max(l_quantity / 1e6 / (l_extendedprice / 1e3)), 9) AS mkeys FROM lineitem GROUP BY 1")
def max_throughput(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_suppkey").agg(F.round(F.max(bm.mkeys_per_second(F.col("l_quantity"), F.col("l_extendedprice"))), 9).alias("mkeys"))


@query("pivot_stat", "SELECT l_linestatus, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r FROM lineitem GROUP BY 1")
def pivot_stat(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return p.select("l_linestatus", *(F.round(c, 6).alias(c.lower()) for c in "ANR"))


@query("critical_path", "SELECT o_custkey, max(o_totalprice) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def critical_path(spark, d):
    return an.critical_path(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("column_sum", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s, count(*) AS n FROM lineitem")
def column_sum(spark, d):
    return table(spark, d, "lineitem").agg(F.sum("l_orderkey").alias("s"), F.count(F.lit(1)).alias("n"))


@query("first_value_ratio", "SELECT event_id, round(first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) / value, 6) AS ratio FROM events WHERE value > 0")
def first_value_ratio(spark, d):
    return an.first_ratio(table(spark, d, "events").filter("value > 0"), ["user_id"], "event_id", "value").select("event_id", _R("ratio"))


@query("fill_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def fill_forward(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return an.fill_forward(t, "event_id", "v", ["user_id"]).select("event_id", "v")


@query("speedup_selfjoin", "WITH t AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT a.l_suppkey, a.l_returnflag, round(b.v / a.v, 6) AS speedup FROM t a JOIN t b ON a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'N' WHERE a.l_returnflag <> 'N'")
def speedup_selfjoin(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    return an.speedup_against(t, ["l_suppkey"], "l_returnflag", "N", "v").select("l_suppkey", "l_returnflag", _R("speedup"))


@query("efficiency_cost", "WITH t AS (SELECT l_linenumber AS p, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT a.p, round(b.v / a.v, 6) AS speedup, round(b.v / a.v / a.p, 6) AS efficiency, round(a.v * a.p, 4) AS cost, round(a.v / b.v, 6) AS slowdown FROM t a, t b WHERE b.p = 1")
def efficiency_cost(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("p")).agg(F.avg("l_extendedprice").alias("v"))
    rows = t.withColumn("t1", F.max(F.when(F.col("p") == 1, F.col("v"))).over(Window.partitionBy()))  # a row for each p
    return rows.select("p", F.round(bm.speedup(F.col("t1"), F.col("v")), 6).alias("speedup"), F.round(bm.efficiency(F.col("t1"), F.col("v"), F.col("p")), 6).alias("efficiency"), F.round(bm.cost(F.col("v"), F.col("p")), 4).alias("cost"), F.round(F.col("v") / F.col("t1"), 6).alias("slowdown"))


@query("baseline_lookup", "SELECT c_custkey, CAST(coalesce(t, 1.5) AS DOUBLE) AS t_seq FROM customer LEFT JOIN (SELECT n_nationkey, CAST(n_nationkey * 2 AS DOUBLE) AS t FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey")
def baseline_lookup(spark, d):
    base = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 2).cast("double").alias("t_seq"))
    return an.with_baseline(table(spark, d, "customer").select("c_custkey", "c_nationkey"), base, "c_nationkey", 1.5).select("c_custkey", "t_seq")


@query("reindex", "SELECT k AS n_nationkey, n_name FROM (SELECT unnest([1, 5, 99]) AS k) LEFT JOIN nation ON n_nationkey = k")
def reindex(spark, d):
    return an.reindex(table(spark, d, "nation").select("n_nationkey", "n_name"), [1, 5, 99], "n_nationkey")


@query("join_rounded", "SELECT k, count(*) AS n FROM (SELECT round(l_discount, 1) AS k FROM lineitem) a JOIN (SELECT DISTINCT round(l_tax, 1) AS k FROM lineitem) b USING (k) GROUP BY 1")
def join_rounded(spark, d):
    t = table(spark, d, "lineitem")
    b = t.select(F.round("l_tax", 1).alias("k")).distinct()
    return an.join_rounded(t.select(F.col("l_discount").alias("k")), b, "k", 1).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("phase_share", "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100, 6) AS share FROM lineitem")
def phase_share(spark, d):
    return an.shares(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", _R("share"))


@query("serial_share", "SELECT l_orderkey, l_linenumber, round(sum(t) OVER w / sum(q) OVER w, 9) AS serial_share FROM (SELECT l_orderkey, l_linenumber, sum(l_tax) AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)")
def serial_share(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_tax").alias("t"), F.sum("l_quantity").alias("q"))
    return an.serial_share(t, ["l_orderkey"], "l_linenumber", "t", "q").select("l_orderkey", "l_linenumber", _R("serial_share", 9))


@query("amdahl_columns", "SELECT l_orderkey, l_linenumber, round(1 / (l_discount + (1 - l_discount) / (l_linenumber + 1)), 6) AS bound, round((1 / l_quantity - 1 / (l_linenumber + 1)) / (1 - 1 / (l_linenumber + 1)), 6) AS f FROM lineitem")
def amdahl_columns(spark, d):
    p = F.col("l_linenumber") + 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(bm.amdahl(p, F.col("l_discount")), 6).alias("bound"), F.round(bm.serial_fraction(F.col("l_quantity"), p), 6).alias("f"))


@query("cost_models", "SELECT l_orderkey, l_linenumber, round(least(500.0, l_quantity * 20), 6) AS roof, round((l_linenumber - 1) * 22.4 / 1e6 + 48.0 / 1150, 9) AS startup, round(l_linenumber / 8 * 48.0 * ((l_linenumber - l_linenumber / 8) / l_linenumber) / 1150, 9) AS nic, round(0.5 * (1 + 1 / (1 - l_discount)), 9) AS probes, round(l_extendedprice * 1e6 / l_quantity, 3) AS ns_per_key, round(l_quantity * 12 / (l_extendedprice * 1e6), 12) AS gb_s FROM lineitem")
def cost_models(spark, d):
    n, q, e = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(bm.roofline(q, 500, 20), 6).alias("roof"), F.round(bm.hockney_startup(n, 22.4, 48.0, 1150), 9).alias("startup"), F.round(bm.hockney_nic(n, 8, 48.0, 1150), 9).alias("nic"), F.round(bm.knuth_probes(F.col("l_discount")), 9).alias("probes"), F.round(bm.ns_per_key(q, e), 3).alias("ns_per_key"), F.round(bm.gb_per_second(q, e), 12).alias("gb_s"))


@query("amdahl_fit")
def amdahl_fit(spark, d):
    points = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    p = F.col("l_linenumber").cast("double")
    return an.amdahl_fit(points.select("l_returnflag", p.alias("p"), (1 + (p - 1) * F.col("q") / 60).alias("s")), ["l_returnflag"], "p", "s")


@query("amdahl_error", "SELECT CAST(f AS DOUBLE) AS f, round(sum((s - 1 / (f + (1 - f) / p)) * (s - 1 / (f + (1 - f) / p))), 6) AS error FROM (SELECT CAST(l_linenumber AS DOUBLE) AS p, l_quantity / 10 AS s FROM lineitem), (SELECT unnest([0.02, 0.05, 0.12, 0.2]) AS f) GROUP BY f")
def amdahl_error(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("p"), (F.col("l_quantity") / 10).alias("s"))
    return an.amdahl_error(t, "p", "s", [0.02, 0.05, 0.12, 0.2]).select(F.col("f").cast("double").alias("f"), _R("error"))


@query("hockney_fit", "SELECT round(avg(l_extendedprice) FILTER (l_quantity <= 5), 6) AS alpha, round(median(l_tax) FILTER (l_quantity >= 40), 6) AS bw FROM lineitem")
def hockney_fit(spark, d):
    return an.hockney_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax", 5, 40).select(_R("alpha"), _R("bw"))


@query("probe_lengths")
def probe_lengths(spark, d):
    return an.probe_counts(spark, [0.25, 0.5, 0.75], 1 << 14)


# ---- filters, sets, sorts


@query("filters", "SELECT event_id, event_type FROM events WHERE (event_type IN ('click', 'view') AND value BETWEEN 10 AND 60) OR contains(event_type, 'purch')")
def filters(spark, d):
    t = table(spark, d, "events")
    return t.filter((F.col("event_type").isin("click", "view") & F.col("value").between(10, 60)) | F.col("event_type").contains("purch")).select("event_id", "event_type")


@query("string_functions", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS DOUBLE) AS number, replace(lower(trim(c_name)), '#', '-') || '/' || CASE WHEN starts_with(c_name, 'Cust') THEN 'c' ELSE 'o' END AS label FROM customer")
def string_functions(spark, d):
    digits = F.regexp_extract("c_name", "([0-9]+)", 1)
    label = F.concat(F.regexp_replace(F.lower(F.trim("c_name")), "#", "-"), F.lit("/"), F.when(F.col("c_name").startswith("Cust"), "c").otherwise("o"))
    return table(spark, d, "customer").select("c_custkey", digits.alias("digits"), F.nullif(digits, F.lit("")).try_cast("double").alias("number"), label.alias("label"))


@query("union_all_keys", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events) GROUP BY k")
def union_all_keys(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("common_keys", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT l_partkey FROM lineitem")
def common_keys(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("k")).intersect(t.select(F.col("l_partkey").alias("k")))


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first(spark, d):
    return an.keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("keep_last", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def keep_last(spark, d):
    return an.keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", "o_orderkey")


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 32")
def top_rows(spark, d):
    """A top-32 report."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(32)


@query("category_order", "SELECT event_id, list_position(['view', 'click', 'purchase', 'signup'], event_type) AS place FROM events")
def category_order(spark, d):
    place = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase", "signup"))), F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.nullif(place, F.lit(0)).alias("place"))


@query("running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS before FROM orders")
def running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 4).alias("before"))


# ---- logs

_LOG = """=== Experiment 1: Sweep N (P=256) ===
--- N=1000000 P=256 ---
[baseline]
plain (no-vec)            N=1000000     median=1.089    ms  stddev=0.012  ms  throughput=918.3 Mkeys/s
Distribuzione: min=3764 max=4070 atteso=3906.2 max/atteso=1.0419
checksum=0x00ff12ab
[autovec]
# a comment
plain (vec)               N=1000000     median=0.763    ms  stddev=0.010  ms  throughput=1310.6 Mkeys/s
--- N=2000000 P=64 key_space=1000 ---
[avx2]
avx2                      N=2000000     median=1.700    ms  stddev=0.020  ms  throughput=1176.5 Mkeys/s
checksum=0xdeadbeef"""


@query("parse_cpu_log", """SELECT * FROM (VALUES
('Experiment 1: Sweep N (P=256)', 'baseline', 1000000, 256, 0, 1.089, 0.012, 918.3, 3764, 4070, 1.0419, '00ff12ab'),
('Experiment 1: Sweep N (P=256)', 'autovec', 1000000, 256, 0, 0.763, 0.010, 1310.6, NULL, NULL, NULL, NULL),
('Experiment 1: Sweep N (P=256)', 'avx2', 2000000, 64, 1000, 1.7, 0.02, 1176.5, NULL, NULL, NULL, 'deadbeef')
) t(experiment, impl, N, P, key_space, median_ms, stddev_ms, throughput_Mkeys_s, dist_min, dist_max, dist_ratio, checksum)""".replace("1.089, 0.012, 918.3", "CAST(1.089 AS DOUBLE), CAST(0.012 AS DOUBLE), CAST(918.3 AS DOUBLE)").replace("1.0419", "CAST(1.0419 AS DOUBLE)"))
def parse_cpu_log(spark, d):
    return logs.cpu_results(spark.createDataFrame([("log", i, x) for i, x in enumerate(_LOG.split("\n"))], "file string, line_no int, line string"))


@query("parse_cuda_log")
def parse_cuda_log(spark, d):
    text = "=== Sweep N ===\n--- N=100 P=8 ---\nH->D  : 1.5 ms\nKernel : 0.5 ms\nD->H : 1.0 ms\nTotale : 3.0 ms\nThroughput (solo kernel): 200.0 Mkeys/s\nThroughput (end-to-end): 33.3 Mkeys/s\nchecksum=0xab\n--- N=200 P=8 ---\nKernel: 0.7 ms"
    return logs.cuda_results(spark.createDataFrame([("log", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string"))


@query("parse_key_values", "SELECT 'a' AS file, '12' AS join_count, '34' AS checksum1, CAST(NULL AS VARCHAR) AS checksum2")
def parse_key_values(spark, d):
    rows = [("a", 0, "hello"), ("a", 1, "join_count=11"), ("a", 2, "join_count=12"), ("a", 3, "checksum1=34")]
    return logs.key_values(spark.createDataFrame(rows, "file string, line_no int, line string"), ["join_count", "checksum1", "checksum2"])
