"""Hashes, mixers and generators against plain Python integers."""

import pytest
from pyspark.sql import functions as F

from shardloom.functions import benchmarks as bm
from shardloom.functions import u64
from shardloom.operators import join, partition
from shardloom.sources import generators as gen

M = (1 << 64) - 1
EDGES = [0, 1, 2, 255, 1 << 31, (1 << 32) - 1, 1 << 32, (1 << 62) + 12345, (1 << 63) - 1, 1 << 63, (1 << 63) + 1, M - 1, M, 0x9E3779B97F4A7C15]


def mix(z):
    z = (z ^ z >> 30) * u64.MIX1 & M
    z = (z ^ z >> 27) * u64.MIX2 & M
    return z ^ z >> 31


def draw(seed, k):
    return mix((seed + k * u64.A64) & M)


def fib32(k, lg):
    return (((k ^ k >> 32) & 0xFFFFFFFF) * u64.A32 & 0xFFFFFFFF) >> (32 - lg) if lg else 0


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(u64.as_long(k), str(k)) for k in EDGES], "key long, name string")


@pytest.mark.parametrize("p", [1, 2, 128, 1 << 20])
def test_partition_hashes(edges, p):
    lg = p.bit_length() - 1
    rows = edges.select("name", *(h(F.col("key"), p).alias(n) for n, h in u64.HASHES.items())).collect()
    for r in rows:
        k = int(r["name"])
        assert r["fib32"] == fib32(k, lg)
        assert r["fib32_lowbits"] == ((k ^ k >> 32) & 0xFFFFFFFF) * u64.A32 % (1 << 32) % p
        assert r["mod"] == k % p
        assert r["fib64"] == (k * u64.A64 & M) >> (64 - lg)
        assert r["mult32_nofold"] == ((k & 0xFFFFFFFF) * u64.A32 & 0xFFFFFFFF) >> (32 - lg)


def test_mixer_and_unsigned(edges):
    rows = edges.select("name", u64.unsigned_string(F.col("key")).alias("u"), u64.unsigned_string(u64.splitmix64("key")).alias("h"), u64.unsigned_mod(F.col("key"), 1_000_003).alias("m")).collect()
    for r in rows:
        k = int(r["name"])
        assert (int(r["u"]), int(r["h"]), r["m"]) == (k, mix((k + u64.A64) & M), k % 1_000_003)


@pytest.mark.parametrize("p", [0, 3, 12])
def test_partition_count_must_be_a_power_of_two(p):
    with pytest.raises(ValueError):
        u64.log2_of(p)


def test_uniform_skips_ahead(spark):
    want = [draw(7, i + 1) % 1000 for i in range(500)]
    assert [r.key for r in gen.uniform(spark, 500, 7, 1000, 7).orderBy("i").collect()] == want
    assert [r.key for r in gen.uniform(spark, 100, 7, 1000, offset=200).orderBy("i").collect()] == want[200:300]
    assert {r.key for r in gen.uniform(spark, 10, 7, 0).collect()} == {0}


def test_skewed_is_the_sequential_stream(spark):
    seed, max_key, p, rho, hot = 42, 100, 16, 0.9, 4
    k, keys, seen = 0, [], set()
    while len(keys) < hot:
        k += 1
        x = draw(seed, k) % max_key
        if fib32(x, 4) not in seen:
            seen.add(fib32(x, 4))
            keys.append(x)
    assert keys == [13, 91, 58, 64]
    want = []
    for _ in range(300):
        coin, value = draw(seed, k + 1), draw(seed, k + 2)
        k += 2
        want.append(keys[value % hot] if coin % 1_000_000 < int(rho * 1e6) else value % max_key)
    assert [r.key for r in gen.skewed(spark, 300, seed, max_key, p, rho, hot, 5).orderBy("i").collect()] == want
    assert gen.hot_keys(gen.second_seed(42), 100, 16, 4)[0] == [75, 8, 30, 3]


def test_skewed_guards(spark):
    assert gen.skewed(spark, 10, 1, 0, 16, 0.5, 0).select("key").distinct().collect()[0].key == 0
    with pytest.raises(ValueError):
        gen.hot_keys(1, 1, 16, 2, tries=1000)


def test_xoshiro_stream(spark):
    s = [draw(42, k) for k in range(1, 5)]
    rot = lambda x, n: (x << n | x >> (64 - n)) & M
    want = []
    for _ in range(50):
        want.append(rot(s[1] * 5 & M, 7) * 9 & M)
        t = s[1] << 17 & M
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rot(s[3], 45)
    got = gen.xoshiro(spark, 50, 42).orderBy("i").select(u64.unsigned_string(F.col("key")).alias("k")).collect()
    assert [int(r.k) for r in got] == want


def test_distributions(spark):
    for name in gen.DISTRIBUTIONS:
        keys = [r.key % (1 << 64) for r in gen.distribution(spark, name, 64).collect()]
        assert len(keys) == 64
        if name == "strided_pow2":
            assert sorted(keys) == [4096 * i for i in range(64)]
        if name == "low16_zero":
            assert not any(k & 0xFFFF for k in keys)
        if name == "dup_struct":
            assert all(k < 1000 << 16 and not k & 0xFFFF for k in keys)


#: Published results: R rows, S rows, seed, key range, partitions, (rho, hot), triple.
GOLDEN = [
    (200, 200, 1, 1000, 32, None, "39|2408547661300521379|12365686921080888036"),
    (200, 400, 42, 100, 16, None, "782|4083594261647277204|12759966172179661935"),
    (200, 400, 42, 100, 16, (0.9, 4), "8|14288878883941118028|10127366633300503530"),
    (10000, 20000, 7, 5000, 32, None, "40179|11118602631294229433|15339275744729819729"),
    (500000, 1000000, 3, 250000, 128, None, "2001127|16586776376866430201|5768992208108660414"),
    (1000000, 2000000, 42, 500000, 128, (0.9, 4), "1390745|5488816061053549960|5632934136443096162"),
]


def relations(spark, nr, ns, seed, max_key, p, skew):
    if skew:
        return tuple(gen.skewed(spark, n, s, max_key, p, *skew) for n, s in ((nr, seed), (ns, gen.second_seed(seed))))
    return tuple(gen.uniform(spark, n, s, max_key) for n, s in ((nr, seed), (ns, gen.second_seed(seed))))


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: f"{c[0]}x{c[1]}")
def test_published_joins(spark, case):
    r, s = relations(spark, *case[:-1])
    assert "|".join(join.join_triple(r, s, "key", "key").first()) == case[-1]


@pytest.mark.parametrize("case", GOLDEN[:3], ids=lambda c: f"{c[2]}-{c[5]}")
def test_every_form_of_the_join_agrees(spark, case):
    r, s = relations(spark, *case[:-1])
    for form in [join.naive_triple(r, s, "key", "key"), *(join.join_triple(r, s, "key", "key", h) for h in join.HINTS)]:
        assert "|".join(form.first()) == case[-1]


def test_join_of_nothing_and_nulls(spark):
    a = spark.createDataFrame([(None,), (1,), (1,), (-1,)], "key long")
    assert tuple(join.join_triple(a.limit(0), a, "key", "key").first()) == ("0", "0", "0")
    assert join.join_triple(a, a, "key", "key").first().join_count == "5"


def test_pid_fold(spark):
    rows = partition.with_pid(spark.range(1000).withColumnRenamed("id", "i"), "i", 64)
    h = u64.FNV_OFFSET
    for i in range(1000):
        h = (h ^ fib32(i, 6)) * u64.FNV_PRIME & M
    assert partition.pid_fold(rows.repartition(5)).first().checksum == f"{h:016x}"


def test_helpers():
    assert bm.size_label(1_000_000) == "$10^{6}$"
    assert bm.size_label(50_000_000) == r"$5\times10^{7}$"
    assert bm.workers_for(100, 10**9, 8) == 1 and bm.workers_for(10**6, 10**7, 8) == 8
    assert bm.block_bounds(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert bm.balanced_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]
    assert bm.ridge(100, 25) == 4
