"""Key files, logs, tables, planners, fits and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import analytics as an
from shardloom.operators import partition, skew
from shardloom.plans import assignment
from shardloom.sources import binary, generators, logs
from shardloom.streaming import key_counts


def test_key_file_round_trip(spark, tmp_path):
    name = binary.auto_name(3000, 7, 100)
    assert name == "ds_3K_ks100_s7.bin"
    path = str(tmp_path / name)
    assert binary.write(path, 3000, 7, 100)
    assert not binary.write(path, 3000, 7, 100)  # valid already
    got = [r.key for r in binary.read(spark, str(tmp_path)).orderBy("i").collect()]
    assert got == [r.key for r in generators.xoshiro(spark, 3000, 7, 100).orderBy("i").collect()]
    row = binary.catalog(spark, str(tmp_path)).first()
    assert (row.name, int(row.n), int(row.seed), int(row.key_space), row.valid) == (name, 3000, 7, 100, True)


def test_key_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE", 1000)
    binary.write(str(tmp_path / "a.bin"), 9500, 3, 0)
    binary.write(str(tmp_path / "none.bin"), 0, 3, 0)
    got = binary.read(spark, str(tmp_path)).orderBy("i").collect()
    assert [r.i for r in got] == list(range(9500))
    assert [r.key for r in got] == [r.key for r in generators.xoshiro(spark, 9500, 3).orderBy("i").collect()]


def test_xoshiro_blocks_are_the_stream():
    """Jumps against the sequential definition, over several blocks."""
    rng, m = generators.Xoshiro(12345), (1 << 64) - 1
    a, b, c, d = (int(x) for x in rng.state)
    want = []
    for _ in range(3 * rng.BLOCK):
        x = b * 5 & m
        want.append(((x << 7 | x >> 57) & m) * 9 & m)
        t = b << 17 & m
        c ^= a
        d ^= b
        b ^= c
        a ^= d
        c ^= t
        d = (d << 45 | d >> 19) & m
    got = rng.blocks(np.array([2, 0, 1]))
    assert [int(v) for k in (1, 2, 0) for v in got[k]] == want


def test_bad_key_files(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(struct.pack("<5Q", 1, 2, 3, 4, 5))
    assert not binary.catalog(spark, str(tmp_path)).first().valid
    assert not binary.valid(str(tmp_path / "bad.bin"), 2, 3, 4) and not binary.valid(str(tmp_path / "none"), 1, 1, 1)
    with pytest.raises(Exception, match="not a key file"):
        binary.read(spark, str(tmp_path)).collect()


def test_auto_names():
    assert [binary.auto_name(n, 1, 0) for n in (10**9, 2 * 10**6, 1500, 7)] == ["ds_1G_full_s1.bin", "ds_2M_full_s1.bin", "ds_1500_full_s1.bin", "ds_7_full_s1.bin"]


def test_phases_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Histogram_R : 51 ms\nJoin_local : 309 ms\njoin_count=5\n")
    text = logs.lines(spark, str(tmp_path / "a.txt"))
    got = logs.phase_seconds(text, ["Histogram_R", "Scatter_R", "Join_local"]).first()
    assert (got.Histogram_R, got.Scatter_R, got.Join_local) == (0.051, 0.0, 0.309)
    df = spark.createDataFrame([(2, 1.23456, "18446744073709551615")], "n int, t double, checksum string")
    logs.write_csv(df, str(tmp_path / "out"), ["t", "n", "checksum"], 4)
    back = logs.read_csv(spark, str(tmp_path / "out"), "t double, n int, checksum string").first()
    assert tuple(back) == (1.2346, 2, "18446744073709551615")


def test_cuda_log(spark):
    from shardloom.queries import QUERIES

    rows = sorted(map(tuple, QUERIES["parse_cuda_log"](spark, "").collect()), key=lambda r: r[1])
    assert rows == [("Sweep N", 100, 8, 1.5, 0.5, 1.0, 3.0, 200.0, 33.3, "ab"), ("Sweep N", 200, 8, None, 0.7, None, None, None, None, None)]


def test_greedy_plan_is_least_loaded():
    placed = assignment.least_loaded([(0, 5), (1, 9), (2, 5), (3, 1)], 2)
    assert placed == [(0, 1, 0, 2), (1, 0, 0, 0), (2, 1, 1, 3), (3, 0, 1, 1)]


def test_hot_split(spark):
    w = spark.createDataFrame([(0, 0, 100, 100)] + [(i, 0, 1, 1) for i in range(1, 16)], "pid int, r_cnt long, s_cnt long, weight long")
    h = skew.hot_partitions(w, workers=8)
    assert [(r.pid, r.splits) for r in h.filter("hot").collect()] == [(0, 8)]
    assert not skew.hot_partitions(w, workers=1).filter("hot").count()
    ranges = sorted(map(tuple, skew.split_ranges(h).filter("pid = 0").collect()))
    assert [r[2:] for r in ranges] == [(13 * i, min(100, 13 * i + 13)) for i in range(8)]


def test_placement_by_plan(spark):
    rows = partition.with_pid(spark.range(1000).withColumnRenamed("id", "key"), "key", 16)
    w = partition.histogram(spark.range(1000).withColumnRenamed("id", "key"), "key", 16).withColumnRenamed("cnt", "weight")
    plan = assignment.greedy_plan(w, 4)
    placed = assignment.place_by_plan(rows, plan, 4).withColumn("at", F.spark_partition_id())
    assert placed.filter("at <> dest").count() == 0 and placed.count() == 1000


def test_amdahl_fit(spark):
    rows = [("a", float(p), 1 / (0.08 + 0.92 / p)) for p in (1, 2, 4, 8, 16, 32)]
    got = an.amdahl_fit(spark.createDataFrame(rows, "g string, p double, s double"), ["g"], "p", "s").first()
    assert abs(got.f - 0.08) < 1e-6 and got.r2 > 0.999999


def test_probe_counts_match_theory(spark):
    got = {r.alpha: r for r in an.probe_counts(spark, [0.25, 0.5], 1 << 14).collect()}
    for r in got.values():
        assert abs(r.mean_probes - r.knuth) < 0.1 and r.n_keys == int(r.alpha * (1 << 14))


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "user_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long").parquet(str(tmp_path / "in"))
    q = key_counts.maintain_counts(stream, "user_id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.sum("n").alias("n")).collect()
    assert sorted((r.key, r.n) for r in got) == [(1, 2), (2, 1)]
