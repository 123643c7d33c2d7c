"""Deterministic key relations: one bigint column ``key`` (unsigned bit pattern).

All skip ahead, so that every partition makes its own rows and any executor can
make them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import A32, A64, SECOND_SEED, TWO64, as_long, log2_of, np_mix


def second_seed(seed: int) -> int:
    return (seed ^ SECOND_SEED) % TWO64


def _rows(spark: SparkSession, n: int, make, partitions: int | None, offset: int = 0) -> DataFrame:
    """``make``: uint64 row numbers to uint64 keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(make(i).view(np.int64))], ["i", "key"])

    ids = spark.range(offset, offset + n, 1, partitions) if partitions else spark.range(offset, offset + n)
    return ids.withColumnRenamed("id", "i").mapInArrow(run, "i long, key long")


def _draw(seed: int, k: np.ndarray) -> np.ndarray:
    """Draw number k (from 1) of the splitmix64 stream."""
    return np_mix(np.uint64(seed % TWO64) + np.uint64(A64) * k)


def uniform(spark: SparkSession, n: int, seed: int, max_key: int, partitions: int | None = None, offset: int = 0) -> DataFrame:
    """(i, key): n keys below ``max_key``, rows ``offset`` to ``offset + n`` of the stream; all 0 if it is 0."""
    m = np.uint64(max_key)

    def make(i: np.ndarray) -> np.ndarray:
        return _draw(seed, i + np.uint64(1)) % m if max_key else np.zeros(len(i), np.uint64)

    return _rows(spark, n, make, partitions, offset)


def _partition_of(key: int, p: int) -> int:
    lg = log2_of(p)
    return (((key ^ (key >> 32)) & 0xFFFFFFFF) * A32 & 0xFFFFFFFF) >> (32 - lg) if lg else 0


def hot_keys(seed: int, max_key: int, p: int, hot: int, tries: int = 10_000_000) -> tuple[list[int], int]:
    """Keys drawn until ``hot`` of them lie in different partitions, and the draws taken."""
    keys: list[int] = []
    seen: set[int] = set()
    draws = 0
    while len(keys) < hot:
        draws += 1
        if draws > tries:
            raise ValueError("the keys cannot fill so many different partitions")
        key = int(_draw(seed, np.array([draws], np.uint64))[0]) % max_key
        pid = _partition_of(key, p)
        if pid not in seen:
            seen.add(pid)
            keys.append(key)
    return keys, draws


def skewed(spark: SparkSession, n: int, seed: int, max_key: int, p: int, rho: float, hot: int, partitions: int | None = None, offset: int = 0) -> DataFrame:
    """(i, key): a share ``rho`` of the rows carries one of ``hot`` keys of different partitions."""
    max_key = max_key or 1
    if not hot:
        rho = 0.0
    hot = min(hot, p)
    keys, used = hot_keys(seed, max_key, p, hot)
    threshold = np.uint64(int(rho * 1_000_000))
    table = np.array(keys or [0], np.uint64)

    def make(i: np.ndarray) -> np.ndarray:
        first = np.uint64(used + 1) + np.uint64(2) * i  # each row takes two draws
        coin, draw = _draw(seed, first), _draw(seed, first + np.uint64(1))
        return np.where(coin % np.uint64(1_000_000) < threshold, table[(draw % np.uint64(max(hot, 1))).astype(np.int64)], draw % np.uint64(max_key))

    return _rows(spark, n, make, partitions, offset)


# Fixed value: seed of the hot values that two relations share.
SHARED_HOT_SEED = 0xABCDEF


def shared_hot(spark: SparkSession, n: int, seed: int, max_key: int, p: int, rho: float, hot: int, partitions: int | None = None) -> DataFrame:
    """(i, key): like :func:`skewed`, with one draw a row and the same hot values for every seed."""
    values = np.array(hot_keys(SHARED_HOT_SEED, max_key or 1 << 30, p, hot)[0] or [0], np.uint64)

    def make(i: np.ndarray) -> np.ndarray:
        r = _draw(seed, i + np.uint64(1))
        cold = r % np.uint64(max_key) if max_key else np.zeros(len(r), np.uint64)
        if rho <= 0 or hot <= 0:
            return cold
        coin = (r >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return np.where(coin < rho, values[((r >> np.uint64(8)) % np.uint64(hot)).astype(np.int64)], cold)

    return _rows(spark, n, make, partitions)


class Xoshiro:
    """xoshiro256** seeded by four splitmix64 steps, in blocks of BLOCK numbers.

    A step is linear over bits, so the state at a block's start is a power of
    the step's 256 x 256 bit matrix times the seed's state: any block can be
    made without those before it, and many blocks are stepped side by side.
    """

    BLOCK = 4096
    _jumps: list[np.ndarray] = []

    def __init__(self, seed: int):
        self.state = _draw(seed, np.arange(1, 5, dtype=np.uint64))

    @staticmethod
    def _step(s: np.ndarray) -> np.ndarray:
        """The next states of (4, lanes) words."""
        a, b, c, d = s
        c, d = c ^ a, d ^ b
        turn = d << np.uint64(45) | d >> np.uint64(19)
        return np.stack([a ^ d, b ^ c, c ^ (b << np.uint64(17)), turn])

    @staticmethod
    def _bits(s: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(s.T).astype("<u8").view(np.uint8)
        return np.unpackbits(words.reshape(s.shape[1], 32), axis=1, bitorder="little").T.astype(np.float32)

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(np.ascontiguousarray(bits.T, np.uint8), axis=1, bitorder="little")
        return np.ascontiguousarray(packed).view("<u8").astype(np.uint64).T

    @classmethod
    def _jump(cls, k: int) -> np.ndarray:
        """The bit matrix that passes over 2^k blocks."""
        if not cls._jumps:
            m = cls._bits(cls._step(cls._words(np.eye(256, dtype=np.float32))))
            for _ in range(cls.BLOCK.bit_length() - 1):
                m = (m @ m) % 2
            cls._jumps.append(m)
        while len(cls._jumps) <= k:
            cls._jumps.append((cls._jumps[-1] @ cls._jumps[-1]) % 2)
        return cls._jumps[k]

    def blocks(self, numbers: np.ndarray) -> np.ndarray:
        """(blocks, BLOCK): the numbers of each block of the stream."""
        bits = np.repeat(self._bits(self.state[:, None]), len(numbers), axis=1)
        for k in range(int(numbers.max(initial=0)).bit_length()):
            on = (numbers >> k & 1).astype(bool)
            bits[:, on] = (self._jump(k) @ bits[:, on]) % 2
        s, out = self._words(bits), np.empty((self.BLOCK, len(numbers)), np.uint64)
        for i in range(self.BLOCK):
            x = s[1] * np.uint64(5)
            out[i] = (x << np.uint64(7) | x >> np.uint64(57)) * np.uint64(9)
            s = self._step(s)
        return out.T


def xoshiro(spark: SparkSession, n: int, seed: int, key_space: int = 0, finish=lambda x: x) -> DataFrame:
    """(i, key) of the xoshiro256** stream; every task makes its own blocks."""
    block = Xoshiro.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = Xoshiro(seed)
        for b in batches:
            numbers = b.column(0).to_numpy()
            for at in range(0, len(numbers), 128):
                some = numbers[at : at + 128]
                for number, x in zip(some.tolist(), rng.blocks(some)):
                    x = x[: n - number * block]
                    x = finish(x % np.uint64(key_space) if key_space else x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(number * block, number * block + len(x))), pa.array(x.view(np.int64))], ["i", "key"])

    return spark.range(-(-n // block)).mapInArrow(run, "i long, key long")


def distribution(spark: SparkSession, name: str, n: int, seed: int = 42) -> DataFrame:
    """(i, key) of a structured or adversarial key distribution."""
    if name in ("sequential", "strided_pow2"):
        step = 1 if name == "sequential" else 4096
        return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * step).alias("key"))
    shapes = {
        "uniform": lambda x: x,
        "low16_zero": lambda x: x << np.uint64(16),
        "high32_only": lambda x: x << np.uint64(32),
        "dup_1000": lambda x: x % np.uint64(1000),
        "dup_struct": lambda x: (x % np.uint64(1000)) << np.uint64(16),
    }
    return xoshiro(spark, n, seed, finish=shapes[name])


DISTRIBUTIONS = ("uniform", "sequential", "strided_pow2", "low16_zero", "high32_only", "dup_1000", "dup_struct")

__all__ = ["as_long", "second_seed", "uniform", "hot_keys", "skewed", "shared_hot", "xoshiro", "Xoshiro", "distribution", "DISTRIBUTIONS"]
