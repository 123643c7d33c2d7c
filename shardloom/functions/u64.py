"""Exact unsigned 64-bit arithmetic on bigint columns that hold bit patterns.

Partition hashes are plain column expressions, small enough for whole-stage
codegen. The 64-bit mixer multiplies modulo 2^64: as a column in plans that are
built with wrap-around arithmetic, and on Arrow batches where a column has to
work in plans of any kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

# Multiplicative constants of the hashes and the mixer.
A32 = 0x9E3779B9
A64 = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
#: The second relation's seed is the first's xor this.
SECOND_SEED = 0xDEADEBDECDEEDEF1

TWO64 = 1 << 64


def as_long(x: int) -> int:
    """The bigint with the bit pattern of an unsigned 64-bit number."""
    x %= TWO64
    return x - TWO64 if x >= 1 << 63 else x


def log2_of(p: int) -> int:
    """Exponent of a power of two; anything else is refused."""
    if p < 1 or p & (p - 1) or p > 1 << 30:
        raise ValueError(f"partition count {p} is not a power of two up to 2^30")
    return p.bit_length() - 1


def is_power_of_two(p: int) -> bool:
    return p >= 1 and not p & (p - 1)


def np_mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def np_splitmix(x: np.ndarray) -> np.ndarray:
    return np_mix(x + np.uint64(A64))


@F.pandas_udf(LongType())
def splitmix64(keys: pd.Series) -> pd.Series:
    """splitmix64 of each key's bit pattern."""
    return pd.Series(np_splitmix(keys.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def splitmix64_mix(keys: pd.Series) -> pd.Series:
    """The finaliser alone."""
    return pd.Series(np_mix(keys.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Bigint arithmetic that wraps around, which is arithmetic modulo 2^64, in
    the frames built inside. The overflow rule becomes part of a plan when it is
    analysed, so the session's own comes back as soon as the plan is built."""
    own = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", own)


def mix_column(z: Column) -> Column:
    """The splitmix64 finaliser as a column, to be analysed inside :func:`wrapping`."""
    for shift, factor in ((30, MIX1), (27, MIX2)):
        z = z.bitwiseXOR(F.shiftrightunsigned(z, shift)) * F.lit(as_long(factor))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def splitmix_column(x: Column) -> Column:
    """splitmix64 of a bit pattern as a column, to be analysed inside :func:`wrapping`."""
    return mix_column(x + F.lit(as_long(A64)))


def fib64(key: Column, p: int) -> Column:
    """High bits of the 64-bit multiplicative hash."""
    shift = 64 - log2_of(p)

    @F.pandas_udf(IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        if shift == 64:
            return pd.Series(np.zeros(len(keys), np.int32))
        return pd.Series(((keys.to_numpy(np.int64).view(np.uint64) * np.uint64(A64)) >> np.uint64(shift)).astype(np.int32))

    return run(key)


def _times_a32(low: Column) -> Column:
    """Low 32 bits of a 32-bit value times A32, by 16-bit limbs: no product leaves bigint."""
    return (low.bitwiseAND(65535) * F.lit(A32) + (F.shiftrightunsigned(low, 16) * F.lit(A32)).bitwiseAND(65535) * 65536).bitwiseAND(F.lit(0xFFFFFFFF))


def _fold(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.shiftrightunsigned(key, 32))


def fib32(key: Column, p: int) -> Column:
    """Partition of a key: high bits of the folded 32-bit multiplicative hash; all 0 for one partition."""
    lg = log2_of(p)
    key = key.cast("long")
    return F.shiftrightunsigned(_times_a32(_fold(key)), 32 - lg).cast("int") if lg else key.bitwiseAND(F.lit(0).cast("long")).cast("int")


def fib32_lowbits(key: Column, p: int) -> Column:
    log2_of(p)
    return _times_a32(_fold(key.cast("long"))).bitwiseAND(p - 1).cast("int")


def mult32_nofold(key: Column, p: int) -> Column:
    lg = log2_of(p)
    low = key.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(_times_a32(low), 32 - lg).cast("int") if lg else low.bitwiseAND(F.lit(0).cast("long")).cast("int")


def mod(key: Column, p: int) -> Column:
    log2_of(p)
    return key.cast("long").bitwiseAND(p - 1).cast("int")


#: Partition hashes by name: (key column, partition count) -> int column.
HASHES = {"fib32": fib32, "fib32_lowbits": fib32_lowbits, "mod": mod, "fib64": fib64, "mult32_nofold": mult32_nofold}


def two64() -> Column:
    """2^64 as decimal(38,0)."""
    return F.lit(str(TWO64)).cast("decimal(38,0)")


def unsigned(key: Column) -> Column:
    """The bit pattern as decimal(20,0)."""
    d = key.cast("decimal(20,0)")
    return F.when(key < 0, (d + two64()).cast("decimal(20,0)")).otherwise(d)


def unsigned_string(key: Column) -> Column:
    return unsigned(key).cast("string")


def unsigned_mod(key: Column, m: int) -> Column:
    """The unsigned remainder, for 0 < m < 2^62."""
    if not 0 < m < 1 << 62:
        raise ValueError("modulus out of range")
    half = F.shiftrightunsigned(key, 1) % F.lit(m)
    return (half * 2 + key.bitwiseAND(F.lit(1).cast("long"))) % F.lit(m)
