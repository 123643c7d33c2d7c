"""Binary key files: a 40-byte header of five little-endian unsigned 64-bit
numbers (magic, count, seed, key space, reserved), then the keys."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import as_long, unsigned
from .generators import Xoshiro

# Fixed values of the format.
MAGIC = 0x53504D4B455953AA
HEADER_FORMAT, HEADER_SIZE = "<5Q", 40

#: Keys that a task reads at once.
RANGE = 1 << 20


def auto_name(n: int, seed: int, key_space: int) -> str:
    unit = next(((n // u, s) for u, s in ((10**9, "G"), (10**6, "M"), (10**3, "K")) if n >= u and n % u == 0), (n, ""))
    return f"ds_{unit[0]}{unit[1]}_{f'ks{key_space}' if key_space else 'full'}_s{seed}.bin"


def valid(path: str, n: int, seed: int, key_space: int) -> bool:
    """Whether the file is there, has these parameters and the right size."""
    try:
        with open(path, "rb") as f:
            head = f.read(HEADER_SIZE)
        return len(head) == HEADER_SIZE and struct.unpack(HEADER_FORMAT, head)[:4] == (MAGIC, n, seed, key_space) and os.path.getsize(path) == HEADER_SIZE + 8 * n
    except OSError:
        return False


def write(path: str, n: int, seed: int, key_space: int = 0, blocks: int = 64) -> bool:
    """Write the xoshiro keys of a seed, unless the file is valid already; whether it wrote."""
    if valid(path, n, seed, key_space):
        return False
    rng, size = Xoshiro(seed), Xoshiro.BLOCK
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER_FORMAT, MAGIC, n, seed, key_space, 0))
        for at in range(0, -(-n // size), blocks):
            x = rng.blocks(np.arange(at, min(at + blocks, -(-n // size)))).ravel()[: n - at * size]
            f.write((x % np.uint64(key_space) if key_space else x).astype("<u8").tobytes())
    return True


def _opened(path: str):
    """A file of any file system that pyarrow knows, for reading at places."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, magic, n, seed, key_space) of the key files under ``path``,
    unsigned numbers as bit patterns; only 40 bytes of each are read, by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                with _opened(name) as f:
                    head = f.read_at(HEADER_SIZE, 0)
                rows.append(struct.unpack("<4q", head[:32]) if len(head) == HEADER_SIZE else (None,) * 4)
            heads = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *heads], ["path", "bytes", "magic", "n", "seed", "key_space"])

    # the listing does not touch the contents, which are never asked for
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select("path", F.col("length").alias("bytes")).mapInArrow(run, "path string, bytes long, magic long, n long, seed long, key_space long")


def _is_valid() -> Column:
    return F.coalesce((F.col("magic") == F.lit(as_long(MAGIC))) & (F.col("n") >= 0) & (F.col("bytes") == F.col("n") * 8 + HEADER_SIZE), F.lit(False))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, key) of all key files under ``path``; a bad header or size
    fails. A file is read in ranges of RANGE keys, by as many tasks as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n, at in zip(*(c.to_pylist() for c in b.columns)):
                with _opened(name) as f:
                    keys = np.frombuffer(f.read_at(8 * min(RANGE, n - at), HEADER_SIZE + 8 * at), "<u8")
                for lo in range(0, len(keys), 1 << 18):
                    part = keys[lo : lo + (1 << 18)].astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at + lo, at + lo + len(part))), pa.array(part.view(np.int64))], ["path", "i", "key"])

    bad = F.raise_error(F.format_string("%s: not a key file of %s keys", "path", F.coalesce(F.col("n").cast("string"), F.lit("?"))))
    ranges = headers(spark, path).select("path", "n", F.explode(F.when(_is_valid(), F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(RANGE).cast("long"))).otherwise(bad.cast("array<bigint>"))).alias("at"))
    return ranges.repartition("path", "at").mapInArrow(run, "path string, i long, key long")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, seed, key_space, mb, valid) of the key files in a folder, from their headers."""
    return headers(spark, path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        *(unsigned(F.col(c)).alias(c) for c in ("n", "seed", "key_space")),
        (F.col("bytes") / (1024 * 1024)).alias("mb"),
        _is_valid().alias("valid"),
    )
