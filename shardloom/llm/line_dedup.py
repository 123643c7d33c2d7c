"""Near-duplicate lines by a deletion-neighbourhood join; the earliest stays.

The distance of two lines is the number of words to insert, delete or replace.
Lines within one edit agree on the first or on the last half of the shorter
one; only lines that find such a half emit their variants, one per deleted
word and the line whole, as hashed keys. Equal variants meet in aggregates, so
hot templates are combined before the shuffle and no pairs of a group are ever
listed. Each line's earliest partner is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, stage, trimmed
from .text import _pow, chunks, mix64, word_hashes

#: Lines of fewer words, those of white space, are left alone; so many and more may differ by an edit.
MIN_WORDS, EDIT_WORDS = 1, 7

#: Lines with a partner's half that are broadcast, by hash and two flags (some
#: 50 MB at most); more are joined by shuffling.
BROADCAST_LINES = 1_000_000

_LINES = "doc_id long, text_hash long, line int, h long, n int, halves array<long>, text string"


def _sequence(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run of words follows, and the inverse powers."""
    p, inv = _pow(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return sums, inv


def _finish(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix64(raw + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """The lines of at least ``least`` words; text and the keys of their halves,
    even for the first and odd for the last, only where an edit is looked for
    and the line is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            doc, text_hash = b.column(0).to_pylist(), b.column(1).to_pylist()
            split = [(t or "").split("\n") for t in b.column(2).to_pylist()]
            flat = pa.array([x for ls in split for x in ls], pa.large_string())
            of = np.repeat(np.arange(len(split)), [len(ls) for ls in split])
            number = np.concatenate([np.arange(len(ls)) for ls in split]) if split else np.zeros(0, int)
            for lo, part in chunks(flat):
                w, rows = word_hashes(part)
                sums, inv = _sequence(w)
                n = np.diff(rows)
                keep = np.flatnonzero(n >= least)
                if not len(keep):
                    continue
                n, a, e = n[keep], rows[:-1][keep], rows[1:][keep]
                h = _finish((sums[e] - sums[a]) * inv[a], n).view(np.int64)
                halves = []
                for half in (n // 2, (n - 1) // 2):  # as the shorter line of a pair, as the longer
                    halves.append(_finish((sums[a + half] - sums[a]) * inv[a], half * 2) & ~np.uint64(1))
                    halves.append(_finish((sums[e] - sums[e - half]) * inv[e - half], half * 2 + 1) | np.uint64(1))
                halves = np.stack(halves, axis=1).view(np.int64).tolist()
                some, texts = [], []
                for i, key, own, m in zip(keep.tolist(), h.tolist(), halves, n.tolist()):
                    new = m >= EDIT_WORDS and key not in seen
                    texts.append(part[i].as_py() if new else None)
                    some.append(sorted({*own}) if new else None)
                    if new and len(seen) < 200_000:
                        seen.add(key)
                at = of[lo + keep].tolist()
                cols = [pa.array([doc[i] for i in at], pa.int64()), pa.array([text_hash[i] for i in at], pa.int64()), pa.array(number[lo + keep].astype(np.int32)), pa.array(h), pa.array(n.astype(np.int32)), pa.array(some, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _LINES.split(", ")])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(trimmed(run), _LINES)


def _variants(lines: DataFrame) -> DataFrame:
    """(v, i, h): the line without word i, or whole where i is -1. Where the
    first half is what another line shares, only words behind it are left out,
    and where the last half is, only words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, rows = word_hashes(b.column(1))
            sums, inv = _sequence(w)
            n = np.diff(rows)
            first, last = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            many = n + 1
            row = np.repeat(np.arange(len(n)), many)
            i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) - 1
            half = ((n - 1) // 2)[row]
            on = (i < 0) | (first[row] & (i >= half)) | (last[row] & (i < n[row] - half))
            row, i = row[on], i[on]
            a, e = rows[:-1][row], rows[1:][row]
            cut = a + np.maximum(i, 0)
            left = (sums[cut] - sums[a]) * inv[a]
            right = (sums[e] - sums[np.minimum(cut + 1, e)]) * inv[a] * inv[1]
            v = np.where(i < 0, _finish((sums[e] - sums[a]) * inv[a], n[row]), _finish(left + right, n[row] - 1))
            for s in range(0, len(v), 1 << 16):
                t = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(v[t].view(np.int64)), pa.array(i[t].astype(np.int32)), b.column(0).take(pa.array(row[t]))], ["v", "i", "h"])

    return lines.select("h", "text", "first", "last").mapInArrow(trimmed(run), "v long, i int, h long")


def _true_links(pairs: DataFrame) -> DataFrame:
    """The pairs (h, x, y) whose words are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda t: t.encode().lower().split()
        for b in batches:
            ok = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = words(x), words(y)
                a = 0
                while a < min(len(x), len(y)) and x[a] == y[a]:
                    a += 1
                ok.append(x[a + 1 :] == y[a + 1 :] or x[a:] == y[a + 1 :] or x[a + 1 :] == y[a:])  # one edit after the common start
            yield b.select(["h"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("h", "x", "y").mapInArrow(trimmed(run), "h long")


def duplicate_lines(docs: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, line) of the lines to drop, and the staged lines.

    A line goes if an earlier one, by doc_id, text hash and line number, has
    the same words, or if one whose first occurrence is earlier differs by one
    word inserted, deleted or replaced and both have EDIT_WORDS words or more.
    Lines of fewer than ``least`` words stay; with 1, only those of white space.
    Words are runs without white space, A-Z lower-cased.
    """
    with batches_of(docs.sparkSession):
        return _duplicate_lines(docs, least)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` several lines have. Keys are combined before the
    shuffle, and a key of very many rows can be split in the join."""
    several = rows.groupBy(key).agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select(key)
    return rows.join(several, key, "left_semi")


def _duplicate_lines(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    lines = stage(_lines(docs, max(least, 1)), "lines")
    at = F.struct("doc_id", "text_hash", "line")
    first = stage(lines.groupBy("h").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("many")), "first")
    keys = lines.filter("halves is not null").select("h", F.explode("halves").alias("key"))
    near = stage(_shared(keys, "key").groupBy("h").agg(F.max(F.col("key") % 2 == 0).alias("first"), F.max(F.col("key") % 2 != 0).alias("last")), "near")
    hint = F.broadcast if near.count() <= BROADCAST_LINES else (lambda df: df)
    some = stage(lines.filter("text is not null").select("h", "text").join(hint(near), "h").groupBy("h", "first", "last").agg(F.min("text").alias("text")), "near")
    release(near)
    every = stage(_variants(some), "variants")
    rows = stage(_shared(every, "v").join(first.select("h", "at"), "h"), "variants")
    release(every)
    me = F.struct("at", "h")
    swapped = rows.filter("i >= 0").groupBy("v", "i").agg(F.min(me).alias("lead"))
    grown = rows.groupBy("v").agg(F.min(F.when(F.col("i") < 0, me)).alias("whole"), F.min(F.when(F.col("i") >= 0, me)).alias("cut")).filter("whole is not null and cut is not null")
    found = rows.join(swapped, ["v", "i"]).select("h", "at", "lead").unionAll(rows.join(grown, "v").select("h", "at", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.col("whole")).alias("lead")))
    links = found.filter("lead.h <> h and lead.at < at").groupBy("h").agg(F.min("lead").alias("lead")).select("h", F.col("lead.h").alias("other"))
    texts = some.select("h", "text")
    pairs = links.join(texts.withColumnRenamed("text", "x"), "h").join(texts.select(F.col("h").alias("other"), F.col("text").alias("y")), "other")
    gone = stage(_true_links(pairs).withColumn("near", F.lit(True)), "gone")
    release(some, rows)
    # one row for every different line that goes somewhere; a line of very many rows is split at run time
    fate = first.join(gone, "h", "left").filter("near or many > 1").select("h", F.col("at").alias("first_at"), "near")
    marked = lines.select("doc_id", "text_hash", "line", "h").join(fate, "h")
    dropped = stage(marked.filter(F.col("near") | (at != F.col("first_at"))).select("doc_id", "text_hash", "line"), "dropped")
    release(first, gone)
    return dropped, lines


def _attach(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, with columns _id and _hash, and the sorted ``_lines`` dropped of each."""
    own = dropped.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.array_sort(F.collect_set("line")).alias("_lines"))
    return docs.join(own, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")), "left").drop("_d", "_t")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, dropped (line numbers from 0).

    Null and empty texts are one empty line, which stays, as do all lines of
    white space; lines of any length are compared whole; repeated rows, alike in
    doc_id and text, are one document and come out once each; an empty table
    gives no rows; other columns are ignored.
    """
    dropped, lines = duplicate_lines(docs)
    release(lines)
    base = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return _attach(base, dropped).select(F.col("_id").alias("doc_id"), "n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("_lines", F.array().cast("array<int>")).alias("dropped"))


def drop_duplicate_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns, without their duplicate lines of ``least``
    words or more. A document that loses lines and keeps none of ``least`` words
    goes; with 1, only one of which nothing but white space is left.

    Null and empty texts lose nothing and stay; repeated rows, alike in doc_id
    and text, lose the same lines and stay or go together; an empty table gives
    no rows."""
    dropped, lines = duplicate_lines(docs, least)
    release(lines)
    row = F.struct(*docs.columns).alias("_row")
    base = docs.select(row, F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    kept = F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains(F.col("_lines"), i))
    out = _attach(base, dropped).select("_row", "_lines", F.when(F.col("_lines").isNotNull(), kept).alias("_kept"))
    own = F.exists("_kept", lambda x: F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), "")) >= least)
    out = out.filter(F.col("_lines").isNull() | own)
    text = F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    return out.select(*(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
