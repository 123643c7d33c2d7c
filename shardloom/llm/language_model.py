"""Language-model scores by deleted interpolation.

n-gram maximum-likelihood estimates of all orders are mixed with weights that
depend on the frequency of the context; the weights are learned by
expectation-maximisation on one fold of the training documents, with counts of
the other folds.

Texts are worked on in chunks of some megabytes. A chunk sends its distinct
n-grams, once each, to the tasks that count them, and gets their counts back in
the same order; so frequent n-grams cost no more than rare ones and no table of
the corpus is ever broadcast or collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, stage, trimmed
from .text import chunks, mix64, word_hashes

#: Text bytes of a chunk, and the most buckets of context frequencies.
CHUNK = 4 << 20
BUCKETS = 24
#: Steps of an octave to which estimates are rounded for the learning of weights.
STEPS = 4
_END, _START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x8EBC6AF09C88C6E3)
_ROWS = "kind string, chunk long, ord int, r long, deleted boolean, n long, blob binary, more binary"
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def remainder(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo the number of folds; null counts as empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _stretch(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each row; row starts."""
    parts, sizes = [], []
    for _, part in chunks(texts):
        h, rows = word_hashes(part)
        n = np.diff(rows) + 1
        out = np.full(n.sum(), _END, np.uint64)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n) - 1] = False
        out[keep] = h
        parts.append(out)
        sizes.append(n)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), starts


def _ngrams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for orders 1 to ``order``."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    grams, before = [tokens], tokens
    for o in range(2, order + 1):
        shifted = np.concatenate([np.full(1, _START, np.uint64), before[:-1]])
        shifted = np.where(place == 0, _START, shifted)  # the gram of the order below that ends one token earlier
        before = mix64(mix64(shifted + np.uint64(o)) + tokens * np.uint64(0x9FB21C651E98DF25))
        grams.append(before)
    return grams


def _chunked(docs: DataFrame, folds: int, held: int, deleted: int, limit: int) -> DataFrame:
    """Chunks (chunk, deleted, n, blob) of documents: ``n`` of them are learned
    from; those of the deleted fold have chunks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: dict[bool, list] = {True: [], False: []}
        texts: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}

        def chunk(own: bool):
            nonlocal made
            number, made = (part << 24) | made, made + 1
            mine, sink = ids[own], pa.BufferOutputStream()
            table = pa.table({"doc_id": pa.array(mine, pa.int64()), "text": pa.chunked_array(texts[own]).combine_chunks().cast(pa.large_string())})
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            ids[own], texts[own], size[own] = [], [], 0
            n = sum(remainder(i, folds) != held for i in mine)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own]), pa.array([n]), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["chunk", "deleted", "n", "blob"])

        for b in batches:
            doc, text = b.column(0).to_pylist(), b.column(1).fill_null("")
            mine = np.array([remainder(i, folds) == deleted for i in doc], bool)
            for own in (True, False):
                take = np.flatnonzero(mine == own)
                if len(take):
                    some = text.take(pa.array(take))
                    ids[own] += [doc[i] for i in take.tolist()]
                    texts[own].append(some)
                    size[own] += some.nbytes
                    if size[own] >= limit:
                        yield chunk(own)
        for own in (True, False):
            if ids[own]:
                yield chunk(own)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "chunk long, deleted boolean, n long, blob binary")


def _opened(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, tokens and row starts of a chunk."""
    table = pa.ipc.open_stream(zstandard.decompress(blob)).read_all()
    return table.column("doc_id").to_pylist(), *_tokens(table.column("text").combine_chunks())


def _keys(chunked: DataFrame, order: int, buckets_log2: int, folds: int, held: int) -> DataFrame:
    """Per chunk and bucket the distinct n-grams with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << buckets_log2, dtype=np.uint64) << np.uint64(64 - buckets_log2)
        for b in batches:
            for number, own, blob in zip(*(c.to_pylist() for c in b.columns)):
                ids, tokens, starts = _opened(blob)
                of_train = np.repeat(np.array([remainder(i, folds) != held for i in ids], bool), np.diff(starts))
                for o, gram in enumerate(_ngrams(tokens, starts, order), 1):
                    rows = []
                    keys, at = np.unique(gram, return_inverse=True)
                    counts = np.bincount(at, weights=of_train, minlength=len(keys)).astype(np.uint32)
                    cut = np.append(np.searchsorted(keys, edges), len(keys))
                    for r in np.flatnonzero(np.diff(cut)).tolist():
                        k = keys[cut[r] : cut[r + 1]]
                        rows.append((number, o, r, own, _squeeze(np.diff(k, prepend=np.uint64(0))), _squeeze(counts[cut[r] : cut[r + 1]])))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["chunk", "ord", "r", "deleted", "blob", "more"])

    return chunked.select("chunk", "deleted", "blob").mapInArrow(trimmed(run), "chunk long, ord int, r long, deleted boolean, blob binary, more binary")


def _counted(keys: DataFrame, buckets_log2: int, parts: int) -> DataFrame:
    """Each chunk's n-grams of a bucket with their counts in the corpus: of all
    training documents and, for chunks of the deleted fold, of the others. A
    chunk counts in 32 bits, the corpus in 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def count() -> pa.RecordBatch:
            k = [np.cumsum(_stretch(h[2], np.uint64), dtype=np.uint64) for h in held]
            uniq, at = np.unique(np.concatenate(k), return_inverse=True)
            local = [_stretch(h[3], np.uint32) for h in held]
            total = np.bincount(at, weights=np.concatenate(local), minlength=len(uniq)).astype(np.uint64)
            own = np.concatenate([c if h[1] else np.zeros(len(c), np.uint32) for c, h in zip(local, held)])
            rest = total - np.bincount(at, weights=own, minlength=len(uniq)).astype(np.uint64)
            rows, a = [], 0
            for h, x in zip(held, k):
                i = at[a : a + len(x)]
                a += len(x)
                rows.append(("counts", h[0], key[0], key[1], h[1], None, _squeeze(total[i]), _squeeze(rest[i]) if h[1] else None))
            # distinct n-grams and n-grams in all training documents, and in those of the deleted fold
            rows.append(("sums", int((total > 0).sum()), key[0], key[1], None, int(total.sum(dtype=np.int64)), None, int(own.sum(dtype=np.int64)).to_bytes(8, "big")))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        for b in batches:
            for chunk, o, r, own, blob, more in zip(*(c.to_pylist() for c in b.columns)):
                if (o, r) != key:
                    if held:
                        yield count()
                    key, held = (o, r), []
                held.append((chunk, own, blob, more))
        if held:
            yield count()

    # buckets are equal shares of the hashes, so equal runs of them make equal tasks
    dealt = keys.repartitionById(parts, F.floor(F.col("r") * parts / (1 << buckets_log2)).cast("int"))
    return dealt.sortWithinPartitions("ord", "r", "chunk").mapInArrow(trimmed(run), _ROWS)


def _assembled(batches: Iterator[pa.RecordBatch], order: int, column: int):
    """(doc ids, tokens, row starts, counts per order at each token) per chunk."""
    chunk, docs, counts = None, None, []

    def done():
        ids, tokens, starts = _opened(docs)
        out = []
        for o, gram in enumerate(_ngrams(tokens, starts, order), 1):
            _, at = np.unique(gram, return_inverse=True)
            out.append(np.concatenate([_stretch(c[1 + column], np.uint64) for c in counts if c[0] == o])[at].astype(np.float64))
        return ids, tokens, starts, out

    for b in batches:
        for c, kind, o, blob, more in zip(*(x.to_pylist() for x in b.columns)):
            if c != chunk:
                if docs is not None:
                    yield done()
                chunk, docs, counts = c, None, []
            if kind == "docs":
                docs = blob
            else:
                counts.append((o, blob, more))
    if docs is not None:
        yield done()


def _by_chunk(chunked: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    cols = ["chunk", "kind", "ord", "r", "blob", "more"]
    docs = chunked.select("chunk", F.lit("docs").alias("kind"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("r"), "blob", F.lit(None).cast("binary").alias("more"))
    rows = docs.unionAll(counted.filter("kind = 'counts'").select(cols))
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", F.desc("kind"), "ord", "r").select("chunk", "kind", "ord", "blob", "more")


def _estimates(counts: list[np.ndarray], starts: np.ndarray, total: float, docs: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of orders 1 to n, and the bucket of each
    token's context: the frequency of the longest context, in octaves."""
    first = np.zeros(len(counts[0]), bool)
    first[starts[:-1]] = True
    p, context = [counts[0] / max(total, 1)], np.full(len(counts[0]), total)
    for o in range(1, len(counts)):
        context = np.where(first, docs, np.concatenate([[0.0], counts[o - 1][:-1]]))
        p.append(np.divide(counts[o], context, out=np.zeros(len(context)), where=context > 0))
    return p, np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def expectation_maximisation(cells: np.ndarray, weights: np.ndarray, buckets: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights per bucket. ``cells``: estimates (rows, orders + 1),
    ``weights``: how many held-out tokens have them. A pooled mixture stands
    in where a bucket has no tokens, and counts as ten tokens of each other."""
    parts = cells.shape[1]

    def learn(x: np.ndarray, w: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
        mix = prior.copy()
        for _ in range(rounds):
            share = x * mix
            share *= (w / share.sum(axis=1))[:, None]
            mix = share.sum(axis=0) + strength * prior
            mix /= mix.sum()
        return mix

    even = np.full(parts, 1 / parts)
    pooled = learn(cells, weights, even, 1.0) if len(weights) else even
    out = np.tile(pooled, (BUCKETS, 1))
    for b in np.unique(buckets):
        out[b] = learn(cells[buckets == b], weights[buckets == b], pooled, 10.0)
    return out


def score(docs: DataFrame, order: int = 2, folds: int = 5, held: int = 1, deleted: int = 0, chunk: int | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; both scores are log10 probabilities of the whole text.

    Documents whose crc32(doc_id) modulo ``folds`` is ``held`` are not learned
    from; those with remainder ``deleted`` are the held-out counts that teach
    the weights. Tokens are words, then one end.

    Null, empty and white-space texts are the end token alone; texts longer than
    ``chunk`` bytes are chunks of their own; a null doc_id
    counts as an empty one; repeated rows are learned from and scored once
    each; with no training documents every word is as likely; an empty table
    gives no rows; other columns, whatever their names, are ignored.

    The n-grams are counted in buckets of four chunks' worth at most, and
    every task holds one bucket or one chunk at a time. Rows exchanged are
    chunks times buckets; terabytes want a ``chunk`` of 64 MB.
    """
    spark = docs.sparkSession
    with batches_of(spark):
        chunked = stage(_chunked(docs, folds, held, deleted, chunk or CHUNK), "chunks")
    with batches_of(spark, 16):  # chunks are large rows
        return _scored(chunked, order, folds, held)


def _scored(chunked: DataFrame, order: int, folds: int, held: int) -> DataFrame:
    spark = chunked.sparkSession
    n_chunks = chunked.count()
    parts = max(n_chunks // 4, 2)
    log2 = max(6, parts.bit_length())  # as many buckets as parts or more
    counted = stage(_counted(_keys(chunked, order, log2, folds, held), log2, parts), "counts")
    sums = counted.filter("kind = 'sums' and ord = 1")
    total, types, own_tokens = (int(x) for x in sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chunk"), F.lit(0)), F.coalesce(F.sum(F.conv(F.hex("more"), 16, 10).cast("long")), F.lit(0))).first())
    by_kind = {bool(r[0]): r[1] for r in chunked.groupBy("deleted").agg(F.sum("n")).collect()}
    n_docs, own_docs = sum(by_kind.values()), by_kind.get(True, 0)
    floor = 1 / (types + 1)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, int] = {}
        for _, tokens, starts, counts in _assembled(batches, order, 1):
            p, bucket = _estimates(counts, starts, others, n_docs - own_docs)
            q = np.stack([bucket, *(np.where(x > 0, np.round(STEPS * np.log2(np.where(x > 0, x, 1))), 1).astype(np.int64) for x in p)], axis=1)
            for cell, n in zip(*(a.tolist() for a in np.unique(q, axis=0, return_counts=True))):
                cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in cells], pa.list_(pa.int64())), pa.array(list(cells.values()), pa.int64())], ["cell", "n"])

    others = total - own_tokens
    deleted_rows = _by_chunk(chunked.filter("deleted"), counted.filter("deleted"), parts)
    # as many rows at most as there are cells of rounded estimates
    got = deleted_rows.mapInArrow(trimmed(held_out), "cell array<long>, n long").groupBy("cell").agg(F.sum("n")).collect()
    cells = np.array([r[0] for r in got], np.int64).reshape(-1, order + 1)
    estimates = np.hstack([np.where(cells[:, 1:] <= 0, 2.0 ** (cells[:, 1:] / STEPS), 0.0), np.full((len(cells), 1), floor)])
    mix = spark.sparkContext.broadcast(expectation_maximisation(estimates, np.array([r[1] for r in got], float), cells[:, 0]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, starts, counts in _assembled(batches, order, 0):
            p, bucket = _estimates(counts, starts, total, n_docs)
            m = mix.value[bucket]
            model = m[:, -1] * floor
            for o, x in enumerate(p):
                model += m[:, o] * x
            base = np.log10((counts[0] + 0.5) / (total + 0.5 * (types + 1)))
            add = lambda v: np.add.reduceat(v, starts[:-1])
            cols = [pa.array(ids, pa.int64()), pa.array([remainder(i, folds) == held for i in ids]), pa.array(np.diff(starts)), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(ids), total)), pa.array(add(base)), pa.array(add(np.log10(model)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = stage(_by_chunk(chunked, counted, parts).mapInArrow(trimmed(scored), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    release(chunked, counted)
    return out
