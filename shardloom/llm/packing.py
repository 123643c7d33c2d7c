"""Packing: documents into token windows of a fixed length.

Bounded-space online packing. Every scan task keeps a fixed number of open
windows, puts each piece into the window it fits best, and emits the fullest
window when none fits. What is left open goes through the same procedure once
more, groups of partitions at a time, until one group remains.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, trimmed

#: Encoded chunks kept by a task before its cache starts afresh, and bytes of
#: the chunks that stay for the worker's next task.
CACHE_ENTRIES, KEPT_BYTES = 1_000_000, 10
#: The mark comes first, so that only marks are looked at.
_PUNCT = re.compile(rb"([.,])(?<=[a-z].)(?=[ \t\n\r\x0b\x0c])")
#: Latin letters, and the characters that byte-level tokenizers write for bytes.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.lower() == c and c.isalpha())
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class ChunkEncoder:
    """Ids of whole texts from cached ids of white-space-separated chunks.

    Valid for tokenizers whose pre-tokens never span white space and which
    lower-case their input, such as ``word_bpe_49k.json``. Texts that hold
    ``<|`` may contain special tokens and are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache = Tokenizer.from_str(tokenizer_json), {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        norm, cut = self.tok.normalizer, self.tok.pre_tokenizer
        #: Lower-case words of such letters reach the model byte by byte.
        self.bare = (not norm or norm.normalize_str(_LETTERS) == _LETTERS) and bool(cut) and [t for t, _ in cut.pre_tokenize_str(_LETTERS)] == [_LETTERS.encode().decode("latin-1").translate(_BYTES)]

    def _learn(self, new: list[bytes]) -> None:
        """Encode chunks into the cache. Lower-case words of Latin letters go to
        the model itself; other words of letters alone are encoded many at a
        time: each is one pre-token and ends with a word-end id."""
        words = [w.decode() for w in new]
        if self.bare:
            split, rest = self.tok.model.tokenize, []
            for w, raw in zip(words, new):
                if raw.isalpha() and raw.islower():
                    self.cache[raw] = _pack([t.id for t in split(w)])
                elif w.isalpha() and max(w) < "\u0250" and w.lower() == w:
                    self.cache[raw] = _pack([t.id for t in split(raw.decode("latin-1").translate(_BYTES))])
                else:
                    rest.append(w)
            words = rest
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):
                odd += some
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, (4 * cut).tolist()):
                self.cache[w.encode()] = raw[a:b]
                a = b
        for w, e in zip(odd, self.tok.encode_batch_fast(odd, add_special_tokens=False)):
            self.cache[w.encode()] = _pack(e.ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if "<|" in t else _PUNCT.sub(rb" \1", t.encode().lower()).split() for t in texts]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        self._learn([w for w in set().union(*(ws for ws in split if ws)) if w not in cache])
        get = cache.__getitem__
        return [_pack(self.tok.encode(t, add_special_tokens=False).ids) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split)]


    def prune(self) -> None:
        """Forget long chunks, which seldom come again."""
        self.cache = {w: v for w, v in self.cache.items() if len(w) <= KEPT_BYTES}


def _pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_encoders: dict[int, ChunkEncoder] = {}


def encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder, and so one cache, per worker process and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(tokenizer_json)
    return _encoders[key]


class Packer:
    """At most ``open_windows`` open windows; yields the windows it closes."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most = size, open_windows
        self.fill: list[int] = []
        self.held: list[list] = []

    def best(self, n: int) -> int:
        """Index of the window that ``n`` tokens fit best, -1 for none."""
        at, gap = -1, self.size + 1
        for i, f in enumerate(self.fill):
            g = self.size - f - n
            if 0 <= g < gap:
                at, gap = i, g
                if not g:
                    break
        return at

    def fullest(self) -> int:
        return max(range(len(self.fill)), key=self.fill.__getitem__)

    def close(self, i: int) -> list:
        self.fill[i], self.fill[-1] = self.fill[-1], self.fill[i]
        self.held[i], self.held[-1] = self.held[-1], self.held[i]
        self.fill.pop()
        return self.held.pop()

    def put(self, piece, n: int) -> list | None:
        """Place a piece; the window that had to close or was filled, if any."""
        out = None
        at = self.best(n)
        if at < 0:
            if len(self.fill) >= self.most:
                out = self.close(self.fullest())
            self.fill.append(0)
            self.held.append([])
            at = len(self.fill) - 1
        self.held[at].append(piece)
        self.fill[at] += n
        if out is None and self.fill[at] == self.size:
            out = self.close(at)
        return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open_in long, ids binary"
_TYPES = [*[pa.int64()] * 8, pa.binary()]


def _rows(window: list, sequence: int, open_in: int | None, out: list) -> None:
    """Rows of a window's pieces (doc, start, ids, doc tokens); ids stay with open windows."""
    at = 0
    for doc, start, ids, total in window:
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, open_in, None if open_in is None else ids))
        at += len(ids) // 4


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [c.split()[0] for c in PIECE.split(", ")])


def place(packer: Packer, doc, start: int, ids: bytes, total: int, cut_gap: int) -> list[list]:
    """Put a run of ids into windows; the windows that closed by that."""
    closed, at, n = [], 0, len(ids) // 4
    while n - at >= packer.size:
        closed.append([(doc, start + at, ids[4 * at : 4 * (at + packer.size)], total)])
        at += packer.size
    while at < n:
        take = n - at
        if packer.best(take) < 0 and len(packer.fill) >= packer.most:
            gap = packer.size - packer.fill[packer.fullest()]
            if gap > cut_gap:
                take = gap
        if window := packer.put((doc, start + at, ids[4 * at : 4 * (at + take)], total), take):
            closed.append(window)
        at += take
    return closed


def cut_rest(pieces: list[tuple], size: int) -> list[list]:
    """The last pieces of all in full windows, and what is then left in windows
    whose lengths are powers of two, which need no padding."""
    left = sum(len(p[2]) for p in pieces) // 4
    lengths = [size] * (left // size) + [1 << b for b in range(size.bit_length(), -1, -1) if left % size >> b & 1]
    windows: list[list] = []
    pieces = pieces[::-1]
    for n in lengths:
        window: list = []
        while n:
            doc, start, ids, total = pieces.pop()
            take = min(n, len(ids) // 4)
            window.append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                pieces.append((doc, start + take, ids[4 * take :], total))
            n -= take
        windows.append(window)
    return windows


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 1, open_windows: int = 32, cut_gap: int = 16, fan_in: int = 64) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids followed by ``end_id``. Documents longer than
    ``size`` are cut into full windows and a rest. When no open window fits a
    piece, the fullest is emitted; if more than ``cut_gap`` tokens of it would
    stay empty, it first takes that much off the front of the piece. What the
    last group leaves open is cut into full windows and powers of two.
    ``sequence_id`` is unique over all windows; ``offset`` runs gapless from 0
    in each.

    Null and empty texts are the single token ``end_id``; a null doc_id stays
    null on its pieces; repeated rows are packed once each; an empty table
    gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = _pack([end_id])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, packer = encoder(shared.value), TaskContext.get().partitionId(), 0, Packer(size, open_windows)
        for b in batches:
            rows: list = []
            for doc, ids in zip(b.column(0).to_pylist(), enc([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                for window in place(packer, doc, 0, ids, len(ids) // 4, cut_gap):
                    _rows(window, (part << 28) | seq, None, rows)
                    seq += 1
            if rows:
                yield _batch(rows)
        enc.prune()
        rows = []
        for window in packer.held:
            _rows(window, (part << 28) | seq, part, rows)
            seq += 1
        if rows:
            yield _batch(rows)

    out = stage(docs.select("doc_id", "text").mapInArrow(trimmed(first), PIECE), "pack")
    closed, level = out.filter("open_in is null").drop("ids"), 0
    rest = out.filter("open_in is not null")
    groups = (rest.agg(F.max("open_in")).first()[0] or 0) + 1
    last = False
    while not last:
        level += 1
        base = level << 56
        groups = -(-groups // fan_in)
        last = groups == 1

        def again(batches: Iterator[pa.RecordBatch], base: int = base, last: bool = last) -> Iterator[pa.RecordBatch]:
            group, seq, packer, rows = None, 0, None, []

            def end_group():
                nonlocal seq
                held = packer.held if packer else []
                for window in cut_rest([p for w in held for p in w], size) if last else held:
                    _rows(window, base | (group << 28) | seq, None if last else group, rows)
                    seq += 1

            for b in batches:
                for doc, start, ids, total, g in zip(*(c.to_pylist() for c in b.columns)):
                    if g != group:
                        end_group()
                        group, seq, packer = g, 0, Packer(size, open_windows)
                    for window in place(packer, doc, start, ids, total, cut_gap):
                        _rows(window, base | (group << 28) | seq, None, rows)
                        seq += 1
                if rows:
                    yield _batch(rows)
                    rows = []
            end_group()
            if rows:
                yield _batch(rows)

        rest = rest.withColumn("g", F.floor(F.col("open_in") / fan_in).cast("long")).repartition("g").sortWithinPartitions("g", F.desc("length"), "doc_id", "start", "ids_crc32")
        out = stage(rest.select("doc_id", "start", "ids", "doc_tokens", "g").mapInArrow(trimmed(again), PIECE), "pack")
        closed = closed.unionAll(out.filter("open_in is null").drop("ids"))
        rest = out.filter("open_in is not null")
    return closed.drop("open_in")
