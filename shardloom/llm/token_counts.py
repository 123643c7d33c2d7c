"""Token counts that follow edits.

Trees are a table: each document's text with the code points and tokens of its
leaves. Edits are applied to the stored trees, which are never encoded again as
a whole. A document is a segment tree over its pre-tokens: every node holds the code
points and the tokens below it. An edit finds the leaves that it touches by
their code points, takes one more leaf on either side as context, encodes that
region alone again and updates the sums on the way to the root.

For tokenizers whose pre-tokens never span white space and that drop it, such
as ``word_bpe_49k.json``: a count is then the sum over white-space-separated
pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed
from .packing import CACHE_ENTRIES, KEPT_BYTES, ChunkEncoder

_SPLIT = re.compile(r"[^ \t\n\r\x0b\x0c]*[ \t\n\r\x0b\x0c]*")
#: Pre-tokens that an edited leaf may hold before its tree is laid out anew.
LEAF = 64


_WHITE = " \t\n\r\x0b\x0c"


class Counter:
    """Tokens of pre-tokens, with the white space behind them, encoded once per worker."""

    def __init__(self, tokenizer_json: str):
        self.encoder, self.known, self.sizes = ChunkEncoder(tokenizer_json), {}, {}

    def learn(self, some: set[str]) -> None:
        known, sizes = self.known, self.sizes
        if len(known) > CACHE_ENTRIES:
            known.clear()
        if len(sizes) > CACHE_ENTRIES:
            sizes.clear()
        new, last, heads, tails = [p for p in some if p not in known], "abcdefghijklmnopqrstuvwxyz", [], []
        for p in new:
            w, tail = p.strip(_WHITE), ""
            if w.isascii() and "<|" not in w:
                w = w.lower()
            if w[-1:] in (".", ",") and w[-2:-1] in last and len(w) > 1 and "<|" not in w:
                w, tail = w[:-1], w[-1]
            heads.append(w)
            tails.append(tail)
        need = {w for w in {*heads, *tails} if w not in sizes}
        self.encoder.cache.clear()
        self.encoder._learn(sorted(w.encode() for w in need))
        sizes.update((w.decode(), len(ids) // 4) for w, ids in self.encoder.cache.items())
        self.encoder.cache.clear()
        known.update(zip(new, map(int.__add__, map(sizes.__getitem__, heads), map(sizes.__getitem__, tails))))

    def prune(self) -> None:
        self.known = {w: n for w, n in self.known.items() if len(w) <= KEPT_BYTES}
        self.sizes = {w: n for w, n in self.sizes.items() if len(w) <= KEPT_BYTES}

    def count(self, pieces: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        except KeyError:
            self.learn(set(pieces))
            return np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))


def pieces(text: str) -> list[str]:
    """Pre-tokens, each with the white space that follows it."""
    return [p for p in _SPLIT.findall(text) if p]


class Leaves:
    """The leaves of a text, cut out of it when they are looked at."""

    def __init__(self, text: str, chars: np.ndarray):
        self.body, self.ends, self.new = text, np.concatenate([[0], np.cumsum(chars, dtype=np.int64)]), {}

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> str:
        return self.new[i] if i in self.new else self.body[self.ends[i] : self.ends[i + 1]]

    def __setitem__(self, i: int, leaf: str) -> None:
        self.new[i] = leaf

    def __iter__(self) -> Iterator[str]:
        return (self[i] for i in range(len(self)))


class CountTree:
    """Segment tree of (code points, tokens) over the leaves of a text, given as
    lists of them or, stored, as the text with the numbers of each."""

    def __init__(self, leaves: list[str] | str, counter: Counter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.counter, self.encoded = counter, 0
        if chars is not None and len(chars):
            self.leaves = Leaves(leaves, chars)
            self._build(chars, tokens)
        else:
            self.leaves = list(leaves) or [""]
            self._build([len(p) for p in self.leaves], counter.count(self.leaves))

    def _build(self, chars: list[int] | np.ndarray, tokens: list[int] | np.ndarray) -> None:
        n = 1 << max(0, len(chars) - 1).bit_length()
        level = np.zeros((n, 2), np.int64)
        level[: len(chars), 0], level[: len(chars), 1] = chars, tokens
        self.levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            self.levels.append(level)

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds code point ``at`` (the last for the end), and its start."""
        i, start = 0, 0
        for level in reversed(self.levels[:-1]):
            i *= 2
            if at >= start + level[i, 0] and level[i + 1, 0]:
                start += int(level[i, 0])
                i += 1
        return i, start

    def region(self, start: int, end: int, new: str) -> tuple[int, int, list[str]]:
        """What an edit asks for, ``new`` in place of the code points from start
        to end: first leaf and the one behind the last that it touches, with one
        of context on either side, and the pre-tokens to stand in their place."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        first, at = self.find(start)
        last, _ = self.find(end - 1) if end > start else (first, at)
        while first > 0:  # one leaf of context before
            first -= 1
            at -= int(self.levels[0][first, 0])
            if self.levels[0][first, 0]:
                break
        stop = last + 1
        while stop < len(self.leaves):  # and one after
            stop += 1
            if self.levels[0][stop - 1, 0]:
                break
        old = "".join(self.leaves[i] for i in range(first, stop))
        return first, stop, pieces(old[: start - at] + new + old[end - at :])

    def put(self, first: int, stop: int, region: list[str], counts: np.ndarray) -> None:
        """The counted region in place of the leaves; sums follow up to the root."""
        self.encoded += len(region)
        if len(region) > LEAF:  # lay the tree out anew
            chars = [np.fromiter(map(len, region), np.int64, len(region)), self.levels[0][: len(self.leaves)]]
            before, behind = chars[1][:first], chars[1][stop:]
            leaves = [*(self.leaves[i] for i in range(first)), *region, *(self.leaves[i] for i in range(stop, len(self.leaves)))]
            level = np.concatenate([before, np.stack([chars[0], counts], axis=1), behind])
            on = np.flatnonzero(level[:, 0])
            self.leaves = [leaves[i] for i in on] or [""]
            self._build(level[on, 0] if len(on) else [0], level[on, 1] if len(on) else [0])
            return
        self.leaves[first] = "".join(region)
        for i in range(first + 1, stop):
            self.leaves[i] = ""
        self.levels[0][first:stop] = 0
        self.levels[0][first] = len(self.leaves[first]), counts.sum()
        lo, hi = first, stop
        for below, level in zip(self.levels, self.levels[1:]):
            lo, hi = lo // 2, (hi + 1) // 2
            level[lo:hi] = below[2 * lo : 2 * hi : 2] + below[2 * lo + 1 : 2 * hi : 2]

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the code points from start to end."""
        first, stop, region = self.region(start, end, new)
        self.put(first, stop, region, self.counter.count(region))

    def text(self) -> str:
        return "".join(self.leaves)


_counters: dict[int, Counter] = {}


def counter(tokenizer_json: str) -> Counter:
    """One counter per worker process and tokenizer."""
    return _counters.get(hash(tokenizer_json)) or _counters.setdefault(hash(tokenizer_json), Counter(tokenizer_json))


_TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
_COUNTS = "n_tokens long, n_edited long, n_edits long, n_leaves long, n_encoded long"


def _lists(lengths: list[int], flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def count_trees(documents: DataFrame, tokenizer_json: str) -> DataFrame:
    """The trees of the documents: doc_id, text, and the code points (``chars``)
    and ``tokens`` of each leaf. Written as a table they are what later edits
    start from: sums are formed from the leaves without encoding anything.

    Null and empty texts have no leaves; texts of any length have one tree;
    repeated rows come out once each; an empty table gives no rows; other
    columns are ignored.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(shared.value)
        for b in batches:
            text = b.column(1).fill_null("")
            cut = [pieces(t) for t in text.to_pylist()]
            flat, n = list(chain.from_iterable(cut)), [len(ps) for ps in cut]
            yield pa.RecordBatch.from_arrays([b.column(0), text, _lists(n, np.fromiter(map(len, flat), np.int32, len(flat))), _lists(n, known.count(flat))], ["doc_id", "text", "chars", "tokens"])
        known.prune()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), _TREE)


def _edited(trees: DataFrame, edits: str, tokenizer_json: str, whole: bool) -> DataFrame:
    small_batches(trees.sparkSession)
    shared = trees.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [c.split()[0] for c in f"{_TREE}, {_COUNTS}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(shared.value)
        for b in batches:
            texts, stored = b.column(1).to_pylist(), [(c.values.to_numpy(), t.values.to_numpy()) for c, t in zip(b.column(2), b.column(3))]
            edits = [[(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in todo or [] if e is not None] for todo in b.column(4).to_pylist()]
            # without edits the stored sums stand
            trees = [CountTree(text, known, *own) if todo else None for text, own, todo in zip(texts, stored, edits)]
            before = [tree.tokens if tree else int(own[1].sum()) for tree, own in zip(trees, stored)]
            for turn in range(max(map(len, edits), default=0)):  # the edits of one turn are encoded together
                now = [(tree, *tree.region(*todo[turn])) for tree, todo in zip(trees, edits) if turn < len(todo)]
                n = known.count(list(chain.from_iterable(r[3] for r in now)))
                for (tree, first, stop, region), to in zip(now, np.cumsum([len(r[3]) for r in now]).tolist()):
                    tree.put(first, stop, region, n[to - len(region) : to])
            counts = [(m, tree.tokens if tree else m, len(todo), len(own[1]), tree.encoded if tree else 0) for m, tree, todo, own in zip(before, trees, edits, stored)]
            after = [tree.levels[0][tree.levels[0][:, 0] > 0].T if tree else own for tree, own in zip(trees, stored)] if whole else []
            texts = [tree.text() if tree else text for tree, text in zip(trees, texts)] if whole else []
            own = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 5
            size, none = [len(c) for c, _ in after], np.zeros(0, np.int32)
            first = [b.column(0), pa.array(texts, pa.string()), *(_lists(size, np.concatenate([none, *(a[k] for a in after)])) for k in (0, 1))] if whole else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*first, *own], names if whole else ["doc_id", *names[4:]])
        known.prune()

    rows = trees.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "chars", "tokens", F.col(edits).alias("edits"))
    return rows.mapInArrow(trimmed(run), f"{_TREE}, {_COUNTS}" if whole else f"doc_id long, {_COUNTS}")


def apply_edits(trees: DataFrame, log: DataFrame, tokenizer_json: str) -> DataFrame:
    """The stored trees (of :func:`count_trees` or of this function) after the
    edits of ``log`` (doc_id, seq, start, end, text), in order of seq; with
    n_tokens before and n_edited after them, n_edits, n_leaves before and
    n_encoded, the pre-tokens encoded for them.

    Places are code points of the text as the edits before left it, those
    beyond the text are its end. Null edits, and an edit's null text, are
    nothing and empty; edits of other documents are ignored; trees without
    edits stay as they are; repeated trees are edited alike.
    """
    own = trees.select("doc_id", "text", "chars", "tokens")
    return _edited(with_edits(own, log, "edits"), "edits", tokenizer_json, True)


def edited_counts(trees: DataFrame, tokenizer_json: str, edits: str = "edits") -> DataFrame:
    """Per tree: doc_id, n_tokens, n_edited, n_edits, n_leaves, n_encoded, as by
    :func:`apply_edits`, for an array of (start, end, text) in column ``edits``."""
    return _edited(trees, edits, tokenizer_json, False)


def with_edits(documents: DataFrame, log: DataFrame, into: str = "edits") -> DataFrame:
    """The rows with a column ``into``, in place of one of that name: the edits
    of ``log`` (doc_id, seq, start, end, text) in order of seq."""
    plain = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))
    own = log.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))), plain).alias(into))
    return documents.drop(into).join(own, "doc_id", "left")


def standard_edits(text: Column, doc_id: Column) -> Column:
    """Four edits that follow from id and length: words replaced at a quarter,
    inserted at the middle, the start cut, the end grown."""
    n, h = F.length(F.coalesce(text, F.lit(""))), F.pmod(F.xxhash64(doc_id), F.lit(1000)).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), t.alias("text"))
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    return F.array(edit(quarter, quarter + h % 60, F.concat(F.lit("edit "), h.cast("string"))), edit(half, half, F.lit("ly, and more words")), edit(F.lit(0), h % 7, F.lit("")), edit(n + 100, n + 100, F.lit(" The end.")))
