"""Near-duplicate documents by exact Jaccard similarity of word shingles.

Candidates share a shingle of their prefixes: in one global order of shingles,
rare ones first, two sets as similar as asked share a shingle among the first
``n - ceil(t n) + 1`` of each. First every set meets one smallest of its
groups; only where groups still hold several components, their members meet: those of
the smallest groups as pairs, each sent once however many groups it shares, all
others in size-banded tiles. Bit counts of hashed bitmaps, which grow with the
sets, bound the overlap from above, and only texts of pairs that pass are moved,
to be verified by intersecting sorted arrays; large groups carry their texts
into the tiles and are verified there, so that a tile gives a forest of links
and never all its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, components, release, stage, trimmed
from .text import chunks, mix64, sets, shingle_hashes, word_hashes

#: Counters of the shingle frequencies that order the prefixes. The table has
#: this size whatever the input; an inexact count only costs time.
COUNTERS = 1 << 20
_BLOCK = 1 << 12
#: Members of a tile's side.
TILE = 1024
#: Groups of more sets are verified inside their tiles.
LARGE = 128
#: Groups of at most so many sets give their pairs without a tile.
FEW = 4
#: Shingles of a tile's side.
WEIGHT = 4_000_000
#: Slots of 64 bits by which texts that no pair needs stay where they are.
SLOTS = 1 << 18
#: Groups are dealt in so many shares by hash; the thin round looks at one.
SHARES = 4

#: Bits of a set's bitmap, a power of two. Larger sets have a second, wide one
#: of a bit a shingle at least.
BITS = 1024

_SKETCH = "doc_id long, k long, n long, text binary, bits binary, wide binary, block long"


def bitmap(s: np.ndarray, bits: int = 0) -> np.ndarray:
    """Parity bitmap of a set. Two sets differ in as many elements at least as
    their bitmaps differ in bits; the fewer they are, the closer it comes."""
    bits = bits or BITS
    at = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view(np.uint64)


def _wide(s: np.ndarray) -> bytes | None:
    return bitmap(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > BITS else None


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, once the wider is folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def set_key(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(mix64(np.array([np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _least_overlap(na, nb, percent: int):
    """Smallest intersection with 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = [f.split()[0] for f in _SKETCH.split(", ")], set()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        counts, pack = np.zeros(COUNTERS, np.uint32), zstandard.ZstdCompressor(3)
        for b in batches:
            for lo, part in chunks(b.column(1)):
                rows: list = []
                h, at = shingle_hashes(*word_hashes(part), k)
                for i, (x, y) in enumerate(zip(at[:-1], at[1:])):
                    doc = b.column(0)[lo + i].as_py()
                    if x == y:
                        rows.append((doc, None, 0, None, None, None, None))
                        continue
                    s = np.unique(h[x:y])
                    key = set_key(s)
                    if key in seen:
                        rows.append((doc, key, len(s), None, None, None, None))
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                    rows.append((doc, key, len(s), pack.compress(part[i].as_py().encode()), bitmap(s).tobytes(), _wide(s), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if counts.any():
            blocks = counts.reshape(-1, _BLOCK)
            rows = [(None, None, None, blocks[i].tobytes(), None, None, i) for i in np.flatnonzero(blocks.any(axis=1)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _SKETCH)


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """The counters summed over all tasks, a fixed number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "text"])

    out = np.zeros((COUNTERS // _BLOCK, _BLOCK), np.uint64)
    for r in sketches.filter("block is not null").select("block", "text").repartition("block").mapInArrow(trimmed(add), "block long, text binary").collect():
        out[r[0]] = np.frombuffer(r[1], np.uint64)
    return out.ravel()


def _prefixes(nodes: DataFrame, order: np.ndarray, k: int, percent: int) -> DataFrame:
    """(sig, k, n): the shingles of each set's prefix."""
    shared = nodes.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counts = zstandard.ZstdDecompressor(), shared.value
        for b in batches:
            keys, texts = b.column(0).to_pylist(), pa.array([unpack.decompress(t).decode() for t in b.column(1).to_pylist()], pa.large_string())
            out = []
            for s in sets(texts, k):
                first = np.argsort(counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                out.append(s[first[: len(s) - -(-percent * len(s) // 100) + 1]])
            if out:
                n = [len(s) for s in out]
                size = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), n)), pa.array(np.repeat(size, n))], ["sig", "k", "n"])

    return nodes.select("k", "text", "n").mapInArrow(trimmed(run), "sig long, k long, n long")


def _texts(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, text): one text of each set of ``keys``, distinct. Nearly all other
    texts are left out by a bitmap of the keys before anything is shuffled."""
    slot, bit = F.pmod(F.xxhash64("k"), F.lit(SLOTS)), F.expr("shiftleft(1L, cast(pmod(xxhash64(k, 1L), 64L) as int))")
    asked = keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("mask"))
    some = nodes.select("k", "text", slot.alias("slot")).join(F.broadcast(asked), "slot").filter(F.col("mask").bitwiseAND(bit) != 0)
    # no semi join: Spark would do it before the other
    return some.select("k", "text").join(keys, "k").groupBy("k").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, kept: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are links: whose sizes and bitmaps allow the overlap
    and whose sorted sets have it."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb, wa, wb = (c.to_pylist() for c in batch.columns[2:])
            diff = [differing(v, w) if v and w else differing(x, y) for x, y, v, w in zip(xa, xb, wa, wb)]
            yield batch.select(["a", "b"]).filter(pa.array([(m + n - d) // 2 >= _least_overlap(m, n, percent) for m, n, d in zip(na, nb, diff)], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            raw = dict(zip(a + b, ta + tb))
            got = dict(zip(raw, sets(pa.array([unpack.decompress(t).decode() for t in raw.values()], pa.large_string()), k)))
            ok = [len(np.intersect1d(got[x], got[y], assume_unique=True)) >= _least_overlap(len(got[x]), len(got[y]), percent) for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: kept.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"), F.col("wide").alias(f"w{x}"))
    sizes = lambda x: kept.select(F.col("k").alias(x), F.col("n").alias(f"s{x}"))
    fit = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent).select("a", "b")
    fit = stage(fit.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb", "wa", "wb").mapInArrow(trimmed(may), "a long, b long"), "fit")
    texts = _texts(nodes, fit.select(F.col("a").alias("k")).union(fit.select("b")).distinct())
    text = lambda x: texts.select(F.col("k").alias(x), F.col("text").alias(f"t{x}"))
    return fit.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long")


def _pairs(mixed: DataFrame) -> DataFrame:
    """(a, b): the pairs of the groups of at most FEW sets, each once."""
    return mixed.filter(F.col("size") <= FEW).select("k", F.explode("near").alias("o")).select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()


def _tiles(mixed: DataFrame, kept: DataFrame, nodes: DataFrame, k: int, percent: int, thin: int | None = None) -> DataFrame:
    """(a, b): candidate pairs of different components, group by group of more
    than FEW sets; if ``thin`` is a number, one a member and tile, the first by a hash of the
    pair and the number. Members of groups of more than LARGE sets bring their
    texts: candidates are verified here, and only links that join what the tile
    has not joined yet come out, fewer than it has members.

    A tile holds a group; of a group of more than TILE sets or WEIGHT shingles,
    two neighbouring size bands, or two blocks of so many of them. Sizes a
    factor of 100 / percent apart never link, so further bands need not meet.
    """
    mixed = mixed.filter(F.col("size") > FEW)
    large = F.col("size") > min(LARGE, TILE)
    small = mixed.filter(~large).join(kept.select("k", "n", "bits"), "k")
    placed = small.select("sig", F.lit(-1).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("blk"), F.lit(-1).alias("band"), "k", "c", "n", "bits", F.lit(None).cast("binary").alias("text"))
    keys = mixed.filter(large).select("k").distinct()
    if not keys.isEmpty():
        rows = mixed.filter(large).join(kept.select("k", "n"), "k")
        rows = rows.join(rows.groupBy("sig").agg(F.sum("n").alias("weight")), "sig")
        whole = (F.col("size") <= TILE) & (F.col("weight") <= WEIGHT)
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")
        rows = rows.withColumn("band", F.when(whole, -1).otherwise(band)).withColumn("at", F.explode(F.when(whole, F.array("band")).otherwise(F.array(F.col("band"), F.col("band") - 1))))
        # members fall into their blocks by hash, so that no task ever sees a whole band
        blocks = rows.groupBy("sig", "at").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / WEIGHT)).cast("int").alias("blocks"))
        rows = rows.join(blocks, ["sig", "at"]).withColumn("blk", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # texts come last, for one shuffle
        rows = rows.select("sig", "at", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "band", "k", "c", "n").join(kept.select("k", "bits").join(_texts(nodes, keys), "k"), "k")
        placed = placed.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done, unpack = None, [], set(), zstandard.ZstdDecompressor()

        def compare() -> list:
            m = held
            same, at = key[2] == key[3], key[1]
            n = np.array([r[3] for r in m], np.int64)
            c = np.array([r[2] for r in m], np.int64)
            blk, low = np.array([r[0] for r in m]), np.array([r[1] for r in m]) == at
            keys = np.array([r[4] for r in m], np.int64).view(np.uint64)
            bits = np.frombuffer(b"".join(r[5] for r in m), np.uint64).reshape(len(m), -1)
            exact, got, out = m[0][6] is not None, {}, []
            for i in range(len(m)):
                # pairs inside the upper band meet in the tile above
                js = np.flatnonzero((c != c[i]) & (low | low[i]) & ((np.arange(len(m)) > i) if same else (blk != blk[i]) & (blk[i] == key[2])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                if not len(js):
                    continue
                diff = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
                js = js[(n[js] + n[i] - diff) // 2 >= _least_overlap(n[js], n[i], percent)]
                if thin is not None and len(js) > 1:
                    js = js[[np.argmin(mix64((keys[js] + keys[i]) ^ np.uint64(thin)))]]
                if exact and (new := [x for x in (i, *js.tolist()) if x not in got]):
                    got |= zip(new, sets(pa.array([unpack.decompress(m[x][6]).decode() for x in new], pa.large_string()), k))
                for j in js.tolist():
                    if exact and c[i] == c[j]:
                        continue
                    pair = (m[i][4], m[j][4]) if m[i][4] < m[j][4] else (m[j][4], m[i][4])
                    if pair not in done:
                        if len(done) < 200_000:
                            done.add(pair)
                        if exact:
                            if len(np.intersect1d(got[i], got[j], assume_unique=True)) < _least_overlap(n[i], n[j], percent):
                                continue
                            c[c == c[j]] = c[i]
                        out.append(pair)
            return out

        for b in batches:
            found: list = []
            for sig, at, i, j, blk, bd, x, c, n, bits, text in zip(*(col.to_pylist() for col in b.columns)):
                if (sig, at, i, j) != key:
                    if len(held) > 1:
                        found += compare()
                    key, held = (sig, at, i, j), []
                held.append((blk, bd, c, n, x, bits, text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
        if len(held) > 1 and (found := compare()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return placed.repartition("sig", "at", "i", "j").sortWithinPartitions("sig", "at", "i", "j").mapInArrow(trimmed(run), "a long, b long")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of distinct k-word shingles. ``component_id`` is the smallest doc_id
    reachable by links.

    Null, empty and white-space texts have an empty set and link with nothing;
    texts of any length are compared whole; a text of fewer than k words has its whole sequence as one shingle;
    repeated rows and equal sets share a component and come out once each; a
    null doc_id is never a component's smallest unless all are null; an empty
    table gives no rows; other columns are ignored.
    """
    with batches_of(docs.sparkSession):
        return _similar(docs, k, percent)


def _similar(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sketches = stage(_sketches(docs, k), "sketches")
    order = _frequencies(sketches)
    nodes = sketches.filter("text is not null and block is null")
    w = Window.partitionBy("sig")
    groups = _prefixes(nodes, order, k, percent).withColumn("low", F.min("k").over(w)).withColumn("high", F.max("k").over(w)).filter("low < high").select("sig", "k", "low")
    # tasks that each saw a copy of a set have each sent its prefix
    groups = stage(groups.dropDuplicates(["sig", "k"]), "groups")
    # each set that has a group, once and without its text, which few need
    kept = stage(nodes.select("k", "n", "bits", "wide").join(groups.select("k").distinct(), "k", "left_semi").groupBy("k").agg(*(F.first(x).alias(x) for x in ("n", "bits", "wide"))), "nodes")
    rows = stage(sketches.filter("block is null").select("doc_id", "k", F.col("n").alias("n_shingles")), "rows")
    # of the smallest sets of its groups, each set meets the one it shares most of them with
    star = groups.filter("k <> low").groupBy("k", "low").agg(F.count(F.lit(1)).alias("shared")).groupBy("k").agg(F.max_by("low", F.struct("shared", "low")).alias("a")).select("a", F.col("k").alias("b"))
    links = stage(_verified(star, kept, nodes, k, percent), "links")
    comp = components(links)
    label = stage(kept.select("k", "n").join(comp.withColumnRenamed("node", "k"), "k", "left").select("k", "n", F.coalesce("component", "k").alias("c")), "labels")
    # groups of near copies become components by a few links of each member,
    # over a share of the groups, before all that are left are compared
    for thin in (0, None):
        some = groups.select("sig", "k") if thin is None else groups.select("sig", "k").filter(F.pmod(F.xxhash64("sig"), F.lit(SHARES)) == thin)
        labelled = some.join(label, "k")
        mixed = labelled.withColumn("low", F.min("c").over(w)).withColumn("high", F.max("c").over(w)).withColumn("size", F.count(F.lit(1)).over(w)).filter("low < high")
        if thin is None:
            before = [F.lag(F.struct("k", "c", "n"), i).over(w.orderBy("k")) for i in range(1, FEW)]
            near = F.filter(F.array(*before), lambda o: (o.c != F.col("c")) & (F.least(o.n, "n") * 100 >= F.greatest(o.n, "n") * percent))
            mixed = mixed.withColumn("near", F.when(F.col("size") <= FEW, F.transform(near, lambda o: o.k))).filter("near is null or size(near) > 0")
            mixed = stage(mixed.select("sig", "k", "c", "size", "near"), "mixed")
            pairs = _tiles(mixed, kept, nodes, k, percent, thin).union(_pairs(mixed)).distinct()
        else:
            mixed = stage(mixed.filter(F.col("size") > FEW).select("sig", "k", "c", "size"), "mixed")
            pairs = _tiles(mixed, kept, nodes, k, percent, thin).distinct()
        links = stage(_verified(pairs, kept, nodes, k, percent), "links")
        release(mixed)
        if not links.isEmpty():
            of = lambda x: label.select(F.col("k").alias(x), F.col("c").alias(f"c{x}"))
            comp = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            label = stage(label.join(comp.withColumnRenamed("node", "c"), "c", "left").select("k", "n", F.coalesce("component", "c").alias("c")), "labels")
    release(sketches, groups, kept)
    rows = rows.join(label.select("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all columns, that are the smallest of their component.
    Rows of one doc_id are one document, of which one row stays; rows without
    doc_id stay."""
    found = stage(similar_documents(docs, k, percent), "similar")
    drop = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.filter("doc_id is null"))
