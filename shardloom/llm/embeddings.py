"""Near-duplicate embeddings by exact cosine, all rows against all rows.

Vectors are rotated to their principal axes. Blocks of vectors, cut along the
first axis, meet pairwise unless their ranges on it are too far apart. In a
tile the products of the leading axes come first, with the product of the
suffix norms as the most that the rest can add; only pairs that can still
reach the threshold go on to further axes and at last to the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import batches_of, components, release, stage, trimmed

#: Vectors of a block; a tile compares two blocks.
BLOCK = 8192
#: Rows of a block compared at once.
STRIP = 512


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times powers of two, which is exact, so that no square overflows or
    vanishes; and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    x, n = _scaled(x)
    return x / n[:, None]


def _axes(classes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes, as columns, and their shares, of all unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                z = _unit(_matrix(b.column(0), dims))
                m += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(m.ravel())], ["i", "v"])

    m = np.zeros(dims * dims)
    for i, v in classes.select("embedding").mapInArrow(trimmed(run), "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        m[i] = v
    share, axes = np.linalg.eigh(m.reshape(dims, dims))
    return axes[:, ::-1], np.maximum(share[::-1], 0) / max(share.sum(), 1e-300)


def _leading(share: np.ndarray) -> int:
    """Axes that come first: 0.3 of the squared length, by eights."""
    m = int(np.searchsorted(np.cumsum(share), 0.3)) + 1
    return min(len(share), -(-m // 8) * 8)


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b, n): b null: n more links of a; otherwise an edge of a tile's
    spanning forest. ``classes``: rep, copies, embedding."""
    axes, share = _axes(classes, dims)
    lead = _leading(share)
    kind = classes.schema["embedding"].dataType.elementType.simpleString()
    stored = np.float32 if kind == "float" else np.float64
    total = classes.count()
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((axes, lead))

    def along(cuts: np.ndarray):
        """Place on the first axis, and the number of cuts at or below it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value[0]
            for b in batches:
                pc = (_unit(_matrix(b.column(2), dims)) @ a[:, :1])[:, 0] if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pc), pa.array(np.searchsorted(cuts, pc, side="right"))], ["rep", "copies", "embedding", "pc", "blk"])

        return classes.select("rep", "copies", "embedding").mapInArrow(trimmed(run), f"rep long, copies long, embedding array<{kind}>, pc double, blk long")

    n_blocks = math.ceil(total / BLOCK)
    shares = [(i + 1) / n_blocks for i in range(n_blocks - 1)]
    placed = along(np.unique(along(np.zeros(0)).approxQuantile("pc", shares, 0.1 / n_blocks)) if shares else np.zeros(0))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, sub = None, [], 0, 0

        def block():
            reps, copies, x, pc = (np.concatenate([h[k] for h in held]) for k in range(4))
            return pa.RecordBatch.from_arrays([pa.array([int(at) << 20 | sub]), pa.array([pc.min()]), pa.array([pc.max()]), pa.array([reps.tobytes()], pa.binary()), pa.array([copies.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["id", "lo", "hi", "reps", "copies", "x"])

        for b in batches:
            blk = b.column(4).to_numpy()
            parts = (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dims).astype(stored), b.column(3).to_numpy())
            for v in np.unique(blk):
                own = blk == v
                if v != at or size + own.sum() > BLOCK:
                    if size:
                        yield block()
                    sub = sub + 1 if v == at else 0
                    at, held, size = v, [], 0
                held.append([p[own] for p in parts])
                size += int(own.sum())
        if size:
            yield block()

    blocks = stage(placed.repartition("blk").sortWithinPartitions("blk", "pc").mapInArrow(trimmed(assemble), "id long, lo double, hi double, reps binary, copies binary, x binary"), "blocks")
    index = sorted(blocks.select("lo", "hi", "id").collect())  # one short row per block
    reach = math.sqrt(2 - 2 * threshold) + 1e-9  # of two unit vectors that link, along any axis
    ends = np.searchsorted(np.array([r[0] for r in index]), np.array([r[1] for r in index]) + reach, side="right")
    # two numbers a block: block at place i meets those from i to before ends[i]
    tiles = spark.sparkContext.broadcast((np.array([r[2] for r in index], np.int64), ends))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends = tiles.value
        for b in batches:
            for r in range(b.num_rows):
                at = int(np.flatnonzero(ids == b.column(0)[r].as_py())[0])
                for i, j in [*((int(h), at) for h in np.flatnonzero(ends[:at] > at)), *((at, j) for j in range(at, int(ends[at])))]:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), *(b.column(c).slice(r, 1) for c in (0, 3, 4, 5))], ["i", "j", "id", "reps", "copies", "x"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, lead = shared.value
        key, held = None, []

        def tile():
            sides = []
            for reps, copies, x in held:
                x, length = _scaled(np.frombuffer(x, stored).astype(np.float64).reshape(-1, dims))
                z = (x / length[:, None]) @ axes
                tail = np.sqrt(np.maximum((z[:, lead:] ** 2).sum(axis=1, keepdims=True), 0))
                sides.append((np.frombuffer(reps, np.int64), np.frombuffer(copies, np.int64), x, length, z, np.hstack([z[:, :lead], tail]).astype(np.float32)))
            (ra, ca, xa, na, za, la), (rb, cb, xb, nb, zb, lb) = sides[0], sides[-1]
            same, half = len(sides) == 1, (lead + dims) // 2
            links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            counts = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
            for s in range(0, len(ra), STRIP):
                i, j = np.nonzero(la[s : s + STRIP] @ lb[s * same :].T >= threshold - 1e-4)
                i, j = i + s, j + s * same
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                for t in range(0, len(i), 1 << 17):
                    p, q = i[t : t + (1 << 17)], j[t : t + (1 << 17)]
                    so_far = np.einsum("ij,ij->i", za[p, :half], zb[q, :half])
                    rest = np.sqrt((za[p, half:] ** 2).sum(axis=1) * (zb[q, half:] ** 2).sum(axis=1))
                    on = so_far + rest >= threshold - 1e-9
                    p, q = p[on], q[on]
                    on = (np.einsum("ij,ij->i", xa[p], xb[q]) / (na[p] * nb[q]) >= threshold) & (ra[p] != rb[q])
                    p, q = p[on], q[on]
                    np.add.at(counts[0], p, cb[q])
                    np.add.at(counts[0] if same else counts[1], q, ca[p])
                    links[0].append(p)
                    links[1].append(q if same else q + len(ra))
                if sum(map(len, links[0])) > 1 << 20:
                    label = _labels(np.concatenate(links[0]), np.concatenate(links[1]), len(ra) + len(rb))
                    far = np.flatnonzero(label != np.arange(len(label)))
                    links = [far], [label[far]]
            reps = ra if same else np.concatenate([ra, rb])
            label = _labels(np.concatenate(links[0]), np.concatenate(links[1]), len(reps))
            far = np.flatnonzero(label != np.arange(len(reps)))
            n = counts[0] if same else np.concatenate(counts)
            has = np.flatnonzero(n)
            if len(has):
                none = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([reps[has], reps[far]])), pa.concat_arrays([none, pa.array(reps[label[far]])]), pa.array(np.concatenate([n[has], np.zeros(len(far), np.int64)]))], ["a", "b", "n"])

        for b in batches:
            for i, j, *rest in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5))):
                if (i, j) != key:
                    if held:
                        yield from tile()
                    key, held = (i, j), []
                held.append(rest)
        if held:
            yield from tile()

    dealt = blocks.mapInArrow(trimmed(deal), "i long, j long, id long, reps binary, copies binary, x binary")
    with batches_of(spark, 4):  # blocks are large rows
        out = stage(dealt.repartition("i", "j").sortWithinPartitions("i", "j", "id").mapInArrow(trimmed(compare), "a long, b long, n long"), "links")
    release(blocks)
    return out


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is at least
    ``threshold``. ``n_links`` counts the other vectors linked directly, exact
    copies included; ``component_id`` is the smallest vec_id reachable by links
    and ``kept`` marks it.

    Null, empty and zero vectors and vectors that hold null or non-finite
    components link with nothing, nor do vectors of different lengths or rows
    without vec_id (their component is null). Components of other types than
    float are compared as doubles, however large or small. Rows of one vec_id
    are one node. Repeated vectors are compared once; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0))
    # equal vectors by 128 bits of hash: the rows meet their class on these alone
    mark = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    with batches_of(spark, 2048):
        classes = stage(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
        links = None
        for (dims,) in sorted(classes.select(F.size("embedding")).distinct().collect()):
            own = _links(classes.filter(F.size("embedding") == dims), dims, threshold)
            links = own if links is None else links.unionAll(own)
    own = F.coalesce("component", "rep", "vec_id")
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    comp = components(links.filter("b is not null").select("a", "b"))
    n = links.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    nodes = classes.select("rep", "copies", *mark).join(n, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    # one join of all rows, so that a class of very many is split at run time
    out = rows.select(F.when(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull(), F.struct(*mark)).alias("m"), "vec_id").select("vec_id", "m.*").join(nodes, ["h1", "h2"], "left")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
