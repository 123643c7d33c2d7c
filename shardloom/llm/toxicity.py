"""Toxicity by a counterfactually regularised linear classifier.

Features are words and word beginnings. Identity terms in the labelled
sentences are swapped for others of their group, the swapped sentences get
features of their own, and the fit pays for every change of the score; so group
mentions alone carry little weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, stage, trim, trimmed
from .text import _pow, chunks, mix64, word_bounds

#: Labelled rows of each class that the fit sees at most, chosen by hash.
SAMPLE = 10_000
#: Features that the fit keeps at most.
FEATURES = 3_000
#: Bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)

#: Rows of the sample that must show a feature.
LEAST_ROWS = 4

# Identity terms by language and group; terms of one list stand in
# for each other.
IDENTITY_TERMS = {
    "en religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "en gender": ["women", "men", "trans", "nonbinary"],
    "en orientation": ["gay", "lesbian", "bisexual", "straight"],
    "en origin": ["african", "asian", "european", "american", "mexican", "arab"],
    "en colour": ["black", "white", "brown"],
    "en age": ["old", "young", "elderly", "teenage"],
    "en ability": ["blind", "deaf", "disabled", "autistic"],
    "de religion": ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"],
    "de people": ["frauen", "männer", "schwule", "lesben", "behinderte", "alte", "junge"],
    "de origin": ["afrikaner", "asiaten", "europäer", "amerikaner", "araber", "türken"],
    "es religion": ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
    "es people": ["mujeres", "hombres", "gays", "lesbianas", "discapacitados", "viejos", "jóvenes"],
    "es origin": ["africanos", "asiáticos", "europeos", "americanos", "árabes", "gitanos"],
    "fr religion": ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
    "fr people": ["femmes", "hommes", "homosexuels", "lesbiennes", "handicapés", "vieux", "jeunes"],
    "fr origin": ["africains", "asiatiques", "européens", "américains", "arabes", "roms"],
}

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()[]{}<>*%&$#-_|/")] = True


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each feature, feature hash); may repeat within a row."""
    for lo, part in chunks(texts):
        x, s, e, rows = word_bounds(part)
        row = np.repeat(np.arange(len(part)), np.diff(rows))
        for _ in range(3):
            e = e - ((e > s) & _PUNCT[x[np.maximum(e - 1, 0)]] if len(x) else 0)
        for _ in range(2):
            s = s + ((e > s) & _PUNCT[x[np.minimum(s, len(x) - 1)]] if len(x) else 0)
        ok = e > s
        s, e, row = s[ok], e[ok], row[ok]
        p, inv = _pow(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p[: len(x)], out=sums[1:])
        out_rows, out = [row], [mix64((sums[e] - sums[s]) * inv[s])]
        for k in BEGINNINGS:
            long = e - s > k
            a = s[long]
            out_rows.append(row[long])
            out.append(mix64((sums[a + k] - sums[a]) * inv[a] ^ np.uint64(k << 56)))
        yield lo, np.concatenate(out_rows), np.concatenate(out)


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def _term_features(term: str) -> np.ndarray:
    return np.unique(next(features(pa.array([term])))[2])


def _statistics(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): how many rows of each class have a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for lo, row, feature in features(b.column(0)):
                row, feature = _distinct(row, feature)
                uniq, at = np.unique(feature, return_inverse=True)
                toxic = np.bincount(at, weights=label[lo + row], minlength=len(uniq)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(uniq)) - toxic)], ["feature", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(trimmed(run), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def minimise(f, x: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent on ``f``, which gives value and gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, coef = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            coef.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(coef)):
            q += s * (a - y @ q / (s @ y))
        rate = 1.0
        while rate > 1e-10:
            new = x - rate * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        if (new - x) @ (new_grad - grad) > 1e-12:
            steps = [*steps[-memory + 1 :], (new - x, new_grad - grad)]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def swapped(text: str, terms: dict[str, list[str]]) -> Iterator[str]:
    """The text once for every identity term in it and other term of its group,
    with the one in place of the other wherever it stands as a word."""
    low = text.lower()
    for group in terms.values():
        for p in group:
            if p in low and (whole := re.compile(rf"(?<!\w){re.escape(p)}(?!\w)", re.IGNORECASE)).search(text):
                yield from (whole.sub(q, text) for q in group if q != p)


def _places(texts: pa.Array, kept: np.ndarray) -> list[list[int]]:
    """Per text the sorted places in ``kept`` of its features."""
    got: list[set[int]] = [set() for _ in range(len(texts))]
    for lo, row, feature in features(texts):
        at = np.minimum(np.searchsorted(kept, feature), len(kept) - 1)
        hit = kept[at] == feature
        for r, i in zip((row[hit] + lo).tolist(), at[hit].tolist()):
            got[r].add(i)
    return [sorted(g) for g in got]


def _change(before: list[int], after: list[int]) -> list[int]:
    """What a swap does to the features: 1 + place, negative for those lost."""
    a, b = set(before), set(after)
    return [*sorted(-1 - i for i in a - b), *sorted(1 + i for i in b - a)]


def fit(labelled: DataFrame, ridge: float = 2e-4, swap_penalty: float = 1.0, terms: dict[str, list[str]] | None = None, most_features: int = FEATURES, least_rows: int = LEAST_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, sorted; weights; bias) from rows (text, toxic, weight),
    which :func:`labelled_sample` bounds.

    The features are those of ``least_rows`` rows and more that say most about
    the label, ``most_features`` at most, and those of the identity ``terms``.
    The loss is the weighted logistic loss, ``ridge`` / 2 times the squared
    weights, and ``swap_penalty`` / 2 times the mean squared change of the logit
    over all swaps: the labelled sentences with an identity term swapped for
    another of its group, and each term alone for each other.
    """
    small_batches(labelled.sparkSession)
    terms = IDENTITY_TERMS if terms is None else terms
    n = {int(r[0]): (r[1], r[2]) for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)), F.max("weight")).collect()}
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0), -3.0
    t, c = (max(n.get(k, (0, 0))[0], 1) for k in (1, 0))
    a, b = (F.col("toxic") + 0.5) / (t + 1.0), (F.col("clean") + 0.5) / (c + 1.0)
    both = (F.col("toxic") + F.col("clean") + 0.5) / (t + c + 1.0)
    gain = F.col("toxic") * F.log(a / both) + F.col("clean") * F.log(b / both)
    best = _statistics(labelled).filter(F.col("toxic") + F.col("clean") >= least_rows).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(most_features).collect()
    each = sorted({x for group in terms.values() for x in group})
    kept = np.unique(np.concatenate([np.zeros(1, np.uint64), np.array([r[0] for r in best], np.int64).view(np.uint64), *(_term_features(x) for x in each)]))
    shared = labelled.sparkSession.sparkContext.broadcast(kept)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _places(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int64())), batch.column(1).cast(pa.int64()), batch.column(2)], ["at", "toxic", "weight"])

    def swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                others = list(swapped(text or "", terms))
                if others:
                    own, *new = (_places(pa.array([x], pa.large_string()), shared.value)[0] for x in [text, *others])
                    yield pa.RecordBatch.from_arrays([pa.array([_change(own, x) for x in new], pa.list_(pa.int64()))], ["change"])

    # bounded: as many rows as the sample, of at most most_features places
    data = labelled.select("text", "toxic", "weight").mapInArrow(trimmed(rows), "at array<long>, toxic long, weight double").collect()
    col = np.concatenate([np.array(r[0], np.int64) for r in data])
    row = np.repeat(np.arange(len(data)), [len(r[0]) for r in data])
    y, w = np.array([r[1] for r in data], float), np.array([r[2] for r in data], float)
    w /= w.sum()
    del data
    # sentences with the same two terms change alike, so they are counted first
    often = {tuple(r[0]): float(r[1]) for r in labelled.select("text").mapInArrow(trimmed(swaps), "change array<long>").groupBy("change").count().collect()}
    alone = dict(zip(each, _places(pa.array(each, pa.large_string()), kept)))
    for group in terms.values():
        for p in group:
            for q in group:
                if p != q and (change := tuple(_change(alone[p], alone[q]))):
                    often[change] = often.get(change, 0.0) + 1.0
    often.pop((), None)
    place = np.array([i for change in often for i in change], np.int64)
    sign, place = np.sign(place), np.abs(place) - 1
    swap = np.repeat(np.arange(len(often)), [len(change) for change in often])
    share = np.array(list(often.values())) / max(sum(often.values()), 1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, bias = x[:-1], x[-1]
        z = bias + np.bincount(row, weights=v[col], minlength=len(y))
        gap = np.bincount(swap, weights=sign * v[place], minlength=len(share))
        value = (w * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (v @ v) + swap_penalty / 2 * (share @ gap**2)
        d = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.bincount(col, weights=d[row], minlength=len(v)) + ridge * v
        g += swap_penalty * np.bincount(place, weights=sign * (share * gap)[swap], minlength=len(v))
        return value, np.append(g, d.sum())

    x = minimise(loss, np.zeros(len(kept) + 1))
    trim()
    return kept, x[:-1], float(x[-1])


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4, held: int = 2) -> DataFrame:
    """(text, toxic, weight): at most ``sample`` texts a class, chosen by hash,
    none of the held-out fold; ``weight`` restores the classes' shares of the
    labelled documents. Repeated rows count once, and the bound is on texts,
    however many a doc_id has."""
    from functools import reduce

    def first(rows: DataFrame, order: Column) -> DataFrame:
        return reduce(DataFrame.unionAll, [rows.filter(F.col("toxic") == t).orderBy(order, *rows.columns).limit(sample) for t in (0, 1)])

    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = stage(own, "labels")
    size = dict(own.groupBy("toxic").count().collect())
    some = stage(first(own, F.xxhash64("doc_id")), "labelled")
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    # at most 2 * sample short rows are broadcast, twice
    texts = documents.select("doc_id", text_hash).join(F.broadcast(some), "doc_id").distinct()
    picked = stage(first(texts, F.xxhash64("doc_id", "h")), "picked")
    weight = F.when(F.col("toxic") == 1, max(size.get(1, 0) / sample, 1.0)).otherwise(max(size.get(0, 0) / sample, 1.0))
    found = documents.select("doc_id", text_hash, "text").join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text"))
    out = stage(found.select("text", "toxic", weight.alias("weight")), "sample")
    release(own, some, picked)
    return out


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(_row, _score): every row as a struct and the score of its whole text."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("text").alias("_text"), F.struct(*documents.columns).alias("_row"))
    schema = rows.select("_row", F.lit(0.0).alias("_score")).schema
    maybe_bits = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weight, bias = shared.value
        maybe = np.zeros(maybe_bits, bool)
        maybe[(kept & np.uint64(maybe_bits - 1)).astype(np.int64)] = True
        for b in batches:
            z = np.full(b.num_rows, bias)
            for lo, row, feature in features(b.column(0)):
                some = maybe[(feature & np.uint64(maybe_bits - 1)).astype(np.int64)]
                row, feature = row[some], feature[some]
                at = np.minimum(np.searchsorted(kept, feature), max(len(kept) - 1, 0))
                hit = kept[at] == feature if len(kept) else np.zeros(0, bool)
                pair = np.unique(row[hit] * (len(kept) + 1) + at[hit])
                if len(pair):
                    z += np.bincount(lo + pair // (len(kept) + 1), weights=weight[pair % (len(kept) + 1)], minlength=len(z))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["_row", "_score"])

    return rows.mapInArrow(trimmed(run), schema)


def _model(documents: DataFrame, labels: DataFrame, sample: int, folds: int, held: int, terms: dict[str, list[str]] | None) -> tuple[np.ndarray, np.ndarray, float]:
    labelled = labelled_sample(documents, labels, sample, folds, held)
    model = fit(labelled, terms=terms)
    release(labelled)
    return model


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, folds: int = 4, held: int = 2, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted.

    Labels are learned from documents whose crc32(doc_id) modulo ``folds`` is
    not ``held``, at most ``sample`` texts a class. Only the text enters a score.
    ``terms``: groups of identity terms for each other, IDENTITY_TERMS if none.

    Null and empty texts score as texts without words; texts of any length are
    scored whole; a null doc_id is never
    learned from and counts as an empty one for the fold; null labels are
    ignored, of several labels of a document the toxic one counts; repeated
    rows score alike and are learned from once; without labels every text
    scores alike, below the threshold; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    out = score(documents.select("doc_id", "text"), _model(documents, labels, sample, folds, held, terms)).select("_row.doc_id", "_score")
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, folds: int = 4, held: int = 2, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """The documents, all columns, that score below ``threshold``, learned as by
    :func:`toxicity`. Null and empty texts stay unless texts without words score
    as toxic; repeated rows stay or go together; an empty table gives no rows."""
    return score(documents, _model(documents, labels, sample, folds, held, terms)).filter(F.col("_score") < threshold).select("_row.*")
