"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``window`` consecutive words has one fingerprint: the smallest of
its k-gram hashes. Texts and items that share such a run therefore share a
fingerprint, whatever surrounds it. Fingerprints of the documents are joined
with those of the benchmark, and each hit is extended to the runs around it,
which are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stage

#: Words of a k-gram.
K = 5
#: Words of a block; long texts are worked on block by block.
BLOCK = 32768
#: Benchmarks of at most so many windows are broadcast (some 100 MB at most);
#: larger ones are joined by shuffling.
BROADCAST_WINDOWS = 500_000

#: So many first words of short items at most are looked for while the words of
#: a text are in hand; with more, every word meets them in a join.
FIRST_WORDS = 10_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row. As a plain column
    the optimiser would move it into the lambdas, to be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(ws: Column, k: int) -> Column:
    """Per k-gram: 46 bits of its hash above 17 bits of its place, from 0."""
    at = lambda h: lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(k))), 18), 17).bitwiseOR(i.cast("long"))
    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), at(h)))


def _minima(g: Column, around: int) -> Column:
    """Distinct smallest of every ``around`` neighbours, from those of every two."""
    if around < 2:
        return g
    pairs = F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.least(F.get(g, i), F.get(g, i + 1)))
    steps = sorted({*range(0, around - 1, 2), around - 2})
    of = lambda m: lambda i: F.least(*(F.get(m, i + o) for o in steps)) if len(steps) > 1 else F.get(m, i)
    return let(pairs, lambda m: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(m) - around + 1), of(m))))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, 17)


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct (item_id, n, run): runs of ``window`` words, or a short item whole."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))).alias("w")).select("item_id", F.size("w").alias("n"), F.concat_ws(" ", "w").alias("run")).distinct()


def find_runs(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct (doc_id, text_hash, start, n, run) where a benchmark run occurs
    in a document, word places from 0; and the (item_id, n, run) table."""
    k, around = min(K, window), window - min(K, window) + 1
    by_item = stage(benchmark_windows(benchmark, window), "windows")
    runs = by_item.select("n", "run").distinct()
    counts = dict(runs.groupBy("n").count().collect())  # at most `window` lengths
    hint = F.broadcast if sum(counts.values()) <= BROADCAST_WINDOWS else (lambda df: df)
    ws = words(F.col("text"))
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    in_blocks = lambda w: F.transform(starts(w), lambda s: F.struct(s.alias("base"), F.slice(w, s + 1, BLOCK + window - 1).alias("w")))
    blocks = (
        documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.explode(let(ws, in_blocks)).alias("b"))
        .select("doc_id", "text_hash", "b.base", "b.w")
    )
    found = None
    if counts.get(window):
        prints = runs.filter(F.col("n") == window).select(_hash(F.array_min(_grams(F.split("run", " "), k))).alias("h")).distinct()
        kept = let(_grams(F.col("w"), k), lambda g: _minima(g, around))
        place = lambda p: p.bitwiseAND(131071).cast("int")
        lo = lambda p: F.greatest(place(p) - (around - 1), F.lit(0))
        #: A fingerprint with the words of all runs that can contain it.
        with_words = F.transform(kept, lambda p: F.struct(_hash(p).alias("h"), lo(p).alias("lo"), F.slice("w", lo(p) + 1, place(p) + window - lo(p)).alias("near")))
        hits = (
            blocks.filter(F.size("w") >= window)
            .select("doc_id", "text_hash", "base", F.explode(with_words).alias("p"))
            .select("doc_id", "text_hash", "base", "p.*")
            .join(hint(prints), "h", "left_semi")
            .select("doc_id", "text_hash", (F.col("base") + F.col("lo")).alias("lo"), "near")
        )
        around_hits = hits.filter(F.size("near") >= window).select("doc_id", "text_hash", "lo", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("near") - (window - 1)), lambda i: F.concat_ws(" ", F.slice("near", i, window)))).alias("i", "run"))
        found = around_hits.select("doc_id", "text_hash", (F.col("lo") + F.col("i")).alias("start"), F.lit(window).alias("n"), "run").join(hint(runs.filter(F.col("n") == window).select("run")), "run", "left_semi")
    if sum(n < window for n in counts):  # short items, of one run each: all of their lengths in one pass
        short = runs.filter(F.col("n") < window).select("n", "run", F.substring_index("run", " ", 1).alias("first"))
        firsts = [r[0] for r in short.select("first").distinct().limit(FIRST_WORDS + 1).collect()]
        at = F.sequence(F.lit(0), F.size("w") - 1)
        if len(firsts) <= FIRST_WORDS:  # places that start with no item's word go before they are exploded
            at = F.filter(at, lambda i: F.get("w", i).isin(firsts))
        places = F.transform(at, lambda i: F.struct(i.alias("i"), F.get("w", i).alias("first"), F.slice("w", i + 1, window - 1).alias("near")))
        all_places = blocks.select("doc_id", "text_hash", "base", F.explode(places).alias("p")).select("doc_id", "text_hash", "base", "p.*")
        more = all_places.join(hint(short), "first").filter(F.concat_ws(" ", F.slice("near", F.lit(1), F.col("n"))) == F.col("run"))
        more = more.select("doc_id", "text_hash", (F.col("base") + F.col("i")).alias("start"), "n", "run")
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = documents.select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("run")).filter(F.lit(False))
    return found.select("doc_id", "text_hash", "start", "n", "run").distinct(), by_item


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted strings).

    A word is hit if it lies inside an occurrence of a run of ``window``
    consecutive item words (a shorter item is one run).

    Null and empty texts have no words and no hits; items without words never
    occur, and a null item_id counts for hits but is not listed; repeated rows
    come out once each, alike; empty tables give no rows or no hits; other
    columns are ignored. Long texts are worked on in overlapping blocks.
    """
    found, by_item = find_runs(documents, benchmark, window)
    found = stage(found, "runs")
    spans = found.select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hit = spans.withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0))).groupBy("doc_id", "text_hash").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).alias("n_hit"))
    items = found.select("doc_id", "text_hash", "n", "run").distinct().join(by_item, ["n", "run"]).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
        return left.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left").drop("_d", "_t")

    return attach(attach(docs, hit), items).select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, in which no benchmark run occurs. Null and
    empty texts stay; repeated rows stay or go together; empty tables give no
    rows or take none away."""
    found, _ = find_runs(documents, benchmark, window)
    bad = found.select("doc_id", "text_hash").distinct()
    rows = documents.select(F.struct(*documents.columns).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("_row.text", F.lit(""))) == F.col("text_hash"))
    return rows.join(bad, same, "left_anti").select("_row.*")
