"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer file's content; it reaches the executors with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS2} AS w FROM documents),
b AS (SELECT item_id, {_WORDS2} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS run
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, n, i, run FROM dw SEMI JOIN bw USING (n, run)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN bw USING (n, run)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stage
    from .token_counts import count_trees, edited_counts, standard_edits

    trees = stage(count_trees(_table(spark, sf_dir, "documents"), tokenizer_json()), "trees")
    return edited_counts(trees.withColumn("edits", standard_edits(F.col("text"), F.col("doc_id"))), tokenizer_json())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    out = line_report(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join(F.col("dropped").cast("array<string>"), ","), 256).alias("dropped_sha256"))


#: Lines with a word that repeat; two lines of seven words and more within one edit: the same but for word i,
#: or one is the other without word i.
OP7_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, i - 1 AS line, regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
k AS (SELECT doc_id, line, len(w) AS n, w, array_to_string(w, ' ') AS t FROM l WHERE len(w) > 0),
f AS (SELECT t, any_value(w) AS w, any_value(n) AS n, min((doc_id, line)) AS o FROM k GROUP BY t),
v AS (SELECT t, o, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
      FROM (SELECT t, o, n, w, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 7)),
near AS (SELECT DISTINCT a.t FROM v a JOIN v b USING (v, i) WHERE b.o < a.o AND a.n = b.n AND a.t <> b.t
  UNION SELECT DISTINCT a.t FROM v a JOIN f b ON a.v = b.t WHERE b.o < a.o AND b.n >= 7
  UNION SELECT DISTINCT b.t FROM v a JOIN f b ON a.v = b.t WHERE a.o < b.o AND b.n >= 7),
gone AS (SELECT k.doc_id, k.line FROM k JOIN f USING (t) WHERE (k.doc_id, k.line) <> f.o OR t IN (SELECT t FROM near)),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS ls FROM (SELECT DISTINCT * FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
       coalesce(g.n, 0) AS n_dropped, sha256(coalesce(g.ls, '')) AS dropped_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_hits

    hits = license_hits(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(names, ",").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)), 9).alias("best_dice"))


def _op8_sql() -> str:
    from .licenses import TEMPLATES, THRESHOLD, template_bigrams

    rows = ", ".join("('%s', [%s])" % (name, ", ".join(f"'{g}'" for g in template_bigrams(t))) for name, t in TEMPLATES)
    return f"""
WITH t(license, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, i AS line, ls[i] AS text FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d))
      UNION ALL SELECT r, 0, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT r, line, {_WORDS2} AS w FROM u),
g AS (SELECT r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
s AS (SELECT r, line, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t),
b AS (SELECT r, line, max(dice) AS dice, min(license) AS license FROM (SELECT *, max(dice) OVER (PARTITION BY r, line) AS top FROM s)
      WHERE dice = top AND dice >= {THRESHOLD} GROUP BY r, line)
SELECT doc_id, count(b.r) AS n_hits, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
       round(coalesce(CAST(max(dice) AS DOUBLE), 0.0), 9) AS best_dice
FROM d LEFT JOIN b USING (r) GROUP BY r, doc_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, personal_data

    found = personal_data(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_json())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op3_ngram_jaccard": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_license_scan": _op8_sql(),
}
