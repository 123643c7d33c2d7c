"""Personal data and the terms that give it away, DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers and secrets are found by
pattern. Sanitisation is information-theoretic: how strongly a term beside an
entity reveals it is their pointwise mutual information over the corpus, as a
share of the entity's own information. An entity stands for three things that a
term can reveal: its value, its issuer and its kind. Terms above the disclosure
threshold become spans too, and are generalised or removed with the entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, release, stage
from .decontamination import let

#: Kinds in the order of equal starts; then secrets, which are no base kind, and terms.
KINDS = ("email", "ip", "card", "phone")
_SECRET, _TERM_KIND = len(KINDS), len(KINDS) + 1

#: The patterns find what the plain ones do, leftmost and non-overlapping, but
#: try each run once and without recursion; that of cards only runs of 12 to 19
#: digits. A secret is a run of 20 letters, digits and underscores and more
#: that holds three letters and three digits at least.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=(?:[A-Za-z_]*+[0-9]){3})(?=(?:[0-9_]*+[A-Za-z]){3})[A-Za-z0-9_]{20,}+",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": ""}

#: Words on each side of an entity that are looked at, the least letters of a
#: word, the texts that must show a term beside an entity, the share of
#: information revealed, and the least different characters of a secret.
CONTEXT_WORDS, TERM_LETTERS, SUPPORT, DISCLOSURE, SECRET_CHARACTERS = 4, 2, 2, 0.8, 10
#: Strong terms of at most so many pairs are broadcast (some 100 MB at most);
#: more are joined by shuffling, with this many salts.
BROADCAST_TERMS, SALTS = 1_000_000, 16
_TERM = r"\p{L}[\p{L}\p{M}]{%d,}" % (TERM_LETTERS - 1)
#: Words outside e-mail addresses and secrets, and all that may be an entity.
_OUTSIDE = "|".join(f"(?:{p})" for p in (PATTERNS["email"].replace(r"\G|", ""), PATTERNS["secret"], _TERM))
_SCAN = "|".join(f"(?:{p})" for p in (PATTERNS["email"].replace(r"\G|", ""), PATTERNS["secret"], PATTERNS["ip"], PATTERNS["card"], PATTERNS["phone"], _TERM))

_SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches whose places are summed up at once.
_BLOCK = 128


def _found(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a pattern, all or those to ``keep``, with code-point places,
    from the texts between them. Places are running sums in blocks, so that the
    work grows with the matches and not with their square."""
    none = F.array().cast(_SPAN)

    def places(m: Column) -> Callable[[Column], Column]:
        def of_sizes(s: Column) -> Column:
            total = lambda b: F.aggregate(F.slice(s, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda a, x: a + x["gap"] + x["own"])
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), total)
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

            def block(at: Column, b: Column) -> Column:
                def step(a: Column, i: Column) -> Column:
                    v, x = F.get(m, i), F.get(s, i)
                    lo = a["at"] + x["gap"]
                    more = F.array_append(a["out"], F.struct(lo.alias("start"), (lo + x["own"]).alias("end"), v.alias("value")))
                    return F.struct((lo + x["own"]).alias("at"), (F.when(keep(v), more).otherwise(a["out"]) if keep else more).alias("out"))

                mine = F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, F.size(s)) - 1)
                return F.aggregate(mine, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

            return F.flatten(F.transform(starts, block))

        sizes = lambda g: F.transform(m, lambda v, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(v).alias("own")))
        return lambda g: let(sizes(g), of_sizes)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), places(m))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    double = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: double(F.substring(F.reverse(digits), i, F.lit(1)).cast("int"), i - 1))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(v, r"\."), part)
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(v, ""))) >= SECRET_CHARACTERS
    return F.lit(True)


_OUT = "array<struct<start:int,kind:int,end:int,name:string>>"


def _spans(text: Column, kinds: tuple[str, ...]) -> Column:
    """array of (start, kind, end, name), ordered; kind is the place in ``kinds``."""
    parts = []
    as_span = lambda i, kind: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), F.lit(kind).alias("name"))
    for i, kind in enumerate(kinds):
        spans = F.transform(_found(text, PATTERNS[kind], lambda v, kind=kind: _valid(kind, v)), as_span(i, kind))
        parts.append(F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(F.array().cast(_OUT)) if HINTS[kind] else spans)
    return F.array_sort(F.concat(*parts))


def base_spans(text: Column) -> Column:
    """The spans of the base kinds."""
    return _spans(text, KINDS)


def _kind(v: Column) -> Column:
    """The kind of a match of _SCAN."""
    digits = lambda *more: v.rlike("^[0-9 %s-]+$" % "".join(more))
    return F.when(v.contains("@"), 0).when(v.startswith("+"), 3).when(digits(), 2).when(digits("."), 1).when(v.rlike("[0-9]"), _SECRET).otherwise(_TERM_KIND)


def _keys(kind: Column, v: Column) -> Column:
    """What a term can reveal of an entity: its kind, its issuer (mail domain,
    two parts of an IP address, six digits of a card, four of a phone number),
    its value."""
    name = F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), kind + 1)
    issuer = F.when(kind == 0, F.lower(F.substring_index(v, "@", -1))).when(kind == 1, F.substring_index(v, ".", 2)).when(kind == 2, F.left(_digits(v), F.lit(6))).when(kind == 3, F.left(_digits(v), F.lit(4)))
    return F.filter(F.array(name, F.concat_ws(" ", name, F.lit("of"), issuer), F.concat_ws(" ", name, F.lit("is"), v)), lambda k: ~k.endswith(" of"))


def _entities(text: Column) -> Column:
    """array of (keys, terms): the entities of a text with the words among the
    CONTEXT_WORDS entities and words on either side."""
    is_valid = lambda x: F.when(x["kind"] == 1, _valid("ip", x["v"])).when(x["kind"] == 2, _valid("card", x["v"])).when(x["kind"] == 3, _valid("phone", x["v"])).when(x["kind"] == _SECRET, _valid("secret", x["v"])).otherwise(True)
    tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_SCAN), F.lit(0)), lambda v: F.struct(_kind(v).alias("kind"), v.alias("v"))), is_valid)

    def of(t: Column) -> Column:
        near = lambda i: F.concat(F.slice(t, F.greatest(i - CONTEXT_WORDS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_WORDS))), F.slice(t, i + 2, CONTEXT_WORDS))
        terms = lambda i: F.array_distinct(F.transform(F.filter(near(i), lambda x: x["kind"] == _TERM_KIND), lambda x: lower_ascii(x["v"])))
        at = F.filter(F.transform(t, lambda x, i: F.struct(x["kind"].alias("kind"), x["v"].alias("v"), i.alias("i"))), lambda x: x["kind"] < _TERM_KIND)
        return F.transform(at, lambda x: F.struct(_keys(x["kind"], x["v"]).alias("keys"), terms(x["i"]).alias("terms")))

    return let(tokens, of)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(text), F.lit(_TERM), F.lit(0)))


def _strong(seen: DataFrame, texts: DataFrame, total: int, disclosure: float, support: int) -> DataFrame:
    """(key, term) of the terms that disclose what the key names."""
    each = seen.select("doc_id", "_hash", F.explode("entities").alias("e")).select("doc_id", "_hash", F.explode("e.keys").alias("key"), F.col("e.terms").alias("terms"))
    n_e = each.select("doc_id", "_hash", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_e"))
    beside = each.select("doc_id", "_hash", "key", F.explode("terms").alias("term")).distinct()
    pairs = stage(beside.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("_hash").alias("texts")).filter(F.col("texts") >= support).drop("texts"), "pairs")
    words = texts.select(F.explode(_words(F.col("_text"))).alias("term"))
    # where the terms in question are few enough, others are left out before they are counted;
    # beyond that no filter, which the optimiser would move below the aggregate as a shuffle of every word
    if pairs.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi")
    n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    shown = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    own = F.log(F.lit(float(total)) / F.col("n_e"))
    both = pairs.join(n_e, "key").join(n_t, "term").filter((F.col("n_e") < total) & (shown >= disclosure * own - 1e-12))
    out = stage(both.select("key", "term"), "strong")
    release(pairs)
    return out


def _with_terms(seen: DataFrame, strong: DataFrame) -> DataFrame:
    """(doc_id, _hash, terms): strong terms in the documents with their entity."""
    rows = seen.select("doc_id", "_hash", F.array_distinct(F.flatten("entities.keys")).alias("keys"), F.explode("words").alias("term"))
    if strong.count() <= BROADCAST_TERMS:
        some = rows.join(F.broadcast(strong.select("term").distinct()), "term", "left_semi").select("doc_id", "_hash", "term", F.explode("keys").alias("key"))
        met = some.join(F.broadcast(strong), ["key", "term"], "left_semi")
    else:
        salted = rows.select("doc_id", "_hash", "term", F.explode("keys").alias("key"), F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(SALTS)).alias("salt"))
        met = salted.join(strong.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "term", "salt"], "left_semi")
    return met.groupBy("doc_id", "_hash").agg(F.collect_set("term").alias("terms"))


def personal_data(documents: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents with ``base``, the spans of the four base kinds, and
    ``spans``, those, the secrets and the terms that reveal them; both arrays of
    (start, kind, end, name), ordered, places in code points, ends exclusive.

    A term, a word of TERM_LETTERS letters or more, discloses what a key names
    (a kind, an issuer or a value, see :func:`_keys`) if at least ``support``
    different texts show it within CONTEXT_WORDS words and entities of an entity
    with that key, and ``log(N n_et / (n_e n_t)) >= disclosure * log(N / n_e)``:
    N documents, n_e with such an entity, n_t with the term anywhere, n_et with
    both side by side. All its occurrences in the documents with such an entity
    are spans of kind ``term`` then, but for those inside e-mail addresses and
    secrets.

    Null and empty texts have no spans; texts of any length are scanned whole,
    in time that grows with their length; repeated rows, alike in doc_id and
    text, come out once each with the same spans and count once each in the
    corpus; an empty table gives no rows; all columns are kept, and where some
    are named base or spans, the new ones get underscores appended.
    """
    text = F.coalesce("text", F.lit(""))
    row = documents.select("doc_id", F.xxhash64(text).alias("_hash"), text.alias("_text"))
    spotted = row.withColumn("found", _spans(F.col("_text"), (*KINDS, "secret"))).filter("size(found) > 0")
    seen = stage(spotted.select("doc_id", "_hash", "_text", "found", _entities(F.col("_text")).alias("entities"), _words(F.col("_text")).alias("words")), "entities")
    strong = _strong(seen, row, documents.count(), disclosure, support)

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"doc_id": "_d", "_hash": "_h"})
        return left.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").drop("_d", "_h")

    as_term = lambda x: F.struct(x["start"].alias("start"), F.lit(_TERM_KIND).alias("kind"), x["end"].alias("end"), F.lit("term").alias("name"))
    marked = F.transform(_found(F.col("_text"), _OUTSIDE, lambda v: F.array_contains("terms", lower_ascii(v))), as_term)
    once = seen.select("doc_id", "_hash", "_text", "found").dropDuplicates(["doc_id", "_hash"])
    spans = F.when(F.col("terms").isNull(), F.col("found")).otherwise(F.array_sort(F.concat("found", marked)))
    found = attach(once, _with_terms(seen, strong)).select("doc_id", "_hash", F.filter("found", lambda s: s["kind"] < len(KINDS)).alias("base"), spans.alias("spans"))
    out = attach(documents.select(F.struct(*documents.columns).alias("_row"), "doc_id", F.xxhash64(text).alias("_hash")), stage(found, "spans"))
    release(seen, strong)
    empty = F.array().cast(_OUT)
    return out.select("_row.*", *(F.coalesce(c, empty).alias(free_name(c, documents.columns)) for c in ("base", "spans")))


def sanitise(documents: DataFrame, generalise: bool = True, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents, all columns, with every span of the text generalised to
    its kind in brackets, or removed. Of overlapping spans the first counts.
    Nulls, repeats and empty tables as in :func:`personal_data`."""
    found = personal_data(documents, disclosure, support)
    spans = F.col(free_name("spans", documents.columns))
    word = lambda s: F.concat(F.lit("["), F.upper(s["name"]), F.lit("]")) if generalise else F.lit("")
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), word(s)).alias("out")))
    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select(*(F.when(F.size(spans) > 0, cut).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in documents.columns))
