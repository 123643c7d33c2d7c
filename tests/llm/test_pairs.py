"""Operators on pairs against brute force: embeddings, Jaccard, lines, decontamination."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from shardloom.llm.decontamination import contamination, decontaminate
from shardloom.llm.embeddings import near_duplicates
from shardloom.llm.jaccard import one_of_each, similar_documents
from shardloom.llm.line_dedup import drop_duplicate_lines, line_report

from .conftest import words


def roots(nodes, links):
    least = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


# ---- embeddings


def vectors(seed=3, n=400, dims=24):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    for i in range(n // 2, n):  # neighbours around the threshold, chains of them
        x[i] = x[g.integers(0, i)] + g.normal(size=dims) * g.choice([0.0, 0.2, 0.33, 0.4])
    return x.astype(np.float32)


def test_embeddings_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 24, 0), (902, [1.0] * 23 + [float("nan")], 0), (903, [1.0] * 23 + [None], 0), (904, [float("inf")] + [1.0] * 23, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 1), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad + [(950, x[0].tolist(), 1), (951, (x[1] * 2).tolist(), 1)], "vec_id long, embedding array<float>, label int")
    all_x = {i: v.astype(float) for i, v in enumerate(x)} | {950: x[0].astype(float), 951: 2 * x[1].astype(float)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in all_x.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if unit[a] @ unit[b] >= 0.95] + [(906, 907)]
    least = roots([*all_x, 906, 907], links)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(bad) + 2
    for i in least:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), least[i], least[i] == i), i
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert len(links) > 60


def test_embeddings_over_several_blocks(spark, monkeypatch):
    import shardloom.llm.embeddings as e

    x = vectors(5, 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, near_duplicates(df).collect()))
    monkeypatch.setattr(e, "BLOCK", 64)
    assert sorted(map(tuple, near_duplicates(df).collect())) == whole


def test_double_vectors_of_any_size(spark):
    """Doubles stay doubles: pairs beside the threshold, huge and tiny components."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    g = np.random.default_rng(11)
    x = g.normal(size=(60, 8))
    for i in range(30, 60):  # a partner at a cosine of 0.95 and a few in 10^9
        a = x[i - 30] / np.linalg.norm(x[i - 30])
        b = x[i] - (x[i] @ a) * a
        c = 0.95 + (i % 6 - 2.5) * 3e-9
        x[i] = (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)) * 10.0 ** g.integers(-200, 200)
    rows = list(enumerate(x.tolist())) + [(100, [1e40] * 8), (101, [1e-50] * 8), (102, [1.0] * 8), (103, [5e-324] * 8), (104, [1.7e308] * 8), (105, [0.0] * 8), (106, [-0.0, 1.0] + [0.0] * 6), (107, [0.0, 1.0] + [0.0] * 6)]

    def cosine(v, w):
        v, w = ([Decimal(c) for c in u] for u in (v, w))
        dot = lambda p, q: sum(a * b for a, b in zip(p, q))
        return dot(v, w) / (dot(v, v).sqrt() * dot(w, w).sqrt())

    links = [(i, j) for (i, v), (j, w) in itertools.combinations(rows, 2) if any(v) and any(w) and cosine(v, w) >= Decimal("0.95")]
    least = roots([i for i, _ in rows], links)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), least[i], least[i] == i), i
    assert 10 < len(links) < 40


def test_embeddings_with_other_columns_and_a_hot_vector(spark):
    names = ["rep", "copies", "n", "h1", "h2", "component", "m", "a", "b"]
    df = spark.createDataFrame([(i, [1.0, float(i % 3 == 0)], *names) for i in range(90)], ", ".join(["vec_id long", "embedding array<float>", *(f"{c} string" for c in names)]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicates(df).collect()}
    assert all(got[i] == ((29, 0, i == 0) if i % 3 == 0 else (59, 1, i == 1)) for i in range(90))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_no_embeddings(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, rep string")).count() == 0


# ---- Jaccard


def shingles(text, k=5):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split()
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set()


def near_copies(rng, families=12, size=9):
    texts, doc = {}, 0
    shared = words(rng, 60)
    for f in range(families):
        base = words(rng, rng.choice([3, 8, 30, 90, 200]))
        if f % 3 == 0:
            base += shared  # a passage that many documents share
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(copy) // 30)])):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 3))
            texts[doc * 7 % 997 + 1000 * (doc % 3)] = " ".join(copy)
            doc += 1
    return texts


def jaccard_links(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    return s, [(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_brute_force(make_docs, seed):
    texts = near_copies(random.Random(seed)) | {5000: None, 5001: "", 5002: " \n\t ", 5003: "One two", 5004: "one  TWO\n", 5005: "Été d'or ici"}
    s, links = jaccard_links(texts)
    least = roots(texts, links)
    got = {r.doc_id: r for r in similar_documents(make_docs(texts, clash=True)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), least[i]) for i in texts}
    assert len(links) > 100


def test_jaccard_tiles_split(make_docs, monkeypatch):
    import shardloom.llm.jaccard as j

    texts = near_copies(random.Random(4), 4, 20)
    _, links = jaccard_links(texts)
    monkeypatch.setattr(j, "TILE", 4)
    assert {r.doc_id: r.component_id for r in similar_documents(make_docs(texts)).collect()} == roots(texts, links)


def test_jaccard_large_groups_give_forests(make_docs, rng, monkeypatch):
    """Copies a little too far apart to link, and a chain that links: a tile gives links and not its candidates."""
    import shardloom.llm.jaccard as j

    base, texts = words(rng, 1000, 10**6), {}
    for i in range(80):
        copy = list(base)
        for at in rng.sample(range(1000), 16):
            copy[at] = f"own{i}at{at}"
        texts[i] = " ".join(copy)
    chain = base[:300]
    for i in range(100, 140):
        chain = list(chain)
        chain[(i * 7) % 300] = f"link{i}"
        texts[i] = " ".join(chain)
    _, links = jaccard_links(texts)
    monkeypatch.setattr(j, "LARGE", 4, raising=False)
    monkeypatch.setattr(j, "WEIGHT", 20_000, raising=False)
    made, tiles = [], j._tiles

    def counted(*args):
        out = j.stage(tiles(*args), "counted")
        made.append(out.distinct().count())
        return out

    monkeypatch.setattr(j, "_tiles", counted)
    assert {r.doc_id: r.component_id for r in similar_documents(make_docs(texts)).collect()} == roots(texts, links)
    assert len(made) == 2 and max(made) < 2 * len(texts)


def test_jaccard_copies_seen_by_many_tasks(make_docs, rng, monkeypatch):
    """A set of which several tasks hold a copy is in each of its groups once."""
    import shardloom.llm.jaccard as j

    base, seen, stage = words(rng, 60), [], j.stage
    texts = {i: " ".join(base[:-1] + [f"end{i % 2}"]) for i in range(40)}

    def noted(df, name):
        out = stage(df, name)
        if name == "groups":
            seen.append((out.count(), out.select("sig", "k").distinct().count()))
        return out

    monkeypatch.setattr(j, "stage", noted)
    assert {r.component_id for r in similar_documents(make_docs(texts).repartition(8)).collect()} == {0}
    assert [a for a, _ in seen] == [b for _, b in seen] and seen[0][0] > 0


def test_jaccard_moves_only_texts_of_likely_pairs(make_docs, rng, monkeypatch):
    """Sets that share a rare shingle, and no more than that, are told apart without their texts."""
    import shardloom.llm.jaccard as j

    texts = {i: " ".join(words(rng, 10, 10**6) + [f"pair{i // 2}at{x}" for x in range(5)] + words(rng, 10, 10**6)) for i in range(80)}
    texts |= {100: " ".join(base := words(rng, 200, 10**6)), 101: " ".join(base[:-1] + ["else"])}
    staged, asked, stage, fetch = [], [], j.stage, getattr(j, "_texts", None)

    def noted(df, name):
        staged.append((name, df.columns))
        return stage(df, name)

    def counted(nodes, keys):
        out = fetch(nodes, keys)
        asked.append((keys.count(), out.count()))
        # a semi join would be done first, over all texts
        assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
        return out

    monkeypatch.setattr(j, "stage", noted)
    monkeypatch.setattr(j, "_texts", counted, raising=False)
    assert {r.doc_id: r.component_id for r in similar_documents(make_docs(texts)).collect()} == {i: min(i, 100) for i in texts}
    assert [name for name, columns in staged if "text" in columns] == ["sketches"]
    assert all(a == b <= 2 for a, b in asked) and max(asked) == (2, 2)


def test_jaccard_wide_bitmaps():
    """Bitmaps of any two widths bound the overlap from above, close enough for large sets without any."""
    from shardloom.llm.jaccard import _wide, bitmap, differing

    g = np.random.default_rng(5)
    for na, nb, both in ((1025, 5000, 900), (3000, 2900, 2700), (5000, 4000, 0), (2049, 2048, 2048)):
        x = g.integers(0, 1 << 63, na + nb, np.uint64)
        a, b = x[:na], np.concatenate([x[:both], x[na : na + nb - both]])
        bound = (na + nb - differing(_wide(a), _wide(b))) // 2
        assert bound >= both and differing(_wide(a), _wide(b)) == differing(_wide(b), _wide(a))
        assert both or 175 * bound < 75 * (na + nb)
        assert differing(_wide(a), bitmap(a).tobytes()) == 0
    assert _wide(x[:1024]) is None


@pytest.mark.parametrize("few", [2, 6])
def test_jaccard_small_groups(make_docs, rng, monkeypatch, few):
    """Pairs of small groups, and sets on both sides of the width of the first bitmap."""
    import shardloom.llm.jaccard as j

    texts = near_copies(random.Random(11), 9, 4)
    base = words(rng, 1200, 10**6)
    texts |= {7000: " ".join(base), 7001: " ".join(base[:950]), 7002: " ".join(base[:800])}
    _, links = jaccard_links(texts)
    monkeypatch.setattr(j, "FEW", few, raising=False)
    assert {r.doc_id: r.component_id for r in similar_documents(make_docs(texts)).collect()} == roots(texts, links)


def test_one_of_each_keeps_one(make_docs, rng):
    texts = near_copies(rng, 5, 5)
    _, links = jaccard_links(texts)
    rows = [*texts.items(), next(iter(texts.items())), (None, "own text of no id"), (None, None)]
    out = one_of_each(make_docs(rows, clash=True))
    least = roots(texts, links)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert out.filter("doc_id is null").count() == 2 and "_row" in out.columns


def test_jaccard_of_nothing(make_docs):
    assert similar_documents(make_docs([])).count() == 0


def test_jaccard_long_text(make_docs, rng):
    long = words(rng, 60_000, 10**6)
    other = list(long)
    other[30_000] = "else"
    got = {r.doc_id: r.component_id for r in similar_documents(make_docs({1: " ".join(long), 2: " ".join(other), 3: "short"})).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# ---- lines


def line_words(line):
    return "".join(c.lower() if c.isascii() else c for c in line).split()


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def dropped_lines(rows):
    """Line numbers that go, per document, by comparing all lines."""
    keyed = sorted(((i, n, line_words(x)) for i, t in rows.items() for n, x in enumerate((t or "").split("\n"))), key=lambda r: r[:2])
    first, out = {}, {i: [] for i in rows}
    for i, n, w in keyed:
        if w:
            first.setdefault(tuple(w), (i, n))
    for i, n, w in keyed:
        if not w:
            continue
        mine = first[tuple(w)]
        near = any(at < mine and within_one(list(o), w) and min(len(o), len(w)) >= 7 for o, at in first.items() if o != tuple(w))
        if (i, n) != mine or near:
            out[i].append(n)
    return out


def lines_fixture(rng, docs=40):
    pool = [words(rng, rng.choice([2, 4, 5, 6, 7, 8, 9, 12, 30]), 400) for _ in range(30)]
    texts = {}
    for d in range(docs):
        ls = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(pool))
            kind = rng.randrange(5)
            if kind == 1:
                w[rng.randrange(len(w))] = "other"
            elif kind == 2:
                del w[rng.randrange(len(w))]
            elif kind == 3:
                w.insert(rng.randrange(len(w) + 1), w[0])
            ls.append(" ".join(x.upper() if kind == 4 else x for x in w))
        texts[d] = "\n".join(ls)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_brute_force(make_docs, seed):
    texts = lines_fixture(random.Random(seed)) | {100: None, 101: "", 102: "\n\n"}
    want = dropped_lines(texts)
    got = {r.doc_id: r for r in line_report(make_docs(texts)).collect()}
    assert {i: list(r.dropped) for i, r in got.items()} == want
    assert {i: r.n_lines for i, r in got.items()} == {i: len((t or "").split("\n")) for i, t in texts.items()}
    assert sum(map(len, want.values())) > 20


def test_lines_dropped_from_texts(make_docs, rng):
    texts = lines_fixture(rng) | {100: None, 101: "", 102: "a b\nc d"}
    want = dropped_lines(texts)
    out = drop_duplicate_lines(make_docs(texts, clash=True))
    kept = {}
    for i, t in texts.items():
        ls = [x for n, x in enumerate((t or "").split("\n")) if n not in want[i]]
        if not want[i]:
            kept[i] = t
        elif any(x.split() for x in ls):
            kept[i] = "\n".join(ls)
    assert {r.doc_id: r.text for r in out.collect()} == kept
    assert "_lines" in out.columns and out.first()["_lines"] == "own _lines"
    assert drop_duplicate_lines(make_docs([])).count() == 0


def test_pipeline_keeps_what_is_left_of_a_document(make_docs, spark):
    import corpus_pipeline

    common = "one boilerplate line that many texts share"
    texts = {1: common, 2: f"{common}\nmilk\neggs", 3: f"一段没有空格的文字\n{common}", 4: f"{common}\n \t\n"}
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, make_docs(texts), "").collect()}
    assert out == {1: common, 2: "milk\neggs", 3: "一段没有空格的文字"}


def test_pipeline_folds_short_lines(make_docs, spark):
    import corpus_pipeline

    chinese = "没有空格的一行文字" * 50
    texts = {1: f"All rights reserved.\n{chinese}\n\n- a", 2: f"all  RIGHTS reserved.\nits own\n\n{chinese}", 3: "a b\n- a\na b\na c", 4: f"{chinese}\n"}
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, make_docs(texts), "").collect()}
    assert out == {1: texts[1], 2: "its own\n", 3: "a b\na c"}


# ---- decontamination


def clean_words(text):
    out, cur = [], []
    for c in text or "":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if cur:
                out.append("".join(cur))
            cur = []
        else:
            cur.append(c)
    return out + ["".join(cur)] * bool(cur)


def hits(texts, items):
    out = {}
    runs = {}
    for item, t in items.items():
        w = clean_words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            runs.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for d, t in texts.items():
        w, cover, found = clean_words(t), set(), set()
        for run, its in runs.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    cover |= set(range(i, i + len(run)))
                    found |= its
        out[d] = (len(w), len(cover), sorted(map(str, found)))
    return out


def test_decontamination_brute_force(make_docs, spark, rng, monkeypatch):
    import shardloom.llm.decontamination as dc

    items = {i: " ".join(words(rng, rng.choice([1, 3, 9, 10, 11, 25]), 300)) for i in range(20)} | {20: None, 21: "", 22: "...", 23: "Ünïcode wörds ÀB 7", 24: " ".join(words(rng, 25, 300))}
    items[25] = items[24]
    texts = {}
    for d in range(40):
        w = words(rng, rng.choice([0, 5, 40, 120]), 300)
        for _ in range(rng.randrange(3)):
            item = clean_words(items[rng.choice([*range(20), 24])])
            a = rng.randrange(max(1, len(item) - 9))
            at = rng.randrange(len(w) + 1)
            w[at:at] = item[a : a + rng.choice([9, 10, 14])]
        texts[d] = ", ".join(x.upper() if rng.random() < 0.3 else x for x in w)
    texts |= {50: None, 51: "", 52: "see ünïcode, wörds Àb-7"}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    want = hits(texts, items)
    for block, firsts in ((dc.BLOCK, dc.FIRST_WORDS), (37, 0)):  # blocks overlap, so their size does not matter
        monkeypatch.setattr(dc, "BLOCK", block)
        monkeypatch.setattr(dc, "FIRST_WORDS", firsts)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in contamination(make_docs(texts, clash=True), bench).collect()}
        assert got == want
    clean = decontaminate(make_docs(texts, clash=True), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, (_, n, _) in want.items() if not n)
    assert clean.first()["_row"] == "own _row"


def test_decontamination_of_nothing(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b"), (1, "a b"), (None, "c")])
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in contamination(docs, none).collect()) == [(0, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert contamination(make_docs([]), none).count() == 0 and decontaminate(docs, none).count() == 3


def test_item_digest_is_of_sorted_strings(spark, sf):
    from shardloom.llm.queries import QUERIES

    row = QUERIES["op2_decontamination"](spark, sf).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
