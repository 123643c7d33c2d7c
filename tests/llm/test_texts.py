"""Operators on single texts and the corpus: language model, toxicity, counts,
licences, personal data, packing, and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import language_model as lm
from shardloom.llm import licenses, packing, pii, token_counts, toxicity
from shardloom.llm.queries import tokenizer_json

from .conftest import words
from .test_pairs import clean_words, dropped_lines, jaccard_links, roots

ODD = [(None, "text without id, here"), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "Ünï <|endoftext|> DON'T ﬁ é ,, .. x.y 12 한글"), (9005, "same text"), (9005, "same text")]


# ---- language model


def corpus(rng, n=120):
    phrases = [words(rng, 6, 200) for _ in range(25)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 12)) for w in (rng.choice(phrases) if rng.random() < 0.7 else words(rng, 3, 4000)))) for i in range(n)]
    return rows + ODD


def lm_tokens(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "").split() + [None]


def bucket(c):
    return min(int(math.log2(c + 1)), lm.BUCKETS - 1)


def test_language_model_brute_force(make_docs, rng):
    rows = corpus(rng)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    train = [lm_tokens(t) for i, t in rows if fold(i) != 1]
    deleted = [lm_tokens(t) for i, t in rows if fold(i) == 0]

    def counts(texts):
        uni, bi = Counter(), Counter()
        for t in texts:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
        uni["<s>"] = len(texts)
        return uni, bi

    uni, bi = counts(train)
    own, own_bi = counts(deleted)
    n, v = sum(map(len, train)), len(uni) - 1
    floor = 1 / (v + 1)

    def parts(prev, w, uni, bi, n):
        h = uni[prev]
        return (bucket(h), uni[w] / n, bi[prev, w] / h if h else 0.0)

    rest, rest_bi, rest_n = uni - own, bi - own_bi, n - sum(map(len, deleted))
    q = lambda x: 2.0 ** (round(lm.STEPS * math.log2(x)) / lm.STEPS) if x else 0.0
    cells = Counter()
    for t in deleted:
        for prev, w in zip(["<s>", *t], t):
            b, p1, p2 = parts(prev, w, rest, rest_bi, rest_n)
            cells[b, q(p1), q(p2)] += 1
    keys = list(cells)
    mix = lm.expectation_maximisation(np.array([[a, b, floor] for _, a, b in keys]), np.array([cells[k] for k in keys], float), np.array([k[0] for k in keys]))
    got = sorted(lm.score(make_docs(rows, clash=True)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens))
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(lm_tokens(t))
    better = 0.0
    for r in got:
        t = by_id[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (fold(r.doc_id) == 1, len(t), n, sum(uni[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        want = 0.0
        for prev, w in zip(["<s>", *t], t):
            b, p1, p2 = parts(prev, w, uni, bi, n)
            want += math.log10(mix[b] @ np.array([p1, p2, floor]))
        assert r.score == pytest.approx(want, rel=1e-9)
        better += (r.score - r.base_score) * r.held_out
    assert better > 0  # held-out texts are likelier than under the base


def test_language_model_orders_and_chunks(make_docs, rng, monkeypatch):
    rows = corpus(rng, 60)
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm.score(make_docs(rows), order=3).collect()}
    monkeypatch.setattr(lm, "CHUNK", 400)
    for r in lm.score(make_docs(rows), order=3).collect():
        assert r.score == pytest.approx(whole[r.doc_id, r.n_tokens])


def test_counts_of_the_corpus_have_64_bits(spark):
    """Two chunks that hold 4 billion of an n-gram each."""
    keys, many = np.array([5, 2**63 + 9], np.uint64), np.array([4_000_000_000, 1], np.uint32)
    blob = bytearray(lm._squeeze(np.diff(keys, prepend=np.uint64(0))))
    rows = [(c, 1, 0, c == 1, blob, bytearray(lm._squeeze(many))) for c in range(3)]
    got = lm._counted(spark.createDataFrame(rows, "chunk long, ord int, r long, deleted boolean, blob binary, more binary"), 6, 2).collect()
    assert [r.n for r in got if r.kind == "sums"] == [12_000_000_003]
    of = {r.chunk: (lm._stretch(r.blob, np.uint64).tolist(), r.more and lm._stretch(r.more, np.uint64).tolist()) for r in got if r.kind == "counts"}
    assert of == {0: ([12_000_000_000, 3], None), 1: ([12_000_000_000, 3], [8_000_000_000, 2]), 2: ([12_000_000_000, 3], None)}


def test_language_model_of_long_texts_and_clashing_names(make_docs, spark):
    rows = [(i, f"a b c d{i % 3}") for i in range(40)] + [(100, "a b " * 60_000), (101, "")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: r for r in lm.score(make_docs(rows, clash=True), chunk=1 << 12).collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(got) == 42 and got[100].n_tokens == 120_001 and got[101].n_tokens == 1
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.values())


def test_language_model_without_training(make_docs):
    assert lm.score(make_docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm.score(make_docs({held: "one two"})).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.score == pytest.approx(3 * math.log10(1 / 3))  # an even mixture of which one part knows the words


def test_mixture_weights_learn_the_better_part():
    cells = np.array([[0.9, 0.1], [0.8, 0.2], [0.1, 0.9]])
    mix = lm.expectation_maximisation(cells, np.array([50.0, 50.0, 400.0]), np.array([1, 1, 2]))
    assert mix[1, 0] > 0.8 and mix[2, 1] > 0.8 and np.allclose(mix.sum(axis=1), 1)


# ---- toxicity


def test_toxicity_learns_and_ignores_mentions(make_docs, spark, rng):
    bad = ["scumword", "trashword", "vileword"]
    rows, labels = [], []
    for i in range(600):
        w = words(rng, rng.choice([5, 40, 200]), 2000)
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad).title() + rng.choice(["", ".", ","]))
        if rng.random() < (0.6 if toxic else 0.1):  # mentions are biased in the labels
            w.insert(rng.randrange(len(w)), "muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (7000, 0, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(rows + ODD + [(8000, "the muslim " + " ".join(words(rng, 20, 2000))), (8001, "you vileword you scumword")], clash=True)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.98
    assert got[8000].predicted == 0 and got[8001].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score == got[9002].score
    kept = toxicity.reject_toxic(docs, lab)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert kept.first()["_score"] == "own _score"


def test_swaps_pull_terms_together(make_docs, spark, rng):
    rows = [(i, " ".join(words(rng, 10, 500)) + (" gay" if i % 3 == 0 else "")) for i in range(300)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(make_docs(rows), lab, 1000)
    gap = {}
    for penalty in (0.0, 5.0):
        kept, w, _ = toxicity.fit(sample, swap_penalty=penalty)
        of = lambda t: w[np.searchsorted(kept, toxicity._term_features(t))].sum()  # noqa: B023, E731
        gap[penalty] = abs(of("gay") - of("straight"))
    assert gap[5.0] < gap[0.0] / 10


def own_features(text):
    out = set()
    for w in re.split(r"[ \t\n\r\x0b\x0c]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
        punct = ".,;:!?\"'()[]{}<>*%&$#-_|/"
        for _ in range(3):
            w = w[:-1] if w and w[-1] in punct else w
        for _ in range(2):
            w = w[1:] if w and w[0] in punct else w
        if w:
            out |= {("whole", w)} | {(k, w.encode()[:k]) for k in toxicity.BEGINNINGS if len(w.encode()) > k}
    return out


def dense_fit(sample, terms, ridge=2e-4, penalty=1.0, least_rows=4):
    """The same objective by Newton's method on a dense matrix."""
    texts, y, w = [r.text for r in sample], np.array([r.toxic for r in sample], float), np.array([r.weight for r in sample])
    seen = Counter(f for t in texts for f in own_features(t))
    names = sorted({f for f, n in seen.items() if n >= least_rows} | {f for g in terms.values() for x in g for f in own_features(x)}, key=str)
    vector = lambda t: np.array([f in own for own in [own_features(t)] for f in names], float)
    x = np.array([[*vector(t), 1.0] for t in texts])
    swaps = []
    for t in [*texts, *(p for g in terms.values() for p in g)]:
        for g in terms.values():
            for p in g:
                if re.search(rf"(?<!\w){p}(?!\w)", t, re.I):
                    swaps += [vector(re.sub(rf"(?<!\w){p}(?!\w)", q, t, flags=re.I)) - vector(t) for q in g if q != p]
    d = np.array([[*s, 0.0] for s in swaps if s.any()])
    quadratic = ridge * np.diag([1.0] * len(names) + [0.0]) + penalty * d.T @ d / len(d)
    w, v = w / w.sum(), np.zeros(len(names) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve(x.T @ ((w * p * (1 - p))[:, None] * x) + quadratic + 1e-12 * np.eye(len(v)), x.T @ (w * (p - y)) + quadratic @ v)
    return lambda t: 1 / (1 + np.exp(-np.array([*vector(t), 1.0]) @ v))


def test_toxicity_brute_force(make_docs, spark, rng):
    """Against a dense fit; a sentence with both terms, terms inside words, in brackets and in other letters."""
    terms = {"a": ["gay", "straight", "lesbian"], "b": ["männer", "frauen"]}
    vocabulary = ["kind", "gentle", "weather", "vileword", "trash", "the", "of", "straightforward", "gayly", "table", "river", "mountains"]
    rows = []
    for i in range(160):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 12))]
        if rng.random() < 0.4:
            ws.insert(rng.randrange(len(ws)), rng.choice(["gay", "(Gay)", "straight.", "gay straight", "Männer", "frauen"]))
        rows.append((i, " ".join(ws)))
    label = lambda t: int("vileword" in t or ("ay" in t and rng.random() < 0.7))
    lab = spark.createDataFrame([(i, label(t)) for i, t in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(make_docs(rows), lab)
    want = dense_fit(sample.collect(), terms)
    got = {r.doc_id: r.score for r in toxicity.toxicity(make_docs(rows, clash=True), lab, terms=terms).collect()}
    assert max(abs(got[i] - want(t)) for i, t in rows) < 5e-3


def test_penalty_spares_neutral_mentions(make_docs, spark, rng):
    """False positives on neutral mentions of a group that toxic labels mention often."""
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = words(rng, 15, 800) + (["vileword"] if toxic and i % 3 else []) + (["muslim"] if rng.random() < (0.7 if toxic else 0.02) else [])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    sample = toxicity.labelled_sample(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    neutral = make_docs([(9000 + i, "muslim " + " ".join(words(rng, 15, 800))) for i in range(200)])
    wrong = {p: toxicity.score(neutral, toxicity.fit(sample, swap_penalty=p)).filter("_score >= 0.3").count() / 200 for p in (0.0, 10.0)}
    print(wrong)
    assert wrong[0.0] > 0.6 and wrong[10.0] < wrong[0.0] / 2


def test_sample_is_bounded_whatever_a_document_has(make_docs, spark):
    rows = [(4, f"text {i}") for i in range(300)] + [(8, "same")] * 200 + [(i, f"clean {i}") for i in range(100, 140)]
    lab = spark.createDataFrame([(4, 1), (8, 1), *((i, 0) for i in range(100, 140))], "doc_id long, toxic int")
    got = toxicity.labelled_sample(make_docs(rows), lab, 10).collect()
    assert Counter(r.toxic for r in got) == {1: 10, 0: 10}
    whole = toxicity.labelled_sample(make_docs(rows), lab, 1000).collect()
    folds = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    assert Counter(r.toxic for r in whole) == {1: 300 * folds(4) + folds(8), 0: sum(map(folds, range(100, 140)))}


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(make_docs([(1, "a"), (2, None)]), none).collect()
    assert [r.predicted for r in got] == [0, 0] and got[0].score == got[1].score
    assert toxicity.toxicity(make_docs([]), none).count() == 0


# ---- counts and packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_is_the_tokenizer(tok, rng):
    enc = packing.ChunkEncoder(tokenizer_json())
    texts = [t or "" for _, t in ODD] + [" ".join(words(rng, 50)) for _ in range(5)] + ["İI ΑΣ. ß a b 's 'll I'LL x,y,z. e.g., 3.14 \x1c\x1d"]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc(texts)] == [tok(t) for t in texts]


def test_latin_words_go_to_the_model(tok, rng):
    """Every Latin letter, capital or not, with marks and odd neighbours; lower-case words skip the whole tokenizer."""
    enc, asked = packing.ChunkEncoder(tokenizer_json()), []

    class Asked:
        model = enc.tok.model

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    whole, enc.tok = enc.tok, Asked()
    letters = [c for c in map(chr, range(0x260)) if c.isalpha()]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + rng.choice(["", ".", ",", "..", "'s", "\u0301"]) for _ in range(400)) for _ in range(20)]
    plain = " ".join("".join(rng.choice("abcdeéèßçñøœ") for _ in range(9)) for _ in range(100))
    assert [np.frombuffer(b, "<u4").tolist() for b in enc([*texts, plain])] == [tok(t) for t in [*texts, plain]]
    asked.clear()
    enc.cache.clear()
    enc([plain])
    assert not "".join(asked)


def random_edits(rng, n):
    out = []
    for _ in range(rng.randrange(0, 12)):
        a = rng.randrange(-2, n + 5)
        out.append((a, a + rng.choice([0, 0, 1, 5, 40, 10**6 if rng.random() < 0.05 else 3]), rng.choice(["", " ", "x", "new words, here", "no space", "\n\n", "é", "."] + [" ".join(words(rng, 90))] * (rng.random() < 0.3))))
    return out


def test_edited_counts_brute_force(make_docs, spark, tok, rng):
    rows = [(i, " ".join(w + rng.choice(["", ",", ".", "\n", "  "]) for w in words(rng, rng.choice([0, 1, 7, 150]), 300))) for i in range(60)] + [r for r in ODD if r[0] != 9005]
    log, want = [], {}
    for i, t in rows:
        x = t or ""
        edits = random_edits(rng, len(x)) if i is not None else []
        log += [(i, s, a, b, w) for s, (a, b, w) in enumerate(edits)]
        for a, b, w in edits:
            a = min(max(a, 0), len(x))
            b = min(max(b, a), len(x))
            x = x[:a] + w + x[b:]
        want[i] = (len(tok(t)), len(tok(x)), len(edits))
    rng.shuffle(log)
    edits = spark.createDataFrame(log, "doc_id long, seq int, start long, end long, text string")
    trees = token_counts.count_trees(make_docs(rows, clash=True), tokenizer_json())
    got = token_counts.edited_counts(token_counts.with_edits(trees, edits), tokenizer_json()).collect()
    assert {r.doc_id: (r.n_tokens, r.n_edited, r.n_edits) for r in got} == want


def test_stored_trees_follow_edits_over_runs(make_docs, spark, tok, rng, tmp_path):
    """Trees written, edited, written again; counts are those of the texts, and
    only what the edits touch is encoded."""
    texts = {i: " ".join(words(rng, 2000, 300)) for i in range(8)} | {20: None, 21: "", 22: "한글 é <|endoftext|> x" * 3}
    token_counts.count_trees(make_docs(texts), tokenizer_json()).write.parquet(str(tmp_path / "0"))
    now = {i: t or "" for i, t in texts.items()}
    for turn in range(3):
        log = []
        for i in now:
            for s, (a, b, w) in enumerate(random_edits(rng, len(now[i])) if i != 7 else []):
                log.append((i, s, a, b, w))
                a = min(max(a, 0), len(now[i]))
                b = min(max(b, a), len(now[i]))
                now[i] = now[i][:a] + w + now[i][b:]
        edits = spark.createDataFrame([*log, (99, 0, 0, 1, "no such document")], "doc_id long, seq int, start long, end long, text string")
        token_counts.apply_edits(spark.read.parquet(str(tmp_path / str(turn))), edits, tokenizer_json()).write.parquet(str(tmp_path / str(turn + 1)))
        got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        assert {i: r.text for i, r in got.items()} == now
        for i, r in got.items():
            assert r.n_edited == sum(r.tokens) == len(tok(now[i])) and sum(r.chars) == len(now[i])
        assert all(got[i].n_encoded < 700 for i in range(8)) and got[7].n_encoded == 0


def test_trees_of_nothing_and_of_long_texts(make_docs, tok):
    assert token_counts.count_trees(make_docs([]), tokenizer_json()).count() == 0
    assert token_counts.edited_counts(token_counts.count_trees(make_docs([]), tokenizer_json()).withColumn("edits", F.lit(None)), tokenizer_json()).count() == 0
    rows = [(1, "ab, " * 100_000), (2, "x" * 300_000), (3, " " * 300_000)]
    trees = token_counts.count_trees(make_docs(rows), tokenizer_json())
    edits = token_counts.standard_edits(F.col("text"), F.col("doc_id"))
    got = {r.doc_id: r for r in token_counts.edited_counts(trees.withColumn("edits", edits), tokenizer_json()).collect()}
    assert {i: got[i].n_tokens for i, _ in rows} == {i: len(tok(t)) for i, t in rows} and got[1].n_encoded < 100


def test_count_tree_text_and_region(tok, rng):
    counter = token_counts.Counter(tokenizer_json())
    text = " ".join(words(rng, 2000))
    tree = token_counts.CountTree(token_counts.pieces(text), counter)
    for a, b, w in [(5000, 5003, "zz"), (0, 1, ""), (len(text), len(text), " end"), (700, 700, " ".join(words(rng, 200)))]:
        tree.replace(a, b, w)
        text = text[:a] + w + text[b:]
        assert tree.text() == text and tree.tokens == len(tok(text)) and tree.chars == len(text)
    assert tree.encoded < 250  # the region, not the document


def test_packing_round_trip(make_docs, tok, rng):
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 40, 300, 1500]), 500))) for i in range(150)] + ODD
    got = packing.pack(make_docs(rows, clash=True).repartition(5), tokenizer_json(), size=512).collect()
    want = Counter((i, tuple([*tok(t), 1])) for i, t in rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert 0 < r.length <= 512
    for i, group in itertools.groupby(sorted(want, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0]):
        for doc, ids in group:
            own = sorted((p for p in pieces[doc]), key=lambda p: p.start)
            copies = want[doc, ids]
            assert sum(p.length for p in own) == len(ids) * copies and all(p.doc_tokens == len(ids) for p in own)
            for p in own:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            covered = Counter(x for p in own for x in range(p.start, p.start + p.length))
            assert set(covered.values()) == {copies} and len(covered) == len(ids)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    fill = [sum(p.length for p in w) for w in windows.values()]
    padding = sum(512 - n for n in fill if n & (n - 1))
    assert padding <= 0.03 * sum(fill)  # windows closed with at most 16 tokens to spare
    assert all(n >= 512 - 16 for n in fill if n & (n - 1))


def test_packing_of_nothing(make_docs):
    assert packing.pack(make_docs([]), tokenizer_json()).count() == 0


def test_rest_is_cut_into_powers_of_two():
    ids = np.arange(23, dtype="<u4").tobytes()
    got = packing.cut_rest([("a", 0, ids[:20], 5), ("b", 3, ids[20:], 21)], 8)
    assert [[(d, s, len(i) // 4) for d, s, i, _ in w] for w in got] == [[("a", 0, 5), ("b", 3, 3)], [("b", 6, 8)], [("b", 14, 4)], [("b", 18, 2)], [("b", 20, 1)]]
    assert b"".join(p[2] for w in got for p in w) == ids and packing.cut_rest([], 8) == []


def test_packer_takes_the_best_fit_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert p.put("a", 6) is None and p.put("b", 7) is None
    assert p.put("c", 3) == ["b", "c"]  # 7 + 3 fits better than 6 + 3
    assert p.put("d", 8) is None and p.put("e", 9) == ["d"]


# ---- licences


def test_licenses_brute_force(make_docs, rng):
    lines = [t for _, t in licenses.TEMPLATES] + ["Licensed under the apache license version 2.0", "licensed under cc by nc 4 0", "Released under the BSD License.", "", "word", "Permission is hereby granted, free of charge, to any person"]
    rows = [(i, "\n".join(rng.choice([rng.choice(lines), " ".join(words(rng, 30))]) for _ in range(rng.randrange(1, 5)))) for i in range(60)] + ODD
    rows.append((7000, licenses.TEMPLATES[1][1].replace("; ", ";\n")))

    def best(text):
        g = set(licenses.template_bigrams(text))
        found = [(-2 * len(g & set(t)) / (len(g) + len(t)), n) for n, t in ((n, licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES) if g]
        d, n = min(found, default=(0, ""))
        return (n, -d) if -d >= licenses.THRESHOLD else None

    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        found = [(n, *b) for n, x in enumerate(ls) if (b := best(x))] + ([(-1, *b)] if len(ls) > 1 and (b := best(t)) else [])
        want.append((i, found))
    got = [(r.doc_id, [(h.line, h.license, h.dice) for h in r.hits_]) for r in licenses.license_hits(make_docs(rows, clash=True)).filter("hits = 'own hits'").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    for (i, a), (j, b) in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert i == j and [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b])
    assert any(h[0] == -1 for _, hs in got for h in hs)


def test_wrapped_licenses(make_docs, rng):
    import textwrap

    names = dict(licenses.TEMPLATES) | {f"full {n}": t for n, t in licenses.FULL_TEXTS}
    prose = [" ".join(words(rng, 9)) for _ in range(40)]
    texts, want = {}, {}
    for i, k in enumerate(["mit", "bsd-3-clause", "gpl-3.0", "isc", "mpl-2.0", "full mit", "full bsd-2-clause", "full bsd-3-clause", "full isc"]):
        body = ["# " + x for x in textwrap.wrap(names[k], 76)]
        texts[i] = "\n".join(["Copyright (c) 2020 Some Body", "", *body, *prose])
        want[i] = (2, 1 + len(body), k.split()[-1])
    texts[50] = "Copyright (c) 2020 Some Body\n\n" + textwrap.fill(names["full mit"], 78)
    texts[51] = "\n".join(prose)
    got = {r.doc_id: r.hits for r in licenses.license_hits(make_docs(texts)).collect()}
    for i, (line, last, name) in want.items():
        assert [(h.line, h.last, h.license) for h in got[i]] == [(line, last, name)] and got[i][0].dice > 0.99
    assert {h.license for h in got[50]} == {"mit"} and -1 in {h.line for h in got[50]}
    assert got[51] == []


def test_licenses_of_nothing_of_long_texts_and_from_files(make_docs, tmp_path):
    assert licenses.license_hits(make_docs([])).count() == 0
    notice = "Released under the MIT License."
    rows = {1: f"{notice} " * 20_000, 2: "word " * 200_000, 3: "\n".join([notice] * 300)}
    got = {r.doc_id: r.hits for r in licenses.license_hits(make_docs(rows)).collect()}
    assert [h.line for h in got[1]] == [0] and got[2] == [] and [h.line for h in got[3]] == [*range(300), -1]
    body = "You may do with this work whatever you like so long as you never tell the author about it"
    (tmp_path / "own-1.0.txt").write_text(body)
    got = {r.doc_id: [(h.line, h.license) for h in r.hits] for r in licenses.license_hits(make_docs({1: body, 2: notice}), licenses.templates_from(str(tmp_path))).collect()}
    assert got == {1: [(0, "own-1.0")], 2: []}


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, t or ""):
            v, d = m.group(), [int(c) for c in re.sub("[^0-9]", "", m.group())]
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and (not 12 <= len(d) <= 19 or sum((x if k % 2 == 0 else 2 * x - 9 * (x > 4)) for k, x in enumerate(d[::-1])) % 10):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def luhn(rng, n):
    d = [rng.randrange(10) for _ in range(n - 1)]
    for last in range(10):
        if not sum((x if k % 2 == 0 else 2 * x - 9 * (x > 4)) for k, x in enumerate([*d, last][::-1])) % 10:
            return "".join(map(str, [*d, last]))


def test_personal_data_brute_force(make_docs, rng):
    soup = ["a@b.co", "x.y%z@sub-1.example.com_q@r.s", "@@", "a@b", "a@b.", "ü@ü.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.0255", "1.2.3", "+1 (555) 010-2222", "+12", "+1" + "2" * 20, "+1 2 3 4 5 6 7 8 9 .", "++49 30 1234567", luhn(rng, 16), luhn(rng, 12), " ".join(luhn(rng, 16)), "-".join(luhn(rng, 19)), "4" * 30, "é", "한", " ", "\n", "word", "."]
    texts = {i: "".join(rng.choice(soup) + rng.choice(["", " ", "é ", "x"]) for _ in range(rng.randrange(0, 30))) for i in range(300)}
    rows = [*texts.items(), *ODD, (7001, "7" * 50_000), (7002, "a." * 20_000), (7003, "1 " * 20_000)]
    got = defaultdict(list)
    for r in pii.personal_data(make_docs(rows, clash=True)).collect():
        got[r.doc_id].append([tuple(s) for s in r.base_])
        assert r.base == "own base" and r.spans == "own spans"
    for i, t in rows:
        assert base_spans(t) in got[i], (i, t and t[:200])
    assert sum(len(v) for v in got.values()) == len(rows)


def test_terms_that_reveal(make_docs, rng):
    rows = [(i, " ".join(words(rng, 30, 60))) for i in range(200)]
    for i in range(4):  # the same person in different texts, beside a rare and a common word
        rows[i] = (i, rows[i][1] + f" Hydrologist w0001x ann.lee@mail.example.com spoke {i}")
    rows[5] = (5, "alone bob@mail.example.com onceonly")
    found = {r.doc_id: r for r in pii.personal_data(make_docs(rows)).collect()}
    texts = dict(rows)
    for i in range(4):
        marked = {texts[i][s.start : s.end] for s in found[i].spans if s.name == "term"}
        assert "Hydrologist" in marked and "spoke" in marked and "w0001x" not in marked
        assert [s for s in found[i].spans if s.name != "term"] == found[i].base
    assert [s.name for s in found[5].spans] == ["email"]  # one text alone is no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    assert "ann.lee" not in clean[0] and "[EMAIL]" in clean[0] and "Hydrologist" not in clean[0] and "[TERM]" in clean[0]
    assert clean[7] == texts[7]
    gone = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows), generalise=False).collect()}
    assert "[" not in gone[0] and "ann.lee" not in gone[0]


def test_terms_are_marked_wherever_they_stand(make_docs, rng):
    rows = [(i, " ".join(words(rng, 30, 60))) for i in range(100)]
    for i in range(3):
        rows[i] = (i, f"Zebulon {rows[i][1]} said zebulon z@x.org {i}")
    rows[3] = (3, f"Zebulon {rows[3][1]} then z@x.org")
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    for i in range(4):
        assert clean[i].startswith("[TERM] w") and "ebulon" not in clean[i]


def test_terms_reveal_kinds_and_issuers(make_docs, rng):
    """Every value occurs once; the words beside them give away the kind."""
    rows = [(i, " ".join(words(rng, 30, 60)) + " the token itself and so on") for i in range(200)]
    secret = lambda i: f"{i:02d}ab9c4d3e8f7061{rng.randrange(10**9):09d}ghij"
    for i in range(6):
        rows[i] = (i, f"w w passphrase = {secret(i)} and the the the the, later passphrase alone")
    for i in range(6, 9):
        rows[i] = (i, f"reach Zoë{chr(97 + i)} at Initech u{i}@initech.example and so on")
    rows[9] = (9, "passphrase without one")
    found = {r.doc_id: r for r in pii.personal_data(make_docs(rows)).collect()}
    for i in range(6):
        marked = [rows[i][1][s.start : s.end] for s in found[i].spans if s.name == "term"]
        assert marked == ["passphrase", "passphrase"] and [s.name for s in found[i].spans].count("secret") == 1 and not found[i].base
    for i in range(6, 9):
        marked = {rows[i][1][s.start : s.end] for s in found[i].spans if s.name == "term"}
        assert {"reach", "Initech"} <= marked and not any(m.startswith("Zo") for m in marked)
    assert found[9].spans == [] and all(found[i].spans == [] for i in range(10, 200))


def test_secrets_are_long_and_mixed(make_docs):
    texts = ["a" * 40, "1" * 40, "aaa111" * 5, "deadbeef00112233445566", "https://example.org/some-long-path/of-words/2024/page", "snake_case_names_are_no_secret_12"]
    found = {r.doc_id: [s.name for s in r.spans] for r in pii.personal_data(make_docs(list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(6)] == [[], [], [], ["secret"], [], []]


def test_long_texts_take_linear_time(make_docs):
    import time

    texts = ["12 x " * 300_000, (luhn(random.Random(1), 16) + " x ") * 20_000, "aa a1@b.co " * 20_000, "1 " * 300_000, "aa1" * 300_000]
    began = time.perf_counter()
    got = {r.doc_id: r.n for r in pii.personal_data(make_docs(list(enumerate(texts)))).select("doc_id", F.size("base").alias("n")).collect()}
    assert got == {0: 0, 1: 20_000, 2: 20_000, 3: 0, 4: 0}
    assert time.perf_counter() - began < 60


def test_personal_data_of_nothing(make_docs):
    assert pii.personal_data(make_docs([])).count() == 0 and pii.sanitise(make_docs([])).count() == 0
    clashing = make_docs([(1, "a@b.co"), (2, None)], clash=True)
    assert {r.text for r in pii.sanitise(clashing).collect()} == {"[EMAIL]", None} and pii.sanitise(clashing).columns == clashing.columns


# ---- pipeline


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    d = tmp_path_factory.mktemp("corpus")
    passage = " ".join(words(rng, 14, 10**6))
    rows, labels = {}, []
    for i in range(300):
        rows[i] = "\n".join(" ".join(words(rng, 25, 10**6)) for _ in range(rng.randrange(1, 5)))
        toxic = i % 6 == 0
        if toxic:
            rows[i] += "\nyou vileword and scumword"
        labels.append((i, 1, int(toxic)))
    rows[1000] = rows[1]  # an exact copy
    near = words(rng, 300, 10**6)
    rows[1001] = " ".join(near)
    near[7], near[150] = "other", "else"
    rows[1002] = " ".join(near)  # a near copy of one long line, two words apart
    rows[1003] = "Before it. " + passage.upper() + ". After it all " + " ".join(words(rng, 30, 10**6))
    rows[1004] = None
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows


def test_pipeline_stages(spark, corpus_dir):
    import corpus_pipeline

    d, rows = corpus_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/out-{k}")
        docs = spark.read.parquet(f"{d}/out-{k}")
        kept[name] = {r.doc_id for r in docs.collect()}
    everyone = set(rows)
    toxic = {i for i in range(300) if i % 6 == 0}
    assert kept["toxicity"] == everyone - toxic
    assert kept["line_dedup"] == everyone - toxic - {1000}
    assert kept["ngram_jaccard"] == everyone - toxic - {1000, 1002}
    assert kept["decontamination"] == everyone - toxic - {1000, 1002, 1003}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == kept["decontamination"]


def test_pipeline_brute_force(spark, sf, tok, tmp_path):
    """Every stage on the smallest tables against a plain version of it on the same input."""
    import corpus_pipeline

    stages, texts = dict(corpus_pipeline.STAGES), {}

    def after(name, docs):
        stages[name](spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        return out, {r.doc_id: r.text for r in out.collect()}

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    kind = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    docs, texts = after("toxicity", docs)
    assert texts == {i: t for i, t in whole.items() if not kind[i]}

    gone = dropped_lines(texts)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) if t and gone[i] else t for i, t in texts.items()}
    want = {i: t for i, t in want.items() if not gone[i] or t.split()}
    docs, texts = after("line_dedup", docs)
    assert texts == want and sum(map(len, gone.values())) > 20

    sets, links = jaccard_links(texts)
    least = roots(texts, links)
    docs, kept = after("ngram_jaccard", docs)
    assert kept == {i: t for i, t in texts.items() if least[i] == i}

    runs = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [clean_words(r.text)] for i in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(r) for r in runs}
    leaks = lambda w: any(tuple(w[i : i + n]) in runs for n in sizes for i in range(len(w) - n + 1))
    docs, clean = after("decontamination", docs)
    assert clean == {i: t for i, t in kept.items() if not leaks(clean_words(t))} and len(clean) < len(kept)

    pieces = defaultdict(list)
    for r in stages["packing"](spark, docs, sf).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == clean.keys()
    for i, t in clean.items():
        ids, at = [*tok(t), 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    places = defaultdict(list)
    for r in itertools.chain.from_iterable(pieces.values()):
        places[r.sequence_id].append((r.offset, r.length))
    for ps in places.values():
        ps.sort()
        assert [o for o, _ in ps] == [sum(n for _, n in ps[:k]) for k in range(len(ps))] and sum(n for _, n in ps) <= 2048


def test_pipeline_run(spark, corpus_dir):
    import corpus_pipeline

    d, rows = corpus_dir
    out = corpus_pipeline.run(spark, d)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids == set(rows) - {i for i in range(300) if i % 6 == 0} - {1000, 1002, 1003}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
