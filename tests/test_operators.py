import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as tx
from lexigrid.functions import vectors as vx
from lexigrid.operators import alignment, cooc, counts, doc_vectors, encoders, learning, representations, sentences, training

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def one(spark, expr, **cols):
    frame = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return frame.select(expr.alias("v")).first()["v"]


def plain_tokens(text):
    out = []
    for word in text.split():
        for c in word:
            kind = unicodedata.category(c)[0] in "MPS"
            if out and out[-1][0] == kind and out[-1][2] == id(word):
                out[-1][1] += c
            else:
                out.append([kind, c, id(word)])
        out.append([None, "", None])
    return [t for k, t, _ in out if t]


def test_tokens_against_plain_python(spark):
    rng = random.Random(1)
    alphabet = list("abcé1,.!-'«☃$+日本ا") + list(WS) + ["é", "ab ", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.tokenize(F.col("text")).alias("t"), tx.split_words(F.col("text")).alias("s"), tx.strip(F.col("text")).alias("p")).collect()
    for r in rows:
        assert r["t"] == plain_tokens(r["text"])
        assert r["s"] == r["text"].split() and r["p"] == r["text"].strip()
    assert one(spark, tx.tokenize(F.lit(None).cast("string"))) == []


def test_grams_and_small_functions(spark):
    words = F.array(*[F.lit(w) for w in ("b", "a", "b")])
    assert one(spark, tx.ngrams(words, 2)) == [["b", "a"], ["a", "b"]]
    assert one(spark, tx.sorted_ngrams(words, 3)) == [["a", "b", "b"]]
    assert one(spark, tx.ngrams(words, 4)) == []
    assert one(spark, tx.label_prefix(F.lit("HUM:ind"))) == "HUM"
    assert one(spark, tx.normalize_sentence(F.lit(" See WWW.x.org -LRB- @Bob http://a.b/c "))) == "see <url> -lrb- <user> <url>".replace("-lrb-", "(")
    ids = F.array(*[F.lit(k).cast("bigint") for k in (5, 6)])
    assert one(spark, tx.pad(ids, 4)) == [5, 6, 0, 0] and one(spark, tx.pad_left(ids, 3)) == [0, 5, 6] and one(spark, tx.mask(ids, 3)) == [1, 1, 0]
    assert one(spark, tx.ceil_to_step(F.lit(65), 64)) == 128
    assert one(spark, tx.ascii_fold(F.col("t")), t="Ünï ﬁ ☃") == "Uni fi "
    assert bytes(one(spark, tx.utf8_bytes(F.col("t")), t=" a&amp;b\nc ")) == b"\n a&b c "


def test_vectors(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vx.unit(lit([3, 4]))) == [0.6, 0.8] and one(spark, vx.unit(lit([0, 0]))) == [0.0, 0.0]
    assert one(spark, vx.cosine(lit([1, 0]), lit([0, 0]))) == 0.0 and one(spark, vx.cosine(lit([1, 1]), lit([2, 2]))) == pytest.approx(1)
    assert one(spark, vx.pair_features(lit([1, 2]), lit([3, 1]))) == [2, 1, 3, 2]
    a, b, c = np.random.default_rng(0).normal(size=(3, 8))
    assert one(spark, vx.compose_mult([lit(a), lit(b), lit(c)])) == pytest.approx(list(a * b * c * 8))
    want = np.real(np.fft.ifft(np.fft.fft(a) * np.fft.fft(b) * np.fft.fft(c)))
    assert one(spark, vx.compose_conv([lit(a), lit(b), lit(c)])) == pytest.approx(list(want))
    assert one(spark, vx.nan_to_zero(lit([float("nan"), float("inf"), 1]))) == [0.0, 1.7976931348623157e308, 1.0]
    drawn = np.array([r[0] for r in spark.range(400).select(vx.random_vector(F.col("id"), 16)).collect()])
    assert abs(drawn.mean()) < 0.02 and abs(drawn.std() - 0.25) < 0.01
    assert set(np.abs(np.array(one(spark, vx.random_vector(F.lit("w"), 9, "rademacher")))).round(9)) == {round(1 / 3, 9)}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_vocabularies(spark):
    d = docs(spark, ["b a b", "", "c a b", None, "d"])
    assert [tuple(r) for r in counts.corpus_vocabulary(d).orderBy("id").collect()] == [("b", 3, 0), ("a", 2, 1), ("c", 1, 2), ("d", 1, 3)]
    assert [tuple(r) for r in counts.corpus_vocabulary(d, min_count=2).orderBy("id").collect()] == [("b", 3, 0), ("a", 2, 1)]
    assert [tuple(r) for r in counts.top_vocabulary(d, 4, 2).orderBy("id").collect()] == [("b", 3, 2), ("a", 2, 3)]
    assert counts.corpus_vocabulary(docs(spark, [])).collect() == []
    many = docs(spark, [f"w{k % 700}" for k in range(2000)])
    assert sorted(r["id"] for r in counts.corpus_vocabulary(many).collect()) == list(range(700))


@pytest.mark.parametrize("window,small", [(1, True), (3, False), (10, True), (10, False), (25, True), (25, False)])
def test_cooccurrence_against_brute_force(spark, window, small, monkeypatch):
    monkeypatch.setattr(cooc, "BLOCK", 32)
    monkeypatch.setattr(cooc, "TOKENS", 50)
    monkeypatch.setattr(cooc, "is_small", lambda *a: small)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgxyz") for _ in range(n)) for n in (0, 1, 5, 200, 64, 33)]
    vocabulary = counts.corpus_vocabulary(docs(spark, ["a a a b b c d e f g"]))
    ids = {r["word"]: r["id"] for r in vocabulary.collect()}
    want, plain = Counter(), Counter()
    for t in texts:
        w = t.split()
        for p in range(len(w)):
            for d in range(1, window + 1):
                if p >= d and w[p] in ids and w[p - d] in ids:
                    k = tuple(sorted((ids[w[p]], ids[w[p - d]])))
                    want[k] += 1 / d
                    plain[k] += 1
    got = {(r["i"], r["j"]): r["x"] for r in cooc.cooccurrence(docs(spark, texts), vocabulary, window).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    found = cooc.cooccurrence(docs(spark, texts), vocabulary, window, unweighted=True)
    assert {(r["i"], r["j"]): r["x"] for r in found.collect()} == plain
    n = Counter()
    for i, j in plain:
        for a, b in {(i, j), (j, i)}:
            n[a] += 1
            n[b] += 1
    assert {r["i"]: r["n"] for r in cooc.nonzeros(found).collect()} == n


def test_a_large_vocabulary_is_paired_in_rows_and_symmetric_reads_once(spark, monkeypatch):
    words = spark.range(1_200_000).select(F.concat(F.lit("w"), "id").alias("word"), "id", F.lit(5).alias("count"))
    lines = docs(spark, ["w3 w1199999 w3", "w3 q w1199999"])
    found = cooc.cooccurrence(lines, words, 2)
    assert sorted(tuple(r) for r in found.collect()) == [(3, 3, 0.5), (3, 1199999, 2.5)]
    both = cooc.symmetric(found)
    assert "Join" not in both._jdf.queryExecution().executedPlan().toString()
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one to pair, one to add up
    assert sorted(tuple(r) for r in both.collect()) == [(3, 3, 0.5), (3, 1199999, 2.5), (1199999, 3, 2.5)]
    assert sorted(tuple(r) for r in cooc.row_totals(lines, words, 2).collect()) == [(3, 3.0), (1199999, 2.5)]


def test_sums_in_many_parts_and_turns(spark, monkeypatch):
    monkeypatch.setattr(cooc, "TOKENS", 50)
    monkeypatch.setattr(cooc, "_parts", lambda *a: 3)
    rng = random.Random(5)
    lines = docs(spark, [" ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(150)) for _ in range(8)])
    vocabulary = counts.corpus_vocabulary(lines)
    want = {(r["i"], r["j"]): r["x"] for r in cooc.cooccurrence(lines, vocabulary).collect()}
    blobs = [cooc._pack(np.arange(5) * k, np.arange(1, 6) << 40) for k in (1, 300)]
    assert all((a == b).all() for k, blob in zip((1, 300), blobs) for a, b in zip(cooc._unpack(blob), (np.arange(5) * k, np.arange(1, 6) << 40)))
    key, total = cooc._added(np.array([7, 1 << 60, 7]), np.array([1 << 50, 3, 1]))
    assert key.tolist() == [7, 1 << 60] and total.tolist() == [(1 << 50) + 1, 3]
    monkeypatch.setattr(cooc, "_parts", lambda *a: 1)
    monkeypatch.setattr(cooc, "SUMS", 50)
    assert {(r["i"], r["j"]): r["x"] for r in cooc.cooccurrence(lines, vocabulary).collect()} == want
    totals = Counter()
    for (i, j), x in want.items():
        for k in {i, j}:
            totals[k] += x
    got = {r["i"]: r["total"] for r in cooc.row_totals(lines, vocabulary).collect()}
    assert got.keys() == totals.keys() and all(math.isclose(got[k], totals[k]) for k in got)


@pytest.mark.parametrize("rows_held", [4, 1000])
def test_context_vectors_without_pairs_and_loss_without_joins(spark, rows_held, monkeypatch):
    monkeypatch.setattr(cooc, "ROWS_HELD", max(rows_held, 40))
    rng = random.Random(7)
    lines = docs(spark, [" ".join(f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(n)) for n in (0, 1, 3, 90, 700, 33)] + [None])
    vocabulary = counts.corpus_vocabulary(lines).where("id < 40")
    own = spark.createDataFrame([(k, [rng.random() for _ in range(3)]) for k in range(0, 40, 3)] + [(99, [1.0, 1.0, 1.0])], "id long, vec array<double>")
    found = cooc.cooccurrence(lines, vocabulary, 4)
    want = {r["i"]: r["vec"] for r in alignment.context_vectors(found, own).collect()}
    made = alignment.corpus_context_vectors(lines, vocabulary, own, 4)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["vec"] for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    few = {r["i"]: r["vec"] for r in alignment.corpus_context_vectors(lines, vocabulary, own, 4, only=own).collect()}
    assert few.keys() == want.keys() & set(range(0, 40, 3)) and all(np.allclose(few[k], want[k]) for k in few)
    state = own.select("id", F.concat("vec", "vec", F.array(F.lit(0.1), F.lit(0.2))).alias("state"))
    held = training.loss(found, state, 3)
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(training, "is_small", lambda *a: False)
    assert held.first()[0] == pytest.approx(training.loss(found, state, 3).first()[0])


def test_document_vectors_are_summed_in_rows(spark, monkeypatch):
    from lexigrid.functions import batches

    rng = random.Random(9)
    lines = docs(spark, [" ".join(rng.choice(["a", "B", "c,", "d", "x"]) for _ in range(n)) for n in (0, 1, 2, 50, 9)] + [None])
    _, v = vectors(spark, ["a", "b", "c", "d", ","])
    weights = spark.createDataFrame([("a", 0.5), ("c", 3.0)], "word string, weight double")
    low = F.lower(F.col("text"))

    def made():
        yield doc_vectors.document_vectors(lines, low, v, 4, weights=weights, split=batches.tokens)
        yield doc_vectors.document_vectors(lines, tx.tokenize(low), v, 4, weights=weights, average=True)
        yield doc_vectors.document_vectors(lines, low, v, 4, average=True, split=batches.words)
        for kind in ("mult", "conv"):
            yield doc_vectors.composed_vectors(lines, v, 3, kind, 4)

    rows = list(made())
    assert all(" Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in rows)
    got = [{r["doc_id"]: r["vec"] for r in f.collect()} for f in rows]
    monkeypatch.setattr(doc_vectors, "is_small", lambda *a: False)
    for own, f in zip(got, made()):
        want = {r["doc_id"]: r["vec"] for r in f.collect()}
        assert own.keys() == want.keys() and all(np.allclose(own[k], want[k]) for k in want)


def test_grams_are_counted_in_batches(spark):
    rng = random.Random(15)
    lines = docs(spark, [" ".join(rng.choice(["a", "B!", "\u00e9", "z", "\U0001f600q"]) for _ in range(n)) for n in (0, 1, 2, 60, 9)] + [None])
    for k in (1, 2, 3):
        for ordered in (True, False):
            tokens = tx.tokenize(F.lower(F.col("text")))
            grams = tx.ngrams(tokens, k) if ordered else tx.sorted_ngrams(tokens, k)
            found = counts.gram_counts(lines, k, ordered)
            assert " Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            want = sorted(map(tuple, counts.document_counts(lines, F.transform(grams, tx.gram_text)).collect()))
            assert sorted(map(tuple, found.collect())) == want
    twice = spark.createDataFrame([(1, "a b"), (1, "a")], "doc_id long, text string")
    assert sorted(map(tuple, counts.gram_counts(twice, 1).collect())) == [(1, "a", 2), (1, "b", 1)]


def test_words_and_tokens_of_batches_are_those_of_columns(spark):
    import pyarrow as pa

    from lexigrid.functions import batches

    texts = ["", None, " a\u00a0b, c!?d ", "\u2003x\x1cy\x85z", "q\u2ffcr \u31ef!", "e\u0301t\u00e9 $5.00\n", "\ud7ff\U0001f600\U0001f600 a_b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.split_words(F.col("text")), tx.tokenize(F.col("text"))).collect()
    for k, split in enumerate((batches.words, batches.tokens)):
        length, flat = split(pa.chunked_array([pa.array(texts)]))
        assert length.tolist() == [len(r[k]) for r in rows] and flat.to_pylist() == [w for r in rows for w in r[k]]


def vectors(spark, words, d=4, seed=3):
    rng = np.random.default_rng(seed)
    table = {w: rng.normal(size=d) for w in words}
    return table, spark.createDataFrame([(w, list(map(float, v))) for w, v in table.items()], "word string, vec array<double>")


def test_document_vectors_and_representations(spark):
    table, v = vectors(spark, ["a", "b", "c", "!"])
    texts = ["A b a", "", "zzz", "c ! b!", "b"]
    d = docs(spark, texts)
    tokens = [plain_tokens(t.lower()) for t in texts]
    zero = np.zeros(4)

    def check(frame, want):
        got = {r["doc_id"]: r["vec"] for r in frame.collect()}
        assert sorted(got) == list(range(len(want)))
        for k, w in enumerate(want):
            assert got[k] == pytest.approx(list(w), abs=1e-9)

    total = lambda ts, w=lambda t: 1.0: sum((w(t) * table.get(t, zero) for t in ts), zero)
    check(representations.WeightedSum(v, 4, a=None).fit(d).transform(d), [total(t) for t in tokens])
    check(representations.WeightedSum(v, 4, a=None, average=True).fit(d).transform(d), [total(t) / max(1, len(t)) for t in tokens])
    seen = Counter(t for k in (0, 3) for t in tokens[k])
    at = 0.1 * sum(seen.values())
    train = d.where("doc_id in (0, 3)")
    check(representations.WeightedSum(v, 4, a=0.1).fit(train).transform(d), [total(t, lambda w: at / (at + seen[w]) if w in seen else 1.0) for t in tokens])
    for composition in ("mult", "conv"):
        def compose(gram):
            if any(w not in table for w in gram):
                return zero
            x, y = (table[w] for w in gram)
            return x * y * 2 if composition == "mult" else np.real(np.fft.ifft(np.fft.fft(x) * np.fft.fft(y)))

        want = [np.concatenate([total(t), sum((compose(g) for g in zip(t, t[1:])), zero) / 2]) for t in tokens]
        check(representations.Composed(v, 4, 2, composition).fit(d).transform(d), want)
    for ordered in (True, False):
        rep = representations.BagOfGrams(2, ordered=ordered).fit(train)
        shape = (lambda g: g) if ordered else (lambda g: tuple(sorted(g)))
        grams = lambda t: [(w,) for w in t] + [shape(g) for g in zip(t, t[1:])]
        known = sorted({g for k in (0, 3) for g in grams(tokens[k])}, key=lambda g: (len(g), g))
        want = {(k, known.index(g)): n for k, t in enumerate(tokens) for g, n in Counter(grams(t)).items() if g in known}
        assert {(r["doc_id"], r["feature_id"]): r["value"] for r in rep.transform(d).collect()} == want
    matrix = doc_vectors.vocabulary_matrix(spark.createDataFrame([("a", 0), ("q", 1)], "word string, id long"), v, 4)
    got = {r["id"]: r["vec"] for r in matrix.collect()}
    assert got[0] == pytest.approx(list(table["a"] / np.linalg.norm(table["a"]))) and got[1] == [0.0] * 4


def test_alignment_against_numpy(spark):
    words = [f"w{k}" for k in range(40)]
    a, va = vectors(spark, words)
    rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(4, 4)))[0]
    moved = {w: rotation @ x + 0.5 for w, x in a.items()}
    vb = spark.createDataFrame([(w, list(map(float, x))) for w, x in moved.items() if w != "w0"] + [("zz", [1.0] * 4)], "word string, vec array<double>")
    pairs = doc_vectors.shared_vocabulary(va, vb)
    m, b = alignment.fit_transform(pairs, orthogonal=True, fit_intercept=True)
    assert np.allclose(m, rotation) and np.allclose(b, 0.5) and np.allclose(m.T @ m, np.eye(4))
    assert alignment.linear_alignment(va, vb, True, True) == pytest.approx(1)
    x, y = (np.array([t[w] for w in words[1:]]) for t in (a, moved))
    m, _ = alignment.fit_transform(pairs, orthogonal=False)
    assert np.allclose(m.T, np.linalg.lstsq(x, y, rcond=None)[0])
    extra = spark.createDataFrame([("w0", [9.0] * 4), ("a_b", [1.0] * 4), ("new", [1.0, 2.0, 3.0, 4.0])], "word string, vec array<double>").unionByName(va.where("word <> 'w0'"))
    got = {r["word"]: r["vec"] for r in alignment.expand_vocabulary(vb, extra).collect()}
    assert "a_b" not in got and got["w1"] == pytest.approx(list(moved["w1"])) and got["new"] == pytest.approx(list(rotation @ [1, 2, 3, 4] + 0.5))
    aligned = {r["word"]: r["vec"] for r in doc_vectors.align_parameters(va, spark.createDataFrame([("w3",), ("none",)], "word string")).collect()}
    assert aligned["none"] == pytest.approx(list(np.mean(list(a.values()), axis=0))) and aligned["w3"] == pytest.approx(list(a["w3"]))


def test_induction_against_numpy(spark):
    rng = np.random.default_rng(6)
    n, d = 12, 3
    x = np.triu(rng.integers(0, 5, (n, n))).astype(float)
    full = x + np.triu(x, 1).T
    w = rng.normal(size=(n, d))
    triples = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(n) for j in range(i, n) if x[i, j]], "i long, j long, x double")
    names = [f"w{k}" for k in range(n)]
    source = spark.createDataFrame(list(zip(names, range(n))), "word string, id long")
    vecs = spark.createDataFrame([(k, list(map(float, w[k]))) for k in range(n)], "id long, vec array<double>")
    target_names = [*names[:8], "new1", "new2"]
    t = np.triu(rng.integers(0, 3, (10, 10))).astype(float)
    t[:, 9] = 0
    t[8:, 8:] = 0
    ttriples = spark.createDataFrame([(int(i), int(j), float(t[i, j])) for i in range(10) for j in range(i, 10) if t[i, j]], "i long, j long, x double")
    target = spark.createDataFrame(list(zip(target_names, range(10))), "word string, id long")
    got = {r["id"]: r["vec"] for r in alignment.induce_embeddings(source, triples, vecs, target, ttriples).collect()}
    u = full @ w / full.sum(1, keepdims=True)
    m = np.linalg.lstsq(u, w, rcond=None)[0]
    tf = (t + np.triu(t, 1).T)[:, :8]
    for k in range(10):
        want = (tf[k] @ w[:8] / tf[k].sum()) @ m if tf[k].sum() else np.zeros(d)
        assert got[k] == pytest.approx(list(want), abs=1e-8)


def test_sentences(spark):
    lines = ["a b", "c", "", "d e f", "g", "h " * 30, "i", "j", "k"]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "file string, line_no long, text string")
    assert [(r["line_no"], r["pre"], r["current"], r["post"]) for r in sentences.triples(rows).collect()] == [(7, ["i"], ["j"], ["k"])]
    assert tuple(sentences.triple_stats(sentences.judged_triples(rows)).first()) == (9, 4, 3, 1)
    known = spark.createDataFrame([("a", 2), ("b", 3)], "word string, id long")
    got = {r["line_no"]: r["ids"] for r in sentences.encode(rows, ["line_no"], tx.split_words(F.col("text")), known, eos=0).collect()}
    assert got[0] == [2, 3, 0] and got[1] == [1, 0] and got[2] == [0]
    assert sentences.shard_borders(10, 3) == [0, 3, 6, 10] and sentences.shard_name("train", 3, 100) == "train-00003-of-00100"
    shards = Counter(r["shard"] for r in sentences.with_shards(spark.range(10).withColumnRenamed("id", "row_id"), 10, 3).collect())
    assert shards == {0: 3, 1: 3, 2: 4}
    split = Counter(r["split"] for r in sentences.permuted_split(rows, "line_no", 4).collect())
    assert split == {"validation": 4, "train": 5}
    encoded = spark.createDataFrame([(k, list(range(1, k + 2))) for k in range(5)], "k long, ids array<bigint>")
    padded = sentences.padded_batches(encoded, [F.asc("k")], 2).collect()
    assert all(len(r["ids"]) == len(r["mask"]) == {0: 2, 1: 4, 2: 5}[r["batch"]] and sum(r["mask"]) == r["k"] + 1 for r in padded)
    assert Counter(r["split"] for r in sentences.head_tail_split(rows, [F.asc("line_no")], 3).collect()) == {"validation": 3, "train": 6}
    assert [r["line_no"] for r in sentences.first_sentences(rows, [F.asc("line_no")], 2).orderBy("line_no").collect()] == [0, 1]
    batch = spark.createDataFrame([(0, k, v, v) for k, v in enumerate(([1.0, 0.0], [0.9, 0.1], [0.0, 1.0]))], "batch long, pos long, left_vec array<double>, right_vec array<double>")
    scores = {(r["p"], r["q"]): (round(r["score"], 6), r["target"]) for r in sentences.context_scores(batch).collect()}
    assert scores[0, 0] == (0.0, False) and scores[0, 1] == (0.9, True) and scores[0, 2] == (0.0, False)
    # best scores: row 0 -> 1, row 1 -> 0, row 2 -> 1; so one of two next rows and both previous rows are found
    assert tuple(sentences.retrieval_accuracy(sentences.context_scores(batch)).first()) == (0.5, 1.0)


def test_scores_folds_and_ridge(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(31)], "doc_id long, label string")
    for f in (learning.exact_folds,):
        sizes = Counter((r["label"], r["fold"]) for r in f(rows, 4).collect())
        for c in "xy":
            own = [sizes[c, k] for k in range(4)]
            assert max(own) - min(own) <= 1
    assert learning.exact_folds(rows.limit(0), 4).collect() == []
    many = spark.createDataFrame([(k, [float(k)]) for k in range(50)], "label int, centroid array<double>")
    near = spark.createDataFrame([(k, [k + 0.3]) for k in range(49)] + [(60, [7.5])], "doc_id int, vec array<double>")
    for at_once in (5000, 7):
        monkeypatch.setattr(learning, "CENTERS_AT_ONCE", at_once)
        assert {r["doc_id"]: r["prediction"] for r in learning.nearest_centroid(near, many, "doc_id").collect()} == {k: k for k in range(49)} | {60: 7}
    xs, ys = [1.0, 2.0, 2.0, 5.0, 4.0], [3.0, 1.0, 4.0, 9.0, 9.0]
    got = learning.correlations(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "x", "y").first()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert got["pearson"] == pytest.approx(100 * np.corrcoef(xs, ys)[0, 1]) and got["spearman"] == pytest.approx(100 * np.corrcoef(rank(xs), rank(ys))[0, 1])
    judged = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "prediction int, label int")
    assert learning.accuracy(judged).first()[0] == pytest.approx(60) and learning.f1(judged).first()[0] == pytest.approx(100 * 4 / 6)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    y = x @ [1, -2, 0.5] + 3
    w, b, _ = learning.ridge(spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "features array<double>, label double"), alphas=(1e-6,))
    assert np.allclose(w, [1, -2, 0.5], atol=1e-3) and abs(b - 3) < 1e-3


@pytest.mark.parametrize("classifier", [learning.Centroid, lambda: learning.Logistic(grid=(1.0,))])
def test_evaluation(spark, classifier):
    _, v = vectors(spark, ["good", "bad", "film", "it"], 4)
    rng = random.Random(8)
    texts = [("good" if k % 2 else "bad", " ".join(rng.choice(["film", "it", "good" if k % 2 else "bad"]) for _ in range(6)) + (" good" if k % 2 else " bad")) for k in range(40)]
    rows = spark.createDataFrame([(k, t, c) for k, (c, t) in enumerate(texts)], "doc_id long, text string, label string")
    scores = learning.evaluate("split", {"train": rows.where("doc_id < 30"), "test": rows.where("doc_id >= 30")}, representations.WeightedSum(v, 4, a=None), classifier)
    assert scores["train"] >= 80 and scores["test"] >= 70
    with pytest.raises(NotImplementedError):
        learning.evaluate("pairs of pairs", {"train": rows.select("doc_id", F.col("text").alias("text1"), F.col("text").alias("text2"), "label"), "test": rows.select("doc_id", F.col("text").alias("text1"), F.col("text").alias("text2"), "label")}, representations.WeightedSum(v, 4, a=None))


def triples_of_rank(spark, n=30, d=3):
    rng = np.random.default_rng(9)
    w = rng.normal(size=(n, d)) * 0.5
    logs = w @ w.T + 1.0
    return spark.createDataFrame([(i, j, float(np.exp(logs[i, j]))) for i in range(n) for j in range(i, n)], "i long, j long, x double"), w


def test_batches_and_rounds_cover_all():
    rng = np.random.default_rng(10)
    i, j = rng.integers(0, 50, (2, 500))
    own = training.batches(i, j)
    assert sorted(np.concatenate(own).tolist()) == list(range(500))
    pairs = set(zip(i.tolist(), j.tolist()))
    i, j = np.array(sorted(pairs)).T
    for at in training.batches(i, j):
        if (i[at] != j[at]).all():
            both = np.concatenate([i[at], j[at]])
            assert len(set(both.tolist())) == len(both)
    seen = [p for r in training.rounds(8) for p in r]
    assert len(seen) == len(set(seen)) == 28 and all(len({b for p in r for b in p}) == 8 for r in training.rounds(8))


@pytest.mark.parametrize("apart", [False, True])
def test_a_word_of_every_entry_makes_few_batches(apart):
    block = np.random.default_rng(13).integers(4, 6, 300) * 3
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    made = training.batches(i, j, block, apart)
    assert sorted(np.concatenate(made).tolist()) == list(range(90_000))
    assert len(made) <= (2 if apart else 5) * max(np.bincount(block // 3)[4:])
    for at in made:
        if apart:
            assert len(set(i[at])) == len(at) == len(set(j[at]))
        else:
            both = np.concatenate([i[at], j[at][i[at] != j[at]]])
            assert len(set(both.tolist())) == len(both)


@pytest.mark.parametrize("adagrad", [False, True])
def test_a_batch_apart_is_its_entries_one_by_one(adagrad):
    rng, d = np.random.default_rng(14), 3
    i, j = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
    weight, log_x, start = rng.random(144), rng.normal(size=144), rng.normal(size=(12, training.GloveRule.size(3)))
    made, runs = training.batches(i, j, np.arange(12) % 2, True), []
    for cut in (made, [np.array([k]) for at in made for k in at]):
        p, acc = start.copy(), np.ones_like(start)
        for at in cut:
            training.GloveRule.step(p, acc, i[at], j[at], weight[at], log_x[at], d, 0.05, adagrad, 0.0, None, None, [0.0])
        runs.append(p)
    assert np.allclose(*runs)


@pytest.mark.parametrize("model,method,eta", [("glove", "adagrad", None), ("glove", "sgd", 0.05), ("sn", "adagrad", None)])
def test_training_lowers_the_loss(spark, model, method, eta):
    found, w = triples_of_rank(spark)
    trainer = training.WordVectorTrainer(4, model, method, epochs=3, eta=eta, blocks=2)
    out = trainer.fit(found, 30)
    assert trainer.losses[-1] < 0.8 * trainer.losses[0] and out.count() == 30
    if model == "glove":
        assert training.loss(found, trainer.state, 4).first()[0] < trainer.losses[0]


@pytest.mark.parametrize("rule", [training.GloveRule, training.SnRule])
@pytest.mark.parametrize("adagrad", [False, True])
def test_a_batch_is_its_entries_one_by_one(rule, adagrad):
    rng = np.random.default_rng(11)
    i, j = rng.permutation(40).reshape(2, 20)
    weight, log_x, d = rng.random(20), rng.normal(size=20), 3
    start, share, src = rng.normal(size=(40, rule.size(d))), rng.random(40) + 1, rng.normal(size=(40, d))
    runs = []
    for cut in ([np.arange(20)], [np.array([k]) for k in range(20)]):
        p, acc, bias = start.copy(), np.ones_like(start), [0.3]
        loss = sum(rule.step(p, acc, i[at], j[at], weight[at], log_x[at], d, 0.1, adagrad, 0.5, src, share, bias) for at in cut)
        runs.append((p, bias[0], loss))
    assert np.allclose(runs[0][0], runs[1][0]) and np.isclose(runs[0][1], runs[1][1]) and np.isclose(runs[0][2], runs[1][2])


def test_blocks_follow_the_size_and_sources_must_be_whole(spark):
    assert [training.block_count(*x) for x in ((10, 10), (60_000, 10), (10, 10**9), (10**6, 10**6))] == [2, 4, 64, 50]
    found, _ = triples_of_rank(spark, 6)
    source = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(5)], "id long, vec array<double>")
    with pytest.raises(ValueError):
        training.WordVectorTrainer(2, epochs=1, source=source).fit(found, 6)


def test_repeated_identifiers_are_refused(spark):
    _, v = vectors(spark, ["a", "b"])
    twice = spark.createDataFrame([(1, "a b"), (1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        doc_vectors.document_vectors(twice, F.split("text", " "), v, 4)
    with pytest.raises(ValueError):
        sentences.encode(twice, ["doc_id"], F.split("text", " "), v.select("word", F.lit(3).alias("id")))


def test_masks_and_brackets_of_whole_tokens(spark):
    texts = ["http://x.y/z\u00a0then and", "a -LRB- x-LRB-y -RSB-", " WWW.a\x0bhtt://q b @me\u2003you ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.normalize_sentence(F.col("text")).alias("t"), tx.mask_users(tx.mask_urls(F.col("text"))).alias("m"))
    assert [r["t"] for r in rows.collect()] == ["<url> then and", "a ( x-lrb-y ]", "<url> <url> b <user> you", ""]
    assert [r["m"] for r in rows.collect()][:3] == ["<url>\u00a0then and", "a -LRB- x-LRB-y -RSB-", " WWW.a\x0b<url> b <user>\u2003you "]


def test_ridge_leaves_one_out(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(25, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=25) * 2
    loss = {}
    for a in learning.C_GRID:
        total = 0.0
        for k in range(25):
            own, t = np.delete(x, k, 0), np.delete(y, k)
            mean = own.mean(0)
            w = np.linalg.solve((own - mean).T @ (own - mean) + a * np.eye(3), (own - mean).T @ (t - t.mean()))
            total += (y[k] - t.mean() - (x[k] - mean) @ w) ** 2
        loss[a] = total
    rows = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y)], "features array<double>, label double")
    w, b, best = learning.ridge(rows)
    assert best == min(loss, key=loss.get)
    mean = x.mean(0)
    assert np.allclose(w, np.linalg.solve((x - mean).T @ (x - mean) + best * np.eye(3), (x - mean).T @ (y - y.mean())))


def test_regularised_training_stays_nearer_its_source(spark):
    found, w = triples_of_rank(spark, 16)
    source = spark.createDataFrame([(k, [5.0, 5.0, 5.0]) for k in range(16)], "id long, vec array<double>")
    far = []
    for reg in (0.001, 5.0):
        out = training.WordVectorTrainer(3, epochs=2, blocks=2, source=source, reg=reg).fit(found, 16).collect()
        far.append(np.mean([np.linalg.norm(np.array(r["vec"]) - 5.0) for r in out]))
    assert far[1] < far[0]


def test_encoder_registry(spark):
    rows = spark.createDataFrame([("a b",), (None,), ("q",)], "text string")
    out = encoders.encode(rows, "bow", words={"a": [3.0, 0.0], "b": [0.0, 4.0]}, dimension=2).collect()
    assert out[0]["vec"] == pytest.approx([0.6, 0.8]) and out[1]["vec"] == [0.0, 0.0]
    with pytest.raises(NotImplementedError):
        encoders.encode(rows, "mlstm")
