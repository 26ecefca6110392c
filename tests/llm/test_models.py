"""Learned operators: held-out quality, and what can be checked exactly."""

import collections
import math
import re
import zlib

from pyspark.sql import functions as F

from keelson.llm import lm, quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def test_language_model(spark, docs, corpus, nothing):
    tokens = {i: WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())) + [b" "] for i, t in corpus}
    c = collections.Counter(w for i, ws in tokens.items() if i is not None and not held(i, 7, 2) for w in ws)
    total, distinct = sum(c.values()), len(c)
    for known in (lm.KNOWN, 50):  # the second leaves most words to the join
        rows = lm.language_model(docs, known=known).collect()
        assert len(rows) == len(corpus)
        for r in rows:
            ws = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), total, held(r.doc_id, 7, 2))
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        unseen = [r for r in rows if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    empty = lm.language_model(nothing)
    assert empty.collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (3, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in lm.language_model(twice).collect()) == [(1, 2), (1, 3), (1, 3), (3, 1)]
    untrained = spark.createDataFrame([(next(i for i in range(99) if held(i, 7, 2)), "a b"), (None, "c")], "doc_id bigint, text string")
    assert [(r.n_known, r.train_tokens) for r in lm.language_model(untrained).collect()] == [(0, 0), (0, 0)]


def test_all_training_rows_are_learned_from(spark, monkeypatch):
    """With next to nothing in the first sample, what follows a word is still learned."""
    monkeypatch.setattr(lm, "CHUNK", 4096)
    text = " ".join(f"w{k}" for k in range(20)) + " "
    docs = spark.createDataFrame([(i, text * 20) for i in range(300)], "doc_id bigint, text string").repartition(2)
    rows = [r for r in lm.language_model(docs, train_tokens=1).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    import numpy as np

    model = lm.Model(np.array([50, 20, 10, 5, 5]), np.full(lm.TAIL, 3.0))
    model.train([np.array([1, 2, 3, 4, 0] * 40)] * 4, 0, 1000)
    state = np.tanh(np.random.default_rng(1).normal(0, 1, (3, lm.HIDDEN))).astype(np.float32)
    tokens = np.arange(lm.HEAD + lm.TAIL)
    for h in state:
        p = np.exp(model.log_probability(np.repeat(h[None], len(tokens), 0), tokens))
        assert abs(p.sum() - 1) < 1e-3


def test_state_is_carried_over_windows():
    import numpy as np

    model = lm.Model(np.arange(100, 0, -1), np.full(lm.TAIL, 3.0))
    rng = np.random.default_rng(2)
    long = [rng.integers(0, 100, n) for n in (1, 5, 64, 65, 700)]
    together = model.score(long, 0)
    assert all(math.isclose(model.score([d], 0)[0], x, rel_tol=1e-4) for d, x in zip(long, together, strict=True))
    # One step after another by hand.
    h, total, previous = np.zeros(lm.HIDDEN, np.float32), 0.0, 0
    for t in long[2]:
        x, u = model.inp[previous], h @ model.rec
        z, r = np.split(lm.sigmoid(x[: 2 * lm.HIDDEN] + u[: 2 * lm.HIDDEN]), 2)
        h = (1 - z) * np.tanh(x[2 * lm.HIDDEN :] + r * u[2 * lm.HIDDEN :]) + z * h
        total += model.log_probability(h[None], np.array([t]))[0]
        previous = t
    assert math.isclose(total, together[2], rel_tol=1e-4)


def test_texts_are_cut_once_for_learning_and_scoring(monkeypatch):
    import numpy as np
    import pyarrow as pa

    cut = []
    words_of = lm.words_of
    monkeypatch.setattr(lm, "words_of", lambda text: cut.append(text) or words_of(text))
    monkeypatch.setattr(lm, "CHUNK", 50)  # documents go over its end, and one is longer
    texts = ["b A a zz", None, "q zz\n b  zz", "a b " * 70]
    known, counts = [lm.END, b"a", b"b"], np.array([4, 9, 7])
    packed = (zlib.compress(b"\n".join(known)), zlib.compress(counts.tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([0] * 4), pa.array(texts)], names=["id", "th", "_text"])
    (got,) = lm.numberer(packed, np.full(lm.TAIL, 5.0).tobytes(), 20, 3)(iter([batch]))
    assert got.column("n_tokens").to_pylist() == [5, 1, 5, 141] and got.column("n_known").to_pylist() == [4, 1, 2, 141]
    assert [sorted((x["word"], x["n"]) for x in r) for r in got.column("rare").to_pylist()] == [[(b"zz", 1)], [], [(b"q", 1), (b"zz", 2)], []]
    zz, q = (lm.HEAD + lm.tail_class(w) for w in (b"zz", b"q"))
    inputs = [x.tolist() for x in lm.inputs_of(got.column("tokens"))]
    assert inputs == [[2, 1, 1, zz, 0], [0], [q, zz, 2, zz, 0], [1, 2] * 70 + [0]]

    model = lm.Model(counts, np.full(lm.TAIL, 4.0))
    (learned,) = lm.trainer(0, {n: getattr(model, n) for n in lm.Model.NAMES}, model.fresh_sums())(iter([got.select(["tokens"])]))
    assert learned.column("n").to_pylist()[0] == 152  # every token
    (scored,) = lm.scorer(model.pack(), 0)(iter([got.drop_columns(["rare"])]))
    assert np.allclose(scored.column("score").to_numpy() * math.log(10), model.score([np.array(x) for x in inputs], 0), rtol=1e-5)
    assert cut == texts


def test_gradients():
    """What a window learns is the slope of the score, also where a document starts within it and where logits are large."""
    import numpy as np

    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 90, n) for n in (20, 5, 15, 20, 1, 19, 20, 20, 20, 7, 13)]  # fills eight lanes of 20
    start = lm.Model(np.arange(90, 0, -1), np.full(lm.TAIL, 3.0))
    start.word = rng.normal(0, 0.3, start.word.shape).astype(np.float32)

    def moved(name, change):
        out = lm.Model.unpack(start.pack())
        for n in lm.Model.NAMES:
            setattr(out, n, getattr(out, n) + np.float32(change if n == name else 0))
        return out

    def slopes(shift):
        net = moved("cls_b", shift)
        before = {n: getattr(net, n).copy() for n in lm.Model.NAMES}
        # With such sums of squares a step is a hundredth of the gradient.
        net.train(documents, 0, 0, rate=1.0, seen={n: np.full_like(w, 1e4) for n, w in before.items()}, once=True)
        return {n: (before[n].astype(float) - getattr(net, n)) * 100 for n in before}

    found, large = slopes(0), slopes(200)
    for name, g in found.items():
        size = np.sqrt((g * g).sum())
        assert size > 0.01 and np.allclose(g, large[name], atol=0.01 * np.abs(g).max() + (0.002 if name == "cls_b" else 0))
        up, down = (sum(moved(name, sign * 0.02 * g / size).score(documents, 0)) for sign in (1, -1))
        assert math.isclose((down - up) / 8 / 0.04, size, rel_tol=0.03), name


def test_quality_classifier(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(out) > 40 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_edge_cases(spark, docs, corpus, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == len(corpus) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(40)] + [(4, 1), (4, None)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels, steps=200).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert quality.classify(nothing, labels).collect() == []
    moved = docs.withColumn("source", F.lit("elsewhere")).withColumn("doc_id", F.col("doc_id"))
    again = {r.doc_id: r.score for r in quality.classify(moved, labels, steps=200).collect()}
    assert all(math.isclose(again[r.doc_id], r.score) for r in rows)


def test_scores_equal_the_plain_forward_pass():
    """Mean of vectors, then softmax, from the strings themselves; and texts that are cut."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "be", "c", "déjà", "no", "no", "yes,", "漢字", "x" * 70]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "_text": texts, "_label": [i % 2 for i in range(len(texts))]})
    features = [r for b in quality.featurizer("doc_id")(iter([batch])) for r in b.column("features").to_pylist()]
    emb, out, bias = quality.learn([(i % 2, f) for i, f in enumerate(features)], steps=300)
    table = quality.Words((emb @ (out[1] - out[0])).astype(np.float32))
    got = quality.scores(texts, table, float(bias[1] - bias[0]))

    def bucket(word_or_gram, whole):
        h, owner, b = quality.subwords([word_or_gram])
        return h[0], b[: 1 if whole else None]

    for text, score in zip(texts, got, strict=True):
        words, rows = (text or "").split(), []
        for w in words:
            rows += bucket(w, False)[1].tolist()
        for a, b in zip(words, words[1:], strict=False):
            rows += quality.pair_buckets(np.array([bucket(a, True)[0]]), np.array([bucket(b, True)[0]])).tolist()
        mean = emb[rows].astype(np.float64).mean(0) if rows else np.zeros(quality.DIM)
        logits = out @ mean + bias
        assert abs(1 / (1 + np.exp(logits[0] - logits[1])) - score) < 1e-5


def test_pairs_across_cuts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    weights = np.random.default_rng(6).normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["a b c d " * 50, "", "e f", "g h a b " * 30]
    whole = quality.scores(texts, quality.Words(weights), 0.0)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(4), "_text": texts, "_label": [0] * 4})
    run = lambda: [r for b in quality.featurizer("doc_id")(iter([batch])) for r in b.column("features").to_pylist()]
    features, batches = run(), quality.batches
    monkeypatch.setattr(quality, "batches", lambda texts: batches(texts, 16))
    assert np.allclose(quality.scores(texts, quality.Words(weights), 0.0), whole) and run() == features
