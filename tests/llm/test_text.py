"""Tokenizer operators, license scans, decontamination, and the pipeline."""

import os
import random

import numpy as np
import pytest
from support import DATA, same

from keelson.llm import catalog, decontaminate, licenses, piece_codec, token_counts, unigram

SMALL = unigram.make_vocabulary([(300 + k, p, -0.5 * k - 1) for k, p in enumerate(["▁", "▁▁", "▁t", "th", "▁the", "e", "er", "ed", "in", "t", "h", "n", "d", "a", "o", "on", "ion", "▁a", "."])], list(range(256)), 400)


def voc():
    return unigram.load_vocabulary(catalog.VOCABULARY) if os.path.exists(catalog.VOCABULARY) else SMALL


def test_best_segmentation_by_brute_force():
    def every(text):
        if not text:
            yield 0
            return
        for j in range(1, len(text) + 1):
            hit = SMALL.pieces.get(text[:j])
            score = hit[1] if hit else len(text[0].encode()) * SMALL.byte_score if j == 1 else None
            if score is not None:
                for rest in every(text[j:]):
                    yield score + rest

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(" thedinao.é") for _ in range(rng.randrange(1, 9)))
        assert unigram.segment(text, SMALL)[0] == max(every(text))


@pytest.mark.parametrize("vocabulary", [SMALL, None])
def test_bulk_and_trie_equal_plain(vocabulary):
    v = vocabulary or voc()
    rng = random.Random(4)
    words = list({"".join(rng.choice(" etaoinshrdlu.,éß漢😀\n▁\0") for _ in range(rng.randrange(1, 60))) for _ in range(1500)} | set(list(v.pieces)[:500]))
    scores, sizes, ids = unigram.BulkSegmenter(v)(words)
    counts, at = token_counts.Trie(v).counts(words), 0
    for w, s, n in zip(words, scores, sizes, strict=True):
        assert unigram.segment(w, v) == (s, ids[at : at + n].tolist()) and counts[w] == n
        at += n


def test_transfer_matrices_combine_associatively():
    rng = random.Random(5)
    text = "".join(rng.choice("the edion a") for _ in range(60))
    encode = piece_codec.Encoder(SMALL)
    parts = [(text[a : a + 15 + SMALL.longest], min(15, len(text) - a)) for a in range(0, len(text), 15)]
    m = [piece_codec.transfer(t, n, encode) for t, n in parts]
    left = piece_codec.combine(piece_codec.combine(piece_codec.combine(m[0], m[1]), m[2]), m[3])
    right = piece_codec.combine(m[0], piece_codec.combine(m[1], piece_codec.combine(m[2], m[3])))
    assert (left == right).all() and left[0, 0] == unigram.segment(text, SMALL)[0]
    score, states = piece_codec.scan(m)
    ids = [i for (t, n), a, b in zip(parts, states, states[1:], strict=False) for i in piece_codec.backtrace(t, n, a, b, encode)]
    assert score == left[0, 0] and b"".join(SMALL.decoded[i] for i in ids).decode() == text


def test_codec_round_trips(docs, corpus, nothing):
    v, texts = voc(), dict(corpus)
    whole = {r.doc_id: r for r in piece_codec.encode(docs, v).collect()}
    cut = piece_codec.encode(docs, v, chunk=300)
    chunked = {r.doc_id: r for r in cut.collect()}
    assert len(whole) == len(chunked) == len(corpus)
    for i, t in texts.items():
        assert whole[i].round_trip and chunked[i].round_trip and whole[i].n_tokens == len(whole[i].ids)
        assert whole[i].score == chunked[i].score == (unigram.segment(" " + t, v)[0] if t else 0)
    assert {r.doc_id: r.text for r in piece_codec.decode(cut, v).collect()} == {i: t or "" for i, t in texts.items()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, v).collect()}
    assert counts == {i: r.n_tokens for i, r in whole.items()}
    assert piece_codec.encode(nothing, v).collect() == [] and token_counts.token_counts(nothing, v).collect() == []


def test_licenses(spark, nothing):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c.py", "x"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "z.py", None),
        (5, None, "Licensed under CC BY-NC 4.0."),
        (6, "a/b/d/e.py", "words words"),
        (7, "q/e.py", "code and then this work is licensed under the gnu general public license version 3 and other words follow"),
        (8, "ab/x", ""),
        (8, "ab/x", ""),
        (9, "a/x/y/z.py", "the of and to it is in a"),
    ]
    got = sorted((tuple(r)[:2] + (r.how, r.from_path) for r in licenses.licenses(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()), key=repr)
    assert got == [
        (1, "MIT", "file", None),
        (2, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
        (3, "Apache-2.0", "file", None),
        (4, None, None, None),
        (5, "CC-BY-NC-4.0", "header", None),
        (6, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
        (7, "GPL-3.0", "header", None),
        (8, None, None, None),
        (8, None, None, None),
        (9, "MIT", "inherited", "a/LICENSE"),
    ]
    assert licenses.licenses(catalog.with_paths(nothing.withColumn("source", nothing.text).withColumn("lang", nothing.text))).collect() == []


def test_licenses_over_line_ends(spark):
    """Headers wrapped as comments of 30 and 80 columns, and the windows against all windows."""
    import textwrap

    prose = "some words before the header and some after it, of no licence at all. " * 3
    files, want = [], []
    for mark in ("// ", " * ", "# "):
        for width in (30, 80):
            for name in sorted(licenses.TEMPLATES):
                for template in licenses.TEMPLATES[name]:
                    wrapped = "\n".join(mark + x for x in textwrap.wrap(template, width))
                    files.append((len(files), f"d{len(files)}/x.py", f"{prose}\n{wrapped}\n{prose}"))
                    want.append(name)
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()}
    assert [got[i].license for i in range(len(want))] == want and all(r.score > 0.999 and r.how == "header" for r in got.values())
    match = licenses.Matcher(licenses.TEMPLATES, {"the": 50, "license": 9}, 60, licenses.THRESHOLD)
    for _, _, text in files[::5]:
        words = licenses.words_of(text)
        plain = max(match.cosine(words[s : s + n], v) for _, n, v in match.parts for s in range(len(words) - n + 1))
        assert match.anywhere(words)[1] == plain


def test_license_prefilter_loses_nothing(spark):
    """The scan by strong words finds what a scan of all lines finds."""
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    match = licenses.Matcher(licenses.TEMPLATES, {}, len(docs), licenses.THRESHOLD)
    everything = licenses.Matcher(licenses.TEMPLATES, {}, len(docs), licenses.THRESHOLD)
    everything.strong = set(everything.weight)
    lines = [licenses.words_of(x) for t in docs for x in t.split("\n")]
    assert [match.passage(w) for w in lines if w] == [everything.passage(w) for w in lines if w]


def smith_waterman(item, passage):
    h, best = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)], 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain():
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 4, n) for n in rng.integers(1, 12, 200)]
    passages = [rng.integers(0, 4, n) for n in rng.integers(1, 20, 200)]
    a, b = np.full((200, 12), -2), np.full((200, 20), -3)
    for k in range(200):
        a[k, : len(items[k])], b[k, : len(passages[k])] = items[k], passages[k]
    best, start, end = decontaminate.align(a, np.array([len(x) for x in items]), b, np.array([len(x) for x in passages]))
    for k in range(200):
        assert best[k] == smith_waterman(items[k], passages[k])
        if best[k]:
            assert smith_waterman(items[k], passages[k][start[k] : end[k]]) == best[k]


def test_decontamination(spark, docs, corpus, nothing, monkeypatch):
    rng, texts = random.Random(8), dict(corpus)
    words = texts[20].split()
    vocabulary = sorted({w for t in texts.values() if t for w in t.split()})
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(25))) for k in range(12)] + [(98, None), (99, "")]
    planted = []
    for k, item in items[:12]:
        edited = [rng.choice(vocabulary) if rng.random() < 0.1 * (k % 2) else w for w in item.split()]
        planted.append((1000 + k, " ".join(words[:30]) + " " + " ".join(edited) + "; " + " ".join(words[30:]), None, 0.0, 1, b""))
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (decontaminate.ITEM_BLOCK, 60):  # the second takes several passes
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        got = {r.doc_id: r for r in decontaminate.contaminated(both, benchmark).collect()}
        assert len(got) == len(corpus) + 12
        assert all(got[1000 + k]["items"] == [k] for k in range(12))
        assert not any(got[i].contaminated for i in texts)
        assert all(got[1000 + k].score == 1 for k in range(0, 12, 2))
    kept = decontaminate.keep_clean(both, benchmark)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == set(texts)
    assert decontaminate.contaminated(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.contaminated(docs, benchmark.limit(0)).collect())


def test_decontamination_equals_plain_alignment(spark, monkeypatch):
    """Every pair of a document and an item, with an edit every two to six words, against Smith-Waterman."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 4, 7, 12, 15, 20, 30, 40)]
    rows, texts = [], {}
    for item in items:
        for every in (2, 3, 4, 5, 6, 99):
            for kind in ("swap", "add", "drop"):
                copy, at = [], rng.randrange(every)
                for i, w in enumerate(item):
                    if (i + at) % every:
                        copy.append(w)
                    else:
                        copy += [["zz"], [w, "zz"], []][("swap", "add", "drop").index(kind)]
                around = [[rng.choice(vocabulary) for _ in range(rng.randrange(40))] for _ in range(2)]
                texts[len(texts)] = around[0] + copy + around[1]
    texts[len(texts)] = items[5]  # verbatim, so that intact word sequences are the more frequent ones
    rows = [(i, " ".join(ws)) for i, ws in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(items)], "item_id bigint, text string")
    want = {i: [k for k, item in enumerate(items) if smith_waterman(item, ws) >= decontaminate.THRESHOLD * len(item)] for i, ws in texts.items()}
    best = {i: max([0.0] + [smith_waterman(items[k], ws) / len(items[k]) for k in want[i]]) for i, ws in texts.items()}
    for places in (decontaminate.PLACES, 50):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        got = {r.doc_id: r for r in decontaminate.contaminated(docs, benchmark).collect()}
        assert {i: r["items"] for i, r in got.items()} == want and {i: r.score for i, r in got.items()} == best


def test_join_equals_alignment_of_all_pairs(spark, data):
    """All documents of the smallest tables with all items, aligned whole."""
    docs, benchmark = (catalog.table(spark, data, t) for t in ("documents", "benchmark"))
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in benchmark.collect()]
    texts = {r.doc_id: decontaminate.words_of(r.text) for r in docs.collect()}
    number = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    short = {i: np.array([number.get(w, -1) for w in ws][:4000]) for i, ws in texts.items()}
    assert max(map(len, texts.values())) <= 4000
    n = max(len(ws) for _, ws in items)
    want = {}
    for i, ids in short.items():
        a = np.full((len(items), n), -2)
        for k, (_, ws) in enumerate(items):
            a[k, : len(ws)] = [number[w] for w in ws]
        size = np.array([len(ws) for _, ws in items])
        best = decontaminate.align(a, size, np.repeat(ids[None], len(items), 0), np.full(len(items), len(ids)))[0] if len(ids) else np.zeros(len(items))
        want[i] = sorted(items[k][0] for k in np.flatnonzero((best >= decontaminate.THRESHOLD * size) & (size > 0)))
    got = {r.doc_id: r["items"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == want and any(want.values())


def test_lanes_are_bounded(spark, monkeypatch):
    """Long items, and passes of few cells, give the same."""
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((2500, 900, 30, 12))]
    docs = spark.createDataFrame([(k, "before it " + t + " and after it") for k, t in items] + [(1, "a repeated id that is clean"), (9, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for cells in (decontaminate.CELLS, 1):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        got = sorted(((r.doc_id, r["items"]) for r in decontaminate.contaminated(docs, benchmark).collect()), key=str)
        assert got == sorted([(k, [k]) for k in range(4)] + [(1, []), (9, [])], key=str)


def test_cosine_of_all_lines(spark):
    """Scores of one-line files against TF-IDF cosines computed from the counts of all files."""
    import math
    from collections import Counter

    lines = ["Released under the MIT License.", "released under the license of mit or so", "Licensed under CC BY 4.0.", "nothing of the kind", "", "CC BY-NC 4.0 licensed", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."] * 2
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame([(i, f"d{i}/f.txt", t) for i, t in enumerate(lines)], "doc_id int, path string, text string")).collect()}
    df = Counter(w for t in lines for w in set(licenses.words_of(t)))
    known = {w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)}
    idf = lambda w: math.log((len(lines) + 1) / ((df[w] if w in known else 0) + 1)) + 1

    def cosine(a, b):
        x, y = ({w: c * idf(w) for w, c in Counter(licenses.words_of(t)).items()} for t in (a, b))
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    for i, t in enumerate(lines):
        n = len(licenses.words_of(t))
        fits = {name: max(cosine(t, x) for x in ts if n <= 1.5 * len(licenses.words_of(x))) if any(n <= 1.5 * len(licenses.words_of(x)) for x in ts) else 0.0 for name, ts in licenses.TEMPLATES.items()}
        name = max(fits, key=lambda k: (fits[k], -sorted(fits).index(k)))
        if fits[name] >= licenses.THRESHOLD:
            assert got[i].license == name and math.isclose(got[i].score, fits[name])
        else:
            assert got[i].license is None or got[i].score >= licenses.THRESHOLD


def test_catalog_and_pipeline(spark, data, duck):
    import corpus_pipeline

    names = list(catalog.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    same(catalog.queries()["op8_exact_dedup"](spark, data), duck, catalog.oracle_sql()["op8_exact_dedup"])
    docs = catalog.table(spark, data, "documents")
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert after.columns == docs.columns and ids <= left and len(ids) > 0.5 * len(left)
        docs, left = after, ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in out} == left and all(r.round_trip for r in out)
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == left
