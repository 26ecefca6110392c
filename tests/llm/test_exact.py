"""Operators with exact results, against brute force."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from keelson.llm import chosen_path, decontaminate, exact_dedup, line_dedup, suffix_dedup
from keelson.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]")


def by_id(i):
    return (i is None, i or 0)


def test_exact_groups(spark, docs, corpus, nothing):
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), by_id(i), i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            want[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    for digest in (exact_dedup.content_hash, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)):  # the second collides all the time
        got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_groups(docs, digest=digest).collect()}
        assert got == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    assert exact_dedup.exact_groups(nothing).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id bigint, text string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_groups(twice).collect()) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]


def test_hot_group_is_whole(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 10**9)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(d)
    assert got.count() == 3000 and got.where("kept").count() == 1501 and got.where("group_size = 1500 and keep_id = 0").count() == 1500


def brute_spans(corpus, length):
    seen, out = set(), {}
    for i, t in sorted(corpus, key=lambda x: by_id(x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            w = b[q : q + length]
            if w in seen:
                gone[q : q + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, corpus, nothing, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 12)  # texts are cut
    for length in (100, 40):
        want = brute_spans(corpus, length)
        assert sum(w[1] for w in want.values()) > 1000
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length=length, want_text=True).collect()}
        assert got == want
    assert suffix_dedup.remove_repeats(nothing).collect() == []


def test_corpus_order_is_the_order_of_all_suffixes():
    import random

    import numpy as np

    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(3)] + [b"\0" * 40, b"zzzzzzzz" * 5, "déjà vu ".encode() * 5]
    for length in (32, 40, 100):
        strings = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + [b"", b"short"]
        strings = [x for x in strings if x]
        data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
        at, same = suffix_dedup.corpus_order(data, size, length)
        begin = (np.cumsum(size) - size).tolist()
        suffix = {b + k: x[k : k + length] for b, x in zip(begin, strings, strict=True) for k in range(len(x) - length + 1)}
        want = sorted(suffix.values())  # what counts is the order as deep as `length`
        assert [suffix[p] for p in at.tolist()] == want and sorted(at.tolist()) == sorted(suffix)
        assert same.tolist() == [i > 0 and want[i] == want[i - 1] for i in range(len(want))]


def test_suffix_dedup_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "ab" * 200)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == [(1, 0), (1, 0), (2, len(text)), (3, 398)]
    top = (1 << 63) - 1  # an id like any other
    d = spark.createDataFrame([(top, text), (None, text + " and more")], "doc_id bigint, text string")
    assert {r.doc_id for r in suffix_dedup.remove_repeats(d).collect()} == {top, None}


def test_one_passage_in_most_documents(spark):
    shared = " ".join(f"common{i}" for i in range(25))
    docs = [(i, f"{i * 7919} before {i} " + shared + f" after {i * 31} " + "tail " * (i % 3)) for i in range(300)]
    want = brute_spans(docs, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)).collect()}
    assert got == want


def test_suffix_parser_memory_is_bounded():
    """A task gathers a million phrases, and holds little more than one copy of them; what it sends comes in small batches."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    tasks = [pa.RecordBatch.from_pydict({"id": [k], "th": [0], "_text": [rng.randbytes(500_000).hex()]}) for k in range(45)]
    tracemalloc.start()
    try:
        sent = [(b.num_rows, b.nbytes) for b in suffix_dedup.parser(8, 100)(iter(tasks))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in sent) == 16 and max(b for _, b in sent) < 16 << 20  # a blob each for eight buckets, twice
    assert peak < 150 << 20


def test_suffix_dedup_near_copy_of_a_repeated_row(spark):
    shared = " ".join(f"w{i}" for i in range(38))
    one, two = shared + "".join(f" x{i * 7}" for i in range(50)), shared + "".join(f" y{i * 5}" for i in range(50))
    for first in (1, None):
        rows = [(first, one), (first, one), (2, two)] if first else [(2, two), (None, one), (None, one)]
        got = sorted(r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        # One repeat, in the later document alone; a separate run without the second copy says how long it is.
        alone = sorted(r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame([r for k, r in enumerate(rows) if r not in rows[:k]], "doc_id bigint, text string")).collect())
        assert alone[0] == 0 and alone[1] >= len(shared) and got == ([0, 0, alone[1]] if first else [0, alone[1], alone[1]])


def test_stages_decide_by_row(spark):
    """Ids that are null or repeat: neither do clean rows go with others, nor do copies stay."""
    schema = "doc_id bigint, text string, extra map<string,int>"
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, "copy one"), (None, "unique text here"), (4, "copy one"), (4, "another unique"), (4, "another unique"), (7, "copy  one"), (None, None), (3, "")]
    make = lambda rows: spark.createDataFrame([(i, t, {"a": 1}) for i, t in rows], schema)
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(make(rows)).collect()), key=repr)
    assert got == sorted([(None, "unique text here"), (4, "another unique"), (7, "copy  one"), (3, "")], key=repr)
    rows = [(1, near), (1, "no such words are in any other text of these"), (2, near + " zz"), (2, "quite alone by itself it stands"), (None, near + " yy"), (None, "null and alone among the others"), (5, "said twice but one document only"), (5, "said twice but one document only")]
    got = sorted(((r.doc_id, r.text) for r in chosen_path.keep_one(make(rows)).collect()), key=repr)
    assert got == sorted([rows[k] for k in (0, 1, 3, 5, 6)], key=repr)
    benchmark = spark.createDataFrame([(1, near)], "item_id bigint, text string")
    rows = [(None, near), (None, "null and clean"), (2, "so " + near), (2, "clean"), (3, None)]
    got = sorted(((r.doc_id, r.text) for r in decontaminate.keep_clean(make(rows), benchmark).collect()), key=repr)
    assert got == sorted([rows[k] for k in (1, 3, 4)], key=repr)


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def test_similarity_classes(spark, docs, corpus, nothing, monkeypatch):
    sets = [(i, shingles(t)) for i, t in corpus]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = collections.defaultdict(list)
    for k in range(len(sets)):
        members[find(k)].append(sets[k][0])
    want = {sets[k][0]: (min((i for i in members[find(k)] if i is not None), default=None), links[k]) for k in range(len(sets))}
    assert sum(links.values()) > 100
    for limit, block, big in ((256, 1024, 4096), (4, 8, 10)):  # the second splits buckets and groups
        monkeypatch.setattr(chosen_path, "LIMIT", limit)
        monkeypatch.setattr(chosen_path, "BLOCK", block)
        monkeypatch.setattr(chosen_path, "BIG", big)
        got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similarity_classes(docs).collect()}
        assert got == want
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if i is None or w[0] == i}
    assert chosen_path.similarity_classes(nothing).collect() == []
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "q r s t u v"), (9, "Q r s t u v")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in chosen_path.similarity_classes(twice).collect()) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (9, 1, 1)]


def test_deeper_paths_go_on_from_large_buckets(spark, monkeypatch):
    """Every set comes once with its open paths: semi joins make a few rows a path, however often a bucket is split."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    docs = [(k, " ".join(words[:j] + [f"x{k}"] + words[j:])) for k in range(300) for j in [rng.randrange(100)]]
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    store = spark._jsparkSession.sharedState().statusStore()

    def joined():
        total = 0
        for e in range(store.executionsList().size()):
            x = store.executionsList().apply(e)
            nodes, values = store.planGraph(x.executionId()).allNodes(), store.executionMetrics(x.executionId())
            for i in range(nodes.size()):
                if "Join" in nodes.apply(i).name() and "LeftSemi" in nodes.apply(i).desc():
                    metrics = nodes.apply(i).metrics()
                    got = [values.get(metrics.apply(m).accumulatorId()) for m in range(metrics.size()) if metrics.apply(m).name() == "number of output rows"]
                    total += sum(int(v.get().replace(",", "")) for v in got if v.isDefined())
        return total

    before = joined()
    got = chosen_path.similarity_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 299)}
    runs = chosen_path.runs_needed(0.8) + chosen_path.MORE_RUNS
    assert 300 * runs < joined() - before < 300 * runs * 4


def test_components(spark):
    edges = [(f"{i}".encode(), f"{i + 1}".encode()) for i in range(100, 140) if i != 120] + [(b"7", b"7"), (b"x", b"a"), (b"a", b"x")]
    rows = spark.createDataFrame(edges, "a binary, b binary").repartition(4)
    want = {str(i).encode(): b"100" if i <= 120 else b"121" for i in range(100, 141)} | {b"a": b"a", b"x": b"a"}
    for one_task in (0, 1000):
        assert {bytes(r.node): bytes(r.root) for r in connected_components(rows, one_task=one_task).collect()} == want
    assert connected_components(rows.limit(0)).collect() == []


def test_line_dedup_lists_in_blocks(spark, monkeypatch):
    """Prefix words whose lists are dealt out in pairs of blocks meet all the same."""
    import random

    import numpy as np

    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    lines = [sorted(rng.sample(words, rng.randrange(4, 9))) for _ in range(200)]
    level = np.full(line_dedup.SLOTS, 1 + 8 * 17, np.uint8)  # as if every word occurred 2**17 times
    split = line_dedup.Lines(level)
    doc, number, start, size, h = split([(0, 0, "\n".join(" ".join(x) for x in lines))])
    mark = line_dedup.digests(h, start)[0]
    line, word, _ = line_dedup.prefixes(split.rarity(h), start, size, mark, 0.8)
    lists = collections.defaultdict(set)
    for a, w in zip(line.tolist(), word.tolist(), strict=True):
        lists[w].add(a)
    met = {(a, b) for x in lists.values() for a in x for b in x}
    assert len(lists) > 12
    for a in range(200):
        for b in range(a):
            x, y = set(lines[a]), set(lines[b])
            assert len(x & y) < 0.8 * len(x | y) or (a, b) in met


def test_runs_reach_the_target():
    assert chosen_path.runs_needed(0.8) == 7 and chosen_path.runs_needed(0.8, 0.9) < 4


def test_words_are_counted_without_conversion():
    import time

    import numpy as np

    h = np.random.default_rng(1).zipf(1.3, 300_000).astype(np.uint64)
    slots = (h % np.uint64(line_dedup.SLOTS)).astype(np.int64)
    table, plain = (np.zeros(line_dedup.SLOTS, np.uint32) for _ in range(2))

    def seconds(f):
        start = time.process_time()
        for _ in range(3):
            f()
        return time.process_time() - start

    fast, slow = seconds(lambda: line_dedup.tally(table, h)), seconds(lambda: np.add.at(plain, slots, 1))
    assert (table == plain).all() and table.sum() == 900_000 and fast < slow / 2


def test_line_dedup(spark, docs, corpus, nothing):
    seen, want = [], {}
    for i, t in sorted(corpus, key=lambda x: by_id(x[0])):
        lines, gone = (t or "").split("\n"), []
        for k, line in enumerate(lines):
            s = set(line.lower().split())
            if s:
                if any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                    gone.append(k)
                seen.append(s)
        want[i] = (len(lines), len(gone), gone, "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert sum(w[1] for w in want.values()) > 100
    for signature in (127, 0):  # the second lets pairs pass that differ, so that lines need all their partners
        got = {r.doc_id: (r.n_lines, r.n_removed, r.removed, r.kept) for r in line_dedup.dedup_lines(docs, want_text=True, signature=signature).collect()}
        assert got == want
    assert line_dedup.dedup_lines(nothing).collect() == []
    near = [(i, f"a b c d e f g h i {chr(110 + i)}") for i in range(4)] + [(9, "other words here"), (9, "other words here")]
    got = sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(near, "doc_id bigint, text string")).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (9, 0), (9, 0)]
