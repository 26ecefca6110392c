"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (lower case, cut at white
space; a shorter text is one shingle).  Documents with equal sets are one node.
All pairs of nodes with Jaccard similarity of `threshold` or more are links, up to
the recall of the runs.

1. Candidates.  Every node has `COORDINATES` min-hashes: shared tokens sampled at
   random.  A run grows a tree of paths: at each tree node one or two coordinates
   are drawn, 1 / threshold on average, and a set goes on to the child of the token
   it has there.  A bucket with at most `LIMIT` sets is searched whole; a larger one
   is split again, down to `DEPTH`.  At similarity t, a run of depth 1, 2, 3 finds a
   pair with probability 0.84, 0.73, 0.64 (t = 0.8); `runs` are repeated until the
   worst of these reaches the target recall (0.999: 7 runs), and `MORE_RUNS` times more.
   A search compares four bits of each min-hash, which is all that is shuffled of a
   set; a pair goes on if so many agree as a pair at the threshold reaches but for
   about three in a million.  Of each bucket a spanning forest is kept, never all pairs.
2. Groups.  The forests' connected components hold every candidate pair.
3. Verification.  Shingle sets are built again for the documents in groups, and
   all pairs in a group are verified exactly: intersections by matrix products.
   A group over `BLOCK` sets is verified in pairs of blocks in separate tasks.
   The same holds for a bucket over `BIG` sets that no path splits.
4. Classes.  Verified links give each document its number of links (copies with
   an equal set are links too) and, by connected components, its class.

Defined cases: documents without words (null, empty) have no links and a class
of their own; ids may be null or repeat (repeated rows are copies, and each gets
a row); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, materialize, perhaps_in, row_key, without
from .components import connected_components

N, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
COORDINATES, DEPTH, LIMIT, BIG, BLOCK = 64, 3, 256, 4096, 2048
#: Beyond what independent runs would need: runs share the min-hashes.
MORE_RUNS = 2
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def runs_needed(threshold: float, target: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was found with the target probability, at the largest depth."""
    found, more = 1.0, 1 / threshold - 1
    for _ in range(depth):
        one = threshold * found
        found = (1 - more) * one + more * (1 - (1 - one) ** 2)
    return math.ceil(math.log(1 - target) / math.log(1 - found))


class Hashes(dict):
    """64-bit hashes of words, made as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


class Shingler:
    """Shingle sets of texts, as sorted 64-bit hashes."""

    REMEMBER = 400_000

    def __init__(self, n: int = N):
        self.n, self.known = n, Hashes()

    def word_hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.REMEMBER:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        parts = [self.word_hashes(p.split()) for group in batches([(text or "").lower()]) for _, p in group]
        h = np.concatenate(parts)
        if not len(h):
            return h
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = out * _PRIME + h[i : i + len(out)]
        return np.unique(mix(out + _U(n)))


def seeds() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _PRIME) | _U(1)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each (non-empty) set its 32-bit min-hashes."""
    x = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i, a in enumerate(seeds()):
        out[:, i] = np.minimum.reduceat(((x ^ (x >> _U(29))) * a >> _U(32)).astype(np.uint32), start)
    return out


def signer(n: int):
    """Arrow function: doc_id, size of the shingle set, digest of the set, min-hashes."""

    def run(rows):
        shingles = Shingler(n)
        for batch in rows:
            size, digest, sig = [], [], []
            pending = []

            def flush(sig=sig, pending=pending):
                full = [s for s in pending if len(s)]
                rows = iter(min_hashes(full) if full else ())
                sig += [next(rows).tobytes() if len(s) else b"" for s in pending]
                pending.clear()

            weight = 0
            for text in batch.column("_text").to_pylist():
                s = shingles(text)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                pending.append(s)
                weight += len(s)
                if weight > 1 << 19:
                    flush()
                    weight = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "node", "sig"])

    return run


def drawn(path: int, threshold: float) -> list[int]:
    """The coordinates that a tree node draws."""
    h = zlib.crc32(path.to_bytes(8, "little"))
    one = h % COORDINATES
    if h / 2**32 % (1 / 64) * 64 < 1 / threshold - 1:
        return [one, (one + 1 + (h >> 8) % (COORDINATES - 1)) % COORDINATES]
    return [one]


ROWS = pa.schema([("key", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("short", pa.binary())])
ROWS_DDL = "key bigint, node binary, n int, short binary"


def shorten(values: np.ndarray) -> bytes:
    """Four bits of each min-hash, two in a byte."""
    low = (values & 15).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def paths(runs: int, threshold: float):
    """Arrow function: the next tree nodes of every set's paths, with the set's size and shortened min-hashes.  Paths go on from the set's `parents`; where it has none, from the roots of the runs."""

    def child(key: int, i: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d %d %d" % (key, i, value), digest_size=8).digest(), "little") >> 1

    def run(rows):
        for batch in rows:
            out = []
            for node, n, sig, parents in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "sig", "parents")), strict=True):
                values = np.frombuffer(sig, np.uint32)
                short = shorten(values)
                values = values.tolist()
                keys = dict.fromkeys(child(key, i, values[i]) for key in (range(runs) if parents is None else parents) for i in drawn(key, threshold))
                out += [(key, node, n, short) for key in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, ROWS, strict=True)], schema=ROWS)

    return run


def least_agreeing(threshold: float) -> int:
    """How many shortened min-hashes of a pair at the threshold agree at least, but for about three pairs in a million."""
    p = threshold + (1 - threshold) / 16
    return int(COORDINATES * p - 4.5 * math.sqrt(COORDINATES * p * (1 - p)))


def forest(nodes: list[bytes], n: np.ndarray, short: np.ndarray, threshold: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs that pass the size and min-hash filters."""
    least = least_agreeing(threshold)
    short = np.stack([short & 15, short >> 4], 2).reshape(len(nodes), -1)
    left, out = np.arange(len(nodes)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = (np.minimum(n[left], n[i]) >= threshold * np.maximum(n[left], n[i])) & ((short[left] == short[i]).sum(1) >= least)
            hit = left[ok]
            out += [(nodes[i], nodes[j]) for j in hit]
            queue += hit.tolist()
            left = left[~ok]
    return out


def searcher(threshold: float, limit: int | None):
    """Arrow function over rows ordered by bucket: edges (a, b).  Buckets over `limit` sets are left to the next depth."""

    def search(rows):
        nodes, n, short = zip(*{r[0]: r for r in rows}.values(), strict=True)
        return forest(list(nodes), np.array(n), np.frombuffer(b"".join(short), np.uint8).reshape(len(nodes), -1), threshold)

    def run(batches_):
        last, rows, size, out = None, [], 0, []
        for batch in batches_:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "n", "short")), strict=True):
                if key != last:
                    if len(rows) > 1 and (limit is None or size <= limit):
                        out += search(rows)
                    last, rows, size = key, [], 0
                size += 1
                if limit is None or size <= limit:
                    rows.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if len(rows) > 1 and (limit is None or size <= limit):
            out += search(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows with a column `bucket`: `key` alone for a group of at most `block` rows, else one for each pair of blocks that the row's block is in.  `side` is the row's block."""
    k = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("_k", k).withColumn("side", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other")
    rows = rows.select("*", other)
    return rows.withColumn("bucket", F.concat_ws(" ", F.col(key).cast("string") if key == "key" else F.hex(key), F.least("side", "_other"), F.greatest("side", "_other"))).drop("_k", "_other")


def link_matrix(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some sets have Jaccard similarity `threshold` or more.  Where there are two sides, only pairs across count."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[place]
    place, owner = (np.cumsum(shared) - 1)[place][keep], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = int(shared.sum())
    for at in range(0, total, 4096):
        s, e = np.searchsorted(place, [at, at + 4096])
        own, row = np.unique(owner[s:e], return_inverse=True)
        dense = np.zeros((len(own), min(4096, total - at)), np.float32)
        dense[row, place[s:e] - at] = 1
        both[np.ix_(own, own)] += dense @ dense.T
    link = both >= threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-3
    np.fill_diagonal(link, False)
    if len(np.unique(side)) > 1:  # links within a block are found where the block meets itself
        link &= side[:, None] != side[None, :]
    return link


def verify(group: pa.Table, threshold: float) -> tuple[list, np.ndarray, list]:
    """Nodes of a block pair, the documents that each links to, and a spanning forest of links."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("node", "side", "copies", "shingles")), strict=True))
    rows = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]
    link = link_matrix([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[1] for r in rows]), threshold)
    left, out = np.arange(len(rows)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            i = queue.pop()
            hit = left[link[i][left]]
            out += [(rows[i][0], rows[j][0]) for j in hit]
            queue += hit.tolist()
            left = left[~link[i][left]]
    return [r[0] for r in rows], link.astype(np.int64) @ np.array([r[2] for r in rows]), out


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def verifier(threshold: float):
    """Function over one block pair: rows (a, null, links) and edges (a, b, null)."""

    def run(group: pa.Table) -> pa.Table:
        nodes, links, edges = verify(group, threshold)
        out = [(a, None, int(n)) for a, n in zip(nodes, links, strict=True) if n] + [(a, b, None) for a, b in edges]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LINKS, strict=True)], schema=LINKS) if out else LINKS.empty_table()

    return run


def set_builder(n: int):
    """Arrow function: node, copies, group and shingle set of the first document of each node."""

    def run(rows):
        shingles = Shingler(n)
        for batch in rows:
            sets = [shingles(t).tobytes() for t in batch.column("_text").to_pylist()]
            # Of rows that repeat an id with other texts, only that of the node itself.
            own = [hashlib.blake2b(s, digest_size=16).digest() == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "copies", "root", "members")] + [pa.array(sets, pa.binary())], names=["node", "copies", "root", "members", "shingles"])
            yield out.filter(pa.array(own, pa.bool_()))

    return run


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Per row of `docs`: doc_id, class_id (the least id of its class), n_links (other documents at the threshold or above)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    signed = materialize(map_arrow(base, signer(n), f"doc_id {kind}, n int, node binary, sig binary"), "signatures")
    full = signed.where("n > 0")
    nodes = materialize(full.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")

    # 1. Candidates, level by level.  Joins whose sides grow with the corpus are shuffled at any size.
    runs, edges = runs_needed(threshold, target_recall) + MORE_RUNS, []
    start = nodes.withColumn("parents", F.lit(None).cast("array<bigint>"))
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        rows = map_arrow(start.select("node", "n", "sig", "parents"), paths(runs, threshold), ROWS_DDL)
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > (BIG if last else LIMIT)), "buckets")
        # Buckets with over a thousandth of all rows are at most 1000 and are broadcast: none of their rows goes to one task.
        hot = F.broadcast(sizes.where(F.col("size") > max(LIMIT, nodes.count() * runs // 1000))) if not last else sizes
        usual = rows.join(hot, "key", "left_anti").withColumn("bucket", F.col("key").cast("string" if last else "bigint"))
        if last:
            usual = usual.select("bucket", "node", "n", "short").unionByName(blocked(rows.join(sizes, "key"), "key", "size", BIG).select("bucket", "node", "n", "short"))
        found = map_arrow(usual.select("bucket", "node", "n", "short").repartition("bucket").sortWithinPartitions("bucket"), searcher(threshold, None if last else LIMIT), "a binary, b binary")
        edges.append(materialize(found, "candidates"))
        if last or sizes.isEmpty():
            break
        # Only the paths in large buckets go on, a row for each set: what is joined grows with the sets, not with their paths.
        parents = materialize(rows.join(sizes, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("parents")), "open")
        start = nodes.hint("merge").join(parents, "node")

    # 2. Groups.
    candidates = edges[0]
    for more in edges[1:]:
        candidates = candidates.unionByName(more)
    groups = materialize(connected_components(candidates), "groups")
    members = groups.groupBy("root").agg(F.count("*").alias("members"))
    grouped = materialize(groups.join(members, "root").hint("merge").join(nodes.select("node", "first", "copies"), "node"), "grouped")

    # 3. Verification of all pairs in a group.
    at_hand = grouped.withColumnRenamed("first", "_id")
    wanted = perhaps_in(base, "doc_id", at_hand, "_id").where("_kl_perhaps")
    texts = at_hand.hint("merge").join(wanted, F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "copies", "root", "members", "_text")
    sets = map_arrow(texts, set_builder(n), "node binary, copies bigint, root binary, members bigint, shingles binary")
    pairs = blocked(sets, "root", "members", BLOCK).select("bucket", "side", "node", "copies", "shingles")
    verified = materialize(pairs.groupBy("bucket").applyInArrow(verifier(threshold), "a binary, b binary, links bigint"), "links")

    # 4. Classes.
    links = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = materialize(connected_components(verified.where("b is not null").select("a", "b")), "classes")
    least = classes.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("class_id"))
    known = classes.join(least, "root").join(links, "node").select("node", "class_id", "links")
    # Every node has one row here; a node's documents are counted with it, so that the join by node is not skewed by copies of which there are few kinds: hot nodes are broadcast.
    summary = materialize(nodes.select("node", "first", "copies").hint("merge").join(known, "node", "left").select("node", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "summary")
    limit = max(1000, signed.count() // 1000)
    hot = F.broadcast(summary.where(F.col("copies") > limit).drop("copies"))
    cold = summary.where(F.col("copies") <= limit).drop("copies")
    ids = full.select("doc_id", "node")
    columns = ("doc_id", "class_id", "n_links")
    out = ids.join(hot, "node").select(*columns).unionByName(ids.join(F.broadcast(hot.select("node")), "node", "left_anti").hint("merge").join(cold, "node").select(*columns))
    return out.unionByName(signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the least id, whatever ids are null or repeat.  Rows that repeat id and text are one document."""
    key = row_key(id_col, text_col)
    classes = materialize(similarity_classes(docs.select(key.alias("_kl_row"), F.col(text_col)), "_kl_row", text_col).select("doc_id", "class_id"), "verdicts")
    kept = F.col("doc_id") == F.col("class_id")
    repeated = classes.where(kept).groupBy("doc_id").count().where("count > 1")
    return without(docs, key, classes.where(~kept).select("doc_id"), repeated.select("doc_id"))
