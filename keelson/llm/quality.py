"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its hashed words, of the character
n-grams of these words and of its word pairs; a softmax over two classes reads
that mean.  Vectors and softmax are learned by plain stochastic gradient
descent in numpy on a bounded sample of labelled rows (`max_train`), whose
features alone come to the driver.

Once trained, the model is linear in the features, so that each feature counts
as one number: executors add up numbers per distinct word, found once a task,
and per word pair.  Whole texts are read.  A word that follows itself makes one
pair feature common to all words.

Defined cases: a null text is empty; an empty text has the score of the bias;
without any usable labels all scores are 0.5; labels with null quality are left
out; of several labels of one document the largest counts; of rows that repeat an
id the least text is learned from; a text over two million characters is read in
pieces cut at white space, with the pairs across these cuts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, crc_mod, map_arrow

BUCKETS, DIM, GRAMS = 1 << 17, 16, (3, 4, 5)
#: Labelled rows that training may use; the first by a hash of the id.
MAX_TRAIN = 3000
#: Gradient steps: rows are repeated until there are so many.
STEPS = 12_000
THRESHOLD = 0.3
HELD_OUT = 5
#: Distinct words that a task remembers.
REMEMBER = 400_000


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _PRIME), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can choose a bucket."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some words: a hash of each, and (number of the word, bucket) of the words and their character n-grams."""
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(chars)) - start[owner]
    whole = mix(np.add.reduceat((chars + np.uint64(1)) * _POWERS[place & 63] * (np.uint64(2) * (place >> 6).astype(np.uint64) + np.uint64(1)), start))
    owners, hashes = [np.arange(len(words))], [whole]
    for n in GRAMS:
        h = np.zeros(max(len(chars) - n + 1, 0), np.uint64)
        for i in range(n):
            h = h * _PRIME + chars[i : i + len(h)]
        inside = place[: len(h)] + n <= size[owner[: len(h)]]
        owners.append(owner[: len(h)][inside])
        hashes.append(mix(h[inside] + np.uint64(n)))
    return whole, np.concatenate(owners), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


class Words:
    """The distinct words of a task: numbers, hashes, sums of weights and counts of features."""

    def __init__(self, weights: np.ndarray):
        self.number, self.weights = {}, weights
        self.hash, self.value, self.n = np.empty(1024, np.uint64), np.empty(1024), np.empty(1024)

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        if new := [w for w in dict.fromkeys(words) if w not in number]:
            at, end = len(number), len(number) + len(new)
            number.update(zip(new, range(at, end), strict=True))
            while end > len(self.hash):
                self.hash, self.value, self.n = (np.concatenate([x, np.empty_like(x)]) for x in (self.hash, self.value, self.n))
            self.hash[at:end], owner, bucket = subwords(new)
            self.value[at:end] = np.bincount(owner, self.weights[bucket], len(new))
            self.n[at:end] = np.bincount(owner, minlength=len(new))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Buckets of word pairs from the words' hashes."""
    return np.where(first == second, 1, mix(first * _PRIME + second) % np.uint64(BUCKETS)).astype(np.int64)


def flatten(group: list[tuple[int, str]]) -> tuple[list[str], np.ndarray]:
    """All words of a group and, for each, the number of its document."""
    words, owners, counts = [], [], []
    for i, piece in group:
        got = piece.split()
        words += got
        owners.append(i)
        counts.append(len(got))
    return words, np.repeat(np.array(owners, np.int64), counts)


def featurizer(id_col: str):
    """Arrow function: per document its features, as zlib of bucket numbers and counts."""

    def run(rows):
        for batch in rows:
            ids, texts, labels = (batch.column(c) for c in (id_col, "_text", "_label"))
            out = []
            for text in texts.to_pylist():
                total, last = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint64)
                for group in batches([text or ""]):
                    words, _ = flatten(group)
                    if words:
                        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                        k = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                        h, owner, bucket = subwords(list(number))
                        total += np.bincount(bucket, np.bincount(k)[owner], BUCKETS).astype(np.int64)
                        h = np.concatenate([last, h[k]])
                        total += np.bincount(pair_buckets(h[:-1], h[1:]), minlength=BUCKETS)
                        last = h[-1:]
                at = np.flatnonzero(total).astype(np.int32)
                out.append(zlib.compress(np.concatenate([at, total[at].astype(np.int32)]).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(out, pa.binary())], names=[id_col, "_label", "features"])

    return run


def learn(rows: list[tuple[int, bytes]], steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Learn vectors (one a bucket) and softmax (weights and bias of two classes)."""
    rng = np.random.default_rng(seed)
    data = [(y, np.frombuffer(zlib.decompress(x), np.int32)) for y, x in rows]
    data = [(y, x[: len(x) // 2], x[len(x) // 2 :].astype(np.float32)) for y, x in data if len(x)]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if len({y for y, *_ in data}) < 2:
        return emb, out, bias
    done, epochs = 0, -(-steps // len(data))
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            rate = np.float32(0.5 * (1 - done / (epochs * len(data))))
            done += 1
            y, at, count = data[i]
            share = count / count.sum()
            vectors = emb[at]
            mean = share @ vectors
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            emb[at] = vectors - (rate * share)[:, None] * back
    return emb, out, bias


def train(rows: list[tuple[int, bytes]], steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """What learn() comes to: each bucket's weight for label 1, and the bias."""
    emb, out, bias = learn(rows, steps, seed)
    return emb @ (out[1] - out[0]), float(bias[1] - bias[0])


def scores(texts: list[str | None], table: Words, bias: float) -> np.ndarray:
    """The score of each text."""
    w, total, n = table.weights, np.zeros(len(texts)), np.zeros(len(texts))
    # The last word of the texts so far: a text that is cut goes on in the next group.
    last_owner, last_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for group in batches(t or "" for t in texts):
        words, owner = flatten(group)
        if not words:
            continue
        if len(table.number) > REMEMBER:
            table.number.clear()
        k = table.numbers(words)
        total += np.bincount(owner, table.value[k], len(texts))
        n += np.bincount(owner, table.n[k], len(texts))
        h, owner = np.concatenate([last_hash, table.hash[k]]), np.concatenate([last_owner, owner])
        same = owner[1:] == owner[:-1]
        pairs = pair_buckets(h[:-1], h[1:])[same]
        total += np.bincount(owner[1:][same], w[pairs], len(texts))
        n += np.bincount(owner[1:][same], minlength=len(texts))
        last_owner, last_hash = owner[-1:], h[-1:]
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -50, 50)))


def scorer(id_col: str, weights: bytes, bias: float):
    """Arrow function: the score of each document."""

    def run(rows):
        table = Words(np.frombuffer(zlib.decompress(weights), np.float32))
        for batch in rows:
            score = scores(batch.column("_text").to_pylist(), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(score)], names=["doc_id", "score"])

    return run


def sieve(text_col: str, weights: bytes, bias: float):
    """Arrow function: the rows whose score reaches the threshold, with all their columns."""

    def run(rows):
        table = Words(np.frombuffer(zlib.decompress(weights), np.float32))
        for batch in rows:
            yield batch.filter(pa.array(scores(batch.column(text_col).to_pylist(), table, bias) >= THRESHOLD))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, steps: int = STEPS) -> tuple[bytes, float]:
    """The model: weights (compressed) and bias.  Learns from at most `max_train` rows that are not held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("doc_id").agg(F.max("_label").alias("_label"))
    sample = known.where(F.col("_label").isin(0, 1) & (crc_mod(F.col("doc_id"), HELD_OUT) != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows, whatever ids repeat: the bound holds at any size.
    known = base.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    rows = known.mapInArrow(featurizer("doc_id"), f"doc_id {kind}, _label int, features binary").collect()
    rows.sort(key=lambda r: (str(r.doc_id), r.features))
    weights, bias = train([(r["_label"], r.features) for r in rows], steps)
    return zlib.compress(weights.astype(np.float32).tobytes(), 1), bias


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, steps: int = STEPS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    `labels` has the id column and `label_col` (0 or 1).  Rows whose crc32 of the
    id modulo 5 is 0 are held out from training.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    weights, bias = fit(docs, labels, id_col, text_col, label_col, max_train, steps)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    scored = map_arrow(base, scorer("doc_id", weights, bias), f"doc_id {kind}, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that the classifier does not reject; no shuffle of texts."""
    return map_arrow(docs, sieve(text_col, *fit(docs, labels, id_col, text_col, label_col)), docs.schema)
