"""SentencePiece encoding and decoding; giant texts by a parallel max-plus scan.

A text gets a space in front and is segmented into the pieces with the highest
sum of scores; bytes stand in for characters without a piece.  No piece crosses
a pre-token's border, so that usual texts are encoded by distinct pre-token.

A text over `chunk` characters is cut there, wherever that is.  The state at a
cut is the number of characters by which the piece that crosses it reaches into
the next chunk, which is below the longest piece's length.  Each chunk gives the
matrix of best scores from entry state to exit state.  Matrices combine under
(max, +), which is associative: those of `SEGMENT` chunks make one product, as a
balanced tree, in a task each; a scan over the products fixes the states between
segments, and a scan in each segment those between its chunks.  Each chunk is
then backtraced on its own.

Decoding joins the bytes of the ids and drops the space in front; decoding an
encoded text gives the text.

Defined cases: a null or empty text has no ids and decodes to the empty text;
every row gets a result of its own, repeated rows too; a null id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .unigram import BulkSegmenter, Vocabulary, char_bytes, load_vocabulary, segment

CHUNK = 1 << 16
#: Characters that one numpy pass takes, and distinct pre-tokens that a task remembers.
GROUP, REMEMBER = 1 << 19, 120_000
NEVER = -(1 << 60)
#: Chunks whose matrices one task combines.
SEGMENT = 64
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
OUT_DDL = "doc_id bigint, n_chars bigint, n_tokens bigint, score bigint, ids array<int>, round_trip boolean"


class Decoder:
    """Bytes of many ids at once."""

    def __init__(self, voc: Vocabulary):
        self.size = np.array([len(b) for b in voc.decoded], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(voc.decoded), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id has."""
        size = self.size[ids]
        return self.pool[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


class Encoder:
    """Remembers the segmentation of pre-tokens."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.split, self.bulk = voc, voc.splitter().findall, BulkSegmenter(voc)
        self.forget()

    def forget(self):
        self.number, self.seen = {}, {}
        self.pool, self.size, self.score = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and of each text its number of ids and its score."""
        if len(self.number) > REMEMBER:
            self.forget()
        number, words, counts = self.number, [], []
        for text in texts:
            got = self.split(" " + text) if text else []
            words += got
            counts.append(len(got))
        if new := [w for w in dict.fromkeys(words) if w not in number]:
            score, size, ids = self.bulk(new)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.score, self.size, self.pool = np.concatenate([self.score, score]), np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
        k = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        size, score, pool = self.size, self.score, self.pool
        start = np.cumsum(size) - size
        own = size[k]
        ids = pool[np.repeat(start[k] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        owner = np.repeat(np.arange(len(texts)), counts)
        n = np.bincount(owner, own, len(texts)).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(score[k])])
        ends = np.cumsum([0, *counts])
        total = run[ends[1:]] - run[ends[:-1]]
        return ids, n, total

    def between(self, text: str, a: int, b: int) -> tuple[int, list[int]]:
        """Score and ids of the pre-tokens between two borders."""
        score, out = 0, []
        for w in self.split(text, a, b):
            if (got := self.seen.get(w)) is None:
                got = self.seen[w] = segment(w, self.voc)
            score += got[0]
            out += got[1]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        return score, out


def round_trips(ids: np.ndarray, n: np.ndarray, texts: list[str], decoder: Decoder) -> list[bool]:
    """Whether each text comes back."""
    data, size = decoder(ids)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])].tolist()
    raw = data.tobytes()
    return [raw[a + 1 : b] == t.encode("utf-8", "surrogatepass") for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]


def usual_encoder(voc: Vocabulary):
    """Arrow function for texts of usual length."""

    def run(rows):
        encode, decoder = Encoder(voc), Decoder(voc)

        def out(doc_ids, texts):
            ids, n, score = encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(score), lists, pa.array(round_trips(ids, n, texts, decoder))], schema=OUT)

        for batch in rows:
            doc_ids, texts, size = [], [], 0
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    doc_ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size > GROUP:
                        yield out(doc_ids, texts)
                        doc_ids, texts, size = [], [], 0
            if texts:
                yield out(doc_ids, texts)

    return run


def lattice(text: str, length: int, entry: np.ndarray, voc: Vocabulary):
    """Best scores (one column for each start in `entry`) at each place up to `length` + longest - 1 that a piece starting below `length` reaches.

    `text` is the chunk and what follows it.  Also yields, by place, the edges that end there.
    """
    reach = min(len(text), length + voc.longest - 1)
    best = np.full((reach + 1, len(entry)), NEVER, np.int64)
    for s, e in enumerate(entry):
        if e <= reach:
            best[e, s] = 0
    edges: list[list[tuple[int, int | bytes]]] = [[] for _ in range(reach + 1)]
    for i in range(min(length, len(text))):
        here = best[i]
        if here.max() <= NEVER // 2:
            continue
        raw = char_bytes(text[i])
        for j, what, score in [(i + 1, raw, len(raw) * voc.byte_score)] + [(j, hit[0], hit[1]) for j in range(i + 1, min(reach, i + voc.longest) + 1) if (hit := voc.pieces.get(text[i:j])) is not None]:
            np.maximum(best[j], here + score, out=best[j])
            edges[j].append((i, what, score))
    return best, edges


def frame(text: str, length: int, voc: Vocabulary) -> tuple[int, int]:
    """The first border that every entry state is before, and the last border in the chunk; (0, 0) if they are not there."""
    places = [m.start() for m in voc.borders().finditer(text, 0, length + 1) if voc.longest <= m.start() <= length]
    return (places[0], places[-1]) if places else (0, 0)


def lattice_transfer(text: str, length: int, voc: Vocabulary, entries: int) -> np.ndarray:
    states = voc.longest
    best, _ = lattice(text, length, np.arange(entries), voc)
    out = np.full((entries, states), NEVER, np.int64)
    for s in range(states):
        if length + s < len(best):
            out[:, s] = best[length + s]
    return out


def transfer(text: str, length: int, encode: Encoder) -> np.ndarray:
    """The matrix of best scores from entry state to exit state of a chunk.

    All ways through the chunk meet at its borders, so that only what is before
    the first and after the last needs a score for each state.
    """
    voc, states = encode.voc, encode.voc.longest
    a, b = frame(text, length, voc)
    if not a:
        out = lattice_transfer(text, length, voc, states)
        for s in range(length + 1, states):  # an entry beyond the chunk passes through
            out[s, s - length] = 0
        return out
    enter = np.array([segment(text[s:a], voc)[0] for s in range(states)], np.int64)
    leave = lattice_transfer(text[b:], length - b, voc, 1)[0] if b < length else np.where(np.arange(states) == 0, 0, NEVER)
    return np.maximum(enter[:, None] + encode.between(text, a, b)[0] + leave[None, :], NEVER)


def backtrace(text: str, length: int, entry: int, leave: int, encode: Encoder) -> list[int]:
    """Ids of the pieces that start in a chunk, for known entry and exit states."""
    voc = encode.voc
    if entry >= length:
        return []
    a, b = frame(text, length, voc)
    if a:
        return segment(text[entry:a], voc)[1] + encode.between(text, a, b)[1] + (backtrace_lattice(text[b:], length - b, 0, leave, voc) if b < length else [])
    return backtrace_lattice(text, length, entry, leave, voc)


def backtrace_lattice(text: str, length: int, entry: int, leave: int, voc: Vocabulary) -> list[int]:
    best, edges = lattice(text, length, np.array([entry]), voc)
    out, j = [], length + leave
    while j > entry:
        i, what, _ = next(e for e in sorted(edges[j], key=lambda e: (e[0], isinstance(e[1], bytes))) if best[e[0], 0] + e[2] == best[j, 0])
        out += [voc.byte_ids[b] for b in reversed(what)] if isinstance(what, bytes) else [what]
        j = i
    return out[::-1]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The (max, +) product of matrices in a row, as a balanced tree."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def scan(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> tuple[int, list[int]]:
    """Best score from the state `entry` to `leave`, and the state at each cut."""
    rows = [np.where(np.arange(len(matrices[0])) == entry, 0, NEVER)]
    for m in matrices:
        rows.append(combine(rows[-1][None], m)[0])
    states = [leave]
    for m, row in zip(matrices[::-1], rows[-2::-1], strict=True):
        states.append(int(np.argmax(row + m[:, states[-1]])))
    return int(rows[-1][leave]), states[::-1]


def chunk_texts(chunk: int, longest: int):
    """Arrow function: the chunks of giant texts, each with what follows it."""

    def run(rows):
        for batch in rows:
            for i, t in zip(batch.column("row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                full = " " + t
                for k, at in enumerate(range(0, len(full), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([k], pa.int32()), pa.array([min(chunk, len(full) - at)], pa.int32()), pa.array([full[at : at + chunk + longest]])], names=["row", "k", "length", "part"])

    return run


def transfers(voc: Vocabulary):
    def run(rows):
        encode = Encoder(voc)
        for batch in rows:
            got = [batch.column(c).to_pylist() for c in ("row", "k", "length", "part")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([transfer(t, n, encode).tobytes() for _, _, n, t in zip(*got, strict=True)], pa.binary())], names=["row", "k", "m"])

    return run


def matrices_of(rows: pa.Table, states: int) -> list[np.ndarray]:
    return [np.frombuffer(m, np.int64).reshape(states, states) for m in rows.column("m").to_pylist()]


def reducer(states: int):
    """Function over a segment of a text: the product of its matrices."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        return pa.table({"row": rows.column("row")[:1], "seg": rows.column("seg")[:1], "m": pa.array([product(matrices_of(rows, states)).tobytes()], pa.binary())})

    return run


def scanner(states: int):
    """Function over a text: entry and exit state of each segment, and the text's score."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg")
        score, cuts = scan(matrices_of(rows, states))
        return pa.table({"row": rows.column("row"), "seg": rows.column("seg"), "entry": pa.array(cuts[:-1], pa.int32()), "leave": pa.array(cuts[1:], pa.int32()), "score": pa.array([score] * len(rows), pa.int64())})

    return run


def filler(states: int):
    """Function over a segment whose entry and exit state are known: those of its chunks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        _, cuts = scan(matrices_of(rows, states), rows.column("entry")[0].as_py(), rows.column("leave")[0].as_py())
        return pa.table({"row": rows.column("row"), "k": rows.column("k"), "entry": pa.array(cuts[:-1], pa.int32()), "leave": pa.array(cuts[1:], pa.int32()), "score": rows.column("score")})

    return run


def backtraces(voc: Vocabulary):
    def run(rows):
        encode = Encoder(voc)
        for batch in rows:
            got = zip(*(batch.column(c).to_pylist() for c in ("length", "entry", "leave", "part")), strict=True)
            ids = [backtrace(t, n, e, x, encode) for n, e, x, t in got]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), batch.column("score"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "k", "score", "ids"])

    return run


def joiner(voc: Vocabulary):
    def run(rows):
        decoder = Decoder(voc)
        for batch in rows:
            texts = batch.column("_text").to_pylist()
            lists = [np.array(x, np.int32) for x in batch.column("ids").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            same = round_trips(np.concatenate(lists), n, texts, decoder) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), batch.column("score"), pa.array(lists, pa.list_(pa.int32())), pa.array(same, pa.bool_())], schema=OUT)

    return run


def encode(docs: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row of `docs`: doc_id, n_chars, n_tokens, score, ids, and round_trip (whether decoding gives the text)."""
    voc = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    usual = map_arrow(base.where(F.length("_text") <= chunk), usual_encoder(voc), OUT_DDL)
    # Written once: the numbers given to rows must stay what they are.
    giant = materialize(base.where(F.length("_text") > chunk).withColumn("row", F.monotonically_increasing_id()), "giant")
    if giant.isEmpty():
        return usual
    parts = map_arrow(giant, chunk_texts(chunk, voc.longest), "row bigint, k int, length int, part string")
    parts = materialize(parts.repartition("row", "k"), "chunks")
    states = voc.longest
    # Up: products of segments; across: states at the segments' ends; down: states at each cut.
    matrices = materialize(map_arrow(parts, transfers(voc), "row bigint, k int, m binary").withColumn("seg", F.expr(f"k div {SEGMENT}")), "transfers")
    ends = matrices.groupBy("row", "seg").applyInArrow(reducer(states), "row bigint, seg bigint, m binary").groupBy("row").applyInArrow(scanner(states), "row bigint, seg bigint, entry int, leave int, score bigint")
    cuts = matrices.join(ends, ["row", "seg"]).groupBy("row", "seg").applyInArrow(filler(states), "row bigint, k int, entry int, leave int, score bigint")
    traced = map_arrow(parts.join(cuts, ["row", "k"]).select("row", "k", "length", "part", "entry", "leave", "score"), backtraces(voc), "row bigint, k int, score bigint, ids array<int>")
    lists = traced.groupBy("row").agg(F.first("score").alias("score"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return usual.unionByName(map_arrow(giant.join(lists, "row").select("doc_id", "_text", "score", "ids"), joiner(voc), OUT_DDL))


def decode(encoded: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text.  Ids must be those of the vocabulary; null ids count as none."""
    voc = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary

    def run(rows):
        decoder = Decoder(voc)
        for batch in rows:
            texts = [decoder(np.array(x or [], np.int64))[0].tobytes()[1:].decode("utf-8", "surrogatepass") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
