"""Benchmark decontamination: shared word pairs and Smith-Waterman alignment.

Words are runs of letters, digits and underscores in lower case.

1. Score.  A document and an item are aligned word by word (match 1, mismatch and
   gap -1).  The score is the best local alignment over the item's number of
   words: 1 for a verbatim copy, and `THRESHOLD` or more for an edited one.
2. Candidates.  An alignment of score s has a run of matched words between any two
   edits, so that it has at least s - 1 places where two words of the document
   follow each other as in the item, and it spans at most 2n - s words for an
   item of n.  Only stretches of a document with so many such places are aligned.
   No pair that reaches the threshold is lost, whatever its words' frequencies.
3. Alignment.  Such a stretch is aligned in passages that hold every alignment
   which begins in it.

Test items are taken in blocks of at most `ITEM_BLOCK` words, so that what is sent
to the executors is bounded; a benchmark of several blocks takes several passes
over the documents, and all items are searched.

Defined cases: null and empty texts are clean; an item under `N` words has to
occur as a whole; an item without words is left out; an empty benchmark finds nothing;
ids may be null or repeat, and each row has its own result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pieces, row_key, without

N, THRESHOLD = 3, 0.4
ITEM_BLOCK = 500_000
#: Alignments in one numpy pass, and words of their passages together.
LANES, CELLS = 256, 1 << 18
#: Pairs of a place and an item that are looked at in one numpy pass.
PLACES = 2_000_000
WORD = re.compile(r"\w+")
HITS = "doc_id {kind}, item_id bigint, score double, word_start int, word_end int"


def words_of(text: str | None) -> list[str]:
    return [w for piece in pieces((text or "").lower()) for w in WORD.findall(piece)]


class Finder:
    """Finds the stretches of documents that may reach the threshold with an item."""

    def __init__(self, items: list[list[str]], threshold: float):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words in items for w in words}))}
        self.numbers = [np.array([self.vocabulary[w] for w in words], np.int64) for words in items]
        n = np.array([len(words) for words in items])
        least = np.array([math.ceil(threshold * k) for k in n])
        # Where one matched word is enough, or the item has only one, single words are looked for.
        single = (n == 1) | ((least < 2) & (n >= N))
        self.need = np.where(single, 1, np.maximum(least - 1, 1))
        self.span = np.maximum(2 * n - least, 1)
        self.tables = [self.postings([(i, x) for i, x in enumerate(self.numbers) if single[i]], 1), self.postings([(i, x) for i, x in enumerate(self.numbers) if not single[i]], 2)]

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for what begins at each place: -1 if it has a word that no item holds."""
        if size == 1 or not len(ids):
            return ids
        after = np.append(ids[1:], -1)
        return np.where((ids >= 0) & (after >= 0), ids * len(self.vocabulary) + after, -1)

    def postings(self, items, size: int):
        """(code, first posting of each, items): the distinct items by code."""
        pairs = [np.empty((0, 2), np.int64)]
        for i, x in items:
            own = np.unique(self.codes(x, size)[: len(x) - size + 1])
            pairs.append(np.stack([own, np.full(len(own), i)], 1))
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        code, first = np.unique(pairs[:, 0], return_index=True)
        return code, np.append(first, len(pairs)), pairs[:, 1]

    def __call__(self, ids: np.ndarray):
        """(item, start, end) of passages of `ids` (-1: in no item) that hold all alignments which reach the threshold."""
        out = []
        for size, (code, first, owners) in enumerate(self.tables, 1):
            if not len(code):
                continue
            own = self.codes(ids, size)
            k = np.minimum(np.searchsorted(code, own), len(code) - 1)
            place = np.flatnonzero((own >= 0) & (code[k] == own))
            k = k[place]
            total = np.cumsum(first[k + 1] - first[k])
            reach = int(self.span.max())
            s = 0
            while s < len(place):
                e = int(np.searchsorted(total, (total[s - 1] if s else 0) + PLACES, "right"))
                # Parts overlap by the longest span, so that every alignment is whole in one.
                e = max(e, int(np.searchsorted(place, place[s] + 2 * reach)))
                out += self.stretches(place[s:e], k[s:e], first, owners)
                if e >= len(place):
                    break
                s = int(np.searchsorted(place, place[e] - reach))
        return out

    def stretches(self, place, k, first, owners):
        count = first[k + 1] - first[k]
        at = np.repeat(place, count)
        item = owners[np.repeat(first[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        often = np.bincount(item, minlength=len(self.need)) >= self.need
        keep = often[item]
        at, item = at[keep], item[keep]
        order = np.argsort(item, kind="stable")
        at, item = at[order], item[order]
        # The last of the places that a stretch needs, counted from each.
        last = np.arange(len(at)) + self.need[item] - 1
        ok = last < len(at)
        last = np.minimum(last, len(at) - 1)
        ok &= (item[last] == item) & (at[last] - at < self.span[item])
        out, own, upto = [], -1, 0
        for i, s, e in zip(item[ok].tolist(), at[ok].tolist(), at[last[ok]].tolist(), strict=True):
            span = int(self.span[i])
            if i != own:
                own, upto = i, -1
            if s > upto:  # alignments that begin up to `upto` are whole in the passage before
                begin = max(e - span, upto + 1)
                out.append((i, begin, begin + 2 * span + 1))
                upto = begin + span
        return out


def align(items: np.ndarray, item_n: np.ndarray, passages: np.ndarray, passage_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage (rows of word numbers): score, and the passage's first and last word in it.

    The gap along the passage is a running maximum, so that a whole row of the
    matrix, of all pairs, is one step.
    """
    pairs, width = passages.shape
    column = np.arange(width + 1)
    score, origin = np.zeros((pairs, width + 1), np.int32), np.tile(column, (pairs, 1))
    best, start, end = (np.zeros(pairs, np.int64) for _ in range(3))
    inside = np.arange(width) < passage_n[:, None]
    rows = np.arange(pairs)
    # Score and origin in one number: the score decides, then the later origin.
    wide = np.int64(width + 2)
    for i in range(items.shape[1]):
        same = (items[:, i : i + 1] == passages) & inside & (items[:, i : i + 1] >= 0)
        step = np.where(same, 1, -1)
        diagonal = (score[:, :-1] + step) * wide + origin[:, :-1]
        up = (score[:, 1:] - 1) * wide + origin[:, 1:]
        here = np.maximum(np.maximum(diagonal, up), column[1:])
        run = np.maximum.accumulate(here + column[1:] * wide, axis=1) - column[1:] * wide
        here = np.maximum(here, run)
        live = (i < item_n)[:, None]
        new = np.where(live, here // wide, score[:, 1:])
        origin[:, 1:] = np.where(live, np.where(here // wide > 0, here % wide, column[1:]), origin[:, 1:])
        score[:, 1:] = new
        at = np.where(inside, new, 0).argmax(1)
        top = np.where((i < item_n), new[rows, at], 0)
        better = top > best
        best[better], end[better], start[better] = top[better], at[better] + 1, origin[rows, at + 1][better]
    return best, start, end


def aligner(items: list[tuple[int, list[str]]], threshold: float):
    """Arrow function: the items that each document leaks."""

    def run(rows):
        finder = Finder([words for _, words in items], threshold)
        numbers, get = finder.numbers, finder.vocabulary.get

        def flush(pending):
            out = []
            pending.sort(key=lambda p: (len(numbers[p[1]]), len(p[2])))
            while pending:
                # Lanes are as wide as their longest passage.
                k, width = 0, 0
                while k < min(LANES, len(pending)) and (not k or max(width, len(pending[k][2])) * (k + 1) <= CELLS):
                    width = max(width, len(pending[k][2]))
                    k += 1
                part, pending = pending[:k], pending[k:]
                item_n, passage_n = (np.array(x) for x in zip(*((len(numbers[p[1]]), len(p[2])) for p in part), strict=True))
                a, b = np.full((len(part), item_n.max()), -2), np.full((len(part), passage_n.max()), -3)
                for i, p in enumerate(part):
                    a[i, : item_n[i]], b[i, : passage_n[i]] = numbers[p[1]], p[2]
                best, start, end = align(a, item_n, b, passage_n)
                ok = best >= threshold * item_n
                out += [(p[0], items[p[1]][0], float(x / n), int(p[3] + f), int(p[3] + t)) for p, x, n, f, t, good in zip(part, best, item_n, start, end, ok, strict=True) if good]
            return out

        for batch in rows:
            pending, held, out = [], 0, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
                for item, s, e in finder(ids):
                    s, e = max(s, 0), min(e, len(ids))
                    pending.append((doc_id, item, ids[s:e], s))
                    held += e - s
                if len(pending) >= 4 * LANES or held >= 4 * CELLS:
                    out += flush(pending)
                    pending, held = [], 0
            out += flush(pending)
            kinds = (batch.column("doc_id").type, pa.int64(), pa.float64(), pa.int32(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "word_start", "word_end"])

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The items, a block of at most about ITEM_BLOCK words at a time, as they stream to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        words = words_of(r.t)
        if words:
            block.append((r.i, words))
            size += len(words)
        if size >= ITEM_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD, item_text_col: str = "text") -> DataFrame:
    """Per document, item and passage that reach the threshold: doc_id, item_id, score, word_start, word_end."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    found = None
    for items in blocks_of(benchmark, item_col, item_text_col):
        hits = map_arrow(base, aligner(items, threshold), HITS.format(kind=kind))
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], HITS.format(kind=kind)) if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, contaminated, items (sorted ids of leaked items), score (of the best alignment, 0 if none reaches the threshold)."""
    text = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    found = materialize(leaks(docs.select(text.alias("_kl_row"), F.col(text_col).alias("_text")), benchmark, "_kl_row", "_text", threshold=threshold), "leaks")
    by = found.groupBy(F.col("doc_id").alias("hash")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("score").alias("score"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("hash"))
    out = rows.join(by, "hash", "left")
    return out.select("doc_id", F.col("score").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("score", F.lit(0.0)).alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that leak no test item: each row is judged by its own text, whatever ids are null or repeat."""
    key = row_key(id_col, text_col).getField("hash")
    return without(docs, key, leaks(docs.select(key.alias("_kl_row"), F.col(text_col)), benchmark, "_kl_row", text_col).select("doc_id"))
