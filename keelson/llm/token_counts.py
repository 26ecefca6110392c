"""Token counts by dynamic programming shared over a trie.

The distinct pre-tokens of a task form a trie.  The best unigram score of a
prefix, and the number of tokens that reach it, depend on the prefix alone, so
that each trie node is computed once however many pre-tokens pass through it.
The node where a pre-token ends has its count.  A document's count is the sum
over its pre-tokens, spaces included, with a space put in front of the text.

The trie is laid out as the sorted pre-tokens and their common prefixes: a row
owns the nodes beyond the prefix it shares with the row before, and takes the
others from the row that owns them.  All nodes of one depth are one numpy step.

Defined cases: null and empty texts have no tokens; a text is read whole, one
over a million characters in pieces cut before white space; repeated rows have a
result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .unigram import BulkSegmenter, Vocabulary, load_vocabulary, segment

#: A task forgets its pre-tokens beyond so many, and lays out so many at a time, which bounds its memory.
REMEMBER, ROWS = 600_000, 1 << 14
#: Characters of text for one step.
GROUP = 1 << 21


class Trie:
    """Token counts of pre-tokens."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.bulk, self.width = voc, BulkSegmenter(voc), BulkSegmenter.LONGEST

    def counts(self, words: list[str]) -> dict[str, int]:
        out = {w: len(segment(w, self.voc)[1]) for w in words if len(w) > self.width}
        usual = sorted(w for w in words if 0 < len(w) <= self.width)
        for at in range(0, len(usual), ROWS):
            part = usual[at : at + ROWS]
            out.update(zip(part, self._terminals(part), strict=True))
        return out

    def _terminals(self, words: list[str]) -> list[int]:
        bulk, m, width = self.bulk, len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        raw = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(raw, np.uint32).reshape(m, width)
        shared = np.zeros(m, np.int64)
        shared[1:] = np.minimum(np.minimum(size[1:], size[:-1]), np.cumprod(chars[1:] == chars[:-1], axis=1).sum(1))
        sums = np.zeros((m, width + 1), np.uint64)
        np.cumsum(bulk.spread(chars) * bulk.power[:width], axis=1, out=sums[:, 1:])
        score, tokens = np.zeros((m, width + 1), np.int64), np.zeros((m, width + 1), np.int32)
        for depth in range(1, width + 1):
            owned = (depth > shared) & (depth <= size)
            row = np.flatnonzero(owned)
            if not len(row):
                break
            top, count = np.full(len(row), -(1 << 60), np.int64), np.zeros(len(row), np.int32)
            for n in range(min(depth, self.voc.longest), 0, -1):
                ids, points = bulk.lookup((sums[row, depth] - sums[row, depth - n]) * bulk.inverse[depth - n])
                more = np.ones(len(row), np.int32)
                if n == 1 and (missing := ids < 0).any():
                    c = chars[row, depth - 1]
                    raw_size = 1 + (c >= 0x80).astype(np.int32) + (c >= 0x800) + (c >= 0x10000)
                    points, more, ids = np.where(missing, raw_size * self.voc.byte_score, points), np.where(missing, raw_size, 1), np.where(missing, 0, ids)
                through = score[row, depth - n] + points
                better = (ids >= 0) & (through > top)
                top, count = np.where(better, through, top), np.where(better, tokens[row, depth - n] + more, count)
            score[row, depth], tokens[row, depth] = top, count
            owner = np.maximum.accumulate(np.where(owned, np.arange(m), 0))
            score[:, depth], tokens[:, depth] = score[owner, depth], tokens[owner, depth]
        return tokens[np.arange(m), size].tolist()


def cut_text(text: str, limit: int = 1 << 20):
    """Pieces of about `limit` characters that begin where a space follows another character."""
    start = 0
    while len(text) - start > limit:
        at = start + limit
        while 0 <= (at := text.find(" ", at)) and text[at - 1] == " ":
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def counter(voc: Vocabulary):
    """Arrow function: doc_id, n_pretokens, n_tokens."""

    def run(rows):
        split, trie, known = voc.splitter().findall, Trie(voc), {}
        for batch in rows:
            texts = batch.column("_text").to_pylist()
            pre, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            words, owner, sizes, weight = [], [], [], 0

            def flush(pre=pre, total=total, words=words, owner=owner, sizes=sizes):
                if new := [w for w in dict.fromkeys(words) if w not in known]:
                    known.update(trie.counts(new))
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                who = np.repeat(np.array(owner, np.int64), sizes)
                pre[:] += np.bincount(who, minlength=len(pre))
                total[:] += np.bincount(who, n, len(total)).astype(np.int64)
                words.clear(), owner.clear(), sizes.clear()
                if len(known) > REMEMBER:
                    known.clear()

            for i, text in enumerate(texts):
                for piece in cut_text(" " + text if text else ""):
                    got = split(piece)
                    words += got
                    owner.append(i)
                    sizes.append(len(got))
                    weight += len(piece)
                    if weight > GROUP:
                        flush()
                        weight = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pre), pa.array(total)], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_pretokens, n_tokens.  `vocabulary`: a SentencePiece model file or a Vocabulary."""
    voc = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return map_arrow(base, counter(voc), f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
