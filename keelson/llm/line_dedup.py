"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower case, cut at `[\\x20\\x09-\\x0D]`).  A line goes if
any earlier line (smaller id, or earlier in the same document) has Jaccard
similarity `threshold` or more with it, whether that line stays or not.  Lines
without words always stay.

1. Lines with equal sets are found by a 128-bit digest; all but the first go.
   What follows compares distinct sets, each by its first line.
2. Words are ordered by rarity: by their counts in a table of `SLOTS` counters,
   which is of fixed size, and then by hash.  Any order common to all lines gives
   exact results; this one makes for short lists.
3. A line of n words has the prefix of its n - ceil(threshold * n) + 1 rarest
   words, and two similar lines share a word of their prefixes.  Each task sends
   one entry a prefix word and distinct set; words that the counters show to
   occur once are left out.  In the list of a word, pairs pass the length filter
   (the list is ordered by length), the positional filter (what can still be
   shared, given the word's places in both), and a bound on the words that differ
   from signatures: a word flips one of 128 bits, so that at least as many words
   differ as bits do.  The list of a word that may be over `BIG` long is dealt out
   in pairs of blocks.
4. Of a line's earlier partners in a list that pass, the two with the nearest
   signatures and the earliest go on, so that a group of many near copies gives a
   few pairs a line; if none is plainly near, all do, up to `FEW`.  Their words are
   fetched, and Jaccard similarity is verified.
   A line that has more partners, and none verified, gets all of them in a second
   pass over the stored entries of its words: nothing is lost.

Defined cases: null and empty texts have one line without words; ids are whole
numbers, and a null id comes last; rows that repeat an id with another text follow
each other by the text's hash; rows that repeat id and text are one document, whose
result each of them gets; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import mix
from .common import BITMAP, discard, map_arrow, materialize, perhaps_in
from .suffix_dedup import Roller, tidy

THRESHOLD = 0.8
SLOTS, CHUNKS = 1 << 22, 64
#: Distinct words of lines for one bucket.
PER_BUCKET = 1 << 20
#: Characters in one numpy pass, and entries in a word's list that one task compares with each other.
GROUP, BIG = 1 << 20, 1 << 15
#: Entries that a task packs together.
ENTRIES = 1 << 19
#: Bytes of entries that a task sends at a time.
BATCH = 4 << 20
#: A line gets all its partners in a list at once if it has so few, and none is plainly near.
FEW = 32
LAST_ID = (1 << 63) - 1
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
#: Columns of an entry: word, set, id, hash of a repeated id's text, line, size, place of the word, signature.
ENTRY = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint32, np.uint32, np.uint64, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Lines:
    """The distinct words of lines, as hashes, for many lines at once; with `level` from the rarest, else in any order."""

    def __init__(self, level: np.ndarray | None = None):
        self.level, self.roller = level, Roller(2 * GROUP)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bytes: the line that each word is in, and its hash."""
        lines, hashes, at, line = [], [], 0, 0
        while at < len(data):
            end = min(at + 2 * GROUP, len(data))
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            part = data[at:end]
            if len(part) >= len(self.roller.power):
                self.roller = Roller(2 * len(part))
            word = np.append(False, ~_SPACE[part])
            start, stop = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word & ~np.append(word[1:], False))
            breaks = np.cumsum(part == 10)
            lines.append(breaks[start] + line)
            hashes.append(mix(self.roller.span(self.roller.sums(part), start, stop)))
            line += int(breaks[-1])
            at = end
        return np.concatenate(lines), np.concatenate(hashes)

    def rarity(self, hashes: np.ndarray) -> np.ndarray:
        """The order of words: the first byte is the rarity."""
        return (self.level[(hashes % _U(SLOTS)).astype(np.int64)].astype(_U) << _U(56)) | (hashes >> _U(8))

    def __call__(self, pieces: list[tuple[int, int, str]]):
        """Of pieces (document, number of the first line, text): document, line, start and size of the lines with words, and the hashes of all their words."""
        none = np.zeros(0, np.int64)
        data = np.frombuffer("\n".join([p[2] for p in pieces]).lower().encode("utf-8", "surrogatepass"), np.uint8)
        if not len(data):
            return none, none, none, none, none.astype(_U)
        owner, h = self.words(data)
        number, known = pd.factorize(h)
        if self.level is not None:
            by = np.argsort(self.rarity(known), kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            known, number = known[by], rank[number]
        key = np.sort((owner << 32) | number)
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        line, start, size = np.unique(key >> 32, return_index=True, return_counts=True)
        total = np.array([p[2].count("\n") + 1 for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), total)[line]
        first = np.array([p[1] for p in pieces], np.int64) - (np.cumsum(total) - total)
        return np.array([p[0] for p in pieces], np.int64)[piece], first[piece] + line, start, size, known[key & 0xFFFFFFFF]


def groups_of(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """(document, number of the first line, piece) in lists of about GROUP characters; no line is cut."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = line = 0
        while True:
            end = text.find("\n", at + GROUP) if len(text) - at > GROUP else -1
            piece = text[at:] if end < 0 else text[at:end]
            group.append((i, line, piece))
            size += len(piece)
            if size >= GROUP:
                yield group
                group, size = [], 0
            if end < 0:
                break
            at, line = end + 1, line + piece.count("\n") + 1
    if group:
        yield group


def digests(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its words."""
    return tuple(np.add.reduceat(mix(hashes ^ _U(seed)), start) if len(start) else np.zeros(0, _U) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def tally(total: np.ndarray, hashes: np.ndarray) -> None:
    """Count words in their slots.  A one of the table's own type: of any other, numpy converts at every word."""
    np.add.at(total, (hashes % _U(SLOTS)).astype(np.int64), total.dtype.type(1))


LINES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("chunk", pa.int32()), ("blob", pa.binary())])
LINES_DDL = "id bigint, th bigint, line int, n int, d1 bigint, d2 bigint, chunk int, blob binary"


def liner(rows):
    """Arrow function: a row for each line with words (its digest), for each document (line -1; n: number of lines), and for the counters of a task's words (line -2)."""
    split, total = Lines(), np.zeros(SLOTS, np.uint32)
    for batch in rows:
        ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
        texts = batch.column("_text").to_pylist()
        blank = lambda n, kind: pa.nulls(n, kind)
        n = len(texts)
        counts = pa.array([t.count("\n") + 1 for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(np.full(n, -1, np.int32)), counts, blank(n, pa.int64()), blank(n, pa.int64()), blank(n, pa.int32()), blank(n, pa.binary())], schema=LINES)
        for group in groups_of(texts):
            doc, line, start, size, h = split(group)
            if len(doc):
                tally(total, h)
                d1, d2 = digests(h, start)
                m = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ths[doc]), pa.array(line.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), blank(m, pa.int32()), blank(m, pa.binary())], schema=LINES)
    size = SLOTS // CHUNKS
    blobs = [pa.compress(total[i * size : (i + 1) * size].tobytes(), codec="zstd", asbytes=True) for i in range(CHUNKS)]
    yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array([-2] * CHUNKS, pa.int32()), *(pa.nulls(CHUNKS, k) for k in (pa.int32(), pa.int64(), pa.int64())), pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], schema=LINES)


def chunk_sum(rows: pa.Table) -> pa.Table:
    """Rarity of a chunk's slots: 0 for none, 1 for one, then by logarithm of the count."""
    size = SLOTS // CHUNKS
    total = np.zeros(size, np.int64)
    for blob in rows.column("blob"):
        total += np.frombuffer(pa.decompress(blob.as_py(), decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint32)
    level = np.where(total == 0, 0, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(total, 1))))).astype(np.uint8)
    return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()), "blob": pa.array([level.tobytes()], pa.binary())})


def prefix_size(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def planes(c: np.ndarray) -> bytes:
    """A column byte by byte: all first bytes, all second bytes and so on."""
    return np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes()


def pack(columns) -> bytes:
    """Entries, with what entries of one line share (all but word and place) once where they follow each other."""
    word, mark, ids, ths, line, size, place, low, high = columns
    new = np.append(True, np.any([c[1:] != c[:-1] for c in (mark, ids, ths, line)], axis=0))
    own = (mark[new], np.diff(ids[new].view(_U), prepend=_U(0)), ths[new], line[new], size[new], low[new], high[new])
    raw = new.tobytes() + b"".join(map(planes, (word, place, *own)))
    return int(new.sum()).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    """The columns of `n` packed entries."""
    m, width = int.from_bytes(blob[:4], "little"), [np.dtype(k).itemsize for k in ENTRY]
    shared = [k for k in range(len(ENTRY)) if k not in (0, 6)]
    size = n * (1 + width[0] + width[6]) + m * sum(width[k] for k in shared)
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    line, at, out = np.cumsum(raw[:n], dtype=np.int64) - 1, n, {}
    for k in (0, 6, *shared):
        rows = m if k in shared else n
        out[k] = np.ascontiguousarray(raw[at : at + rows * width[k]].reshape(width[k], rows).T).view(ENTRY[k]).reshape(rows)
        at += rows * width[k]
    out[2] = np.cumsum(out[2].view(_U), dtype=_U).view(np.int64)
    return [out[k][line] if k in shared else out[k] for k in range(len(ENTRY))]


def levels_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=SLOTS, codec="zstd", asbytes=True), np.uint8)


def prefixes(word: np.ndarray, start, size, mark, threshold: float):
    """(line, word, place) of the prefix words, from the words of lines in order of rarity; a word whose list may be long stands for a pair of blocks."""
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(start, size)
    least = math.ceil(threshold / (1 - threshold) - 1e-9)  # below this size a line can't be similar to one that differs
    keep = (place < np.repeat(prefix_size(size, threshold), size)) & (word >> _U(56) != 1) & np.repeat(size >= least, size)
    line, place, word = line[keep], place[keep], word[keep]
    # Words are cut to 48 bits at the end: lists of different words that meet bring candidates in vain, and lose none.
    blocks = np.maximum(1, np.ceil(2 ** (((word >> _U(56)).astype(np.float64) - 1) / 8) / BIG)).astype(np.int64)
    if len(blocks) and blocks.max() > 1:
        of = np.repeat(np.arange(len(blocks)), blocks)
        other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        line, place, word, k = line[of], place[of], word[of], blocks[of]
        own = (mark[line] % k.astype(_U)).astype(np.int64)
        pair = np.minimum(own, other) * k + np.maximum(own, other) + 1
        word = np.where(k > 1, mix(word ^ (pair.astype(_U) * _PRIME)), word)
    return line, word >> _U(16), place


def flush(found: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries as one packed row a bucket, in batches of about `BATCH` bytes; of equal sets in a word's list only the first line."""
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    word, mark, ids, ths, line, _, place = columns[:7]
    order = np.lexsort((place, mark, word))
    same = np.all([c[order[1:]] == c[order[:-1]] for c in (word, mark, place)], axis=0)
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(several):
        at = order[several]
        order[several] = at[np.lexsort((line[at], ths[at], ids[at], place[at], mark[at], word[at]))]
        order = np.sort(order[np.append(True, ~same)])
    else:
        order = np.arange(len(word))
    part = (word[order] % _U(buckets)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    order, part = order[by], part[by]
    columns = [c[order] for c in columns]
    cut = np.searchsorted(part, np.arange(buckets + 1))
    out = [(b, int(cut[b + 1] - cut[b]), pack(c[cut[b] : cut[b + 1]] for c in columns)) for b in np.unique(part).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "n", "blob"])
    step = max(1, len(batch) * BATCH // batch.nbytes)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def poster(levels: bytes, buckets: int, threshold: float, signature: int):
    """Arrow function: entries by bucket of the word."""

    def run(rows):
        split = Lines(levels_of(levels))
        found, held = [], 0
        for batch in rows:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            order = np.lexsort((ths, ids))
            texts = batch.column("_text").take(pa.array(order)).to_pylist()
            ids, ths = ids[order], ths[order]
            for group in groups_of(texts):
                doc, number, start, size, h = split(group)
                if not len(doc):
                    continue
                mark = digests(h, start)[0]
                bit = h & _U(signature)
                one = _U(1) << (bit & _U(63))
                low, high = (np.bitwise_xor.reduceat(np.where((bit >> _U(6)) == k, one, _U(0)), start) for k in (0, 1))
                line, word, place = prefixes(split.rarity(h), start, size, mark, threshold)
                # Of equal sets in a group the first is enough: it is the earliest there.
                first = np.zeros(len(mark), bool)
                first[np.unique(mark, return_index=True)[1]] = True
                keep = first[line]
                line, word, place = line[keep], word[keep], place[keep]
                found.append([c.astype(k) for c, k in zip((word, mark[line], ids[doc[line]], ths[doc[line]], number[line], size[line], place, low[line], high[line]), ENTRY, strict=True)])
                held += len(word)
                if held >= ENTRIES:
                    yield from flush(found, buckets)
                    found, held = [], 0
        if held:
            yield from flush(found, buckets)

    return run


def picker(wanted: bytes):
    """Arrow function: of packed entries those whose word is in a bitmap."""

    def run(rows):
        bits = np.frombuffer(pa.decompress(wanted, decompressed_size=BITMAP // 8, codec="zstd", asbytes=True), np.uint8)
        for batch in rows:
            for part, n, blob in zip(*(batch.column(c) for c in ("part", "n", "blob")), strict=True):
                columns = unpack(blob.as_py(), n.as_py())
                at = (columns[0] % _U(BITMAP)).astype(np.int64)
                hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([len(hit)], pa.int32()), pa.array([pack(c[hit] for c in columns)], pa.binary())], names=["part", "n", "blob"])

    return run


def node_bytes(ids: np.ndarray, ths: np.ndarray, line: np.ndarray) -> pa.Array:
    """20 bytes each, whose order is the corpus order."""
    out = np.empty((len(ids), 20), np.uint8)
    for at, c in ((0, ids), (8, ths)):
        out[:, at : at + 8] = (c.astype(np.int64).view(_U) ^ _U(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16:] = line.astype(">u4").view(np.uint8).reshape(-1, 4)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(20), len(ids), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


PAIRS = pa.schema([("later", pa.binary()), ("earlier", pa.binary()), ("more", pa.bool_())])
PAIRS_DDL = "later binary, earlier binary, more boolean"


class Bucket:
    """The lists of one bucket's words."""

    def __init__(self, rows: pa.Table):
        parts = [unpack(b, n) for b, n in zip(rows.column("blob").to_pylist(), rows.column("n").to_pylist(), strict=True)]
        word, mark, ids, ths, line, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        n, place = rest[:2]
        order = np.lexsort((line, ths, ids, place, mark, word))
        new = np.append(True, np.any([c[order[1:]] != c[order[:-1]] for c in (word, mark, place)], axis=0))[: len(order)]
        order = order[new]  # the first line of each set; its words that share a cut number differ in place
        order = order[np.lexsort((mark[order], n[order], word[order]))]
        self.word, self.mark, self.ids, self.ths, self.line, n, place, self.low, self.high = (c[order] for c in (word, mark, ids, ths, line, *rest))
        self.n, self.place = n.astype(np.int64), place.astype(np.int64)
        self.when = np.empty(len(order), np.int64)
        self.when[np.lexsort((self.line, self.ths, self.ids))] = np.arange(len(order))

    def pairs(self, threshold: float):
        """Yield (later, earlier, differing bits) of pairs that pass the filters; a line is at most twice the later one in a step."""
        word, n, place = self.word, self.n, self.place
        active, d = np.arange(max(len(word) - 1, 0)), 1
        while len(active):
            active = active[active + d < len(word)]
            y = active + d
            # Lists are ordered by size: a pair too far apart in size is the end of a row.
            active = active[(word[y] == word[active]) & (n[active] >= threshold * n[y] - 1e-9)]
            x, y = active, active + d
            both = n[x] + n[y]
            need = np.ceil(threshold / (1 + threshold) * both - 1e-9)
            can = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
            bits = (np.bitwise_count(self.low[x] ^ self.low[y]) + np.bitwise_count(self.high[x] ^ self.high[y])).astype(np.int64)
            near = (can >= need) & (bits <= both - 2 * need) & (self.mark[x] != self.mark[y])
            x, y, bits = x[near], y[near], bits[near]
            forward = self.when[x] < self.when[y]
            for later, earlier, ok in ((y, x, forward), (x, y, ~forward)):
                if ok.any():
                    yield later[ok], earlier[ok], bits[ok]
            d += 1

    def table(self, later: np.ndarray, earlier: np.ndarray, more: np.ndarray) -> pa.Table:
        nodes = [node_bytes(self.ids[k], self.ths[k], self.line[k]) for k in (later, earlier)]
        return pa.Table.from_arrays([*nodes, pa.array(more, pa.bool_())], schema=PAIRS)


def chooser(threshold: float):
    """Function over one bucket: of each line's earlier partners in a word's list the two nearest and the earliest; `more` if there are others."""

    def run(rows: pa.Table) -> pa.Table:
        b = Bucket(rows)
        m = len(b.word)
        far = 1 << 40
        near, second, first = (np.full(m, far) for _ in range(3))
        who = np.full((3, m), -1)
        count = np.zeros(m, np.int64)
        # Bits that are expected to differ where far fewer words do than may.
        plain = 64 * (1 - np.exp(-0.6 / 64 * 2 * (1 - threshold) / (1 + threshold) * b.n))
        kept, held = [], 0
        for later, earlier, bits in b.pairs(threshold):
            count[later] += 1
            few = (count[later] <= FEW) & (np.minimum(near[later], bits) > plain[later])
            kept.append((later[few], earlier[few]))
            held += int(few.sum())
            if held > 4 * m + 100_000:
                kept = [tuple(np.concatenate(c) for c in zip(*kept, strict=True))]
                few = (count[kept[0][0]] <= FEW) & (near[kept[0][0]] > plain[kept[0][0]])
                kept = [(kept[0][0][few], kept[0][1][few])]
                held = int(few.sum())
            closer = bits < near[later]
            k = later[closer]
            second[k], who[1, k], near[k], who[0, k] = near[k], who[0, k], bits[closer], earlier[closer]
            next_ = ~closer & (bits < second[later])
            k = later[next_]
            second[k], who[1, k] = bits[next_], earlier[next_]
            before = b.when[earlier] < first[later]
            k = later[before]
            first[k], who[2, k] = b.when[earlier[before]], earlier[before]
        who[2] = np.where((who[2] == who[0]) | (who[2] == who[1]), -1, who[2])
        whole = (count <= FEW) & (near > plain)
        who[:, whole] = -1
        more = (count > (who >= 0).sum(0)) & ~whole
        which, later = np.nonzero(who >= 0)
        earlier = who[which, later]
        if kept:
            a, e = (np.concatenate(c) for c in zip(*kept, strict=True))
            ok = whole[a]
            later, earlier = np.concatenate([later, a[ok]]), np.concatenate([earlier, e[ok]])
        return b.table(later, earlier, more[later])

    return run


def completer(threshold: float):
    """Function over one bucket and the sets in it that need all their partners: all pairs of these."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        if not len(rows) or not len(sets):
            return PAIRS.empty_table()
        b = Bucket(rows)
        chosen = np.isin(b.mark, sets.column("mark").to_numpy().view(_U))
        out = [(later[c], earlier[c]) for later, earlier, _ in b.pairs(threshold) if (c := chosen[later]).any()]
        if not out:
            return PAIRS.empty_table()
        later, earlier = (np.concatenate(x) for x in zip(*out, strict=True))
        return b.table(later, earlier, np.zeros(len(later), bool))

    return run


def places_of(levels: bytes, buckets: int, threshold: float):
    """Arrow function: bucket, mark and word of the list entries of given sets."""

    def run(rows):
        split = Lines(levels_of(levels))
        for batch in rows:
            hashes = [np.frombuffer(w, _U) for w in batch.column("words").to_pylist()]
            out = []
            for h in hashes:
                mark = digests(h, np.zeros(1, np.int64))[0]
                order = np.sort(split.rarity(h))
                word = prefixes(order, np.zeros(1, np.int64), np.array([len(h)]), mark, threshold)[1]
                out.append((word, np.full(len(word), mark[0], _U)))
            word, mark = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, _U)] * 2
            yield pa.RecordBatch.from_arrays([pa.array((word % _U(buckets)).astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(word.view(np.int64))], names=["part", "mark", "word"])

    return run


def fetcher(rows):
    """Arrow function: the word sets of wanted lines."""
    split = Lines()
    for batch in rows:
        ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
        wanted = batch.column("wanted").to_pylist()
        for group in groups_of(batch.column("_text").to_pylist()):
            doc, line, start, size, h = split(group)
            asked = np.array([(i << 32) | k for i in dict.fromkeys(p[0] for p in group) for k in wanted[i]], np.int64)
            got = np.flatnonzero(np.isin((doc << 32) | line, asked))
            sets = [h[s : s + n].tobytes() for s, n in zip(start[got].tolist(), size[got].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([node_bytes(ids[doc[got]], ths[doc[got]], line[got]), pa.array(sets, pa.binary())], names=["node", "words"])


def verifier(threshold: float):
    """Arrow function over pairs with both sets: the later lines that are similar to the earlier one."""

    def run(rows):
        for batch in rows:
            if not len(batch):
                continue
            a, b = ([np.frombuffer(w, _U) for w in batch.column(c).to_pylist()] for c in ("wa", "wb"))
            na, nb = (np.array([len(x) for x in side]) for side in (a, b))
            flat = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1].astype(np.int64)
            key = np.sort((np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)]) << 32) | flat)
            both = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(a))
            ok = both * (1 + threshold) >= threshold * (na + nb) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("later").filter(pa.array(ok))], names=["later"])

    return run


def remover(rows):
    """Arrow function: texts without the removed lines."""
    for batch in rows:
        kept = []
        for text, removed in zip(batch.column("_text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            gone = set(removed or ())
            kept.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_removed"), batch.column("removed"), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "removed", "kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, want_text: bool = False, signature: int = 127) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines, n_removed, removed (sorted line numbers from 0); with `want_text` also kept.  `signature` masks the signatures' bits, for tests."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"), text.alias("_text"))
    again = (base.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > 1
    base = base.select("id", (F.xxhash64("_text") if again else F.lit(0).cast("bigint")).alias("th"), "_text")

    lines = materialize(map_arrow(base, liner, LINES_DDL), "lines")
    total = lines.where("line >= 0").agg(F.sum("n")).first()[0] or 0
    buckets = max(32, int(total) // PER_BUCKET)
    # One row a chunk: the table of counters is of fixed size.
    levels = {r.chunk: bytes(r.blob) for r in lines.where("line = -2").select("chunk", "blob").groupBy("chunk").applyInArrow(tidy(chunk_sum), "chunk int, blob binary").collect()}
    level = pa.compress(b"".join(levels.get(i, bytes(SLOTS // CHUNKS)) for i in range(CHUNKS)), codec="zstd", asbytes=True)

    def similar(pairs: DataFrame):
        """The later lines of pairs that are similar, and the word sets that were fetched."""
        nodes = pairs.select(F.col("later").alias("node")).unionByName(pairs.select(F.col("earlier").alias("node"))).distinct()
        signed = lambda at: F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
        wanted = nodes.select(signed(1).alias("id"), signed(9).alias("th"), F.conv(F.hex(F.substring("node", 17, 4)), 16, 10).cast("int").alias("line"))
        wanted = materialize(wanted.groupBy("id", "th").agg(F.collect_list("line").alias("wanted")), "wanted")
        likely = perhaps_in(base, "id", wanted, "id").where("_kl_perhaps").drop("_kl_perhaps")
        texts = (likely.dropDuplicates(["id", "th"]) if again else likely).hint("merge").join(wanted, ["id", "th"]).select("id", "th", "_text", "wanted")
        sets = materialize(map_arrow(texts, fetcher, "node binary, words binary"), "line-words")
        first = pairs.select("later", "earlier").hint("merge").join(sets.select(F.col("node").alias("earlier"), F.col("words").alias("wa")), "earlier").select("later", "wa")
        both = first.hint("merge").join(sets.select(F.col("node").alias("later"), F.col("words").alias("wb")), "later").select("later", "wa", "wb")
        return materialize(map_arrow(both, verifier(threshold), "later binary").distinct(), "similar"), sets

    entries_ddl = "part int, n int, blob binary"
    entries = materialize(map_arrow(base, poster(level, buckets, threshold, signature), entries_ddl), "line-entries")
    chosen = entries.groupBy("part").applyInArrow(tidy(chooser(threshold)), PAIRS_DDL)
    pairs = materialize(chosen.groupBy("later", "earlier").agg(F.max("more").alias("more")), "line-pairs")
    found, sets = similar(pairs)
    # Lines with further partners, none of the first being similar: all their pairs.
    open_ = materialize(pairs.where("more").select("later").distinct().hint("merge").join(found, "later", "left_anti"), "open-lines")
    if not open_.isEmpty():
        at = materialize(map_arrow(sets.hint("merge").join(open_.withColumnRenamed("later", "node"), "node", "left_semi"), places_of(level, buckets, threshold), "part int, mark bigint, word bigint"), "open-places")
        bit = F.expr(f"cast(conv(hex(word), 16, 10) as decimal(20,0)) % {BITMAP}").cast("bigint")
        marked = np.zeros(BITMAP, bool)
        for r in at.select(F.expr("1L").alias("one"), bit.alias("bit")).groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(one, cast(bit % 64 as int)))").alias("bits")).toLocalIterator():
            marked[r.w * 64 : r.w * 64 + 64] = np.unpackbits(np.array([r.bits], np.int64).view(np.uint8), bitorder="little").astype(bool)
        wanted_words = pa.compress(np.packbits(marked, bitorder="little").tobytes(), codec="zstd", asbytes=True)
        picked = map_arrow(entries, picker(wanted_words), entries_ddl)
        rest = picked.groupBy("part").cogroup(at.select("part", "mark").distinct().groupBy("part")).applyInArrow(completer(threshold), PAIRS_DDL)
        found = found.unionByName(similar(materialize(rest.select("later", "earlier").distinct(), "line-pairs"))[0]).distinct()
    discard(entries)

    # Equal sets: all lines but the first.  Classes over the limit are at most 1000, and are broadcast.
    own = lines.where("line >= 0").select("id", "th", "line", "d1", "d2")
    if again:
        own = own.distinct()
    at = F.struct("id", "th", "line")
    classes = materialize(own.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(at).alias("first")).where("c > 1"), "classes")
    limit = max(1000, lines.count() // 1000)
    big, small = F.broadcast(classes.where(F.col("c") > limit)), classes.where(F.col("c") <= limit)
    copies = [side.join(part, ["d1", "d2"]).where(at != F.col("first")).select("id", "th", "line") for side, part in ((own, big), (own.join(F.broadcast(classes.where(F.col("c") > limit)), ["d1", "d2"], "left_anti").hint("merge"), small))]
    signed = lambda at: F.conv(F.hex(F.substring("later", at, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    near = found.select(signed(1).alias("id"), signed(9).alias("th"), F.conv(F.hex(F.substring("later", 17, 4)), 16, 10).cast("int").alias("line"))
    # A set's first line is no copy, and only first lines are near: none is here twice.
    gone = copies[0].unionByName(copies[1]).unionByName(near)
    removed = gone.groupBy("id", "th").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    each = lines.where("line = -1").select("id", "th", F.col("n").cast("bigint").alias("n_lines"))
    out = each.hint("merge").join(removed, ["id", "th"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    out = out.select("id", "th", F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")
    if not want_text:
        return out.drop("id", "th")
    whole = out.join(base.dropDuplicates(["id", "th"]), ["id", "th"]).drop("id", "th")
    return map_arrow(whole, remover, "doc_id bigint, n_lines bigint, n_removed bigint, removed array<int>, kept string")
