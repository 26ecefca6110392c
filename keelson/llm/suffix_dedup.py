"""Removal of repeated 100-byte strings by prefix-free parsing.

Every document is a string of UTF-8 bytes (null: empty).  A byte goes if a
`length`-byte string that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one.  Strings never cross documents and are
judged on the input.

1. Parse.  A rolling hash of `GRAM` bytes runs over the text.  The trigger of a
   100-byte string is the place with the smallest hash inside it (the first of
   equals), so that every string has one and equal strings have it at the same
   distance.  Successive strings with one trigger make a phrase: the bytes from
   its first string's start to its last string's end.
2. Dictionary.  Phrases are keyed by the hash at their trigger, and by a
   fingerprint of all their bytes.  Of equal phrases, all but the first in
   corpus order are repeats throughout.  Each task settles its own repeats
   before the shuffle, so that a passage which many documents share reaches the
   shuffle once a task.  A key with one distinct phrase is settled.
3. Corpus order.  Where a key has several distinct phrases, the bytes of the first
   occurrence of each are fetched and parsed again, at windows whose hash is 0
   modulo `MODULUS`.  The suffix array of the distinct short phrases (the
   dictionary) and that of their sequence (the parse) combine into the order of
   all suffixes, in which equal 100-byte strings are neighbours and are compared
   byte by byte.  Of equal ones, all but the first in the corpus are repeats.
4. The spans found are brought to their documents, merged and cut out.

Equality of whole phrases in step 2 rests on two 64-bit hashes.  Shuffled are about 20 bytes a phrase (one per 35 bytes of text), the
bytes of unsettled phrases, and the texts twice.

Defined cases: ids are whole numbers, and a null id comes last; texts under 100
bytes stay whole; rows that repeat an id with another text follow each other in
an order given by the text's hash; rows that repeat id and text are one
document, whose result every one of them gets; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release_memory

LENGTH, GRAM = 100, 32
#: Bytes of text in one numpy pass, and the bits that number its places.
BLOCK, BITS = 1 << 18, 20
#: Phrases that a task gathers before it sends them, and the bytes of one batch of them.
GATHERED, BATCH = 1 << 20, 4 << 20
#: Bytes of text for one bucket of phrases.
PER_BUCKET = 8 << 20
LAST_ID = (1 << 63) - 1
_U = np.uint64


def _mix(h):
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a base, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Rolling hashes of a buffer of at most `size` bytes."""

    def __init__(self, size: int):
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
        self.power, self.inverse = (powers(x, size) for x in (base, inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def phrases(segments: list[bytes], roller: Roller, length: int) -> tuple[np.ndarray, ...]:
    """Of segments laid end to end: segment number, trigger, first and last start (within the segment), key and fingerprint of each phrase."""
    size = np.array([len(x) for x in segments], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(segments), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = roller.sums(data)
    n = len(data) - GRAM + 1
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * roller.inverse[:n])
    low = _U((1 << BITS) - 1)
    trigger = (lowest((h & ~low) | np.arange(n, dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    m = len(trigger)
    owner = np.repeat(np.arange(len(segments)), size)[:m]
    fits = np.arange(m) + length <= (start + size)[owner]
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (trigger[1:] != trigger[:-1])
    last = fits.copy()
    last[:-1] &= ~fits[1:] | (trigger[1:] != trigger[:-1])
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    a = trigger[s]
    key = h[a]
    mark = _mix(roller.span(sums, s, e + length) + _mix(((a - s) * 256 + (a - e)).astype(np.uint64)))
    own = owner[s]
    return own, a - start[own], s - start[own], e - start[own], key, mark


def segments_of(texts: list[bytes], length: int):
    """Lists of (document number, offset, bytes) of about BLOCK bytes; long texts are cut with length - 1 bytes of overlap."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            piece = text[at : at + BLOCK + length - 1]
            group.append((i, at, piece))
            size += len(piece)
            at += BLOCK
            if size >= BLOCK:
                yield group
                group, size = [], 0
            if at + length - 1 >= len(text):
                break
    if group:
        yield group


def pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: Columns of a phrase: key, mark, id, hash of a repeated id's text, trigger, bytes from first and last start to it.
PHRASE = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8)
SHUFFLED = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
FOUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("settled", pa.bool_()), ("n", pa.int32()), ("blob", pa.binary())])
BYTES = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("blob", pa.binary()), ("text", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def by_document(ids: np.ndarray, ths: np.ndarray, *columns: np.ndarray):
    """Yield (id, hash, slices of the columns) for each document."""
    if not len(ids):
        return
    order = np.lexsort((ths, ids))
    ids, ths, columns = ids[order], ths[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])]))
    for s, e in zip(cut, [*cut[1:], len(ids)], strict=True):
        yield int(ids[s]), int(ths[s]), [c[s:e] for c in columns]


def repeats(key, mark, ids, ths, at) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, phrase and corpus; and where a phrase's first occurrence is."""
    order = np.lexsort((at, ths, ids, mark, key))
    k, m = key[order], mark[order]
    return order, np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.zeros(0, bool)


def parser(buckets: int, length: int):
    """Arrow function of step 1: phrases by bucket, and the spans that repeat within the task."""

    def flush(found):
        # The columns are the bulk of a task's memory: each has one copy at a time.
        columns = []
        for c in found:
            columns.append(np.concatenate(c))
            c.clear()

        def take(which):
            for i in range(len(columns)):
                columns[i] = columns[i][which]

        order, first = repeats(*columns[:5])
        take(order)
        del order
        ids, ths, at, before, after = columns[2:]
        rest = ~first
        # An occurrence seen twice (rows that repeat id and text) is no repeat of itself.
        same = np.zeros(len(first), bool)
        same[1:] = rest[1:] & (ids[1:] == ids[:-1]) & (ths[1:] == ths[:-1]) & (at[1:] == at[:-1])
        owner = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        rest &= ~((ids == ids[owner]) & (ths == ths[owner]) & (at == at[owner])) & ~same
        del owner, same
        for i, t, (s, e) in by_document(ids[rest], ths[rest], (at - before)[rest], (at - after)[rest] + length):
            yield -1 - (hash((i, t)) % buckets), i, t, len(s), pack(s, e)
        del ids, ths, at, before, after, rest
        take(first)
        part = (columns[0] % _U(buckets)).astype(np.int64)
        order = np.lexsort((columns[4], columns[2], part))
        part = part[order]
        take(order)
        cut = np.searchsorted(part, np.arange(buckets + 1))
        for b, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if e > s:
                yield b, None, None, int(e - s), pack(*(c[s:e] for c in columns))

    def batched(rows):
        out, size = [], 0
        for row in rows:
            out.append(row)
            size += len(row[-1]) + 64
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SHUFFLED, strict=True)], schema=SHUFFLED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SHUFFLED, strict=True)], schema=SHUFFLED)

    def run(rows):
        roller, found, n = Roller(2 * BLOCK + length), [[] for _ in PHRASE], 0
        for batch in rows:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            texts = [x or b"" for x in batch.column("_text").cast(pa.binary()).to_pylist()]
            for group in segments_of(texts, length):
                own, a, s, e, key, mark = phrases([x[2] for x in group], roller, length)
                doc, offset = (np.array([x[i] for x in group], np.int64)[own] for i in (0, 1))
                for column, c in zip(found, (key, mark, ids[doc], ths[doc], a + offset, (a - s).astype(np.uint8), (a - e).astype(np.uint8)), strict=True):
                    column.append(c)
                n += len(a)
                if n >= GATHERED:
                    yield from batched(flush(found))
                    n = 0
        if n:
            yield from batched(flush(found))

    return run


def tidy(run):
    """A function over a bucket, after which the worker gives its memory back."""

    def tidied(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release_memory()

    return tidied


def dictionary(length: int):
    """Function of step 2 over one bucket: spans of repeated phrases, and the phrases left to compare."""

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() < 0:
            settled = pa.array([True] * len(rows))
            return pa.Table.from_arrays([rows.column("id"), rows.column("th"), settled, rows.column("n"), rows.column("blob")], schema=FOUND)
        parts = [unpack(b, n, *PHRASE) for b, n in zip(rows.column("blob").to_pylist(), rows.column("n").to_pylist(), strict=True)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order, first = repeats(*columns[:5])
        key, mark, ids, ths, at, before, after = (c[order] for c in columns)
        owner = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = ~first & ~((ids == ids[owner]) & (ths == ths[owner]) & (at == at[owner]))
        out = [(i, t, True, len(s), pack(s, e)) for i, t, (s, e) in by_document(ids[again], ths[again], (at - before)[again], (at - after)[again] + length)]
        key, ids, ths, at, before, after = (c[first] for c in (key, ids, ths, at, before, after))
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        out += [(i, t, False, len(k), pack(k, a, b, f)) for i, t, (k, a, b, f) in by_document(ids[shared], ths[shared], *(c[shared] for c in (key, at, before, after)))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND) if out else FOUND.empty_table()

    return run


def fetcher(buckets: int, length: int):
    """Arrow function of step 3: the bytes of unsettled phrases, by bucket."""

    def flush(found):
        key, ids, ths, at, before, after = (np.concatenate(c) for c in list(zip(*found, strict=True))[:6])
        size = before.astype(np.int64) - after + length
        texts = np.concatenate([f[6] for f in found])
        part = (key % _U(buckets)).astype(np.int64)
        start = np.cumsum(size) - size
        out = []
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(buckets + 1))
        for b, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if e > s:
                k = order[s:e]
                data = texts[np.repeat(start[k] - (np.cumsum(size[k]) - size[k]), size[k]) + np.arange(size[k].sum())]
                out.append((b, len(k), pack(key[k], ids[k], ths[k], at[k], before[k], after[k]), pack(data)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BYTES, strict=True)], schema=BYTES)

    def run(rows):
        found, n = [], 0
        for batch in rows:
            got = [batch.column(c).to_pylist() for c in ("id", "th", "_text", "ns", "blobs")]
            for i, t, text, ns, blobs in zip(*got, strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
                parts = [unpack(b, m, np.uint64, np.int64, np.uint8, np.uint8) for b, m in zip(blobs, ns, strict=True)]
                key, at, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
                size = before.astype(np.int64) - after + length
                place = np.repeat(at - before - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found.append((key, np.full(len(key), i), np.full(len(key), t), at, before, after, data[place]))
                n += len(place)
                if n >= 16 << 20:
                    yield flush(found)
                    found, n = [], 0
        if n:
            yield flush(found)

    return run


#: Inside a bucket's bytes, a trigger is a window of `WINDOW` bytes whose hash is 0 modulo `MODULUS`.
WINDOW, MODULUS = 8, 12


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number in byte order; zeros stand beyond the end."""
    padded, out = np.concatenate([data, np.zeros(8, np.uint8)]), np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << _U(8)) | padded[i : i + len(data)]
    return out


def doubled(rank: np.ndarray, depth: int, reach: int) -> np.ndarray:
    """Prefix doubling: from ranks of `depth` symbols from each place to ranks of at least `reach`.  Behind the end is nothing, the least."""
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64) + _U(1)
    while depth < reach:
        later = np.concatenate([rank[depth:], np.zeros(min(depth, len(rank)), np.uint64)])
        rank = np.unique((rank << _U(32)) | later, return_inverse=True)[1].astype(np.uint64) + _U(1)
        depth *= 2
    return rank


def corpus_order(data: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix-free parsing of strings laid end to end: the places with `length` bytes left in their string, in the order of their suffixes; and for each whether its first `length` bytes are those of the place before.

    Phrases run from one trigger through the next.  The dictionary has each
    distinct phrase once, and its suffix array is made of these alone; the parse is
    the sequence of phrases by rank, with a suffix array of its own.  A suffix of
    the text is a suffix of a phrase, and then a suffix of the parse, which gives
    its place among all.
    """
    n = len(data)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    end = (begin + size)[owner]
    word, place = words8(data), np.arange(n)
    # Phrases: text[t : next t + WINDOW], or to the string's end.
    trigger = (_mix(word) % _U(MODULUS) == 0) & (place + WINDOW <= end)
    trigger[begin] = True
    t = np.flatnonzero(trigger)
    last = np.append(owner[t][1:] != owner[t][:-1], True)
    stop = np.where(last, end[t], np.append(t[1:], 0) + WINDOW)
    phrase = np.cumsum(trigger) - 1
    width = stop - t
    # Dictionary: phrases are alike by a hash of their bytes, and compared with the first of their kind.
    roller = Roller(n)
    mark = _mix(roller.span(roller.sums(data), t, stop)) ^ (width.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, first, kind = np.unique(mark, return_index=True, return_inverse=True)
    own = np.repeat(np.arange(len(t)), width)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(width) - width, width)
    if not ((width == width[first[kind]]).all() and (data[t[own] + inside] == data[t[first[kind[own]]] + inside]).all()):
        raise ValueError("phrases that differ share a hash")
    # The suffix array of the dictionary: its phrases with an end mark below all bytes.
    room = width[first] + 1
    at = np.cumsum(room) - room
    text = np.zeros(int(room.sum()), np.uint64)
    own = np.repeat(np.arange(len(first)), width[first])
    inside = np.arange(len(own)) - np.repeat(np.cumsum(width[first]) - width[first], width[first])
    text[at[own] + inside] = data[t[first[own]] + inside].astype(np.uint64) + _U(1)
    padded = np.concatenate([text, np.zeros(3, np.uint64)])
    four = (padded[: len(text)] << _U(27)) | (padded[1 : len(text) + 1] << _U(18)) | (padded[2 : len(text) + 2] << _U(9)) | padded[3 : len(text) + 3]
    # What stands behind an end mark must not count: each symbol after the first mark is one.
    gap = np.repeat(at + room, room) - 1 - np.arange(len(text))
    for k in range(1, 4):
        four[gap < k] &= ~_U((1 << 9 * (4 - k)) - 1)
    rank, depth = np.unique(four, return_inverse=True)[1].astype(np.uint64) + _U(1), 4
    while depth < int(room.max()):
        ahead = np.arange(len(text)) + depth
        later = np.where(gap >= depth, rank[np.minimum(ahead, len(text) - 1)], _U(0))
        rank = np.unique((rank << _U(32)) | later, return_inverse=True)[1].astype(np.uint64) + _U(1)
        depth *= 2
    # The suffix array of the parse, as deep as `length` bytes can reach; a string's last phrase has an end mark behind it.
    parse = np.zeros(len(t) + len(size), np.uint64)
    slot = np.arange(len(t)) + owner[t]
    parse[slot] = rank[at[kind]]
    suffix = doubled(parse, 1, min(length, len(parse)) + 1)
    after = np.where(last, _U(0), suffix[np.minimum(slot + 1, len(suffix) - 1)])
    # Both together.
    asked = np.flatnonzero(place + length <= end)
    j = phrase[asked]
    order = np.lexsort((after[j], rank[at[kind[j]] + asked - t[j]]))
    asked = asked[order]
    same = np.zeros(len(asked), bool)
    if len(asked):
        same[1:] = True
        for k in [*range(0, length - 7, 8), length - 8]:
            w = word[asked + k]
            same[1:] &= w[1:] == w[:-1]
    return asked, same


def suffixes(length: int):
    """Function of step 3 over one bucket: spans of suffixes whose first `length` bytes also start earlier."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8)
        parts, texts = [], []
        for n, blob, text in zip(*(rows.column(c).to_pylist() for c in ("n", "blob", "text")), strict=True):
            parts.append(unpack(blob, n, *kinds))
            size = int((parts[-1][4].astype(np.int64) - parts[-1][5] + length).sum())
            texts.append(np.frombuffer(pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True), np.uint8))
        key, ids, ths, at, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
        data = np.concatenate(texts)
        size = before.astype(np.int64) - after + length
        start = np.cumsum(size) - size
        order = np.lexsort((at, ths, ids, key))
        # Rows that repeat id and text bring the same phrases, and are one document.
        same = np.ones(len(order) - 1, bool)
        for c in (key, ids, ths, at):
            same &= c[order][1:] == c[order][:-1]
        order = order[np.concatenate([[True], ~same])]
        cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        out, s = [], 0
        while s < len(order):
            # Whole keys, of about half a million bytes at least.
            reach = np.cumsum(size[order[s:]])
            end = s + int(np.searchsorted(reach, 1 << 19)) + 1
            later = cut[np.searchsorted(cut, end) :]
            end = int(later[0]) if len(later) else len(order)
            k = order[s:end]
            s = end
            lens = size[k]
            begin = np.cumsum(lens) - lens
            text = data[np.repeat(start[k] - begin, lens) + np.arange(lens.sum())]
            at_, same = corpus_order(text, lens, length)
            # Equal strings are neighbours now; k is in corpus order within a key, and equal strings have one key.
            run = np.cumsum(~same)
            least = np.full(int(run[-1]) + 1 if len(run) else 0, len(text))
            np.minimum.at(least, run, at_)
            again_at = np.zeros(len(text), bool)
            again_at[at_[at_ != least[run]]] = True
            count = lens - length + 1
            owner = np.repeat(np.arange(len(k)), count)
            place = np.arange(count.sum()) - (np.cumsum(count) - count)[owner]
            again = again_at[begin[owner] + place]
            begins = again.copy()
            begins[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
            ends = again.copy()
            ends[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
            b, e = np.flatnonzero(begins), np.flatnonzero(ends)
            w = k[owner[b]]
            first = at[w] - before[w]
            out += [(i, t, True, len(x), pack(x, y)) for i, t, (x, y) in by_document(ids[w], ths[w], first + place[b], first + place[e] + length)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND) if out else FOUND.empty_table()

    return run


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans merged."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([new[1:], [True]])
    return list(zip(starts[new].tolist(), ends[last].tolist(), strict=True))


def cutter(want_text: bool):
    """Arrow function of step 4."""

    def run(rows):
        for batch in rows:
            out = []
            got = [batch.column(c).to_pylist() for c in ("none", "id", "_text", "ns", "blobs")]
            for none, i, text, ns, blobs in zip(*got, strict=True):
                data, spans = (text or "").encode("utf-8", "surrogatepass"), []
                if blobs:
                    s, e = (np.concatenate(c) for c in zip(*(unpack(b, n, np.int64, np.int64) for b, n in zip(blobs, ns, strict=True)), strict=True))
                    spans = union(s, e)
                edges = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if none else i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans] if want_text else None, kept if want_text else None))
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            upto = 7 if want_text else 5
            yield pa.RecordBatch.from_arrays(columns[:upto], names=list(names[:upto]))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, want_text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `want_text` also spans (array of start and end) and kept (bytes, since a cut can fall inside a character)."""
    if not GRAM <= length < GRAM + 256:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 255}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").isNull().alias("none"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"), text.alias("_text"))
    total, repeated = base.groupBy("id").agg(F.sum(F.octet_length("_text")).alias("b"), F.count("*").alias("n")).agg(F.sum("b"), F.max("n")).first()
    base = base.select("none", "id", (F.xxhash64("_text") if (repeated or 0) > 1 else F.lit(0).cast("bigint")).alias("th"), "_text")
    buckets = max(32, int(total or 0) // PER_BUCKET)

    parsed = map_arrow(base, parser(buckets, length), ddl(SHUFFLED))
    found = materialize(parsed.groupBy("part").applyInArrow(tidy(dictionary(length)), ddl(FOUND)), "phrases")

    def joined(spans: DataFrame, how: str) -> DataFrame:
        lists = spans.groupBy("id", "th").agg(F.collect_list("n").alias("ns"), F.collect_list("blob").alias("blobs"))
        return base.join(lists, ["id", "th"], how).select("none", "id", "th", "_text", "ns", "blobs")

    fetched = map_arrow(joined(found.where(~F.col("settled")), "inner"), fetcher(buckets, length), ddl(BYTES))
    late = materialize(fetched.groupBy("part").applyInArrow(tidy(suffixes(length)), ddl(FOUND)), "suffixes")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start: bigint, end: bigint>>, kept binary" * want_text
    return map_arrow(joined(found.where("settled").unionByName(late), "left"), cutter(want_text), schema)
