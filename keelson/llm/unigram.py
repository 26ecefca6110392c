"""A unigram vocabulary: pieces with integer scores, and the best segmentation of short strings.

Scores are fixed-point log probabilities (`UNIT` to the nat), so that sums are
exact in any order.  Where the model file holds merge ranks instead of log
probabilities (BPE), a piece of rank r gets -ln(r + 2), which is Zipf's law.
A character that no piece covers falls back to its UTF-8 bytes, so that every
string has a segmentation and decodes to itself.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

UNIT = 1 << 20
SPACE = "▁"
#: What a byte costs more than the rarest piece.
BYTE_PENALTY = 2 * UNIT


@dataclass
class Vocabulary:
    """`pieces`: string (with plain spaces) to (id, score); `byte_ids`: ids of the 256 bytes; `decoded`: bytes of each id."""

    pieces: dict[str, tuple[int, int]]
    byte_ids: list[int]
    byte_score: int
    longest: int
    decoded: list[bytes]
    #: Whether any piece holds a line end; else texts are cut there too.
    lines: bool = field(default=False)

    def borders(self) -> re.Pattern:
        """Finds the places that no piece crosses, from the characters around them."""
        return re.compile(r"(?<=[^ ])(?= )" if self.lines else r"(?<=[^ ])(?= )|(?<=\n)|(?=\n)")

    def splitter(self) -> re.Pattern:
        """Cuts a text into pre-tokens.  No piece crosses their borders."""
        return re.compile(r" *[^ ]+| +" if self.lines else r"\n| *[^ \n]+| +")


def make_vocabulary(pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int) -> Vocabulary:
    """From (id, piece with U+2581 for a space, log probability) and the ids of the bytes."""
    known = {p.replace(SPACE, " "): (i, round(s * UNIT)) for i, p, s in pieces}
    for p in known:
        if " " in p.lstrip(" "):
            raise ValueError(f"piece {p!r} has a space after another character")
    decoded = [b""] * size
    for p, (i, _) in known.items():
        decoded[i] = p.encode()
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    worst = min((s for _, s in known.values()), default=0)
    return Vocabulary(known, byte_ids, worst - BYTE_PENALTY, max(map(len, known), default=1), decoded, any("\n" in p for p in known))


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model that has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError(f"{path} has no byte pieces")
    usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in usual]
    # Some files give pieces of spaces a score far below all others: they rank last.
    real = [s for s in scores if s > -1e8]
    if real == sorted(real, reverse=True) and all(s == int(s) for s in real):
        scores = [-math.log(2 - max(s, -size)) for s in scores]
    return make_vocabulary([(i, model.id_to_piece(i), s) for i, s in zip(usual, scores, strict=True)], byte_ids, size)


def char_bytes(char: str) -> bytes:
    return char.encode("utf-8", "surrogatepass")


def segment(text: str, voc: Vocabulary) -> tuple[int, list[int]]:
    """Best score and ids.  Of last pieces that end alike with equal score, the longest wins."""
    pieces, longest, n = voc.pieces, voc.longest, len(text)
    best, back = [0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        top = None
        for i in range(max(0, j - longest), j):
            if (hit := pieces.get(text[i:j])) is not None and (top is None or best[i] + hit[1] > top):
                top = best[i] + hit[1]
                back[j] = (i, hit[0])
        # A byte costs more than any piece, so that bytes are for characters without one.
        if text[j - 1] not in pieces:
            raw = char_bytes(text[j - 1])
            if top is None or best[j - 1] + len(raw) * voc.byte_score > top:
                top = best[j - 1] + len(raw) * voc.byte_score
                back[j] = (j - 1, raw)
        best[j] = top
    out = []
    while n:
        i, what = back[n]
        if isinstance(what, bytes):
            out += [voc.byte_ids[b] for b in reversed(what)]
        else:
            out.append(what)
        n = i
    return best[-1], out[::-1]


_BASE = 0x9E3779B97F4A7C15


class BulkSegmenter:
    """segment() for many strings at once, in numpy.

    Substrings are looked up by rolling hash in two tables with one slot a hash;
    the dynamic programme takes one step for each place and piece length over all
    strings that are still so long.
    """

    TABLE, CHARS, LONGEST = 1 << 18, 1 << 19, 48

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        inverse = pow(_BASE, -1, 1 << 64)

        def powers(base):
            out = np.full(self.CHARS + 4 * self.LONGEST, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.power, self.inverse = powers(_BASE), powers(inverse)
        by_hash: dict[int, tuple[int, int]] = {}
        for piece, (i, score) in voc.pieces.items():
            sums = self.sums(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32))
            by_hash[int(sums[-1])] = (i, score)
        # Open addressing with as many tables as it takes; two or three in practice.
        self.tables, left = [], by_hash
        while left:
            shift = np.uint64(46 - 11 * len(self.tables) if len(self.tables) < 4 else 0)
            keys, ids, scores = np.zeros(self.TABLE, np.uint64), np.full(self.TABLE, -1, np.int32), np.zeros(self.TABLE, np.int64)
            rest = {}
            for h, (i, score) in left.items():
                slot = (h * (2 * len(self.tables) + 1) % (1 << 64)) >> int(shift) & (self.TABLE - 1)
                if ids[slot] < 0:
                    keys[slot], ids[slot], scores[slot] = h, i, score
                else:
                    rest[h] = (i, score)
            self.tables.append((np.uint64(2 * len(self.tables) + 1), shift, keys, ids, scores))
            left = rest

    def sums(self, chars):
        out = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(self.spread(chars) * self.power[: len(chars)], out=out[1:])
        return out

    @staticmethod
    def spread(chars):
        """A 64-bit value for each character."""
        c = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return c ^ (c >> np.uint64(32))

    def lookup(self, h):
        """(id or -1, score) of hashes."""
        ids, scores = np.full(len(h), -1, np.int32), np.zeros(len(h), np.int64)
        left = None
        for factor, shift, keys, values, points in self.tables:
            part = h if left is None else h[left]
            slot = ((part * factor) >> shift & np.uint64(self.TABLE - 1)).astype(np.int64)
            hit = (keys[slot] == part) & (values[slot] >= 0)
            at = np.flatnonzero(hit) if left is None else left[hit]
            ids[at], scores[at] = values[slot[hit]], points[slot[hit]]
            left = np.flatnonzero(~hit) if left is None else left[~hit]
        return ids, scores

    def __call__(self, words: list[str]):
        """Scores, numbers of ids, and the ids of all words end to end."""
        out: list = [None] * len(words)
        part, size = [], 0
        for k, w in enumerate(words):
            if len(w) > self.LONGEST or not w:
                out[k] = segment(w, self.voc)
                continue
            part.append(k)
            size += len(w)
            if size >= self.CHARS:
                self._part(words, part, out)
                part, size = [], 0
        if part:
            self._part(words, part, out)
        n = np.array([len(x[1]) for x in out], np.int64)
        flat = np.concatenate([np.asarray(x[1], np.int32) for x in out]) if out else np.zeros(0, np.int32)
        return np.array([x[0] for x in out], np.int64), n, flat

    def _part(self, words, part, out):
        longest = self.voc.longest
        order = sorted(part, key=lambda k: -len(words[k]))
        chars = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(words[k]) for k in order], np.int64)
        start = np.cumsum(size) - size
        sums = self.sums(chars)
        # Place p of word w is at start[w] + w + p: a word of n characters has n + 1 places.
        base = start + np.arange(len(order))
        never = -(1 << 60)
        best, back, piece = np.full(len(chars) + len(order), never, np.int64), np.zeros(len(chars) + len(order), np.int64), np.full(len(chars) + len(order), -1, np.int32)
        best[base] = 0
        for p in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -p, side="right"))
            s, b = start[:live], base[:live]
            top, step, which = np.full(live, never, np.int64), np.zeros(live, np.int64), np.full(live, -1, np.int32)
            for n in range(min(p, longest), 0, -1):
                at = s + p - n
                ids, scores = self.lookup((sums[s + p] - sums[at]) * self.inverse[at])
                if n == 1 and (missing := ids < 0).any():
                    # A character without a piece costs its bytes.
                    c = chars[s + p - 1]
                    raw = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                    scores = np.where(missing, raw * self.voc.byte_score, scores)
                    ids = np.where(missing, -2, ids)
                score = np.where(ids != -1, best[b + p - n] + scores, never)
                better = score > top
                top, step, which = np.where(better, score, top), np.where(better, n, step), np.where(better, ids, which)
            best[b + p], back[b + p], piece[b + p] = top, step, which
        # Back from the ends, all words at once.
        place, owner, steps = size.copy(), np.arange(len(order)), []
        while len(owner):
            at = base[owner] + place
            steps.append((owner, piece[at]))
            place = place - back[at]
            owner, place = owner[place > 0], place[place > 0]
        who = np.concatenate([o for o, _ in steps])
        what = np.concatenate([i for _, i in steps])
        turn = np.repeat(np.arange(len(steps)), [len(o) for o, _ in steps])
        sort = np.lexsort((-turn, who))
        who, what = who[sort], what[sort]
        cut = np.searchsorted(who, np.arange(len(order) + 1))
        total = best[base + size].tolist()
        bytewise = set(who[what == -2].tolist())
        for w, k in enumerate(order):
            out[k] = segment(words[k], self.voc) if w in bytewise else (total[w], what[cut[w] : cut[w + 1]])
