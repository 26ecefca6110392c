"""A gated recurrent language model over words.

Tokens of a text: its words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then
one end token.  The model reads a document from its first token to its end and
carries its state all the way.

Vocabulary and counts come from all training rows: every distinct token is
counted in a shuffle.  The `HEAD` most frequent tokens have vectors of their
own, in classes of `PER_CLASS`; the others fall into `TAIL` classes by their last
two bytes.  The output softmax is factored: first the class, then, in a class of
head words, a softmax over its words; in a tail class the add-one share
(c + 1) / (sum of (c + 1) in the class + 1), where the last 1 is for words that
never occurred.

Learning is truncated backpropagation in numpy over windows of `WINDOW` tokens,
state carried from window to window.  A first model learns on the driver from
about `TRAIN_TOKENS` tokens: documents drawn by a hash of the id, and of a text
over `LONG` tokens stretches of `STRETCH` tokens by a hash of their place.  From
this start each task on the executors learns from all of its training documents,
in chunks of `CHUNK` tokens that end with a document (a longer one is cut), and the weights are averaged by the tokens behind them.
So every training token is learned from, in bounded memory; the state starts anew
where a chunk or a lane begins.  Scoring steps many documents side by side on the
executors.

Texts are cut into words twice: to count them, and, once the vocabulary is known, to
write each document's model inputs (16 bits a token) to the shared folder, which
learning and scoring read.

What goes to executors is bounded: the model, and the counts of the `KNOWN` most
frequent tokens.  The counts of rarer tokens come by a shuffled join, one row
for each document and distinct rare token.

Defined cases: a null text is empty and has the end token only; ids are whole
numbers; every row has a result, repeated rows too; a null id is a document that
is not learned from, and is not held out; an empty table gives no rows, and without
training rows nothing is known.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, materialize, pieces

HIDDEN, HEAD, PER_CLASS, TAIL = 32, 4096, 64, 64
KNOWN = 200_000
TRAIN_TOKENS, WINDOW, LANES, LONG, STRETCH = 1_200_000, 32, 64, 16_384, 2_048
#: Lanes of the pass over all rows.
WIDE_LANES = 256
#: Tokens that a task learns from at a time, its rate, and weights in a row of the shuffle that averages them.
CHUNK, TASK_RATE, SLICE = 1 << 18, 0.02, 4096
HELD_OUT_MOD, HELD_OUT = 7, 2
#: Stands for the end token; no word holds a space.
END = b" "
SCORE_LANES, SCORE_STEPS = 512, 64
#: States whose class softmax is taken at a time, so that it stays in a core's cache.
BLOCK = 1024
#: Rows from which a key's gradients are summed on their own.
OFTEN = 8
#: Logits of no greater size need no maximum taken off before exp.
SMALL = 80


def words_of(text: str | None):
    """The words of a text, in lists of at most about a million bytes."""
    for piece in pieces(text or ""):
        yield piece.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


class Numbers(dict):
    """Places of the known words; any other word is noted in `rare` and has the place of its tail class behind them."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(vocabulary))
        self.known, self.rare = len(self), []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.known + zlib.crc32(word[-2:]) % TAIL


def counter(rows):
    """Arrow function: (word, c) of a task's tokens."""
    total: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "c"])

    for batch in rows:
        for text in batch.column(0).to_pylist():
            for words in words_of(text):
                total.update(words)
            total[END] += 1
            if len(total) > 400_000:
                yield out()
                total.clear()
    if total:
        yield out()


def encoder(head: list[bytes], bound: int):
    """Arrow function: model inputs of documents, or of stretches of long ones, as 32-bit integers."""

    def run(rows):
        number = {w: i for i, w in enumerate(head)}
        for batch in rows:
            ids, out = [], []
            for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                got = [number[w] if w in number else HEAD + tail_class(w) for words in words_of(text) for w in words] + [number[END]]
                parts = [got]
                if len(got) > LONG:
                    parts = [got[k : k + STRETCH] for k in range(0, len(got), STRETCH)]
                    parts = [p for k, p in enumerate(parts) if zlib.crc32(f"{i} {k}".encode()) < 2**32 * bound / len(got)]
                for p in parts:
                    ids.append(i)
                    out.append(np.array(p, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "tokens"])

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place; exp may overflow, which gives 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def sums_by(keys: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (16 bits), and the sum of the rows of each: row i is what `planes` have at i, side by side."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys, many = keys[order], len(planes)
    values = np.take(planes.reshape(-1, planes.shape[2]), order[:, None] + np.arange(many) * len(keys), axis=0, mode="clip").reshape(len(keys), -1)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.diff(first, append=len(keys))
    out, ones = values[first], np.ones(len(keys), np.float32)
    # Frequent keys have a sum each; of the others, all second rows are added at once, then all third rows.
    for i in np.flatnonzero(n > OFTEN):
        np.dot(ones[: n[i]], values[first[i] : first[i] + n[i]], out=out[i])
    rows = np.flatnonzero(n <= OFTEN)
    for k in range(1, OFTEN):
        rows = rows[n[rows] > k]
        out[rows] += values[first[rows] + k]
    return keys[first], out


def is_small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state in -1 to 1 gives a logit whose exp leaves the range of 32-bit floats; a row of `weights` for each logit."""
    return bool((np.abs(weights).sum(1) + np.abs(bias)).max() < SMALL)


def less_truth(logits: np.ndarray, truth: np.ndarray, lanes: int, small: bool) -> None:
    """Turns rows of logits, in place, into their softmax less the truth, divided by `lanes`."""
    if not small:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= 1 / (np.float32(lanes) * (logits @ np.ones((logits.shape[1], 1), np.float32)))
    logits[np.arange(len(truth)), truth] -= np.float32(1 / lanes)


class Model:
    """Weights: `inp` (token to gates z, r, n), `rec` (state to gates), `cls`/`cls_b` (class), `word`/`word_b` (head words)."""

    NAMES = ("inp", "rec", "cls", "cls_b", "word", "word_b")

    def __init__(self, counts: np.ndarray, tail_total: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.classes = HEAD // PER_CLASS + TAIL
        head = np.zeros(HEAD)
        head[: len(counts)] = counts
        self.inp, self.rec, self.cls = scale(HEAD + TAIL, 3 * HIDDEN), scale(HIDDEN, 3 * HIDDEN), scale(HIDDEN, self.classes)
        self.word = np.zeros((HEAD, HIDDEN), np.float32)
        # The start is the unigram model; places of the head without a word can't be drawn.
        mass = np.concatenate([head.reshape(-1, PER_CLASS).sum(1), tail_total])
        self.cls_b = np.log(np.maximum(mass, 0.5) / max(mass.sum(), 1)).astype(np.float32)
        self.word_b = np.where(head > 0, np.log(np.maximum(head, 1)), -30).astype(np.float32)
        self.word_b -= np.repeat(self.word_b.reshape(-1, PER_CLASS).max(1), PER_CLASS)

    def pack(self) -> bytes:
        return zlib.compress(b"".join(getattr(self, n).tobytes() for n in self.NAMES), 1)

    @staticmethod
    def unpack(blob: bytes) -> Model:
        out, raw, at = Model.__new__(Model), zlib.decompress(blob), 0
        out.classes = HEAD // PER_CLASS + TAIL
        shapes = ((HEAD + TAIL, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, out.classes), (out.classes,), (HEAD, HIDDEN), (HEAD,))
        for n, shape in zip(Model.NAMES, shapes, strict=True):
            size = math.prod(shape)
            setattr(out, n, np.frombuffer(raw, np.float32, size, at).reshape(shape))
            at += 4 * size
        return out

    def word_groups(self, tokens: np.ndarray):
        """(class, places of the tokens of this class) for head tokens."""
        at = np.flatnonzero(tokens < HEAD)
        cls = tokens[at] // PER_CLASS
        at = at[np.argsort(cls.astype(np.uint8), kind="stable")]
        cut = np.cumsum(np.bincount(cls, minlength=HEAD // PER_CLASS))
        for c, (i, k) in enumerate(zip([0, *cut[:-1]], cut, strict=True)):
            if i < k:
                yield c, at[i:k]

    def log_probability(self, state: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural log of each token's class, and of the word in it for head tokens."""
        cls = np.where(tokens < HEAD, tokens // PER_CLASS, tokens - HEAD + HEAD // PER_CLASS)
        out = np.empty(len(cls))
        for k in range(0, len(cls), BLOCK):
            out[k : k + BLOCK] = self._log_softmax(state[k : k + BLOCK], self.cls, self.cls_b, cls[k : k + BLOCK])
        for c, group in self.word_groups(tokens):
            own = slice(c * PER_CLASS, (c + 1) * PER_CLASS)
            for k in range(0, len(group), BLOCK):
                at = group[k : k + BLOCK]
                out[at] += self._log_softmax(state.take(at, 0), self.word[own].T, self.word_b[own], tokens[at] - c * PER_CLASS)
        return out

    @staticmethod
    def _log_softmax(state, weights, bias, truth):
        logits = state @ weights
        logits += bias
        out = logits[np.arange(len(truth)), truth]
        np.exp(logits, out=logits)
        out -= np.log(logits @ np.ones(logits.shape[1], np.float32))
        return out

    def fresh_sums(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients before the first step."""
        return {name: np.full_like(getattr(self, name), 1e-6) for name in self.NAMES}

    def train(self, sequences: list[np.ndarray], end: int, bound: int, least_steps: int = 300, rate: float = 0.02, seen: dict[str, np.ndarray] | None = None, once: bool = False) -> None:
        """Truncated backpropagation; each sequence starts from the zero state.

        `seen` are the sums of squared gradients, which go on from call to call;
        `once` is one pass at a constant rate.
        """
        if not sequences:
            return
        wide = WIDE_LANES if once else LANES
        lanes = wide if sum(map(len, sequences)) >= wide * WINDOW * 4 else 8
        target = np.concatenate(sequences)
        start = np.zeros(len(target), bool)
        start[np.cumsum([0, *map(len, sequences)])[:-1]] = True
        given = np.roll(target, 1)
        given[start] = end
        n = -(-len(target) // lanes)
        fill = lanes * n - len(target)
        # Step after step, as they are learned from.
        target, given, start = (np.ascontiguousarray((np.concatenate([x, x[:fill]]) if fill <= len(x) else np.resize(x, lanes * n)).reshape(lanes, n).T) for x in (target, given, start))
        steps_per = -(-n // WINDOW)
        epochs = 1 if once else min(20, max(2, -(-least_steps // steps_per)))
        seen = self.fresh_sums() if seen is None else seen
        total, done = epochs * steps_per, 0

        def update(name, grad, rows=slice(None)):
            w, s = getattr(self, name), seen[name]
            r = np.float32(rate if once else rate * max(0.1, 1 - done / total))
            step = grad * grad
            step += s[rows]
            s[rows] = step
            np.sqrt(step, out=step)
            np.divide(grad, step, out=step)
            step *= r
            w[rows] -= step

        # Fresh pages cost more than what is computed in them, so all windows share these.
        room = [np.empty(WINDOW * lanes * k * HIDDEN, np.float32) for k in (3, 4, 1, 1, 1, 1, 1, 1)]
        with np.errstate(over="ignore"):
            for _ in range(epochs):
                state = np.zeros((lanes, HIDDEN), np.float32)
                for t0 in range(0, n, WINDOW):
                    state = self._window(target[t0 : t0 + WINDOW], given[t0 : t0 + WINDOW], start[t0 : t0 + WINDOW], state, update, room)
                    done += 1

    def _window(self, target, given, start, state, update, room):
        steps, lanes = target.shape
        m = lanes * steps
        tokens, inputs = target.reshape(-1).astype(np.int64), given.reshape(-1).astype(np.int64)
        # What belongs to one gate lies together: arithmetic on parts of rows takes several times as long.
        gates, d, before, after, us, to_z, to_r, to_n = (x[: x.size // WINDOW * steps].reshape(-1, steps, lanes, HIDDEN) for x in room)
        before, after, us, to_z, to_r, to_n = (x[0] for x in (before, after, us, to_z, to_r, to_n))
        # The gates z, r, n take the place of the inputs that they come from.
        np.take(self.inp.reshape(-1, HIDDEN), 3 * inputs + np.arange(3)[:, None], axis=0, out=gates.reshape(3, m, HIDDEN), mode="clip")
        rec = np.ascontiguousarray(self.rec.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        at, fresh = np.nonzero(start)
        cut = np.searchsorted(at, np.arange(steps + 1))
        fresh = [fresh[i:k] for i, k in zip(cut[:-1], cut[1:], strict=True)]
        u = np.empty((2, lanes, HIDDEN), np.float32)
        for t in range(steps):
            was, zr, n = before[t], gates[:2, t], gates[2, t]
            was[:] = state
            if len(fresh[t]):
                was[fresh[t]] = 0
            np.matmul(was, rec[:2], out=u)
            zr += u
            sigmoid(zr)
            np.matmul(was, rec[2], out=us[t])
            n += np.multiply(zr[1], us[t], out=u[0])
            # tanh(x) = 2 / (1 + exp(-2 x)) - 1
            n *= -2
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            state = after[t]
            np.subtract(was, n, out=state)
            state *= zr[0]
            state += n
        state = state.copy()
        h = after.reshape(m, HIDDEN)
        dh = self._softmaxes(h, tokens, lanes, update).reshape(steps, lanes, HIDDEN)
        z, r, n = gates
        # What a gradient of the state is multiplied by on its way to the gates; the states and `us` are not needed any more.
        spare = np.subtract(1, z, out=after)
        np.subtract(before, n, out=to_z)
        to_z *= z
        to_z *= spare
        np.multiply(n, n, out=to_n)
        np.subtract(1, to_n, out=to_n)
        to_n *= spare
        np.subtract(1, r, out=to_r)
        to_r *= r
        to_r *= us
        # Gradients: n at the input, z, r, n at the state.
        back, rec_back, u = np.zeros((lanes, HIDDEN), np.float32), rec.transpose(0, 2, 1), np.empty((3, lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            back += dh[t]
            dn = np.multiply(back, to_n[t], out=d[0, t])
            np.multiply(back, to_z[t], out=d[1, t])
            np.multiply(dn, to_r[t], out=d[2, t])
            np.multiply(dn, r[t], out=d[3, t])
            back *= z[t]
            np.matmul(d[1:, t], rec_back, out=u)
            for x in u:
                back += x
            if len(fresh[t]):
                back[fresh[t]] = 0
        d = d.reshape(4, m, HIDDEN)
        grad = np.matmul(before.reshape(m, HIDDEN).T, d[1:]).transpose(1, 0, 2).reshape(HIDDEN, -1)
        update("rec", np.clip(grad, -1, 1))
        rows, grad = sums_by(inputs, d[:3])
        # From n, z, r to z, r, n.
        grad = np.roll(grad, -HIDDEN, 1)
        update("inp", np.clip(grad, -1, 1, out=grad), rows)
        return state

    def _softmaxes(self, h, tokens, lanes, update):
        """Learns both softmaxes from the states before `tokens`; the gradient of the states."""
        m = len(tokens)
        cls = np.where(tokens < HEAD, tokens // PER_CLASS, tokens - HEAD + HEAD // PER_CLASS)
        dh, dcls, dcls_b = np.empty_like(h), np.zeros_like(self.cls), np.zeros_like(self.cls_b)
        small, ones = is_small(self.cls.T, self.cls_b), np.ones(m, np.float32)
        for k in range(0, m, BLOCK):
            p = h[k : k + BLOCK] @ self.cls
            p += self.cls_b
            less_truth(p, cls[k : k + BLOCK], lanes, small)
            np.matmul(p, self.cls.T, out=dh[k : k + BLOCK])
            dcls += h[k : k + BLOCK].T @ p
            dcls_b += ones[: len(p)] @ p
        groups = list(self.word_groups(tokens))
        if groups:
            order = np.concatenate([at for _, at in groups])
            states, own_word, k = h.take(order, 0), tokens[order] % PER_CLASS, 0
            small = is_small(self.word, self.word_b)
            back, dword, dword_b = np.empty_like(states), np.zeros_like(self.word), np.zeros_like(self.word_b)
            for c, at in groups:
                own, here = slice(c * PER_CLASS, (c + 1) * PER_CLASS), slice(k, k + len(at))
                q = states[here] @ self.word[own].T
                q += self.word_b[own]
                less_truth(q, own_word[here], lanes, small)
                np.matmul(q, self.word[own], out=back[here])
                np.matmul(q.T, states[here], out=dword[own])
                np.dot(ones[: len(at)], q, out=dword_b[own])
                k += len(at)
            dh[order] += back
            update("word", dword)
            update("word_b", dword_b)
        update("cls", dcls)
        update("cls_b", dcls_b)
        return dh

    def score(self, documents: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log of class and head-word probability of each document, stepped side by side in lanes."""
        lanes = min(SCORE_LANES, len(documents))
        heap, queue = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
            load, lane = heapq.heappop(heap)
            queue[lane].append(d)
            heapq.heappush(heap, (load + len(documents[d]), lane))
        queue.sort(key=lambda q: -sum(len(documents[d]) for d in q))
        order = [d for q in queue for d in q]
        size = np.array([len(documents[d]) for d in order])
        target = np.concatenate([documents[d] for d in order])
        first = np.cumsum(size) - size
        given = np.empty_like(target)
        given[1:] = target[:-1]
        given[first] = end
        fresh = np.zeros(len(target), bool)
        fresh[first] = True
        owner = np.repeat(np.array(order, np.int32), size)
        length = np.array([sum(len(documents[d]) for d in q) for q in queue])
        begin = np.cumsum(length) - length
        # z and r come from exp(-x), n from exp(-2x), so the signs are folded into the weights.
        sign = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)
        inp, rec = (self.inp * sign).reshape(-1, HIDDEN), np.ascontiguousarray((self.rec * sign).reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        state, out, ends = np.zeros((lanes, HIDDEN), np.float32), np.zeros(len(documents)), -length
        # As in learning, what belongs to one gate lies together.
        gate, room = np.arange(3)[:, None], np.empty((2, 3 * lanes * HIDDEN), np.float32)
        states = np.empty((SCORE_STEPS * lanes, HIDDEN), np.float32)
        for t0 in range(0, int(length[0]), SCORE_STEPS):
            places, k = [], 0
            for t in range(t0, min(t0 + SCORE_STEPS, int(length[0]))):
                active = int(np.searchsorted(ends, -t))
                place = begin[:active] + t
                h = state[:active]
                if (new := fresh[place]).any():
                    h[new] = 0
                x, u = room[:, : 3 * active * HIDDEN].reshape(2, 3, active, HIDDEN)
                np.take(inp, 3 * given[place] + gate, axis=0, out=x, mode="clip")
                np.matmul(h, rec, out=u)
                zr, n = x[:2], x[2]
                zr += u[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                u[2] *= zr[1]
                n += u[2]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                h -= n
                h *= zr[0]
                h += n
                states[k : k + active] = h
                k += active
                places.append(place)
            place = np.concatenate(places)
            out += np.bincount(owner[place], self.log_probability(states[:k], target[place]), len(documents))
        return out


def numberer(known: tuple[bytes, bytes], tail_total: bytes, total: int, distinct: int):
    """Arrow function: per document its model inputs as 16-bit integers, n_tokens, n_known, base, the tails' part of the score, and its rare words with their numbers of occurrences."""

    def run(rows):
        vocabulary = zlib.decompress(known[0]).split(b"\n")
        counts = np.frombuffer(zlib.decompress(known[1]), np.int64)
        number = Numbers(vocabulary)
        head = min(HEAD, len(vocabulary))
        token = np.array([i if i < head else HEAD + tail_class(w) for i, w in enumerate(vocabulary)], np.int16)
        base = np.log10((counts + 1) / (total + distinct + 1))
        local = np.where(token < HEAD, 0.0, np.log10((counts + 1) / np.frombuffer(tail_total, np.float64)[np.maximum(token - HEAD, 0)]))
        # Rare words have a number for each tail class; their sums come later, by the join.
        token = np.concatenate([token, np.arange(HEAD, HEAD + TAIL, dtype=np.int16)])
        base, local = (np.concatenate([x, np.zeros(TAIL)]) for x in (base, local))
        end = number[END]
        for batch in rows:
            ids, ths, texts = (batch.column(c) for c in ("id", "th", "_text"))
            documents, sums, rare_words, rare_n, offsets = [], [], [], [], [0]
            for text in texts.to_pylist():
                parts, rare, n, seen, b, s = [], Counter(), 1, int(counts[end] > 0), base[end], local[end]
                for words in words_of(text):
                    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    n += len(at)
                    seen += len(at) - len(number.rare)
                    rare.update(number.rare)
                    number.rare.clear()
                    b += base[at].sum()
                    s += local[at].sum()
                    parts.append(token[at].tobytes())
                documents.append(b"".join([*parts, token[end].tobytes()]))
                sums.append((n, seen, b, s))
                rare_words += rare.keys()
                rare_n += rare.values()
                offsets.append(len(rare_words))
            if not documents:
                continue
            n, seen, b, s = (np.array(x) for x in zip(*sums, strict=True))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64())], ["word", "n"]))
            columns = {"id": ids, "th": ths, "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen, pa.int64()), "base": pa.array(b), "local": pa.array(s), "tokens": pa.array(documents, pa.binary()), "rare": rare}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def inputs_of(column: pa.Array) -> list[np.ndarray]:
    """The model inputs of each row of `tokens`."""
    return [np.frombuffer(x.as_buffer(), np.int16) for x in column]


def trainer(end: int, weights: dict[str, np.ndarray], seen: dict[str, np.ndarray]):
    """Arrow function: the weights after learning from all of a task's documents, in slices, times the number of tokens."""

    def run(rows):
        net = Model.__new__(Model)
        net.classes = HEAD // PER_CLASS + TAIL
        for name, w in weights.items():
            setattr(net, name, w.copy())
        sums = {name: x.copy() for name, x in seen.items()}
        sequences, size, total = [], 0, 0

        def learn():
            nonlocal sequences, size, total
            if sequences:
                net.train(sequences, end, 0, rate=TASK_RATE, seen=sums, once=True)
            sequences, size, total = [], 0, total + size

        for batch in rows:
            for document in inputs_of(batch.column(0)):
                # A document may be longer than what is learned from at a time.
                for k in range(0, len(document), CHUNK):
                    part = document[k : k + CHUNK]
                    sequences.append(part)
                    size += len(part)
                    if size >= CHUNK:
                        learn()
        learn()
        if total:
            flat = np.concatenate([getattr(net, n).reshape(-1) for n in Model.NAMES]).astype(np.float64) * total
            cut = [flat[k : k + SLICE].tobytes() for k in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([total] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["slice", "n", "w"])

    return run


def add_slices(group: pa.Table) -> pa.Table:
    """The sum of one slice over the tasks."""
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("w"))
    n = sum(group.column("n").to_pylist())
    return pa.Table.from_arrays([group.column("slice")[:1], pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "n", "w"])


def learn_all(model: Model, documents: DataFrame, end: int, seen: dict[str, np.ndarray]) -> None:
    """One pass over all `documents` (model inputs) from the weights of `model`, which become the tasks' average."""
    schema = "slice int, n bigint, w binary"
    learned = map_arrow(documents, trainer(end, {n: getattr(model, n) for n in Model.NAMES}, seen), schema)
    rows = sorted(learned.groupBy("slice").applyInArrow(add_slices, schema).collect())
    if rows:
        flat, at = np.concatenate([np.frombuffer(r.w, np.float64) / r.n for r in rows]).astype(np.float32), 0
        for name in Model.NAMES:
            w = getattr(model, name)
            setattr(model, name, flat[at : at + w.size].reshape(w.shape).copy())
            at += w.size


def scorer(model: bytes, end: int):
    """Arrow function: the columns but `tokens`, and the score of class and head word."""

    def run(rows):
        np.seterr(over="ignore")
        net = Model.unpack(model)
        for batch in rows:
            if batch.num_rows:
                score = net.score(inputs_of(batch.column("tokens")), end) / math.log(10)
                names = [n for n in batch.schema.names if n != "tokens"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, "score"])

    return run


def most_frequent(counts: DataFrame, bound: int) -> int:
    """The smallest c for which at most `bound` words occur so often."""
    by = sorted(counts.groupBy("c").count().orderBy(F.desc("c")).limit(bound).collect(), key=lambda r: -r["c"])
    n, least = 0, (by[0]["c"] + 1 if by else 1)
    for r in by:
        n += r["count"]
        if n > bound:
            break
        least = r["c"]
    return least


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_tokens: int = TRAIN_TOKENS, known: int = KNOWN) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32 of the id modulo 7 is not 2; `train_tokens` bounds the sample that the first model learns from.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    held = F.coalesce(crc_mod(F.col("id"), HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    training = base.where(F.col("id").isNotNull() & ~held)
    counts = materialize(map_arrow(training.select("_text"), counter, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    least = most_frequent(counts, known)
    # At most `known` words: the bound holds at any size.
    top = sorted(((r.c, bytes(r.word)) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    top = [(c, w) for c, w in top if w != END]
    ends = counts.where(F.col("word") == F.lit(END)).first()
    top.insert(0, (ends.c if ends else 0, END))
    head = [w for _, w in top[:HEAD]]

    cls = F.crc32(F.substring("word", -2, 2)) % TAIL
    sums = {r["t"]: r["s"] for r in counts.groupBy(cls.alias("t")).agg(F.sum(F.col("c") + 1).alias("s")).collect()}
    tail_total = np.array([float(sums.get(t, 0)) + 1 for t in range(TAIL)])
    for c, w in top[:HEAD]:
        tail_total[tail_class(w)] -= c + 1 if c else 0

    share = min(1.0, train_tokens / max(total, 1))
    # By row and without repeated rows, so that no frequent id or text brings more than its share.
    drawn = training.where(F.pmod(F.xxhash64("id", "_text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).dropDuplicates(["id", "_text"])
    rows = drawn.mapInArrow(encoder(head, LONG), "id bigint, tokens binary").collect()
    rows.sort(key=lambda r: (r.id * 0x9E3779B97F4A7C15 % (1 << 64), bytes(r.tokens)))
    model = Model(np.array([c for c, _ in top[:HEAD]]), tail_total - 1)
    seen = model.fresh_sums()
    model.train([np.frombuffer(r.tokens, np.int32) for r in rows], head.index(END), train_tokens, seen=seen)
    del rows
    # Texts are cut into words once, for learning and for scoring.
    packed = (zlib.compress(b"\n".join(w for _, w in top), 1), zlib.compress(np.array([c for c, _ in top], np.int64).tobytes(), 1))
    repeated = base.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    keyed = base.select("id", (F.xxhash64("_text") if repeated > 1 else F.lit(0).cast("bigint")).alias("th"), "_text")
    own = "id bigint, th bigint, n_tokens bigint, n_known bigint, base double, local double"
    numbered = map_arrow(keyed, numberer(packed, tail_total.tobytes(), total, distinct), f"{own}, tokens binary, rare array<struct<word: binary, n: bigint>>")
    numbered = materialize(numbered, "numbered")
    end = head.index(END)
    learn_all(model, numbered.where(F.col("id").isNotNull() & ~held).select("tokens"), end, seen)

    scored = map_arrow(numbered.drop("rare"), scorer(model.pack(), end), f"{own}, score double")
    scored = scored.select("id", "th", F.lit(1).alias("m"), "n_tokens", "n_known", "base", (F.col("score") + F.col("local")).alias("score"))
    item = numbered.select("id", "th", F.explode("rare").alias("x")).select("id", "th", "x.word", "x.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    weight = F.element_at(F.lit(tail_total.tolist()).cast("array<double>"), (cls + 1).cast("int"))
    rare = item.join(counts.where(F.col("c") < least), "word", "left").select(
        "id",
        "th",
        F.lit(0).alias("m"),
        F.lit(0).cast("bigint").alias("n_tokens"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("base"),
        (F.col("n") * F.log10((c + 1) / weight)).alias("score"),
    )
    out = scored.unionByName(rare).groupBy("id", "th").agg(*(F.sum(x).alias(x) for x in ("m", "n_tokens", "n_known", "base", "score")))
    m = F.col("m")
    if repeated > 1:  # rows that repeat id and text have a result each
        out = out.withColumn("_again", F.explode(F.sequence(F.lit(1), m))).drop("_again")
    return out.select(
        F.col("id").alias("doc_id"),
        held.alias("held_out"),
        (F.col("n_tokens") / m).cast("bigint").alias("n_tokens"),
        (F.col("n_known") / m).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") / m).alias("base_score"),
        (F.col("score") / m).alias("score"),
    )
