"""LM scoring: a gated recurrent language model with a class-factored softmax, over counts of all training words."""

import math
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kindred.llm.quality import remainder
from kindred.llm.words import CHUNK, LOWER, U, text_bytes, word_hashes, word_spans
from kindred.shared import KEPT, bound_batches, discard, materialize, tidy

#: Words that the network tells apart; all others are told apart within their form by their counts.
HEAD = 2047
HIDDEN, CLASSES = 24, 48
#: Words whose counts every task holds: at most so many, the most frequent ones (16 MB). Rarer ones are joined by a shuffle.
LOOKUP = 500_000
#: The network starts on about so many words, of pieces that a hash picks from the whole table. Then all training documents
#: train it once, in rounds of a fixed share each by tasks of about TASK_WORDS; after a round the tasks' networks are averaged.
START_WORDS, ROUNDS, TASK_WORDS = 600_000, 3, 1_000_000
#: Words that a task holds at a time, and parallel runs through them, at the start and in rounds.
HELD_WORDS, START_STREAMS, STREAMS, STEPS = 500_000, 64, 256, 24
#: Rates at the start, at its end and at the end of the last round.
RATES = 0.005, 0.003, 0.0005
#: Words of a row of the token table: long documents stand in many rows, which a hash deals to rounds and tasks one by one.
PIECE = 4_096
SLICES = 32  # of a network's weights, which are summed apart
#: Tokens that are scored in one go.
AT_ONCE = 2_000_000
#: Logits up to here have an exp, and sums of it, that 32-bit floats hold.
SAFE = 60.0
END = U(0x5EED0E11D0C00001)  # stands for the end of a document, among word hashes
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"


def forms() -> tuple[np.ndarray, int]:
    """The form of a word by its last byte, and the number of forms; words with bytes beyond ASCII have forms of their own."""
    groups = [b"aeiou", b"n", b"t", b"s", b"r", b"dgh", b"ly", b",.;:!?"]
    table = np.full(256, len(groups), dtype=np.int64)
    for k, chars in enumerate(groups):
        table[np.frombuffer(chars, np.uint8)] = k
    return table, 2 * (len(groups) + 1)


FORM, FORMS = forms()


def word_forms(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.int64)
    beyond = np.concatenate([[0], np.cumsum(raw >= 128, dtype=np.int64)])
    return FORM[LOWER[raw[ends - 1]]] + FORMS // 2 * (beyond[ends] > beyond[starts])


class Table:
    """Hash keys to numbers by open addressing, many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=U), np.full(1 << self.bits, -1, dtype=np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = (keys[left] + U(probe)) & U((1 << self.bits) - 1)
            free = np.flatnonzero(self.values[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[left[won]], values[left[won]]
            left, probe = np.delete(left, won), probe + 1
        self.probes = probe

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for probe in range(self.probes):
            slot = (keys[open_] + U(probe)) & U((1 << self.bits) - 1)
            value = self.values[slot]
            hit = (self.keys[slot] == keys[open_]) & (value >= 0)
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
            if not len(open_):
                break
        return out


def _sums(x: np.ndarray) -> np.ndarray:
    """The sum of each row: by a product, which is quicker than a reduction where rows are short."""
    return x @ np.ones(x.shape[1], x.dtype)


def _top(weights: np.ndarray, bias: np.ndarray) -> float:
    """What no logit of a state in -1 .. 1 can pass."""
    return float((np.abs(weights).sum(axis=0) + np.abs(bias)).max()) if bias.size else 0.0


def _exp(x: np.ndarray, top: float) -> np.ndarray:
    """exp(x) in place, less the largest of each row where exp alone might overflow; rows keep their proportions."""
    if top > SAFE:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


class Network:
    """h' = (1 - z) h + z tanh(..), z and r logistic; then P(class | h) P(token | class, h)."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(counts)
        # Classes of about equal square-rooted mass, in order of frequency; every form of rarer words is a class alone.
        head = np.arange(n - FORMS)
        order = head[np.argsort(-counts[head], kind="stable")]
        mass = np.cumsum(np.sqrt(counts[order] + 1.0))
        self.cls = np.empty(n, dtype=np.int64)
        self.cls[order] = np.unique(np.minimum((classes * mass / mass[-1]).astype(np.int64), classes - 1), return_inverse=True)[1] if len(order) else 0
        own = int(self.cls[order].max()) + 1 if len(order) else 0
        self.cls[n - FORMS :] = own + np.arange(FORMS)
        k = own + FORMS
        self.members = [np.flatnonzero(self.cls == c) for c in range(k)]
        self.place = np.empty(n, dtype=np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        f = np.float32
        g = lambda *s: (rng.standard_normal(s) * 0.08).astype(f)
        mass_of = np.array([counts[m].sum() + 1.0 for m in self.members])
        self.p = {"E": g(n, 3 * hidden), "U": g(hidden, 3 * hidden) * f(2), "b": np.zeros(3 * hidden, f), "C": g(hidden, k), "cb": np.log(mass_of / mass_of.sum()).astype(f), "W": g(n, hidden), "wb": np.log((counts + 1.0) / mass_of[self.cls]).astype(f)}
        self.p["b"][:hidden] = -1.0
        self.hidden = hidden

    def step(self, token: np.ndarray, h: np.ndarray, biased: np.ndarray | None = None) -> tuple:
        """The next state, and the parts that gradients need; ``biased`` is E + b where it is at hand."""
        n, p = self.hidden, self.p
        x = np.take(p["E"], token, axis=0) + p["b"] if biased is None else np.take(biased, token, axis=0)
        zr = h @ p["U"][:, : 2 * n]
        zr += x[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :n], zr[:, n:]
        rh = r * h
        c = rh @ p["U"][:, 2 * n :]
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, rh

    def _heads(self) -> list[tuple]:
        """Of each class with several members its weights, bias and what its logits can't pass."""
        w, b = self.p["W"], self.p["wb"]
        return [(np.ascontiguousarray(w[m].T), b[m], _top(w[m].T, b[m])) if len(m) > 1 else None for m in self.members]

    def token_logs(self, h: np.ndarray, token: np.ndarray, heads: list | None = None) -> np.ndarray:
        """Natural logarithm of each token's probability after the state h."""
        p, c = self.p, self.cls[token]
        heads = self._heads() if heads is None else heads
        e = _exp(h @ p["C"] + p["cb"], _top(p["C"], p["cb"]))
        share = e[np.arange(len(c)), c] / _sums(e)
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(len(self.members) + 1))
        inner = np.ones(len(c), h.dtype)
        for k, head in enumerate(heads):
            rows = order[cuts[k] : cuts[k + 1]]
            if head is not None and len(rows):
                x = h[rows] @ head[0]
                x += head[1]
                e = _exp(x, head[2])
                inner[rows] = e[np.arange(len(rows)), self.place[token[rows]]] / _sums(e)
        tiny = np.finfo(np.float32).tiny
        return np.log(np.maximum(share, tiny)).astype(np.float64) + np.log(np.maximum(inner, tiny))

    def score(self, docs: list[np.ndarray], window: int = 64) -> np.ndarray:
        """The natural log-probability of each whole token sequence; states are carried from window to window."""
        out = np.zeros(len(docs))
        size = np.array([len(d) for d in docs], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        heads, biased = self._heads(), self.p["E"] + self.p["b"]
        for a in range(0, len(order), 1024):
            own = order[a : a + 1024]
            n = size[own]
            h = np.zeros((len(own), self.hidden), np.float32)
            last = np.full(len(own), len(self.cls) - FORMS - 1)  # the end token stands before each document
            for t0 in range(0, int(n[0]), window):
                live = int(np.searchsorted(-n, -t0, "left"))  # documents longer than t0
                span = min(window, int(n[0]) - t0)
                grid = np.zeros((live, span), dtype=np.int64)
                for i, d in enumerate(own[:live]):
                    part = docs[d][t0 : t0 + span]
                    grid[i, : len(part)] = part
                lens = np.minimum(n[:live] - t0, span)
                states, tokens, rows = [], [], []
                for t in range(span):
                    k = int(np.searchsorted(-lens, -t, "left"))  # those with a token at t
                    states.append(self.step(last[:k], h[:k], biased)[0])
                    h[:k] = states[-1]
                    last[:k] = grid[:k, t]
                    tokens.append(grid[:k, t])
                    rows.append(np.arange(k))
                logs = self.token_logs(np.concatenate(states), np.concatenate(tokens), heads)
                out[own] += np.bincount(np.concatenate(rows), logs, minlength=len(own))
        return out

    def train(self, chunks, expected: float, rates: tuple[float, float], streams: int = STREAMS, steps: int = STEPS) -> int:
        """Truncated backpropagation through ``steps`` tokens of parallel runs, by Adam; states are carried between windows.

        Each chunk is cut into ``streams`` runs of equal width, which overlap by less than a token a
        run, so that every token but a chunk's first is predicted. The rate falls from the first to
        the second of ``rates`` over ``expected`` tokens. Returns the tokens predicted.
        """
        p = self.p
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        t = done = 0
        for chunk in chunks:
            n = len(chunk) - 1
            if n < 1:
                continue
            runs = max(1, min(streams, n // steps))
            width = -(-n // runs)
            starts = np.arange(runs) * (n - width) // max(1, runs - 1)
            x = chunk[starts[:, None] + np.arange(width + 1)]
            h = np.zeros((runs, self.hidden), np.float32)
            for a in range(0, width, steps):
                t += 1
                end = min(a + steps, width)
                grad, h = self._gradients(x[:, a:end], x[:, a + 1 : end + 1], h)
                along = min(1.0, (done + n * a / width) / expected)
                lr = (rates[0] + (rates[1] - rates[0]) * along) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                for k, g in grad.items():
                    if isinstance(g, tuple):  # rows of a table
                        rows, g = g
                        np.clip(g, -1, 1, out=g)
                        m1[k][rows] = 0.9 * m1[k][rows] + 0.1 * g
                        m2[k][rows] = 0.99 * m2[k][rows] + 0.01 * g * g
                        p[k][rows] -= lr * m1[k][rows] / (np.sqrt(m2[k][rows]) + 1e-7)
                    else:
                        np.clip(g, -1, 1, out=g)
                        m1[k] = 0.9 * m1[k] + 0.1 * g
                        m2[k] = 0.99 * m2[k] + 0.01 * g * g
                        p[k] -= lr * m1[k] / (np.sqrt(m2[k]) + 1e-7)
            done += n
        return done

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size

    def _gradients(self, ins: np.ndarray, outs: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        p, n, (B, T) = self.p, self.hidden, ins.shape
        kept, states, biased = [], np.empty((T + 1, B, n), h.dtype), p["E"] + p["b"]
        states[0] = h
        for t in range(T):
            states[t + 1], *parts = self.step(ins[:, t], states[t], biased)
            kept.append(parts)
        H, y = states[1:].reshape(-1, n), outs.T.ravel()
        scale = h.dtype.type(1.0 / B)

        def off(e: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Of exponentials the softmax less one at the right place, over the runs."""
            e *= (scale / _sums(e))[:, None]
            e[np.arange(len(at)), at] -= scale
            return e

        c = self.cls[y]
        d = off(_exp(H @ p["C"] + p["cb"], _top(p["C"], p["cb"])), c)
        grad = {"C": H.T @ d, "cb": _sums(d.T)}
        dH = d @ p["C"].T
        gW, gb = {}, []
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(len(self.members) + 1))
        for k, m in enumerate(self.members):
            own = order[cuts[k] : cuts[k + 1]]
            if len(m) < 2 or not len(own):
                continue
            Hk, Wk, bk = H[own], p["W"][m], p["wb"][m]
            d = off(_exp(Hk @ Wk.T + bk, _top(Wk.T, bk)), self.place[y[own]])
            gW[k] = d.T @ Hk
            gb.append(d.sum(axis=0))
            dH[own] += d @ Wk
        if gW:
            at = np.concatenate([self.members[k] for k in gW])
            grad["W"], grad["wb"] = (at, np.concatenate(list(gW.values()))), (at, np.concatenate(gb))
        dx = np.empty((T, B, 3 * n), h.dtype)
        back = np.zeros((B, n), h.dtype)
        dzr, dc = np.empty((B, 2 * n), h.dtype), np.empty((B, n), h.dtype)
        dz, dr = dzr[:, :n], dzr[:, n:]
        Uzr, Uc = np.ascontiguousarray(p["U"][:, : 2 * n].T), np.ascontiguousarray(p["U"][:, 2 * n :].T)
        for t in range(T - 1, -1, -1):
            z, r, c, _ = kept[t]
            before = states[t]
            dh = dH[t * B : (t + 1) * B]
            dh += back
            np.multiply(dh, z, out=dc)
            dc *= 1 - c * c
            drh = dc @ Uc
            np.multiply(dh, c - before, out=dz)
            dz *= z * (1 - z)
            np.multiply(drh, before, out=dr)
            dr *= r * (1 - r)
            dx[t, :, : 2 * n], dx[t, :, 2 * n :] = dzr, dc
            dh *= 1 - z
            drh *= r
            back = dzr @ Uzr
            back += dh
            back += drh
        flat = dx.reshape(-1, 3 * n)
        rh = np.concatenate([k[3] for k in kept])
        grad["U"] = np.concatenate([states[:T].reshape(-1, n).T @ flat[:, : 2 * n], rh.T @ flat[:, 2 * n :]], axis=1)
        grad["b"] = _sums(flat.T)
        token = ins.T.ravel()
        order = np.argsort(token, kind="stable")
        used, first = np.unique(token[order], return_index=True)
        grad["E"] = (used, np.add.reduceat(np.take(flat, order, axis=0), first, axis=0))
        return grad, states[T].copy()


def text_words(column: pa.Array):
    """(word hashes, forms, first word of each text and the end) of chunks of whole texts, as (first text, ...)."""
    raw, at = text_bytes(column)
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK, "right")) - 1)
        part = raw[at[begin] : at[end]]
        starts, ends, first = word_spans(part, at[begin : end + 1] - at[begin])
        yield begin, word_hashes(part, starts, ends), word_forms(part, starts, ends), first
        begin = end


def _counts(batches):
    def out(keys, forms, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(forms.astype(np.int8)), pa.array(n.astype(np.int64))], names=["word", "form", "n"])

    held, size = [], 0

    def merged():
        keys, forms, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, one, where = np.unique(keys, return_index=True, return_inverse=True)
        return keys, forms[one], np.bincount(where, n, len(keys))

    docs = 0
    for batch in batches:
        docs += batch.num_rows
        for _, w, f, _ in text_words(batch.column("text")):
            if len(w):
                keys, one, n = np.unique(w, return_index=True, return_counts=True)
                held.append((keys, f[one], n.astype(np.float64)))
                size += len(keys)
        if size > 2_000_000:
            m = merged()
            held, size = [m], len(m[0])
            if size > 1_000_000:
                yield out(*m)
                held, size = [], 0
    if held:
        yield out(*merged())
    if docs:
        yield out(np.array([END], dtype=U), np.zeros(1, np.int64), np.array([docs]))


@dataclass
class Model:
    """What tasks need: the counts of frequent words and the totals of all words; and the network."""

    table: Table  # word -> place in counts; the first HEAD places at most are the network's tokens
    counts: np.ndarray
    head: int  # words that are tokens of the network, without the end
    total: int
    distinct: int
    form_total: np.ndarray  # of words that aren't
    form_distinct: np.ndarray
    ends: int  # training documents
    network: Network | None = None
    trained: int = 0  # tokens that the rounds trained it on

    def base_floor(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    def form_floor(self) -> np.ndarray:
        return np.log10(self.form_total + 0.5 * (self.form_distinct + 1))


def count_words(training: DataFrame) -> DataFrame:
    """(word, form, c): how often each word, and the end of a document, stands in all of ``training``.

    Words are told apart by 64-bit hashes; among a billion different words, two share one with a
    chance of 0.03.
    """
    rows = training.select("text").mapInArrow(tidy(_counts), "word long, form byte, n long")
    return materialize(rows.groupBy("word").agg(F.first("form").alias("form"), F.sum("n").alias("c")), "words")


#: The use of tasks that hold a model, as tidy() has it.
USE = "language model"


def _load(sent, name: str):
    held = KEPT.setdefault(USE, {})
    if name not in held:
        held.clear()
        held[name] = pickle.loads(sent.value)
    return held[name]


def _prepare(sent, name: str):
    """Of rows (doc_id, h, text), whole texts as the network's tokens with their end, and all of a score that counts give.

    ``base`` and ``inner`` leave out the counts of words that the table doesn't have: these come by a
    join with ``rare``, which says how many times each stands in the text.
    """
    def run(batches):
        model: Model = _load(sent, name)
        end = model.head
        known_c = np.log10(model.counts + 0.5)
        form_floor, base_floor = model.form_floor(), model.base_floor()
        log_end = math.log10(model.ends + 0.5)
        for batch in batches:
            for begin, w, f, first in text_words(batch.column("text")):
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                at = model.table.find(w)
                have, in_head = at >= 0, (at >= 0) & (at < model.head)
                token = np.where(in_head, at, end + 1 + f).astype("<u2")
                log_c = np.where(have, known_c[np.maximum(at, 0)], 0.0)
                sums = lambda x: np.bincount(doc, x, minlength=len(n))  # noqa: E731, B023
                base = sums(log_c) - (n + 1) * base_floor + log_end
                inner = sums(np.where(in_head, 0.0, log_c - form_floor[f]))
                known = sums(have).astype(np.int64) + (1 if model.ends else 0)
                far = np.flatnonzero(~have)
                d, k = doc[far], w[far].view(np.int64)
                order = np.lexsort((k, d))
                d, k = d[order], k[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(d) else np.zeros(0, np.int64)
                times, cut = np.diff(np.append(new, len(d))).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=len(n)))]).astype(np.int32)
                whole = [np.append(t, np.array(end, "<u2")).tobytes() for t in np.split(token, first[1:-1])]
                rows = [batch.column(c).slice(begin, len(n)) for c in ("doc_id", "h")]
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (k[new], times)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(n + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(inner, pa.float64()), *lists, pa.array(whole, pa.binary())], names=["doc_id", "h", "n_tokens", "known", "base", "inner", "rare", "many", "tokens"])

    return run


PREPARED = "doc_id long, h long, n_tokens long, known long, base double, inner double, rare array<long>, many array<int>, tokens binary"


def _pieces(batches):
    """Rows (h, tokens) in numbered pieces of at most PIECE tokens."""
    for batch in batches:
        out, row, part = [], [], []
        for r, x in enumerate(batch.column("tokens")):
            raw = memoryview(x.as_buffer())
            mine = [bytes(raw[i : i + 2 * PIECE]) for i in range(0, len(raw), 2 * PIECE)]
            out += mine
            row += [r] * len(mine)
            part += range(len(mine))
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(row[i : i + 256], pa.int64())), pa.array(part[i : i + 256], pa.int32()), pa.array(out[i : i + 256], pa.binary())], names=["h", "part", "tokens"])


def _chunks(batches, end: int):
    """The tokens of rows in arrays of about HELD_WORDS, each headed by the token before it (the end before all)."""
    held, size, before = [], 0, np.array([end])
    for batch in batches:
        for x in batch.column("tokens"):
            held.append(np.frombuffer(x.as_buffer(), "<u2"))
            size += len(held[-1])
            if size >= HELD_WORDS:
                out = np.concatenate([before, *held]).astype(np.int64)
                yield out
                held, size, before = [], 0, out[-1:]
    if held:
        yield np.concatenate([before, *held]).astype(np.int64)


def _train(sent, end: int, expected: float, rates: tuple[float, float], streams: int):
    """The network as trained on a task's rows, in slices."""
    def run(batches):
        network: Network = pickle.loads(sent.value)
        n = network.train(_chunks(batches, end), expected, rates, streams)
        if n:
            slices = [x.astype("<f4").tobytes() for x in np.array_split(network.flat(), SLICES)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(slices, pa.binary())], names=["slice", "task", "n", "data"])

    return run


def _sum_slices(batches):
    """Of each slice the sum over tasks, weighted by their tokens."""
    sums, weights = {}, {}
    for batch in batches:
        for k, n, x in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
            sums[k] = sums.get(k, 0.0) + np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) * n
            weights[k] = weights.get(k, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(weights.values()), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "n", "data"])


def _round(rows: DataFrame, network: Network, end: int, expected: float, rates: tuple[float, float], streams: int) -> int:
    """Train by one task per partition of ``rows`` (h, tokens), each from the same weights; ``network`` gets their average. Returns the tokens."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(network, protocol=5))
    tasks = rows.sortWithinPartitions("h", "tokens").mapInArrow(tidy(_train(sent, end, expected, rates, streams)), "slice int, task int, n long, data binary")
    parts = tasks.repartition("slice").sortWithinPartitions("slice", "task").mapInArrow(_sum_slices, "slice int, n long, data binary").collect()  # SLICES rows, two networks large
    sent.destroy()
    if parts:
        network.set_flat(np.concatenate([np.frombuffer(r.data, "<f8") / r.n for r in sorted(parts, key=lambda r: r.slice)]))
    return parts[0].n if parts else 0


def _train_all(network: Network, prepared: DataFrame, head: int, total: int) -> int:
    """Train on every token of the prepared training rows, of ``total`` tokens; returns the tokens of the rounds."""
    tokens = materialize(prepared.select("h", "tokens").mapInArrow(tidy(_pieces), "h long, part int, tokens binary").select(F.xxhash64("h", "part").alias("h"), "tokens"), "tokens")
    share = min(1.0, START_WORDS / max(1, total))
    start = tokens.where(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * share))
    _round(start.repartition(1), network, head, max(1, total * share), RATES[:2], START_STREAMS)
    tasks, trained = max(1, round(total / ROUNDS / TASK_WORDS)), 0
    fall = lambda k: RATES[1] + (RATES[2] - RATES[1]) * k / ROUNDS
    for k in range(ROUNDS):
        rows = tokens.where(F.pmod("h", F.lit(ROUNDS)) == k).repartition(tasks, "h")
        trained += _round(rows, network, head, max(1, total / ROUNDS / tasks), (fall(k), fall(k + 1)), STREAMS)
    discard(tokens)
    return trained


def learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model and all word counts of the documents of ``docs`` (doc_id, text) whose remainder() isn't 1, and all rows as _prepare() makes them, numbered in ``row``."""
    training = docs.where(remainder() != 1)
    words = count_words(training)
    end = np.int64(END.view(np.int64))
    stats = words.groupBy("form", F.floor(F.log2("c") * 8).alias("bin"), (F.col("word") == F.lit(int(end))).alias("is_end")).agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect()  # a few hundred rows at any size
    total, distinct = sum(r.c for r in stats), sum(r.v for r in stats)
    by_bin: dict[int, int] = {}
    for r in stats:
        by_bin[r.bin] = by_bin.get(r.bin, 0) + r.v
    floor_, held = None, 0
    for b in sorted(by_bin, reverse=True):
        held += by_bin[b]
        if held > LOOKUP and floor_ is not None:
            break
        floor_ = b
    top = words.where((F.floor(F.log2("c") * 8) >= F.lit(floor_ if floor_ is not None else 0)) & (F.col("word") != F.lit(int(end)))).toPandas()
    if len(top) > LOOKUP:  # the first bin alone may hold more; the rest is joined like all rarer words
        top = top.sort_values(["c", "word"], ascending=[False, True], kind="stable").head(LOOKUP)
    top = top.sort_values(["c", "word"], ascending=[False, True], kind="stable")
    keys, c, f = top["word"].to_numpy(dtype=np.int64).view(U), top["c"].to_numpy(dtype=np.int64), top["form"].to_numpy(dtype=np.int64)
    head = min(HEAD, len(keys))
    ft, fd = np.zeros(FORMS, dtype=np.int64), np.zeros(FORMS, dtype=np.int64)
    ends = 0
    for r in stats:
        if r.is_end:
            ends = r.c
        else:
            ft[r.form] += r.c
            fd[r.form] += r.v
    np.subtract.at(ft, f[:head], c[:head])
    np.subtract.at(fd, f[:head], 1)
    model = Model(Table(keys, np.arange(len(keys))), c, head, total, distinct, ft, fd, ends)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))  # LOOKUP words
    prepared = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(3)).alias("h"), "text").mapInArrow(tidy(_prepare(sent, uuid.uuid4().hex), USE), PREPARED)
    prepared = materialize(prepared.withColumn("row", F.monotonically_increasing_id()), "prepared")  # rows are numbered as they are written
    sent.destroy()
    model.network = Network(np.concatenate([c[:head], [ends], np.maximum(ft, 0)]).astype(np.float64))
    model.trained = _train_all(model.network, prepared.where(remainder() != 1), head, total)
    return model, words, prepared


def _score(sent, name: str):
    """Of prepared rows the network's log10-probability of all their tokens, AT_ONCE of them at a time."""
    def run(batches):
        network: Network = _load(sent, name)
        held, size = [], 0

        def flush():
            docs = [np.frombuffer(x.as_buffer(), "<u2") for b in held for x in b.column("tokens")]
            row, unseen = (pa.concat_arrays([b.column(k) for b in held]) for k in ("row", "inner"))
            return pa.RecordBatch.from_arrays([row, pa.array(network.score(docs) / math.log(10.0) + unseen.to_numpy())], names=["row", "score"])

        for batch in batches:
            held.append(batch)
            size += batch.column("tokens").nbytes // 2
            if size >= AT_ONCE:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text, any more columns).

    A text's tokens are its words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end. All
    documents whose remainder() isn't 1 are counted. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))).
    ``score`` is the log10-probability of the network for the text's tokens: a frequent word or the
    end by the class-factored softmax; any other by the probability of its form times
    (c + 0.5) / (N' + 0.5 (V' + 1)) within the form, where words never seen count as one.

    Null texts are empty and have the end alone. Rows that repeat a doc_id are scored each; null
    doc_ids count as empty text in remainder(). With no training document, every probability is
    that of an unseen word or of the untrained network. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, words, prepared = learn(docs)
    sent = spark.sparkContext.broadcast(pickle.dumps(model.network, protocol=5))  # of fixed size
    scored = materialize(prepared.select("row", "inner", "tokens").mapInArrow(tidy(_score(sent, uuid.uuid4().hex), USE), "row long, score double"), "scores")
    sent.destroy()
    rare = prepared.select("row", F.explode(F.arrays_zip("rare", "many")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.many").alias("many"))
    # Words that no training document has count 0: log10(0.5), which is added for all and corrected for those found.
    zero = math.log10(0.5)
    found = rare.join(words.select("word", "c"), "word").groupBy("row").agg(F.sum(F.col("many") * (F.log10(F.col("c") + 0.5) - F.lit(zero))).alias("more"), F.sum("many").alias("seen"))
    unseen = F.aggregate("many", F.lit(0).cast("long"), lambda a, x: a + x) * F.lit(zero) + F.coalesce("more", F.lit(0.0))
    out = prepared.select("row", "doc_id", "n_tokens", "known", "base", "many").join(scored, "row").join(found, "row", "left")
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + unseen).alias("base_score"), (F.col("score") + unseen).alias("score"))
