"""A gated recurrent network over token classes and head words, in numpy: truncated backpropagation and scoring.

Ids below ``heads`` are head words, dealt to ``heads / width`` classes of ``width`` each; an id from ``heads`` on is a class of
its own. The output is factored: a softmax over classes, then one over the words of the class. The inputs are the
previous ids, whose embeddings enter the gates directly.

Sequences run in lanes side by side, one after the other in each lane, longest first to the emptiest lane. A lane's
state goes on from window to window within a sequence and begins anew with the next; gradients stop at a window's start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

LANES, WINDOW = 256, 16
STRETCH = 1024  # ids of a sequence that learn as one
#: Steps of Adam: rate and decays.
RATE, DECAY_1, DECAY_2 = 0.008, 0.9, 0.99


class Shape(NamedTuple):
    heads: int
    width: int
    classes: int  # of head words and others
    hidden: int

    @property
    def ids(self) -> int:
        return self.heads + self.classes - self.heads // self.width


def initial(shape: Shape, class_share: np.ndarray, word_share: np.ndarray, seed: int = 42) -> dict[str, np.ndarray]:
    """Parameters that give each class its share, whatever came before, and each head word its share of its class."""
    rng = np.random.default_rng(seed)
    normal = lambda *size, by: (rng.standard_normal(size) * by).astype(np.float32)
    h = shape.hidden
    return {
        "embed": normal(shape.ids + 1, 3 * h, by=0.1),  # the last is what stands before a sequence
        "gates": normal(h, 2 * h, by=h**-0.5),
        "inner": normal(h, h, by=h**-0.5),
        "to_class": normal(h, shape.classes, by=0.01),
        "class_bias": np.log(np.maximum(class_share, 1e-12)).astype(np.float32),
        "to_word": normal(shape.heads // shape.width, h, shape.width, by=0.01),
        "word_bias": np.log(np.maximum(word_share, 1e-12)).astype(np.float32).reshape(-1, shape.width),
    }


def lanes_of(size: np.ndarray, lanes: int) -> list[list[int]]:
    """The sequences of each lane, in order; lanes of more steps come first."""
    lanes = min(lanes, len(size))
    heap = [(0, k) for k in range(lanes)]
    found, total = [[] for _ in range(lanes)], [0] * lanes
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heap[0]
        found[k].append(i)
        total[k] = n + int(size[i])
        heapq.heapreplace(heap, (total[k], k))
    return [found[k] for k in sorted(range(lanes), key=lambda k: -total[k])]


class Lanes(NamedTuple):
    """Sequences dealt to lanes: ids in the lanes' order, where each lane begins, how many ids it has."""

    ids: np.ndarray
    begins: np.ndarray  # whether a sequence begins here
    start: np.ndarray
    length: np.ndarray
    order: np.ndarray  # the sequences in the lanes' order

    def windows(self, nothing: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(places, whether there is an id, ids, ids before, whether a sequence begins), steps x lanes that are not at their end."""
        for lo in range(0, int(self.length.max(initial=0)), window):
            active = int((self.length > lo).sum())
            t = np.arange(lo, min(lo + window, int(self.length[0])))[:, None]
            there = t < self.length[:active]
            place = np.where(there, self.start[:active] + t, self.start[:active])
            begins = self.begins[place]
            yield place, there, self.ids[place], np.where(begins, nothing, self.ids[place - 1]), begins


def dealt(ids: np.ndarray, size: np.ndarray, lanes: int = LANES) -> Lanes:
    """Deals sequences, which lie one after the other in ids, to lanes. Empty sequences are left out."""
    some = np.flatnonzero(size)
    own = [some[x] for x in lanes_of(size[some], lanes)] if len(some) else []
    order = np.concatenate(own) if own else np.zeros(0, np.int64)
    n = size[order]
    first = np.cumsum(n) - n
    flat = ids[np.repeat((np.cumsum(size) - size)[order] - first, n) + np.arange(int(n.sum()))].astype(np.int32)
    begins = np.zeros(len(flat), bool)
    begins[first] = True
    length = np.array([int(size[x].sum()) for x in own], np.int64)
    return Lanes(flat, begins, np.cumsum(length) - length, length, order)


def stretches(size: np.ndarray, most: int = STRETCH) -> np.ndarray:
    """Sizes of the pieces of at most so many ids that sequences are cut into."""
    n = np.maximum(1, -(-size // most))
    out = np.full(int(n.sum()), most, np.int64)
    out[np.cumsum(n) - 1] = size - (n - 1) * most
    return out


def _sigmoid(x: np.ndarray, numerator: float = 1.0, negated: bool = False) -> np.ndarray:
    """numerator / (1 + exp(-x)), in place; numpy's exp is faster than its tanh. Only far below 0 would exp overflow.

    negated: x is -x already, and the caller ignores overflows, which rightly give 0.
    """
    if not negated:
        np.negative(x, out=x)
        np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(numerator, x, out=x)


def _exp_and_sum(a: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """exp(a), in place of a, and its rows' sums; bounded: no element is over 80, so that exp can't overflow."""
    if not bounded:
        np.minimum(a, 80, out=a)
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], a.dtype)


def _with_ones(h: np.ndarray) -> np.ndarray:
    """h with a column of ones, which a bias is multiplied by."""
    out = np.ones((h.shape[0], h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


class Weights(NamedTuple):
    """The parameters as products need them: biases are last rows, and what goes into exp of gates and new parts has its sign and factor (exact: -1 and -2)."""

    embed: np.ndarray
    recurrent: np.ndarray  # transposed
    to_class: np.ndarray
    to_word: np.ndarray
    bounded: bool  # whether no state, which lies in -1 .. 1, gives an exponent over 80


class Network:
    def __init__(self, shape: Shape, values: dict[str, np.ndarray]):
        self.shape, self.p = shape, values
        # the class of each id, and of head words which it is of its class
        k = shape.heads // shape.width
        self.class_of = np.concatenate([np.arange(shape.heads) // shape.width, np.arange(k, shape.classes)]).astype(np.int32)

    def weights(self) -> Weights:
        p, n = self.p, self.shape.hidden
        factor = np.repeat([-1, -1, -2], n).astype(p["embed"].dtype)
        to_class = np.concatenate([p["to_class"], p["class_bias"][None]])
        to_word = np.concatenate([p["to_word"], p["word_bias"][:, None]], axis=1)
        most = max(float((np.abs(w[..., :-1, :]).sum(axis=-2) + w[..., -1, :]).max(initial=0)) for w in (to_class, to_word))
        return Weights(p["embed"] * factor, np.ascontiguousarray((np.concatenate([p["gates"], p["inner"]], axis=1) * factor).T), to_class, to_word, most <= 79)

    def states(self, w: Weights, x: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """The state (hidden, lanes) after each step, and with keep what the way back needs: states before, sums (gates z and r, -2 times the inner part), new parts.

        Lanes come last, so that each gate's numbers lie side by side.
        """
        n, (steps, lanes), kind = self.shape.hidden, x.shape, w.embed.dtype
        inputs = np.ascontiguousarray(np.take(w.embed, x, axis=0).transpose(0, 2, 1))
        out, held = np.empty((steps, n, lanes), kind), steps if keep else 1
        before, sums, new = np.empty((held, n, lanes), kind), np.empty((held, 3 * n, lanes), kind), np.empty((held, n, lanes), kind)
        goes_on, new_ones = (~begins).astype(kind), begins.any(axis=1).tolist()
        h = np.ascontiguousarray(h.T)
        with np.errstate(over="ignore"):
            for t in range(steps):
                k = t if keep else 0
                if new_ones[t] or keep:
                    h = np.multiply(h, goes_on[t], out=before[k])
                a, b = np.matmul(w.recurrent, h, out=sums[k]), new[k]
                gates = a[: 2 * n]
                gates += inputs[t, : 2 * n]
                _sigmoid(gates, negated=True)
                np.multiply(a[n : 2 * n], a[2 * n :], out=b)
                b += inputs[t, 2 * n :]
                _sigmoid(b, 2.0, negated=True)
                b -= 1  # the tangent
                h = np.subtract(h, b, out=out[t])
                h *= a[:n]
                h += b
        return out, (before, sums, new)

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]], tuple[np.ndarray, np.ndarray]]:
        """(places of the head words, sorted by class; each class and where it is among them; where each word is in its class)."""
        own = np.flatnonzero(y < self.shape.heads)
        c = (y[own] // self.shape.width).astype(np.int16)
        order = np.argsort(c, kind="stable")
        own, c = own[order], c[order]
        ends = np.searchsorted(c, np.arange(self.shape.heads // self.shape.width + 1)).tolist()
        runs = [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
        return own, runs, (np.arange(len(own)), y[own] % self.shape.width)

    def _word_sums(self, w: Weights, h: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
        out = np.empty((len(h), self.shape.width), h.dtype)
        for k, at in runs:
            np.matmul(h[at], w.to_word[k], out=out[at])
        return out

    def log_likelihood(self, h: np.ndarray, y: np.ndarray, w: Weights | None = None) -> np.ndarray:
        """The natural logarithm of each id's probability, given states (n, hidden)."""
        w, h = w or self.weights(), _with_ones(h)
        a = h @ w.to_class
        out = a[np.arange(len(y)), self.class_of[y]]
        out -= np.log(_exp_and_sum(a, w.bounded)[1])
        own, runs, words = self._by_class(y)
        a = self._word_sums(w, h[own], runs)
        picked = a[words]
        picked -= np.log(_exp_and_sum(a, w.bounded)[1])
        out[own] += picked
        return out

    def score(self, ids: np.ndarray, size: np.ndarray, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """The natural logarithm of each id's probability given those before it in its sequence, in the order of ids."""
        own, w = dealt(ids, size, lanes), self.weights()
        found = np.zeros(len(own.ids), np.float32)
        h = np.zeros((len(own.length), self.shape.hidden), np.float32)
        for place, there, y, x, begins in own.windows(self.shape.ids, window):
            states, _ = self.states(w, x, begins, h[: x.shape[1]])
            h, at = states[-1].T, there.ravel()
            found[place.ravel()[at]] = self.log_likelihood(states.transpose(0, 2, 1).reshape(-1, self.shape.hidden)[at], y.ravel()[at], w)
        out = np.zeros(len(ids), np.float32)
        n = size[own.order]
        first = np.cumsum(n) - n
        out[np.repeat((np.cumsum(size) - size)[own.order] - first, n) + np.arange(int(n.sum()))] = found
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, begins: np.ndarray, there: np.ndarray, h: np.ndarray, full: int, costs: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of a window's cost, divided by the ids of a full one: gradients, the state at its end and, with costs, the cost."""
        p, n, w = self.p, self.shape.hidden, self.weights()
        states, (before, sums, new) = self.states(w, x, begins, h, keep=True)
        at, kind, weight, cost = np.flatnonzero(there.ravel()), states.dtype, 1 / full, 0.0
        own, y = _with_ones(states.transpose(0, 2, 1).reshape(-1, n)[at]), y.ravel()[at]

        def away(a: np.ndarray, right: tuple[np.ndarray, np.ndarray]) -> None:
            """Makes of sums what the cost changes by with them."""
            nonlocal cost
            a, total = _exp_and_sum(a, w.bounded)
            if costs:
                cost -= float(np.log(np.maximum(a[right] / total, 1e-30)).sum())
            a *= (weight / total)[:, None]
            a[right] -= weight

        a = own @ w.to_class
        away(a, (np.arange(len(y)), self.class_of[y]))
        g_class, back = own.T @ a, a @ p["to_class"].T
        heads, runs, words = self._by_class(y)
        chosen, g_word = own[heads], np.zeros_like(w.to_word)
        a = self._word_sums(w, chosen, runs)
        away(a, words)
        back_words = np.empty((len(heads), n), kind)
        for k, some in runs:
            np.matmul(chosen[some].T, a[some], out=g_word[k])
            np.matmul(a[some], p["to_word"][k].T, out=back_words[some])
        back[heads] += back_words
        g = {"to_word": g_word[:, :n], "word_bias": g_word[:, n], "to_class": g_class[:n], "class_bias": g_class[n]}
        d_states = np.zeros((x.size, n), kind)
        d_states[at] = back
        d_states = np.ascontiguousarray(d_states.reshape(*x.shape, n).transpose(0, 2, 1))
        z, r, inner = sums[:, :n], sums[:, n : 2 * n], sums[:, 2 * n :]
        # what a change of the state is multiplied by on its way to the new part, z and r
        by = np.empty((len(x), 3, n, x.shape[1]), kind)
        np.multiply(1 - z, 1 - new * new, out=by[:, 0])
        np.multiply(before - new, z * (1 - z), out=by[:, 1])
        np.multiply(by[:, 0] * inner, r * (1 - r), out=by[:, 2])
        by[:, 2] *= -0.5  # inner is -2 times the inner part
        # of new, z, r and the inner part: the first three are the inputs', the last three the sums'; rows 1,024 bytes apart would share few places of the cache
        d_all = np.empty((len(x), 4 * n, x.shape[1] + 8), kind)[:, :, : x.shape[1]]
        d, weights, goes_on = np.zeros((n, x.shape[1]), kind), np.concatenate([p["gates"], p["inner"]], axis=1), (~begins).astype(kind)
        for t in range(len(x) - 1, -1, -1):
            d += d_states[t]
            np.multiply(by[t], d, out=d_all[t, : 3 * n].reshape(3, n, -1))
            np.multiply(d_all[t, :n], r[t], out=d_all[t, 3 * n :])
            d *= z[t]
            d += weights @ d_all[t, n:]
            d *= goes_on[t]
        rows = d_all.transpose(0, 2, 1).reshape(-1, 4 * n)
        g_sums = before.transpose(0, 2, 1).reshape(-1, n).T @ rows[:, n:]
        g["gates"], g["inner"] = g_sums[:, : 2 * n], g_sums[:, 2 * n :]
        flat = x.ravel().astype(np.int16 if self.shape.ids < 32767 else np.int32)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        g["embed"] = np.zeros_like(p["embed"])
        of = np.add.reduceat(rows[order, : 3 * n], first, axis=0)
        g["embed"][flat[first]] = np.concatenate([of[:, n:], of[:, :n]], axis=1)  # an embedding holds z, r, new
        return g, states[-1].T, cost * weight

    def learn(self, ids: np.ndarray, size: np.ndarray, steps: dict, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> None:
        """One pass over sequences by truncated backpropagation and Adam; steps holds the moments and the number of steps so far.

        Sequences of over STRETCH ids learn as several, so that a long one doesn't keep a lane busy when all others are at
        their ends; the state begins anew in each.
        """
        own = dealt(ids, stretches(size), lanes)
        h = np.zeros((len(own.length), self.shape.hidden), np.float32)
        for _, there, y, x, begins in own.windows(self.shape.ids, window):
            g, h, _ = self.gradients(x, y, begins, there, h[: x.shape[1]], lanes * window, costs=False)
            n = steps["n"] = steps.get("n", 0) + 1
            for k, v in g.items():
                a = steps.setdefault((k, 1), np.zeros_like(v))
                b = steps.setdefault((k, 2), np.zeros_like(v))
                a *= np.float32(DECAY_1)
                a += np.float32(1 - DECAY_1) * v
                v *= v
                v *= np.float32(1 - DECAY_2)
                b *= np.float32(DECAY_2)
                b += v
                change = np.sqrt(b, out=v)
                change += np.float32(1e-8)
                np.divide(a, change, out=change)
                change *= np.float32(rate * (1 - DECAY_2**n) ** 0.5 / (1 - DECAY_1**n))
                self.p[k] -= change
