"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Steps of a window, in which gradients flow; state flows on across windows.
WINDOW = 32


@dataclass
class Lanes:
    """Texts laid end to end in parallel lanes of about equal length, longest first; a lane forgets its state where a text begins."""

    stream: np.ndarray
    fresh: np.ndarray
    start: np.ndarray
    length: np.ndarray
    order: np.ndarray
    text_at: np.ndarray

    @classmethod
    def even(cls, texts: list[np.ndarray], lanes: int) -> Lanes:
        """All texts in one row, cut into lanes of the same length: a text that is cut goes on without its state, so this is for learning only."""
        stream = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        text_at = np.cumsum(sizes) - sizes
        fresh = np.zeros(len(stream), bool)
        fresh[text_at] = True
        edges = np.linspace(0, len(stream), max(1, min(lanes, len(stream) // WINDOW)) + 1).astype(np.int64)
        length = np.diff(edges)
        by_length = np.argsort(-length, kind="stable")
        return cls(stream, fresh, edges[:-1][by_length], length[by_length], np.arange(len(texts)), text_at)

    @classmethod
    def of(cls, texts: list[np.ndarray], lanes: int) -> Lanes:
        """Each text goes to the lane that is shortest so far, longest text first. No text may be empty."""
        sizes = np.array([len(t) for t in texts])
        heap = [(0, k) for k in range(min(lanes, len(texts)))]
        own: list[list[int]] = [[] for _ in heap]
        for k in np.argsort(-sizes, kind="stable").tolist():
            n, lane = heap[0]
            own[lane].append(k)
            heapq.heapreplace(heap, (n + int(sizes[k]), lane))
        own.sort(key=lambda some: -int(sizes[some].sum()))
        order = np.array([k for some in own for k in some])
        length = np.array([int(sizes[some].sum()) for some in own])
        text_at = np.cumsum(sizes[order]) - sizes[order]
        stream = np.concatenate([texts[k] for k in order.tolist()])
        fresh = np.zeros(len(stream), bool)
        fresh[text_at] = True
        return cls(stream, fresh, np.cumsum(length) - length, length, order, text_at)

    def windows(self, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places in the stream, tokens, tokens before them, fresh), each steps x lanes; lanes that have ended are left out, a place past an end is -1.

        first: the token that stands before a text.
        """
        for t in range(0, int(self.length[0]), WINDOW):
            n = int(np.searchsorted(-self.length, -t))
            steps = np.arange(t, min(t + WINDOW, int(self.length[0])))[:, None]
            inside = steps < self.length[None, :n]
            at = np.where(inside, self.start[None, :n] + steps, -1)
            fresh = self.fresh[at] & inside
            yield at, self.stream[at], np.where(fresh, first, self.stream[at - 1]), fresh


def _softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability at `at` of each column of logits, which become probabilities (choices x cases: sums run along memory)."""
    logits -= logits.max(axis=0)
    told = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    logits /= total
    return told - np.log(total)


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Their stable order. Numbers below `most`; those of 16 bits are sorted by digits, which is faster."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _less(p: np.ndarray, at: np.ndarray) -> None:
    """What met less what was expected, in place of the probabilities."""
    p *= -1
    p[at, np.arange(len(at))] += 1


@dataclass
class Recurrent:
    """Weights of a model of `classes` classes of `width` tokens each; token i is in class i // width."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    NAMES = ("embedding", "into", "bias", "gates", "class_weight", "class_bias", "token_weight", "token_bias")

    @classmethod
    def fresh(cls, counts: np.ndarray, classes: int, hidden: int, seed: int = 0) -> Recurrent:
        """A model that at first gives each token its share of counts (and of one more each), whatever came before. counts: classes x width."""
        rng = np.random.default_rng(seed)
        width = len(counts) // classes
        share = (counts + 1.0).reshape(classes, width)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        bias = np.zeros(3 * hidden, np.float32)
        bias[:hidden] = 1.0  # states last at first
        return cls({
            "embedding": small(len(counts), hidden), "into": (small(hidden, 3 * hidden) * 3), "bias": bias, "gates": small(hidden, 3 * hidden) * 2, "class_weight": small(hidden, classes) * 0.1,
            "class_bias": np.log(share.sum(axis=1) / share.sum()).astype(np.float32), "token_weight": small(classes, hidden, width) * 0.1,
            "token_bias": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
        })

    @property
    def hidden(self) -> int:
        return len(self.weights["gates"])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].reshape(-1) for k in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Recurrent:
        out, at = {}, 0
        for k in self.NAMES:
            w = self.weights[k]
            out[k] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return Recurrent(out)

    def _forward(self, before: np.ndarray, fresh: np.ndarray, state: np.ndarray, projected: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each step of a window (steps x lanes x hidden)."""
        h, n = self.hidden, before.shape[1]
        gates, inward = self.weights["gates"], projected[before]
        out = np.empty((*before.shape, h), np.float32)
        state, anew = state[:n], fresh.any(axis=1)
        for t in range(len(before)):
            if anew[t]:
                state = state * ~fresh[t][:, None]
            back = state @ gates
            zr = _sigmoid(inward[t, :, : 2 * h] + back[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = r * back[:, 2 * h :]
            new += inward[t, :, 2 * h :]
            new = _sigmoid(np.multiply(new, 2, out=new))  # tanh by the same exponential
            new *= 2
            new -= 1
            if kept is not None:
                kept.append((state, z, r, new, back[:, 2 * h :]))
            after = np.subtract(state, new, out=out[t])
            after *= z
            after += new
            state = after
        return out

    def _told(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of tokens given states; with grads, what the states' gradient of their sum is, and adds the weights' own."""
        w = self.weights
        width = w["token_bias"].shape[1]
        kind, within = np.divmod(tokens, width)
        order = _order(kind, len(w["class_bias"]))  # by class, so that each class is one product
        kind, within, by_class = kind[order], within[order], states[order]
        p = w["class_weight"].T @ by_class.T
        p += w["class_bias"][:, None]
        told = _softmax(p, kind)
        d = None
        if grads is not None:
            _less(p, kind)
            grads["class_weight"] += by_class.T @ p.T
            grads["class_bias"] += p.sum(axis=1)
            d = p.T @ w["class_weight"].T
        edges = np.searchsorted(kind, np.arange(len(w["class_bias"]) + 1))
        for c in np.flatnonzero(np.diff(edges)):
            some = slice(edges[c], edges[c + 1])
            p = w["token_weight"][c].T @ by_class[some].T
            p += w["token_bias"][c][:, None]
            told[some] += _softmax(p, within[some])
            if grads is not None:
                _less(p, within[some])
                grads["token_weight"][c] += by_class[some].T @ p.T
                grads["token_bias"][c] += p.sum(axis=1)
                d[some] += p.T @ w["token_weight"][c].T
        out = np.empty(len(told))
        out[order] = told
        if grads is None:
            return out, None
        d_states = np.empty_like(d)
        d_states[order] = d
        return out, d_states

    def _projected(self) -> np.ndarray:
        return self.weights["embedding"] @ self.weights["into"] + self.weights["bias"]

    def log_probabilities(self, texts: list[np.ndarray], first: int, lanes: int = 256) -> np.ndarray:
        """The natural log-probability of each whole text (tokens)."""
        if not texts:
            return np.empty(0)
        laid, projected = Lanes.of(texts, lanes), self._projected()
        told, state = np.zeros(len(laid.stream)), np.zeros((len(laid.length), self.hidden), np.float32)
        for at, tokens, before, fresh in laid.windows(first):
            states = self._forward(before, fresh, state, projected)
            state = states[-1]
            inside = at >= 0
            told[at[inside]] = self._told(states[inside], tokens[inside])[0]
        out = np.empty(len(texts))
        out[laid.order] = np.add.reduceat(told, laid.text_at)
        return out

    def learn(self, texts: list[np.ndarray], first: int, optimizer: Adam, lanes: int = 128) -> float:
        """One pass over the texts, an update a window; returns the log-probability of all tokens as they were met."""
        if not texts:
            return 0.0
        laid, total, h = Lanes.even(texts, lanes), 0.0, self.hidden
        state = np.zeros((len(laid.length), h), np.float32)
        for at, tokens, before, fresh in laid.windows(first):
            kept: list = []
            projected = self._projected()
            states = self._forward(before, fresh, state, projected, kept)
            state, inside = states[-1], at >= 0
            grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
            told, d = self._told(states[inside], tokens[inside], grads)
            total += float(told.sum())
            d_states = np.zeros_like(states)
            d_states[inside] = d
            self._backward(before, fresh, kept, d_states, grads)
            optimizer.step(self.weights, grads, int(inside.sum()))
        return total

    def _backward(self, before: np.ndarray, fresh: np.ndarray, kept: list, d_states: np.ndarray, grads: dict) -> None:
        """Gradients through the window's steps, down to the embedding."""
        h, gates = self.hidden, self.weights["gates"]
        d_in = np.empty((*before.shape, 3 * h), np.float32)
        carried: np.ndarray | float = 0.0
        for t in range(len(before) - 1, -1, -1):
            state, z, r, new, back = kept[t]
            d = d_states[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            inward = d_in[t]
            inward[:, :h] = d * (state - new) * z * (1 - z)
            inward[:, h : 2 * h] = d_new * back * r * (1 - r)
            inward[:, 2 * h :] = d_new
            d_back = inward.copy()
            d_back[:, 2 * h :] *= r
            grads["gates"] += state.T @ d_back
            carried = d * z + d_back @ gates.T
            if fresh[t].any():
                carried = carried * ~fresh[t][:, None]
        flat, tokens = d_in.reshape(-1, 3 * h), before.reshape(-1)
        order = _order(tokens, len(self.weights["embedding"]))
        first = np.flatnonzero(np.diff(tokens[order], prepend=-1))
        by_token, own = np.add.reduceat(flat[order], first, axis=0), tokens[order][first]
        grads["embedding"][own] += by_token @ self.weights["into"].T
        grads["into"] += self.weights["embedding"][own].T @ by_token
        grads["bias"] += by_token.sum(axis=0)


class Adam:
    """Steps along gradients of a sum of log-probabilities, by their running mean over the root of their running square."""

    def __init__(self, rate: float = 0.01, keep: float = 0.9, keep_square: float = 0.99) -> None:
        self.rate, self.keep, self.keep_square, self.n = rate, keep, keep_square, 0
        self.mean: dict[str, np.ndarray] = {}
        self.square: dict[str, np.ndarray] = {}

    def step(self, weights: dict, grads: dict, tokens: int) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - self.keep_square**self.n) / (1 - self.keep**self.n)
        for k, g in grads.items():
            g /= max(1, tokens)
            m = self.mean.setdefault(k, np.zeros_like(g))
            s = self.square.setdefault(k, np.zeros_like(g))
            m += (1 - self.keep) * (g - m)
            s += (1 - self.keep_square) * (g * g - s)
            weights[k] += rate * m / (np.sqrt(s) + 1e-8)
