"""A gated recurrent language model over output ids, in numpy.

Outputs are ordered by frequency and cut into classes of equal size; the
probability of an output is that of its class times that within the class.
Before training the biases make it the unigram model of the counts.

Texts run in lanes: each lane is a sequence of whole texts, the state starts
anew at a text's first output and is carried from window to window, so a text's
log-likelihood is complete however long it is.  Lanes have lengths of their own
and a window is laid out only for those that reach it, so memory follows the
number of outputs, not the longest text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Hidden units, and width of the embeddings.
HIDDEN = 24
F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; what is too large to be raised to a power is 0 or 1."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gates(w: np.ndarray) -> np.ndarray:
    """The columns of each gate and of the new state, one after the other."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))


def _columns(w: np.ndarray) -> np.ndarray:
    """What ``_gates`` was made of."""
    return w.transpose(1, 0, 2).reshape(w.shape[1], -1)


def _chosen(h: np.ndarray, w: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(powers of e of the scores ``h @ w`` row by row, their sums, the scores at ``own``), all less a row's highest score where sums would overflow or vanish."""
    s = np.matmul(h, w).reshape(-1, w.shape[-1])
    picked = s[np.arange(len(s)), own].astype(np.float64)
    ones = np.ones(s.shape[1], s.dtype)
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
        total = s @ ones
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e30):
        s = np.matmul(h, w).reshape(-1, w.shape[-1])
        top = s.max(axis=1)
        s -= top[:, None]
        picked -= top
        np.exp(s, out=s)
        total = s @ ones
    return s, total, picked


def lanes(texts: list[np.ndarray], count: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, the longest text first; the longest lane comes first."""
    heap = [(0, k) for k in range(min(count, len(texts)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        load, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (load + len(texts[i]), k))
    return sorted(out, key=lambda lane: -sum(len(texts[i]) for i in lane))


class Lanes:
    """Texts (one output each at least) end to end, lane after lane, and the windows over them."""

    def __init__(self, texts: list[np.ndarray], count: int):
        dealt = lanes(texts, count)
        self.order = [i for lane in dealt for i in lane]
        sizes = np.array([len(texts[i]) for i in self.order], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.flat = np.concatenate([texts[i] for i in self.order])
        self.goes_on = np.ones(len(self.flat), bool)
        self.goes_on[self.starts] = False
        self.lengths = np.array([sum(len(texts[i]) for i in lane) for lane in dealt], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``flat``, which of them are real, places before them) of each window, as (time, lane) tables of the lanes left."""
        for at in range(0, int(self.lengths[0]), window):
            left = int(np.searchsorted(-self.lengths, -at))
            steps = min(window, int(self.lengths[0]) - at)
            time = at + np.arange(steps)[:, None]
            real = time < self.lengths[None, :left]
            yield np.where(real, self.begins[None, :left] + time, 0), real, np.where(real, self.begins[None, :left] + time - 1, 0)


class Gru:
    """Parameters of the network, its windows forwards and backwards, and Adam."""

    NAMES = ("embed", "wx", "bx", "u", "wc", "bc", "wo", "bo")

    def __init__(self, frequencies: np.ndarray, classes: int, hidden: int = HIDDEN, seed: int = 17):
        rng = np.random.default_rng(seed)
        size = -(-len(frequencies) // classes)
        mass = np.full(classes * size, 1e-9)
        mass[: len(frequencies)] = (frequencies + 1) / (frequencies + 1).sum()
        mass = mass.reshape(classes, size)
        draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(F32)
        self.hidden, self.classes, self.size = hidden, classes, size
        self.p = {
            "embed": draw(0.3, classes * size, hidden),
            "wx": draw(hidden**-0.5, hidden, 3 * hidden),
            "bx": np.zeros(3 * hidden, F32),
            "u": draw(hidden**-0.5, hidden, 3 * hidden),
            "wc": draw(0.1, hidden, classes),
            "bc": np.log(mass.sum(axis=1)).astype(F32),
            "wo": draw(0.1, classes * size, hidden),
            "bo": np.log(mass / mass.sum(axis=1, keepdims=True)).astype(F32).ravel(),
        }

    def copy(self) -> Gru:
        """A network of its own with the same parameters."""
        other = Gru.__new__(Gru)
        other.hidden, other.classes, other.size = self.hidden, self.classes, self.size
        other.p = {name: v.copy() for name, v in self.p.items()}
        return other

    def flat(self) -> np.ndarray:
        """All parameters end to end."""
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            self.p[n] = flat[at : at + self.p[n].size].reshape(self.p[n].shape).astype(F32)
            at += self.p[n].size

    def states(self, x: np.ndarray, goes_on: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of a window, each the one that its output is predicted from.

        ``x`` is the projected input that leads to each state, the output before, as (gate, time, lane, unit).
        ``keep`` gets the states before, the gates, and the two parts of the new state.
        """
        k, u = self.hidden, _gates(self.p["u"])
        steps = x.shape[1]
        out = np.empty((steps, *h.shape), F32)
        before, gates = (np.empty_like(out), np.empty((2, *out.shape), F32)) if keep is not None else (None, None)
        inner, new = (np.empty_like(out), np.empty_like(out)) if keep is not None else (None, None)
        a = np.empty((3, len(h), k), F32)
        with np.errstate(over="ignore"):
            for t, whole in enumerate(goes_on.all(axis=1).tolist()):
                if not whole:
                    h = h * goes_on[t][:, None]
                np.matmul(h, u, out=a)
                g = a[:2]
                g += x[:2, t]
                _sigmoid(g)
                c = g[1] * a[2]
                c += x[2, t]
                np.tanh(c, out=c)
                if keep is not None:
                    before[t], gates[:, t], inner[t], new[t] = h, g, a[2], c
                h = np.subtract(h, c, out=out[t])
                h *= g[0]
                h += c
        if keep is not None:
            keep += [before, gates, inner, new]
        return out

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of outputs ``y`` after states ``h``; with ``grads``, also the states' gradient."""
        p, k, size = self.p, self.hidden, self.size
        kind = (y // size).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        own = y[order] - kind * size
        ones = np.empty((len(y), k + 1), F32)  # states with a one for the bias
        ones[:, :k], ones[:, k] = h[order], 1
        inner = np.concatenate((p["wo"], p["bo"][:, None]), axis=1)
        scores, total, logp = _chosen(ones, np.concatenate((p["wc"], p["bc"][None, :])), kind)
        down = None
        if grads is not None:
            scores *= np.reciprocal(total)[:, None]
            scores[np.arange(len(y)), kind] -= 1
            g = ones.T @ scores
            grads["wc"], grads["bc"] = g[:k], g[k]
            grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
            down = scores @ p["wc"].T
        edges = np.searchsorted(kind, np.arange(self.classes + 1))
        counts = np.diff(edges)
        weights = inner.reshape(self.classes, size, k + 1)
        within = np.empty(len(y), F32)
        # while training windows are short: classes go by frequency, so twice as many at a time have about equally many rows, and are filled up to the most
        low = 0
        while low < self.classes:
            high = low + 1 if grads is None else min(self.classes, max(low + 1, 2 * low))
            most = int(counts[low:high].max())
            if most and high == low + 1:
                rows = slice(int(edges[low]), int(edges[high]))
                s, within[rows], picked = _chosen(ones[rows], weights[low].T, own[rows])
                logp[rows] += picked
                if grads is not None:
                    s *= np.reciprocal(within[rows])[:, None]
                    s[np.arange(most), own[rows]] -= 1
                    g = s.T @ ones[rows]
                    grads["wo"][low * size : high * size], grads["bo"][low * size : high * size] = g[:, :k], g[:, k]
                    down[rows] += s @ weights[low, :, :k]
            elif most:
                real = np.arange(most) < counts[low:high, None]
                at = np.where(real, edges[low:high, None] + np.arange(most), 0)
                hc, real, flat = ones[at], real.ravel(), at.ravel()
                s, sums, picked = _chosen(hc, weights[low:high].transpose(0, 2, 1), own[flat])
                rows = flat[real]
                within[rows] = sums[real]
                logp[rows] += picked[real]
                s *= (real / sums).astype(F32)[:, None]
                s[np.arange(len(flat)), own[flat]] -= real
                s = s.reshape(high - low, most, size)
                g = np.matmul(s.transpose(0, 2, 1), hc).reshape(-1, k + 1)
                grads["wo"][low * size : high * size], grads["bo"][low * size : high * size] = g[:, :k], g[:, k]
                down[rows] += np.matmul(s, weights[low:high, :, :k]).reshape(-1, k)[real]
            low = high
        logp -= np.log(total)
        logp -= np.log(within)
        back = np.empty_like(order)
        back[order] = np.arange(len(y))
        return logp[back], down[back] if down is not None else None

    def log_likelihoods(self, texts: list[np.ndarray], width: int = 256, window: int = 64) -> np.ndarray:
        """Natural log-probability of each whole text."""
        if not texts:
            return np.empty(0)
        laid = Lanes(texts, width)
        bias = self.p["bx"].reshape(3, 1, -1)
        table = (np.matmul(self.p["embed"], _gates(self.p["wx"])) + bias).astype(F32)
        logp = np.zeros(len(laid.flat), F32)
        h = np.zeros((len(laid.lengths), self.hidden), F32)
        for at, real, before in laid.windows(window):
            on = laid.goes_on[at] | ~real
            x = table[:, laid.flat[before]]
            if not on.all():
                x[:, ~on] = bias
            out = self.states(x, on, h[: at.shape[1]])
            h = out[-1]
            logp[at[real]] = self.outputs(out[real], laid.flat[at[real]])[0]
        result = np.empty(len(texts))
        result[laid.order] = np.add.reduceat(logp, laid.starts, dtype=np.float64)
        return result

    def window_loss(self, inputs: np.ndarray, y: np.ndarray, goes_on: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss an output, gradients truncated at the window's start, and the state after it."""
        p, k, kept, g = self.p, self.hidden, [], {}
        on = goes_on.astype(F32)
        e = np.empty((inputs.size, k + 1), F32)  # inputs with a one for the bias
        np.multiply(p["embed"][inputs.ravel()], on.reshape(-1, 1), out=e[:, :k])
        e[:, k] = 1
        x = np.matmul(e, _gates(np.concatenate((p["wx"], p["bx"][None, :]))))
        out = self.states(x.reshape(3, *y.shape, k), goes_on, h, kept)
        real = y >= 0
        whole = bool(real.all())
        logp, down = self.outputs(out.reshape(-1, k), y.ravel(), g) if whole else self.outputs(out[real], y[real], g)
        if whole:
            grad = down.reshape(out.shape)
        else:
            grad = np.zeros_like(out)
            grad[real] = down
        before, gates, inner, new = kept
        z, r = gates
        rest = 1 - z
        to_z = before - new
        to_z *= z
        to_z *= rest
        to_new = new * new
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        to_r = 1 - r
        to_r *= r
        to_r *= inner
        dx, scaled = np.empty((3, *y.shape, k), F32), np.empty((*y.shape, k), F32)  # ``scaled`` is what the state before's share of the new state gets
        back, pulled = _gates(p["u"]).transpose(0, 2, 1).copy(), np.empty((3, len(h), k), F32)
        dh = np.zeros_like(h)
        goes = goes_on.all(axis=1).tolist()
        for t in reversed(range(len(y))):
            dh += grad[t]
            dn = np.multiply(dh, to_new[t], out=dx[2, t])
            np.multiply(dh, to_z[t], out=dx[0, t])
            np.multiply(dn, to_r[t], out=dx[1, t])
            np.multiply(dn, r[t], out=scaled[t])
            dh *= z[t]
            np.matmul(dx[:2, t], back[:2], out=pulled[:2])
            np.matmul(scaled[t], back[2], out=pulled[2])
            dh += pulled[0]
            dh += pulled[1]
            dh += pulled[2]
            if not goes[t]:
                dh *= on[t][:, None]
        flat = dx.reshape(3, -1, k)
        turned = before.reshape(-1, k).T
        g["u"] = _columns(np.stack((turned @ flat[0], turned @ flat[1], turned @ scaled.reshape(-1, k))))
        both = _columns(np.matmul(e.T, flat))
        g["wx"], g["bx"] = both[:k], both[k]
        wx = _gates(p["wx"])
        de = flat[0] @ wx[0].T
        de += flat[1] @ wx[1].T
        de += flat[2] @ wx[2].T
        de *= on.reshape(-1, 1)
        g["embed"] = np.zeros_like(p["embed"])
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        g["embed"][ids[first]] = np.add.reduceat(de[order], first, axis=0)
        n = max(1, len(logp))
        return -float(logp.sum()) / n, {name: v / n for name, v in g.items()}, out[-1]

    def train(self, texts: list[np.ndarray], rate: float, width: int = 64, window: int = 32) -> list[float]:
        """One pass of truncated backpropagation over the texts with Adam; the losses."""
        if not texts:
            return []
        laid = Lanes(texts, width)
        h = np.zeros((len(laid.lengths), self.hidden), F32)
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        losses = []
        for n, (at, real, before) in enumerate(laid.windows(window), 1):
            value, g, h = self.window_loss(laid.flat[before], np.where(real, laid.flat[at], -1), laid.goes_on[at] | ~real, h[: at.shape[1]])
            losses.append(value)
            norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
            cut = min(1.0, 1.0 / (norm + 1e-9))
            warm = rate * min(1.0, n / 20)
            a, b = warm / (1 - 0.9**n), 1 / (1 - 0.99**n)
            for name, v in g.items():
                m, s = first[name], second[name]
                v *= F32(cut)
                m += F32(0.1) * (v - m)
                v *= v
                s += F32(0.01) * (v - s)
                step = np.sqrt(s * F32(b))
                step += F32(1e-6)
                np.divide(m, step, out=step)
                step *= F32(a)
                self.p[name] -= step
        return losses
