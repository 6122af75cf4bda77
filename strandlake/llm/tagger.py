"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters with an id of their own: printable ASCII; then letter, white space, other, padding.
ASCII = 95
LETTER, SPACE, OTHER, PAD = ASCII, ASCII + 1, ASCII + 2, ASCII + 3
SYMBOLS = ASCII + 4


def char_ids(text: str) -> np.ndarray:
    """A symbol for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ids = np.where((points >= 32) & (points < 127), points - 32, LETTER)
    if (points > 126).any() or (points < 32).any():
        for at in np.flatnonzero((points > 126) | (points < 32)):
            c = chr(points[at])
            ids[at] = SPACE if c.isspace() else LETTER if c.isalpha() else OTHER
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Emissions from two LSTMs, and a linear-chain CRF over the tags."""

    def __init__(self, tags: int, hidden: int = 24, width: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"embed": draw(SYMBOLS, width) * 2, "out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "step": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(width, 4 * hidden), f"u{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States over x (time, batch, symbols as projected input), forwards."""
        n, batch, _ = x.shape
        h, c = np.zeros((batch, self.hidden), np.float32), np.zeros((batch, self.hidden), np.float32)
        u, k, out, kept = self.p[f"u{d}"], self.hidden, [], []
        for t in range(n):
            z = x[t] + h @ u
            s = _sigmoid(z[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 3 * k :])
            new = f * c + i * g
            squashed = np.tanh(new)
            kept.append((h, c, i, f, o, g, squashed))
            h, c = o * squashed, new
            out.append(h)
        return np.stack(out), kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (batch, time, tags) of equally long rows of symbols."""
        e = self.p["embed"][ids.T]
        forward, kept_f = self._lstm(e @ self.p["wf"] + self.p["cf"], "f")
        backward, kept_b = self._lstm((e @ self.p["wb"] + self.p["cb"])[::-1], "b")
        both = np.concatenate((forward, backward[::-1]), axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2), (e, both, kept_f, kept_b)

    def _back_lstm(self, grad: np.ndarray, kept: list, d: str, e: np.ndarray, out: dict) -> np.ndarray:
        k, u = self.hidden, self.p[f"u{d}"]
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dz_all = np.empty((*grad.shape[:2], 4 * k), np.float32)
        du = np.zeros_like(u)
        for t in reversed(range(len(grad))):
            h, c, i, f, o, g, squashed = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)), axis=1)
            dz_all[t] = dz
            du += h.T @ dz
            dh, dc = dz @ u.T, dc * f
        out[f"u{d}"] = du
        flat = dz_all.reshape(-1, 4 * k)
        out[f"w{d}"], out[f"c{d}"] = e.reshape(-1, e.shape[2]).T @ flat, flat.sum(axis=0)
        return dz_all @ self.p[f"w{d}"].T

    def loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood a row, and its gradients."""
        scores, (e, both, kept_f, kept_b) = self.emissions(ids)
        rows, n, k = scores.shape
        step, first, last = self.p["step"], self.p["first"], self.p["last"]
        alpha, beta = np.empty((n, rows, k)), np.empty((n, rows, k))
        alpha[0] = first + scores[:, 0]
        for t in range(1, n):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + step, 1) + scores[:, t]
        beta[n - 1] = last
        for t in reversed(range(n - 1)):
            beta[t] = _logsum(step + (scores[:, t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[n - 1] + last, 1)
        share = np.exp(alpha + beta - total[:, None]).transpose(1, 0, 2)
        at = np.arange(rows)[:, None], np.arange(n)[None, :], gold
        value = total.sum() - scores[at].sum() - step[gold[:, :-1], gold[:, 1:]].sum() - first[gold[:, 0]].sum() - last[gold[:, -1]].sum()
        g: dict = {"step": np.zeros_like(step), "first": share[:, 0].sum(axis=0), "last": share[:, -1].sum(axis=0)}
        for t in range(n - 1):
            g["step"] += np.exp(alpha[t][:, :, None] + step + (scores[:, t + 1] + beta[t + 1] - total[:, None])[:, None, :]).sum(axis=0)
        np.add.at(g["step"], (gold[:, :-1], gold[:, 1:]), -1)
        np.add.at(g["first"], gold[:, 0], -1)
        np.add.at(g["last"], gold[:, -1], -1)
        share[at] -= 1
        back = share.transpose(1, 0, 2).astype(np.float32)
        g["out"], g["bias"] = both.reshape(n * rows, -1).T @ back.reshape(n * rows, k), back.sum(axis=(0, 1))
        down = back @ self.p["out"].T
        h = self.hidden
        de = self._back_lstm(down[:, :, :h], kept_f, "f", e, g) + self._back_lstm(down[::-1, :, h:], kept_b, "b", e[::-1], g)[::-1]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T, de)
        return value / rows, {name: x / rows for name, x in g.items()}

    def train(self, ids: np.ndarray, gold: np.ndarray, steps: int, batch: int = 32, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over random batches; the losses."""
        rng, first, second, losses = np.random.default_rng(seed), {}, {}, []
        for n in range(1, steps + 1):
            pick = rng.choice(len(ids), min(batch, len(ids)), replace=False)
            value, gradient = self.loss(ids[pick], gold[pick])
            losses.append(value)
            norm = np.sqrt(sum(float((x**2).sum()) for x in gradient.values()))
            now = rate * min(1.0, 2 * (1 - n / (steps + 1)))
            for name, x in gradient.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                first[name] = 0.9 * first.get(name, 0) + 0.1 * x
                second[name] = 0.99 * second.get(name, 0) + 0.01 * x * x
                self.p[name] -= (now * (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return losses

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """The tags of highest total score over (time, tags) emissions of any length."""
        found = Decoder(self)
        found.push(scores)
        return found.path()


class Decoder:
    """The tags of highest total score over emissions that come part by part; what it holds is a byte for each place and tag."""

    def __init__(self, model: Tagger):
        self.model, self.best, self.back = model, None, []

    def push(self, scores: np.ndarray) -> None:
        back = np.zeros(scores.shape, np.int8)
        for t, own in enumerate(scores):
            if self.best is None:
                self.best = self.model.p["first"] + own
                continue
            ways = self.best[:, None] + self.model.p["step"]
            back[t] = ways.argmax(axis=0)
            self.best = ways.max(axis=0) + own
        self.back.append(back)

    def path(self) -> np.ndarray:
        back = np.concatenate(self.back)
        path = np.empty(len(back), np.int8)
        tag = int((self.best + self.model.p["last"]).argmax())
        for t in range(len(back) - 1, -1, -1):
            path[t] = tag
            tag = back[t, tag]
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
