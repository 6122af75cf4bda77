"""State segmentation: k-means, Gaussian hidden Markov models, fragment-length digestion.

Training and decoding run over all rows on the executors; only sums and the
parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-4, seed: int = 12345) -> tuple[np.ndarray, float]:
    """(centres in ascending order, inertia) of the best of several runs of Lloyd's method with spread-out starts."""
    x = np.asarray(x, np.float64).reshape(len(x), -1)
    rng = np.random.RandomState(np.random.MT19937(np.random.SeedSequence(seed)))
    best: tuple[np.ndarray, float] | None = None
    limit = tolerance * x.var(axis=0).mean()
    for _ in range(starts):
        centres = x[[rng.randint(len(x))]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.randint(len(x))
            centres = np.concatenate((centres, x[[pick]]))
        for _ in range(rounds):
            own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            step = ((moved - centres) ** 2).sum()
            centres = moved
            if step <= limit:
                break
        inertia = float(((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
        if best is None or inertia < best[1]:
            best = centres, inertia
    centres, inertia = best
    return centres[np.lexsort(centres.T[::-1])], inertia


def weighted_points(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The distinct rows of ``features``, with the column n of how often each occurs."""
    return rows.groupBy(*features).agg(F.count("*").alias("n"))


def _nearest(points: DataFrame, features: Sequence[str], centres: np.ndarray) -> DataFrame:
    """Adds ``own``, the first of the nearest centres, and ``far``, the squared distance to it."""
    gaps = [sum(((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, c)), F.lit(0.0)) for c in centres]
    best = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    own = F.coalesce(*[F.when(g == best, F.lit(j)) for j, g in enumerate(gaps)])
    return points.withColumn("own", own).withColumn("far", best)


def _seeds(points: DataFrame, features: Sequence[str], k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, weights): oversampled seeding, a bounded number of points drawn together each round by weight and distance."""
    rng = np.random.RandomState(seed)
    unit = lambda: (F.pmod(F.xxhash64(*features, F.lit(int(rng.randint(1 << 30)))), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    first = points.orderBy(-F.log(unit()) / F.col("n"), *features).select(*features).first()
    chosen = np.array([list(first)], np.float64)
    for _ in range(rounds):
        near = _nearest(points, features, chosen)
        cost = near.agg(F.sum(F.col("n") * F.col("far"))).first()[0]
        if not cost:
            break
        drawn = near.where((F.col("far") > 0) & (unit() < F.col("n") * F.col("far") * (3 * k / cost))).select(*features).collect()
        if drawn:
            chosen = np.concatenate((chosen, np.array([list(r) for r in drawn], np.float64)))
    sizes = {r["own"]: r["n"] for r in _nearest(points, features, chosen).groupBy("own").agg(F.sum("n").alias("n")).collect()}
    return chosen, np.array([sizes.get(i, 0) for i in range(len(chosen))], np.float64)


def _spread_start(chosen: np.ndarray, weight: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """``k`` of the candidates, each drawn by its weight and its distance to those before it."""
    centres = [rng.choice(len(chosen), p=weight / weight.sum())]
    while len(centres) < k:
        far = weight * ((chosen[:, None] - chosen[centres][None]) ** 2).sum(axis=2).min(axis=1)
        centres.append(rng.choice(len(chosen), p=far / far.sum()) if far.sum() > 0 else centres[-1])
    return chosen[centres]


def _moved(points: DataFrame, features: Sequence[str], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, costs) after one round of every start at once: one pass over the points, partial sums by batch."""
    starts, k, size = centres.shape
    names = [f"s{i}" for i in range(size)]

    def run(batches):
        for pdf in batches:
            x, n = pdf[list(features)].to_numpy(np.float64), pdf["n"].to_numpy(np.float64)
            out = []
            for start in range(starts):
                gaps = ((x[:, None] - centres[start][None]) ** 2).sum(axis=2)
                own = gaps.argmin(axis=1)
                sums = [np.bincount(own, n * x[:, i], k) for i in range(size)]
                out.append(pd.DataFrame({"start": start, "own": range(k), "n": np.bincount(own, n, k), "cost": np.bincount(own, n * gaps[np.arange(len(x)), own], k), **dict(zip(names, sums))}))
            yield pd.concat(out)

    schema = "start int, own int, n double, cost double, " + ", ".join(f"{c} double" for c in names)
    parts = points.select("n", *features).mapInPandas(run, schema)
    moved, costs = centres.copy(), np.zeros(starts)
    for r in parts.groupBy("start", "own").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)]).collect():
        costs[r["start"]] += r["cost"]
        if r["n"]:
            moved[r["start"], r["own"]] = [r[c] / r["n"] for c in names]
    return moved, costs


def kmeans_rows(points: DataFrame, features: Sequence[str], k: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-4, seed: int = 12345) -> tuple[np.ndarray, float]:
    """``kmeans`` over all rows of a table of weighted points.

    All starts come from one oversampled set of seeds and move together: a
    round of every start is one pass over the points.
    """
    spread = points.agg(F.sum("n"), *[F.sum(F.col("n") * F.col(f)) / F.sum("n") for f in features], *[F.sum(F.col("n") * F.col(f) ** 2) / F.sum("n") for f in features]).first()
    if not spread[0]:
        return np.empty((0, len(features))), 0.0
    mean, square = np.array(spread[1 : len(features) + 1]), np.array(spread[len(features) + 1 :])
    limit = tolerance * float((square - mean**2).mean())
    chosen, weight = _seeds(points, features, k, 4, seed)
    rng = np.random.RandomState(seed)
    centres = np.array([_spread_start(chosen, weight, k, rng) for _ in range(starts)])
    open_ = np.arange(starts)
    for _ in range(rounds):
        moved, _ = _moved(points, features, centres[open_])
        steps = ((moved - centres[open_]) ** 2).sum(axis=(1, 2))
        centres[open_] = moved
        open_ = open_[steps > limit]
        if not len(open_):
            break
    _, costs = _moved(points, features, centres)
    best = centres[costs.argmin()]
    return best[np.lexsort(best.T[::-1])], float(costs.min())


@dataclass
class GaussianHmm:
    """Start and transition probabilities, means and full covariances of the states."""

    start: np.ndarray
    step: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row under each state."""
        out = np.empty((len(x), len(self.means)))
        for j, (m, c) in enumerate(zip(self.means, self.covariances)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, j] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def _forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dens = self.log_density(x)
        with np.errstate(divide="ignore"):
            step, first = np.log(self.step), np.log(self.start)
        a, b = np.empty_like(dens), np.zeros_like(dens)
        a[0] = first + dens[0]
        for t in range(1, len(x)):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + step, axis=0) + dens[t]
        for t in reversed(range(len(x) - 1)):
            b[t] = np.logaddexp.reduce(step + dens[t + 1] + b[t + 1], axis=1)
        return a, b, dens

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """State probabilities of each row of one sequence given the whole of it."""
        a, b, _ = self._forward_backward(np.asarray(x, np.float64))
        total = a + b
        return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])

    def fit(self, sequences: Sequence[np.ndarray], rounds: int = 20, floor: float = 1e-3) -> GaussianHmm:
        """Expectation maximisation over independent sequences; changes the model and returns it."""
        for _ in range(rounds):
            starts, moves = np.zeros_like(self.start), np.zeros_like(self.step)
            gammas, rows = [], []
            for x in sequences:
                a, b, dens = self._forward_backward(x)
                with np.errstate(divide="ignore"):
                    step = np.log(self.step)
                whole = np.logaddexp.reduce(a[-1])
                g = np.exp(a + b - whole)
                starts += g[0]
                for t in range(len(x) - 1):
                    moves += np.exp(a[t][:, None] + step + dens[t + 1] + b[t + 1] - whole)
                gammas.append(g)
                rows.append(x)
            g, x = np.concatenate(gammas), np.concatenate(rows)
            weight = g.sum(axis=0) + 1e-12
            self.start, self.step = starts / starts.sum(), (moves + 1e-12) / (moves + 1e-12).sum(axis=1, keepdims=True)
            self.means = (g.T @ x) / weight[:, None]
            self.covariances = np.array([((x - m).T * g[:, j]) @ (x - m) / weight[j] + floor * np.eye(x.shape[1]) for j, m in enumerate(self.means)])
        return self

    @classmethod
    def from_kmeans(cls, x: np.ndarray, k: int = 3, seed: int = 12345) -> GaussianHmm:
        """A model whose states are the clusters of the rows."""
        centres, _ = kmeans(x, k, seed=seed)
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        size = x.shape[1]
        covariances = np.array([(np.cov(x[own == j].T).reshape(size, size) if (own == j).sum() > size else np.eye(size)) + 1e-3 * np.eye(size) for j in range(k)])
        step = np.full((k, k), 0.1 / max(1, k - 1))
        np.fill_diagonal(step, 0.9)
        return cls(np.full(k, 1 / k), step, centres, covariances)


def _start_model(points: DataFrame, features: Sequence[str], k: int) -> GaussianHmm:
    """``GaussianHmm.from_kmeans`` over weighted points."""
    size = len(features)
    centres, _ = kmeans_rows(points, features, k)
    sums = [F.sum(F.col("n") * F.col(f)).alias(f"s{i}") for i, f in enumerate(features)]
    squares = [F.sum(F.col("n") * F.col(f) * F.col(g)).alias(f"q{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features)]
    found = {r["own"]: r for r in _nearest(points, features, centres).groupBy("own").agg(F.sum("n").alias("n"), *sums, *squares).collect()}
    covariances = np.array([np.eye(size)] * k)
    for own, r in found.items():
        if r["n"] > size:
            mean = np.array([r[f"s{i}"] for i in range(size)]) / r["n"]
            square = np.array([[r[f"q{i}_{j}"] for j in range(size)] for i in range(size)])
            covariances[own] = (square - r["n"] * np.outer(mean, mean)) / (r["n"] - 1)
    step = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(step, 0.9)
    return GaussianHmm(np.full(k, 1 / k), step, centres, covariances + 1e-3 * np.eye(size))


#: Coordinates of a block of a sequence, and blocks that are put together at once.
BLOCK, FAN = 1 << 17, 1024


def _times(left: np.ndarray, right: np.ndarray, best: bool = False) -> np.ndarray:
    """The product of two matrices of logarithms: sums of probabilities, or with ``best`` the largest."""
    both = left[..., :, :, None] + right[..., None, :, :]
    return both.max(axis=-2) if best else np.logaddexp.reduce(both, axis=-2)


def _logs(model: GaussianHmm) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(model.step), np.log(model.start)


def _flat(x: np.ndarray) -> list[float]:
    return np.asarray(x, np.float64).ravel().tolist()


ELEMENT = "first array<double>, rest array<double>"
#: The vectors at a block's two ends; a sequence's first block is entered by none.
BORDER = "into array<double>, after array<double>"


def _element(model: GaussianHmm, x: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a block does to the vector of states before it: the densities of its first row, and the product of the matrices of its other rows."""
    step, _ = _logs(model)
    dens = model.log_density(x)
    rest = np.where(np.eye(len(step), dtype=bool), 0.0, -np.inf)
    for row in dens[1:]:
        rest = _times(rest, step + row, best)
    return dens[0], rest - max(0.0, rest.max()) if np.isfinite(rest.max()) else rest


def _joined(step: np.ndarray, elements: list[tuple[np.ndarray, np.ndarray]], best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring blocks as one."""
    first, rest = elements[0]
    for dens, more in elements[1:]:
        rest = _times(_times(rest, step + dens, best), more, best)
        rest = rest - rest.max() if np.isfinite(rest.max()) else rest
    return first, rest


def _walk(step: np.ndarray, start: np.ndarray, elements: list[tuple[np.ndarray, np.ndarray]], into: np.ndarray | None, after: np.ndarray, best: bool) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """The vectors at the ends of each of some neighbouring blocks, from those at the ends of all of them."""
    vector, ahead = (lambda v, m: _times(v[None], m, best)[0]), (lambda m, v: _times(m, v[:, None], best)[:, 0])
    before: list[np.ndarray | None] = []
    for dens, rest in elements:
        before.append(into)
        into = vector((start if into is None else vector(into, step)) + dens, rest)
        into = into - into.max()
    behind = [after]
    for dens, rest in reversed(elements[1:]):
        after = ahead(step, dens + ahead(rest, after))
        after = after - after.max()
        behind.append(after)
    return list(zip(before, reversed(behind)))


def _borders(elements: DataFrame, model: GaussianHmm, sequence: str, best: bool) -> DataFrame:
    """(sequence, _block, into, after) of the blocks (sequence, _block, first, rest): a prefix product over blocks from both sides.

    More than ``FAN`` blocks are put together ``FAN`` at a time, and the larger blocks walked first.
    """
    k = len(model.start)
    step, start = _logs(model)
    kind = elements.schema[sequence].dataType.simpleString()
    unpack = lambda pdf: [(np.array(a), np.array(b).reshape(k, k)) for a, b in zip(pdf["first"], pdf["rest"])]
    names = [sequence, "_block", "into", "after"]

    def table(pdf, into, after):
        found = _walk(step, start, unpack(pdf), into, after, best)
        return pd.DataFrame({sequence: pdf[sequence], "_block": pdf["_block"], "into": [None if a is None else _flat(a) for a, _ in found], "after": [_flat(b) for _, b in found]})[names]

    schema = f"{sequence} {kind}, _block long, {BORDER}"
    if (elements.groupBy(sequence).count().agg(F.max("count")).first()[0] or 0) <= FAN:
        return elements.groupBy(sequence).applyInPandas(lambda pdf: table(pdf.sort_values("_block"), None, np.zeros(k)), schema)
    placed = elements.withColumn("_wide", F.floor(F.col("_block") / FAN))

    def join(pdf):
        pdf = pdf.sort_values("_block")
        first, rest = _joined(step, unpack(pdf), best)
        return pd.DataFrame({sequence: pdf[sequence].iloc[:1], "_block": pdf["_wide"].iloc[:1], "first": [_flat(first)], "rest": [_flat(rest)]})

    wide = stored(placed.groupBy(sequence, "_wide").applyInPandas(join, f"{sequence} {kind}, _block long, {ELEMENT}"), "state-blocks")
    ends = _borders(wide, model, sequence, best).withColumnRenamed("_block", "_wide")

    def narrow(pdf, own):
        into = own["into"].iloc[0]
        return table(pdf.sort_values("_block"), None if into is None else np.array(into), np.array(own["after"].iloc[0]))

    return placed.groupBy(sequence, "_wide").cogroup(ends.groupBy(sequence, "_wide")).applyInPandas(narrow, schema)


def _by_block(rows: DataFrame, model: GaussianHmm, sequence: str, position: str, features: Sequence[str], work, schema: str, block: int, best: bool = False) -> DataFrame:
    """``work(rows of a block in order, densities, vector before or None, vector after)`` for each block of each whole sequence."""
    kind = rows.schema[sequence].dataType.simpleString()
    placed = rows.withColumn("_block", F.floor(F.col(position) / block))

    def element(pdf):
        pdf = pdf.sort_values(position)
        first, rest = _element(model, pdf[list(features)].to_numpy(np.float64), best)
        return pd.DataFrame({sequence: pdf[sequence].iloc[:1], "_block": pdf["_block"].iloc[:1], "first": [_flat(first)], "rest": [_flat(rest)]})

    elements = stored(placed.groupBy(sequence, "_block").applyInPandas(element, f"{sequence} {kind}, _block long, {ELEMENT}"), "state-elements")
    ends = _borders(elements, model, sequence, best)

    def local(pdf, own):
        pdf = pdf.sort_values(position)
        into = own["into"].iloc[0]
        return work(pdf, model.log_density(pdf[list(features)].to_numpy(np.float64)), None if into is None else np.array(into), np.array(own["after"].iloc[0]))

    return placed.groupBy(sequence, "_block").cogroup(ends.groupBy(sequence, "_block")).applyInPandas(local, schema)


def _inside(model: GaussianHmm, dens: np.ndarray, into: np.ndarray | None, after: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors of a block's rows, from the vectors at its ends."""
    step, start = _logs(model)
    fold = np.max if best else np.logaddexp.reduce
    a, b = np.empty_like(dens), np.empty_like(dens)
    a[0] = (start if into is None else fold(into[:, None] + step, axis=0)) + dens[0]
    for t in range(1, len(dens)):
        a[t] = fold(a[t - 1][:, None] + step, axis=0) + dens[t]
    b[-1] = after
    for t in reversed(range(len(dens) - 1)):
        b[t] = fold(step + dens[t + 1] + b[t + 1], axis=1)
    return a, b


def fit_rows(rows: DataFrame, points: DataFrame, sequence: str, position: str, features: Sequence[str], k: int = 3, rounds: int = 20, floor: float = 1e-3, block: int = BLOCK) -> GaussianHmm:
    """``GaussianHmm.fit`` over the whole sequences of a table, from the clusters of its weighted points.

    A round is a product of matrices by block, a prefix product over the blocks,
    and one aggregate of sums; no sequence is cut or held as a whole.
    """
    size = len(features)
    model = _start_model(points, features, k)
    for _ in range(rounds):
        own = model
        step, _ = _logs(own)

        def sums(pdf, dens, into, after, own=own, step=step):
            x = pdf[list(features)].to_numpy(np.float64)
            a, b = _inside(own, dens, into, after)
            g = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1)[:, None])
            before, ahead = (a[:-1], (dens + b)[1:]) if into is None else (np.concatenate((into[None], a[:-1])), dens + b)
            pairs = before[:, :, None] + step[None] + ahead[:, None, :]
            whole = np.logaddexp.reduce(pairs.reshape(len(pairs), -1), axis=1) if len(pairs) else np.empty(0)
            moves = np.exp(pairs - whole[:, None, None]).sum(axis=0)
            off = x[:, None] - own.means[None]
            first = g[0] if into is None else np.zeros(k)
            flat = np.concatenate((first, moves.ravel(), g.sum(axis=0), np.einsum("tj,tjd->jd", g, off).ravel(), np.einsum("tj,tjd,tje->jde", g, off, off).ravel()))
            return pd.DataFrame({"at": range(len(flat)), "x": flat})

        parts = _by_block(rows.select(sequence, position, *features), own, sequence, position, features, sums, "at int, x double", block)
        flat = np.array([r["x"] for r in sorted(parts.groupBy("at").agg(F.sum("x").alias("x")).collect(), key=lambda r: r["at"])])
        if not len(flat):
            break
        starts, moves, weight, first, second = np.split(flat, np.cumsum([k, k * k, k, k * size]))
        weight, moves = weight + 1e-12, moves.reshape(k, k) + 1e-12
        shift = first.reshape(k, size) / weight[:, None]
        covariances = second.reshape(k, size, size) / weight[:, None, None] - np.einsum("jd,je->jde", shift, shift) + floor * np.eye(size)
        model = GaussianHmm(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), model.means + shift, covariances)
    return model


def decode(rows: DataFrame, model: GaussianHmm, sequence: str, position: str, features: Sequence[str], block: int = BLOCK, best: bool = False) -> DataFrame:
    """(sequence, position, state, posteriors) of every row given the whole of its sequence, in order of position.

    A sequence is spread over blocks of ``block`` coordinates: each block's product of transfer
    matrices, a prefix product over the blocks from both sides, and a pass
    within each block.  The blocks' size does not change the result.  With
    ``best`` the states are those of the likeliest path and ``posteriors`` are
    the log scores of the best path through each state, less the best of all.
    """
    keep = [sequence, position]

    def work(pdf, dens, into, after):
        a, b = _inside(model, dens, into, after, best)
        total = a + b
        p = total - total.max(axis=1)[:, None] if best else np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
        return pd.DataFrame({sequence: pdf[sequence], position: pdf[position], "state": p.argmax(axis=1).astype(np.int32), "posteriors": list(p)})

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", state int, posteriors array<double>"
    return _by_block(rows.select(*keep, *features), model, sequence, position, features, work, schema, block, best)


#: Mean and spread of fragment lengths in each component: nucleosome-free, one, two, three nucleosomes.
COMPONENTS = ((50.0, 20.0), (200.0, 20.0), (400.0, 20.0), (600.0, 20.0))


#: Bins of fragment lengths that the driver holds at most; shorter lengths than this are bins of their own.
LENGTHS = 1 << 20


def length_mixture(fragments: DataFrame, components: Sequence[tuple[float, ...]] = COMPONENTS, rounds: int = 500, narrowest: float = 0.5, lengths: int = LENGTHS) -> list[tuple[float, float, float]]:
    """(mean, spread, share) of each length component: a mixture of normal densities fitted by expectation maximisation.

    Begins from ``components`` with equal shares and stops where the likelihood no longer rises; the order of the components is kept.
    Every fragment (left, right, and n, one where it is not given) counts, by
    one aggregate over lengths.  Where the longest fragment has over ``lengths`` bases, lengths are put
    together in stretches of a power of two, at most ``lengths`` of them, each at its own mean.  Spreads are
    at least ``narrowest``.  Without fragments the components come back as they are.
    """
    n = F.col("n") if "n" in fragments.columns else F.lit(1).cast("long")
    sizes = fragments.where("right > left").select((F.col("right") - F.col("left")).cast("long").alias("length"), n.alias("n")).groupBy("length").agg(F.sum("n").alias("n"))
    longest = sizes.agg(F.max("length")).first()[0]
    start = [(float(c[0]), float(c[1]), 1 / len(components)) for c in components]
    if longest is None:
        return start
    width = 1
    while longest // width >= lengths:
        width *= 2
    found = sizes.groupBy(F.floor(F.col("length") / width).alias("at")).agg((F.sum(F.col("length") * F.col("n").cast("double")) / F.sum("n")).alias("x"), F.sum("n").cast("double").alias("n")).orderBy("at").toPandas()
    return fit_mixture(found["x"].to_numpy(), found["n"].to_numpy(), start, rounds, narrowest)


def fit_mixture(x: np.ndarray, n: np.ndarray, start: Sequence[tuple[float, float, float]], rounds: int = 500, narrowest: float = 0.5) -> list[tuple[float, float, float]]:
    """(mean, spread, share) of normal components over values ``x`` that occur ``n`` times."""
    mean, spread, share = (np.array(v, np.float64) for v in zip(*start))
    before = -np.inf
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            logs = np.log(share) - np.log(spread) - 0.5 * ((x[:, None] - mean) / spread) ** 2
        whole = np.logaddexp.reduce(logs, axis=1)
        likely = float(n @ whole)
        if likely - before <= 1e-9 * abs(likely):
            break
        before = likely
        own = np.exp(logs - whole[:, None]) * n[:, None]
        weight = own.sum(axis=0)
        share = weight / weight.sum()
        held = weight > 1e-9 * weight.sum()
        safe = np.where(held, weight, 1.0)
        mean = np.where(held, (own * x[:, None]).sum(axis=0) / safe, mean)
        spread = np.where(held, np.maximum(narrowest, np.sqrt((own * (x[:, None] - mean) ** 2).sum(axis=0) / safe)), spread)
    return [(float(m), float(s), float(w)) for m, s, w in zip(mean, spread, share)]


def digested(fragments: DataFrame, components: Sequence[tuple[float, ...]] = COMPONENTS) -> DataFrame:
    """Fragments with the weights w0, w1, ... of the length components, normal densities that sum to one.

    A component is a mean and a spread, and its share of the fragments where that is known.
    """
    length = F.col("right") - F.col("left")
    logs = [-((length - F.lit(c[0])) ** 2) / F.lit(2 * c[1] * c[1]) - F.log(F.lit(c[1])) + F.lit(float(np.log(max(c[2], 1e-300))) if len(c) > 2 else 0.0) for c in components]
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    total = sum(parts[1:], parts[0])
    return fragments.select("*", *[(p / total).alias(f"w{i}") for i, p in enumerate(parts)])
