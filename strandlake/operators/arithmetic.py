"""Track arithmetic: what two tracks give, base by base, on their union of breakpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fold_enrichment, log_likelihood_ratio, symmetric_log_likelihood_ratio
from . import scoring, tracks

METHODS: dict[str, Callable[[Column, Column], Column]] = {
    "subtract": lambda a, b: a - b,
    "add": lambda a, b: a + b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b != 0, a / b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "mean": lambda a, b: (a + b) / 2,
    "fe": fold_enrichment,
    "logfe": lambda a, b: F.log10(fold_enrichment(a, b)),
    "loglr": log_likelihood_ratio,
    "slogllr": symmetric_log_likelihood_ratio,
}


def compare(treat: DataFrame, control: DataFrame, method: str) -> DataFrame:
    """(chrom, start, end, value) of a method by name; 'ppois' and 'qpois' are the Poisson scores."""
    if method in METHODS:
        return tracks.compare(treat, control, METHODS[method])
    runs = tracks.align({"treat": treat, "lambda": control})
    scored = scoring.with_poisson(runs)
    if method == "qpois":
        scored = scoring.with_q(scored)
    elif method != "ppois":
        raise ValueError(f"no such method: {method}")
    return tracks.compact(scored.select("chrom", "start", "end", F.col("p" if method == "ppois" else "q").alias("value")))


def combine(replicates: list[DataFrame], method: str) -> DataFrame:
    """One track out of several: 'max', 'min', 'mean' or 'sum' of all of them, base by base."""
    names = [f"r{i}" for i in range(len(replicates))]
    runs = tracks.align(dict(zip(names, replicates)))
    columns = [F.col(n) for n in names]
    total = sum(columns[1:], columns[0])
    value = {"max": F.greatest(*columns) if len(columns) > 1 else columns[0], "min": F.least(*columns) if len(columns) > 1 else columns[0], "mean": total / len(columns), "sum": total}[method]
    return tracks.compact(runs.select("chrom", "start", "end", value.alias("value")))


def transform(track: DataFrame, method: str, amount: float) -> DataFrame:
    """A track with its values multiplied, added to, raised, or cut to at most or at least ``amount``."""
    v, x = F.col("value"), F.lit(float(amount))
    value = {"multiply": v * x, "add": v + x, "pow": F.pow(v, x), "at_most": F.least(v, x), "at_least": F.greatest(v, x)}[method]
    return tracks.compact(track.select("chrom", "start", "end", value.alias("value")))
