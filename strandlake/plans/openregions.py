"""Open regions as one plan: fragment lengths digested into tracks, clusters, hidden states, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions, states
from ..operators.tracks import sweep
from .scratch import stored

#: Weights are counted in millionths, so that sums do not depend on their order.
MILLION = 1_000_000


def digested_signal(fragments: DataFrame, components: Sequence[tuple[float, ...]] = states.COMPONENTS, step: int = 10) -> DataFrame:
    """(chrom, bin, s0, s1, ...): the mean coverage of each length component in bins of ``step`` bases that any fragment (chrom, left, right, n) touches.

    A fragment's bases in each bin are constant between its first and its last
    bin, so it is four changes along the bins, however long it is, and one sweep
    sums them.
    """
    names = [f"s{i}" for i in range(len(components))]
    parts = states.digested(fragments.where("right > left"), components)
    parts = parts.withColumn("a", F.floor(F.col("left") / step)).withColumn("b", F.floor((F.col("right") - 1) / step))
    inside = lambda at: F.least("right", (at + 1) * step) - F.greatest("left", at * step)
    one = F.col("a") == F.col("b")
    change = lambda pos, bases, touch: F.struct(pos.alias("pos"), bases.cast("long").alias("bases"), F.lit(touch).cast("long").alias("touch"))
    short = F.array(change(F.col("a"), inside(F.col("a")), 1), change(F.col("a") + 1, -inside(F.col("a")), -1))
    long = F.array(change(F.col("a"), inside(F.col("a")), 1), change(F.col("a") + 1, step - inside(F.col("a")), 0), change(F.col("b"), inside(F.col("b")) - step, 0), change(F.col("b") + 1, -inside(F.col("b")), -1))
    events = parts.withColumn("e", F.explode(F.when(one, short).otherwise(long)))
    weights = [(F.round(F.col(f"w{i}") * MILLION).cast("long") * F.col("n") * F.col("e.bases")).alias(s) for i, s in enumerate(names)]
    runs = sweep(events.select("chrom", "e.pos", (F.col("n") * F.col("e.touch")).alias("touch"), *weights), ["touch", *names])
    bins = runs.where("touch > 0").withColumn("bin", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    return bins.select("chrom", "bin", *[(F.col(s) / (MILLION * step)).alias(s) for s in names])


def open_regions(
    fragments: DataFrame,
    components: Sequence[tuple[float, ...]] = states.COMPONENTS,
    step: int = 10,
    max_gap: int = 0,
    min_length: int = 100,
    rounds: int = 10,
    fit_lengths: bool = True,
) -> DataFrame:
    """(chrom, start, end, posterior) of stretches in the open state, of fragments (chrom, left, right, n).

    With ``fit_lengths`` the components are where a fitted mixture of lengths begins, otherwise they are taken as they are.
    Square roots of the digested signals are the observations.  Bins that follow
    one another are a sequence, taken whole; a model of
    three states is fitted from clusters over all sequences, and the open state
    is the one whose mean of the shortest component is largest.  ``posterior`` is
    the mean over the region's bins.
    """
    names = [f"x{i}" for i in range(len(components))]
    if fit_lengths:
        components = states.length_mixture(fragments, components)
    signal = digested_signal(fragments, components, step)
    rows = signal.select("chrom", "bin", (F.col("bin") * step).alias("start"), ((F.col("bin") + 1) * step).alias("end"), *[F.sqrt(f"s{i}").alias(x) for i, x in enumerate(names)])
    rows = regions.islands(rows, 0).withColumn("sequence", F.concat_ws("\t", "region", "chrom")).drop("region")
    rows = stored(rows, "digested-signal")
    if rows.isEmpty():
        return rows.select("chrom", "start", "end", F.lit(0.0).alias("posterior"))
    points = stored(states.weighted_points(rows, names), "signal-points")
    model = states.fit_rows(rows, points, "sequence", "start", names, rounds=rounds)
    opened = int(model.means[:, 0].argmax())
    found = states.decode(rows, model, "sequence", "start", names).where(F.col("state") == opened)
    open_bins = found.select(F.expr("substring(sequence, instr(sequence, '\t') + 1)").alias("chrom"), "start", (F.col("start") + step).alias("end"), F.element_at("posteriors", opened + 1).alias("p"))
    whole = regions.islands(open_bins, max_gap).groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("p").alias("posterior"))
    return whole.where(F.col("end") - F.col("start") >= min_length).select("chrom", "start", "end", "posterior")
