"""Scores of aligned runs: Poisson p, rank-based q, fold enrichment.

The Poisson tail is taken in Arrow batches, once for each distinct (count, rate)
pair of a batch, so no run is shuffled for its score.  The q table ranks distinct scores by the bases at
each; its running sums have two levels like a sweep's, so the ordered pass is
never one task over all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import fold_enrichment, poisson_score_column

#: Scores are told apart to this many decimals.
DECIMALS = 9


def with_poisson(runs: DataFrame, treat: str = "treat", control: str = "lambda") -> DataFrame:
    """Adds p = -log10 P(X > floor(treat)) at rate ``control``."""
    k = F.floor(F.col(treat) + F.lit(1e-9)).cast("double")
    return runs.withColumn("p", F.round(poisson_score_column(k, F.col(control).cast("double")), DECIMALS))


def with_fold(runs: DataFrame, treat: str = "treat", control: str = "lambda", pseudo: float = 1.0) -> DataFrame:
    """Adds fe, the fold enrichment with a pseudo count."""
    return runs.withColumn("fe", fold_enrichment(F.col(treat), F.col(control), pseudo))


def q_table(runs: DataFrame) -> DataFrame:
    """(p, bases, q) for each distinct score p of the runs.

    From the highest score down, q = p + log10(rank) - log10(all bases), where
    rank is one more than the bases at higher scores; q never rises again and is
    never negative.
    """
    bases = runs.where("p is not null").groupBy("p").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
    bases = bases.withColumn("_bin", F.floor(F.least(F.col("p"), F.lit(1e15)) * 16).cast("long"))
    down = Window.partitionBy().orderBy(F.desc("_bin"))
    bins = bases.groupBy("_bin").agg(F.sum("bases").alias("_sum"))
    bins = bins.select("_bin", F.coalesce(F.sum("_sum").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_bin").orderBy(F.desc("p"))
    local = bases.withColumn("_higher", F.coalesce(F.sum("bases").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    raw = local.join(bins, "_bin").select("p", "bases", "_bin", (F.col("p") + F.log10(1 + F.col("_higher") + F.col("_above")) - F.log10("_all")).alias("_raw"))
    lows = raw.groupBy("_bin").agg(F.min("_raw").alias("_low")).select(F.col("_bin").alias("_b"), F.min("_low").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    falling = F.least(F.min("_raw").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.coalesce("_before", F.lit(float("inf"))))
    return raw.join(lows, F.col("_bin") == F.col("_b")).select("p", "bases", F.greatest(F.lit(0.0), falling).alias("q"))


def with_q(runs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds q from the runs' own q table, or a given one."""
    table = (table if table is not None else q_table(runs)).select(F.col("p").alias("_p"), "q")
    return runs.join(table, F.col("p").eqNullSafe(F.col("_p")), "left").drop("_p")


def histogram(runs: DataFrame, decimals: int = 0) -> DataFrame:
    """(score, bases): how many bases have each score, rounded."""
    return runs.groupBy(F.round("p", decimals).alias("score")).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
