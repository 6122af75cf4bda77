"""One query for each operator over the standard tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import arithmetic, assembly, background, model, reads, regions, scoring, smooth, states, tracks, variants
from ..streaming import coverage as streaming
from . import adapter
from .callpeak import PeakOptions, call_narrow, enriched_track, scored_track, signal_tracks
from .openregions import digested_signal, open_regions
from .scratch import stored

GENOME, SIZE, SMALL, LARGE = 7500.0, 8, 50, 400
#: Length components of the tables' fragments, shorter than any real ones.
LENGTHS = [(5.0, 3.0), (20.0, 5.0), (35.0, 5.0), (48.0, 3.0)]
P_CUTOFF, WEAK, GAP, LEAST = 1.0, 0.6, 3, 4
Q_CUTOFF, Q_WEAK = 0.4, 0.2
CURVE = [round(0.313 + 0.037 * k, 3) for k in range(60)]
HOW = background.Background(GENOME, SIZE, SMALL, LARGE)
OPTIONS = PeakOptions(GENOME, fragment=SIZE, tag=GAP, keep_duplicates="all", small_local=SMALL, large_local=LARGE)
PLACE = ("chrom", "pos", "strand")


def _side(spark: SparkSession, sf_dir: str, treated: bool) -> DataFrame:
    return reads.collapse(adapter.reads(spark, sf_dir, treated))


def _fragments(spark: SparkSession, sf_dir: str, treated: bool | None = None) -> DataFrame:
    return reads.collapse(reads.fragments_of(adapter.fragments(spark, sf_dir, treated)), ("chrom", "left", "right"))


def _track(spark: SparkSession, sf_dir: str, treated: bool) -> DataFrame:
    return tracks.coverage(reads.extend(_side(spark, sf_dir, treated), SIZE), F.col("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_track(adapter.reads(spark, sf_dir, True), adapter.reads(spark, sf_dir, False), OPTIONS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_track(adapter.reads(spark, sf_dir, True), adapter.reads(spark, sf_dir, False), OPTIONS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored track, rounded."""
    return _rounded(_scored(spark, sf_dir), 4, "treat", "lambda", "p", "fe", "q")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def read_stats(spark, sf_dir):
    """Reads and their mean length by chromosome and strand."""
    return adapter.reads(spark, sf_dir).groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def tag_size(spark, sf_dir):
    return reads.tag_size(adapter.reads(spark, sf_dir, True))


def redundant_rate(spark, sf_dir):
    return reads.duplicate_statistics(adapter.reads(spark, sf_dir, True), 1)


def filterdup_1(spark, sf_dir):
    return reads.filter_duplicates(adapter.reads(spark, sf_dir, True), 1)


def filterdup_auto(spark, sf_dir):
    return reads.filter_duplicates(adapter.reads(spark, sf_dir, True), "auto", GENOME)


def filterdup_all(spark, sf_dir):
    return reads.filter_duplicates(adapter.reads(spark, sf_dir, True), "all")


def fragments_dedup(spark, sf_dir):
    found = adapter.fragments(spark, sf_dir, True).drop("count")
    return reads.filter_duplicates(reads.fragments_of(found), 1, keys=("chrom", "left", "right"))


def fragment_counts_wrapped(spark, sf_dir):
    """Counts held in sixteen bits, of counts that overrun them."""
    big = adapter.fragments(spark, sf_dir, True).withColumn("count", F.col("count") * 40_000 - 100_000)
    return reads.fragments_of(big).groupBy("chrom").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))


def intervals_normalised(spark, sf_dir):
    """Intervals from order day to ship day, turned round where they run backwards."""
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", days("l_shipdate").alias("right"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", days("o_orderdate").alias("left"))
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_returnflag").alias("chrom"), "left", "right")
    return reads.fragments_of(pairs).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("right") - F.col("left")).alias("bases"), F.min("left").alias("first_left"))


def union_replicates(spark, sf_dir):
    """Two replicates read as one: reads by chromosome."""
    both = adapter.reads(spark, sf_dir, True).unionByName(adapter.reads(spark, sf_dir, False))
    return reads.collapse(both).groupBy("chrom").agg(F.sum("n").alias("n"), F.count("*").alias("places"))


def shifted_extension(spark, sf_dir):
    """Coverage of reads moved five towards 5' before extension."""
    return tracks.coverage(reads.extend(_side(spark, sf_dir, True), SIZE, -5), F.col("n"))


def pileup_se(spark, sf_dir):
    return _track(spark, sf_dir, True)


def pileup_pe(spark, sf_dir):
    found = _fragments(spark, sf_dir).select("chrom", F.col("left").alias("start"), F.col("right").alias("end"))
    return tracks.coverage(found)


def pileup_weighted(spark, sf_dir):
    found = _fragments(spark, sf_dir).select("chrom", F.col("left").alias("start"), F.col("right").alias("end"), "n")
    return tracks.coverage(found, F.col("n"))


def pileup_clamped(spark, sf_dir):
    """Coverage of fragments up to chromosome ends that lie 30 before the last end."""
    found = _fragments(spark, sf_dir).select("chrom", F.col("left").alias("start"), F.col("right").alias("end"), "n")
    return tracks.coverage(found, F.col("n"), found.groupBy("chrom").agg((F.max("end") - 30).alias("length")))


def pileup_signals(spark, sf_dir):
    """Coverage of half-hour windows after each event."""
    found = adapter.signals(spark, sf_dir).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 30).alias("end"))
    return tracks.coverage(found)


def _enriched(spark, sf_dir, how, control=True):
    other = _side(spark, sf_dir, False) if control else None
    return _rounded(background.enrich_reads(_side(spark, sf_dir, True), other, how), 6, "treat", "lambda")


def scale_small(spark, sf_dir):
    return _enriched(spark, sf_dir, HOW)


def scale_large(spark, sf_dir):
    return _enriched(spark, sf_dir, background.Background(GENOME, SIZE, SMALL, LARGE, scale_to="large"))


def lambda_nolambda(spark, sf_dir):
    return _enriched(spark, sf_dir, background.Background(GENOME, SIZE, SMALL, LARGE, local=False))


def lambda_nocontrol(spark, sf_dir):
    return _enriched(spark, sf_dir, HOW, control=False)


def lambda_fragments(spark, sf_dir):
    found = background.enrich_fragments(_fragments(spark, sf_dir, True), _fragments(spark, sf_dir, False), HOW)
    return _rounded(found, 6, "treat", "lambda")


def mean_fragment(spark, sf_dir):
    size = background.mean_fragment(_fragments(spark, sf_dir, True))
    return spark.range(1).select(F.round(F.lit(size), 6).alias("mean_length"))


def track_align(spark, sf_dir):
    return tracks.align({"a": _track(spark, sf_dir, True), "b": _track(spark, sf_dir, False)})


def _arithmetic(method: str):
    def query(spark, sf_dir):
        found = arithmetic.compare(_track(spark, sf_dir, True), _track(spark, sf_dir, False), method)
        return _rounded(found, 6, "value")

    query.__name__ = f"bdgcmp_{method}"
    return query


def track_compact(spark, sf_dir):
    """Coverage in steps of fifty, equal neighbours merged."""
    found = _track(spark, sf_dir, True)
    return tracks.compact(found.select("chrom", "start", "end", F.floor(F.col("value") / 50).alias("value")))


def track_transform(spark, sf_dir):
    return arithmetic.transform(_track(spark, sf_dir, True), "at_most", 60.0)


def track_combine(spark, sf_dir):
    return _rounded(arithmetic.combine([_track(spark, sf_dir, True), _track(spark, sf_dir, False)], "mean"), 6, "value")


def poisson_score(spark, sf_dir):
    return _rounded(scoring.with_poisson(_runs(spark, sf_dir)).select("chrom", "start", "end", "p"), 5, "p")


def fold_enrichment(spark, sf_dir):
    return _rounded(scoring.with_fold(_runs(spark, sf_dir)).select("chrom", "start", "end", "fe"), 5, "fe")


def qtable(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("chrom", "start", "end", "q"), 4, "q")


def score_histogram(spark, sf_dir):
    return scoring.histogram(_scored(spark, sf_dir), 1)


def _narrow(spark, sf_dir):
    return regions.narrow_peaks(_scored(spark, sf_dir), P_CUTOFF, GAP, LEAST, "p")


def peaks_narrow(spark, sf_dir):
    return _rounded(regions.named(_narrow(spark, sf_dir), "run"), 4, "pileup", "p", "fe", "q")


def summits(spark, sf_dir):
    return _narrow(spark, sf_dir).select("chrom", F.col("summit").alias("start"), (F.col("summit") + 1).alias("end"), F.round("q", 4).alias("q"))


def _broad(spark, sf_dir):
    return regions.broad_peaks(_scored(spark, sf_dir), P_CUTOFF, WEAK, GAP, 4 * GAP, LEAST, "p")


def peaks_broad(spark, sf_dir):
    return _rounded(_broad(spark, sf_dir).select("chrom", "start", "end", "pileup", "p", "fe"), 4, "pileup", "p", "fe")


def peaks_gapped(spark, sf_dir):
    found = regions.gapped_peaks(_broad(spark, sf_dir))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("chrom", "start", "end", F.col("block_count").cast("long").alias("block_count"), text("block_sizes"), text("block_starts"))


def cutoff_analysis(spark, sf_dir):
    found = regions.cutoff_analysis(_scored(spark, sf_dir), [0.5, 0.8, 1.0, 1.5], GAP, LEAST)
    return _rounded(found, 6, "mean_length")


def cutoff_curve(spark, sf_dir):
    """Regions at each of sixty cutoffs."""
    found = regions.cutoff_analysis(_scored(spark, sf_dir), CURVE, GAP, LEAST)
    return _rounded(found.withColumn("cutoff", F.round("cutoff", 3)), 6, "mean_length")


def cutoff_scores(spark, sf_dir):
    """What each of sixty cutoffs of p would call, with the q that it stands for."""
    found = regions.cutoff_scores(_scored(spark, sf_dir), CURVE, GAP, LEAST)
    return _rounded(found.withColumn("pscore", F.round("pscore", 3)).withColumn("qscore", F.round("qscore", 4)), 6, "avelpeak")


def bdgpeakcall(spark, sf_dir):
    found = _track(spark, sf_dir, True)
    high = found.agg(F.avg("value") * 1.1).first()[0]
    return regions.threshold_regions(found, math.floor(high), GAP, LEAST)


def bdgdiff(spark, sf_dir):
    """Forward against reverse reads, each with its side of the control."""
    side = lambda strand, treated: tracks.coverage(reads.extend(_side(spark, sf_dir, treated).where(F.col("strand") == strand), SIZE), F.col("n"))
    found = regions.condition_differences(side("+", True), side("+", False), side("-", True), side("-", False), 1.0, GAP, LEAST)
    return _rounded(found, 4, "score")


def reads_in_regions(spark, sf_dir):
    """Reads of the control inside the narrow regions."""
    marked = _narrow(spark, sf_dir).select("chrom", "start", "end")
    inside = regions.overlapping(_side(spark, sf_dir, False), marked, 64)
    return inside.groupBy("chrom", "start", "end").agg(F.sum("n").alias("reads"))


def refinepeak(spark, sf_dir):
    marked = _narrow(spark, sf_dir).select("chrom", "start", "end")
    return regions.refine_summits(marked, _side(spark, sf_dir, True), 3)


def predictd(spark, sf_dir):
    """Agreement of forward and reverse ends at each offset up to forty."""
    return model.strand_agreement(_side(spark, sf_dir, True), 40)


def digestion(spark, sf_dir):
    """Weights of four length components, summed by chromosome."""
    found = states.digested(_fragments(spark, sf_dir), [(5.0, 3.0), (20.0, 5.0), (35.0, 5.0), (48.0, 3.0)])
    return found.groupBy("chrom").agg(*[F.round(F.sum(F.col(f"w{i}") * F.col("n")), 3).alias(f"w{i}") for i in range(4)])


def randsample(spark, sf_dir):
    """A fifth of the reads by seed."""
    return reads.sample(adapter.reads(spark, sf_dir, True), 0.2, 7)


def summits_sg(spark, sf_dir):
    named = regions.named(_narrow(spark, sf_dir), "run")
    return smooth.sub_summits(named, _track(spark, sf_dir, True), window=5)


def peaks_summits(spark, sf_dir):
    """Every sub-summit of every narrow peak, with its scores."""
    scored = stored(_scored(spark, sf_dir), "scored-runs")
    named = regions.named(regions.narrow_peaks(scored, P_CUTOFF, GAP, LEAST, "p"), "run")
    return _rounded(smooth.at_summits(named, scored, SIZE), 4, "pileup", "p", "fe", "q")


def peaks_narrow_q(spark, sf_dir):
    """Narrow peaks by a cutoff of q."""
    return _rounded(regions.named(regions.narrow_peaks(_scored(spark, sf_dir), Q_CUTOFF, GAP, LEAST, "q"), "run"), 4, "pileup", "p", "fe", "q")


def peaks_broad_q(spark, sf_dir):
    """Broad peaks by cutoffs of q, with the names of their gapped form."""
    found = regions.broad_peaks(_scored(spark, sf_dir), Q_CUTOFF, Q_WEAK, GAP, 4 * GAP, LEAST, "q")
    return _rounded(regions.named(found, "run").select("chrom", "start", "end", "pileup", "p", "fe", "q", "name"), 4, "pileup", "p", "fe", "q")


def signal_per_million(spark, sf_dir):
    """The treatment's signal behind a call, by a million reads of the smaller depth."""
    options = replace(OPTIONS, per_million=True)
    treat, _ = signal_tracks(adapter.reads(spark, sf_dir, True), adapter.reads(spark, sf_dir, False), options)
    return _rounded(treat, 4, "value")


def predictd_model(spark, sf_dir):
    """The fragment length by paired peaks of the two strands."""
    return model.model_length(_side(spark, sf_dir, True), GENOME, (0.5, 50), 20, 2)


def peaks_modelled(spark, sf_dir):
    """Narrow peaks of a call that takes its fragment length from the paired-peak model."""
    options = replace(OPTIONS, fragment=None, fold_range=(0.5, 50), band_width=20, least_pairs=1, fallback=SIZE, p_cutoff=10**-P_CUTOFF, min_length=LEAST, name="run")
    found = call_narrow(adapter.reads(spark, sf_dir, True), adapter.reads(spark, sf_dir, False), options)
    return _rounded(found, 4, "pileup", "p", "fe", "q")


def open_states(spark, sf_dir):
    """Stretches in the open state of digested fragment lengths."""
    found = open_regions(_fragments(spark, sf_dir), LENGTHS, step=4, min_length=4, rounds=3, fit_lengths=False)
    return _rounded(found, 4, "posterior")


def open_states_fitted(spark, sf_dir):
    """Stretches in the open state, with length components fitted to the fragments."""
    return _rounded(open_regions(_fragments(spark, sf_dir), LENGTHS, step=4, min_length=4, rounds=3), 4, "posterior")


def length_mixture(spark, sf_dir):
    """The fitted length components, and the fragments that each holds."""
    fragments = _fragments(spark, sf_dir)
    found = states.length_mixture(fragments, LENGTHS)
    held = states.digested(fragments, found).agg(*[F.sum(F.col(f"w{i}") * F.col("n")).alias(f"w{i}") for i in range(len(found))])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("component"), *[F.round(F.lit(v), 4).alias(c) for c, v in zip(("mean", "spread", "share"), part)], F.round(f"w{i}", 2).alias("fragments")) for i, part in enumerate(found)]))
    return held.select(rows.alias("r")).select("r.*")


def digested_bins(spark, sf_dir):
    """The mean coverage of each length component in bins of four bases."""
    found = digested_signal(_fragments(spark, sf_dir), LENGTHS, 4)
    return _rounded(found, 8, *[f"s{i}" for i in range(len(LENGTHS))])


def _state_rows(spark, sf_dir) -> DataFrame:
    found = tracks.align({"a": _track(spark, sf_dir, True), "b": _track(spark, sf_dir, False)})
    return found.select("chrom", "start", F.log1p("a").alias("x"), F.log1p("b").alias("y"))


def kmeans_state(spark, sf_dir):
    """Centres of three clusters of log coverage, over all runs."""
    points = stored(states.weighted_points(_state_rows(spark, sf_dir), ["x", "y"]), "state-points")
    centres, _ = states.kmeans_rows(points, ["x", "y"], 3)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(np.round(centres, 6))], "state int, x double, y double")


def hmm_posterior(spark, sf_dir):
    """States of every stretch of coverage given its whole chromosome, learned from all of them."""
    rows = stored(_state_rows(spark, sf_dir), "state-rows")
    points = stored(states.weighted_points(rows, ["x", "y"]), "state-points")
    fitted = states.fit_rows(rows, points, "chrom", "start", ["x", "y"], rounds=5)
    return states.decode(rows, fitted, "chrom", "start", ["x", "y"]).select("chrom", "start", "state", F.round(F.array_max("posteriors"), 6).alias("posterior"))


def hmm_path(spark, sf_dir):
    """The likeliest path of states over each whole chromosome, under a model of given low, middle and high coverage."""
    model = states.GaussianHmm(np.full(3, 1 / 3), np.where(np.eye(3, dtype=bool), 0.9, 0.05), np.array([[0.5, 0.5], [2.5, 2.5], [4.5, 4.5]]), np.array([np.eye(2)] * 3))
    rows = _state_rows(spark, sf_dir)
    return states.decode(rows, model, "chrom", "start", ["x", "y"], block=512, best=True).select("chrom", "start", "state")


def callvar_assembly(spark, sf_dir):
    """Substitutions, insertions and deletions of the treatment's alignments against the control's, by local assembly of every stretch that reads cover."""
    treat, control = (stored(adapter.alignments(spark, sf_dir, x), "alignments") for x in (True, False))
    width = 256
    marked = treat.select("chrom", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("end") - 1) / width))).alias("k")).distinct()
    found = assembly.call_assembled(treat, marked.select("chrom", (F.col("k") * width).alias("start"), ((F.col("k") + 1) * width).alias("end")), control)
    return _rounded(found, 4, "score")


def callvar_bases(spark, sf_dir):
    """Substitutions by base counts at every place that the treatment's alignments cover."""
    treat = stored(adapter.alignments(spark, sf_dir, True), "alignments")
    spans = treat.groupBy("chrom").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return _rounded(variants.call_variants(variants.base_counts(treat, spans)), 3, "score")


def stream_counts(spark, sf_dir):
    """Events in six-hour windows; the plan that the streaming test runs on a stream."""
    found = streaming.windowed_counts(adapter.signals(spark, sf_dir), "6 hours")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def stream_pileup(spark, sf_dir):
    """Coverage from streamed deltas, as a batch over the same events."""
    deltas = streaming.coverage_deltas(adapter.signals(spark, sf_dir), "chrom", "pos", 30)
    return tracks.compact(tracks.sweep(deltas, ["delta"]).withColumnRenamed("delta", "value"))


def binomial_limit(spark, sf_dir):
    """The automatic duplicate limit of the treatment."""
    total = adapter.reads(spark, sf_dir, True).count()
    return spark.range(1).select(F.lit(stats.binomial_max_duplicates(total, GENOME)).cast("long").alias("max_duplicates"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    read_stats, tag_size, redundant_rate, filterdup_1, filterdup_auto, filterdup_all, fragments_dedup, fragment_counts_wrapped, intervals_normalised, union_replicates,
    binomial_limit, mean_fragment, shifted_extension, pileup_se, pileup_pe, pileup_weighted, pileup_clamped, pileup_signals, scale_small, scale_large, lambda_nolambda, lambda_nocontrol,
    lambda_fragments, track_align, track_compact, track_transform, track_combine, poisson_score, fold_enrichment, qtable, score_histogram, peaks_narrow, summits,
    peaks_broad, peaks_gapped, cutoff_analysis, cutoff_curve, cutoff_scores, bdgpeakcall, bdgdiff, reads_in_regions, refinepeak, predictd, digestion, randsample, summits_sg, peaks_summits, peaks_narrow_q, peaks_broad_q, signal_per_million, predictd_model, peaks_modelled, open_states, open_states_fitted, length_mixture, digested_bins, kmeans_state,
    hmm_posterior, hmm_path, callvar_assembly, callvar_bases, stream_counts, stream_pileup, *[_arithmetic(m) for m in (*arithmetic.METHODS, "ppois", "qpois")],
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in QUERIES}
