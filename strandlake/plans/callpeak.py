"""Peak calling as one declared plan: duplicates, coverage, background, scores, regions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import background, model, reads, regions, scoring, smooth
from ..operators.tracks import compact
from ..sources import ordered, writers
from .scratch import stored


@dataclass(frozen=True)
class PeakOptions:
    """What a call is made with; the cutoff is a probability.

    ``fragment`` is the length that reads are extended to.  None asks for the
    model: reads of the treatment around pairs of strand peaks, whose fold over
    the mean lies in ``fold_range`` in windows of twice ``band_width``, tell it
    (``with_length``); ``fallback`` stands in where there are too few pairs.
    """

    genome_size: float
    fragment: int | None = 200
    tag: int = 200
    q_cutoff: float = 0.05
    broad_cutoff: float = 0.1
    p_cutoff: float | None = None
    keep_duplicates: int | str = 1
    shift: int = 0
    small_local: int = 1_000
    large_local: int = 10_000
    scale_to: str = "small"
    local: bool = True
    max_gap: int | None = None
    min_length: int | None = None
    clamp: bool = True
    call_summits: bool = False
    per_million: bool = False
    fold_range: tuple[float, float] = (5, 50)
    band_width: int = 300
    name: str = "NA"
    fallback: int | None = None
    least_pairs: int = 100

    def __post_init__(self) -> None:
        if len(self.fold_range) != 2:
            raise ValueError("the fold range has a low and a high end")

    @property
    def gap(self) -> int:
        return self.tag if self.max_gap is None else self.max_gap

    @property
    def least(self) -> int:
        return self.fragment if self.min_length is None else self.min_length

    def background(self) -> background.Background:
        return background.Background(self.genome_size, self.fragment, self.small_local, self.large_local, self.scale_to, self.local, self.shift, self.clamp)


def with_length(treat: DataFrame, options: PeakOptions) -> PeakOptions:
    """The options with a fragment length: their own, or that of the paired-peak model over the treatment's reads, duplicates limited."""
    if options.fragment is not None:
        return options
    limited = stored(reads.filter_duplicates(treat, options.keep_duplicates, options.genome_size), "model-reads")
    found = model.model_length(limited, options.genome_size, options.fold_range, options.band_width).first()
    length = found["d"] if found["d"] is not None and found["n_pairs"] >= options.least_pairs else options.fallback
    if length is None:
        raise ValueError(f"{found['n_pairs']} paired peaks are too few for a model of the fragment length; give a fragment or a fallback")
    return replace(options, fragment=int(length))


def enriched_track(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False) -> DataFrame:
    """Runs (chrom, start, end, treat, lambda) of reads (chrom, pos, strand) or fragments (chrom, left, right, n)."""
    if paired:
        return background.enrich_fragments(treat, control, options.background())
    options = with_length(treat, options)
    limit = lambda t: reads.filter_duplicates(t, options.keep_duplicates, options.genome_size)
    return background.enrich_reads(limit(treat), limit(control) if control is not None else None, options.background())


def scored_track(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False) -> DataFrame:
    """The enriched runs with p, fe and q."""
    both = enriched_track(treat, control, options, paired)
    return scoring.with_q(stored(scoring.with_fold(scoring.with_poisson(both)), "scored-runs"))


def call_narrow(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False, scored: DataFrame | None = None) -> DataFrame:
    """Named narrow peaks; with ``call_summits`` a row for each summit of a peak, its attributes those at the summit.

    ``scored`` are the call's scored runs where they are there already.
    """
    options = options if paired else with_length(treat, options)
    cutoff, score = (options.q_cutoff, "q") if options.p_cutoff is None else (options.p_cutoff, "p")
    scored = scored_track(treat, control, options, paired) if scored is None else scored
    found = regions.named(regions.narrow_peaks(scored, -math.log10(cutoff), options.gap, options.least, score), options.name)
    return smooth.at_summits(found, scored, max(smooth.NARROWEST, options.fragment)) if options.call_summits else found


def signal_tracks(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tracks (chrom, start, end, value) of treatment and background behind a call, by a million of the smaller depth with ``per_million``.  ``scored`` as in ``call_narrow``."""
    runs = stored(enriched_track(treat, control, options, paired), "signal-runs") if scored is None else scored
    if options.per_million:
        sizes = [side.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for side in (_counted(x, options, paired) for x in (treat, control) if x is not None)]
        depth = max(sizes) if options.scale_to == "large" else min(sizes)
        runs = runs.select("chrom", "start", "end", *[(F.col(c) * 1e6 / max(1, depth)).alias(c) for c in ("treat", "lambda")])
    side = lambda c: compact(runs.select("chrom", "start", "end", F.col(c).alias("value")))
    return side("treat"), side("lambda")


def _counted(side: DataFrame, options: PeakOptions, paired: bool) -> DataFrame:
    return side if paired else reads.filter_duplicates(side, options.keep_duplicates, options.genome_size)


def table_header(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False, broad: bool = False, tag: str = "BED", files: tuple[str, str | None] = ("", None)) -> list[str]:
    """The lines that stand above a table of peaks: what was asked for, and what was counted."""
    options = options if paired else with_length(treat, options)
    lines = [
        "ARGUMENTS LIST:",
        f"name = {options.name}",
        f"format = {tag}",
        f"ChIP-seq file = {[files[0]]}",
        f"control file = {[files[1]] if files[1] else None}",
        f"effective genome size = {options.genome_size:.2e}",
        f"band width = {options.band_width}",
        f"model fold = {list(options.fold_range)}",
        f"qvalue cutoff = {options.q_cutoff:.2e}" if options.p_cutoff is None else f"pvalue cutoff = {options.p_cutoff:.2e}",
        'The maximum gap between significant sites is assigned as the read length/tag size.' if options.max_gap is None else f"The maximum gap between significant sites = {options.max_gap}",
        'The minimum length of peaks is assigned as the predicted fragment length "d".' if options.min_length is None else f"The minimum length of peaks = {options.min_length}",
        f"{'Larger' if options.scale_to == 'small' else 'Smaller'} dataset will be scaled towards {'smaller' if options.scale_to == 'small' else 'larger'} dataset.",
        f"Range for calculating regional lambda is: {options.small_local} bps and {options.large_local} bps",
        f"Broad region calling is {'on' if broad else 'off'}",
        f"Paired-End mode is {'on' if paired else 'off'}",
        *(["Searching for subpeak summits is on"] if options.call_summits else []),
        None,
        f"{'fragment' if paired else 'tag'} size is determined as {options.fragment if paired else options.tag} bps",
    ]
    kind = "fragments" if paired else "tags"
    for name, side in (("treatment", treat), ("control", control)):
        if side is None:
            continue
        places = side if paired else reads.collapse(side)
        lines.append(f"total {kind} in {name}: {places.agg(F.coalesce(F.sum('n'), F.lit(0))).first()[0]}")
        if not paired and options.keep_duplicates != "all":
            keep = reads.duplicate_limit(places, options.keep_duplicates, options.genome_size)
            told = reads.duplicate_statistics(side, keep).first()
            lines += [f"tags after filtering in {name}: {told['kept']}", f"maximum duplicate tags at the same position in {name} = {keep}", f"Redundant rate in {name}: {told['redundant_rate'] or 0:.2f}"]
    lines.append(f"d = {options.fragment}")
    if not options.local:
        lines.append("local lambda is disabled!")
    return ["" if x is None else f"# {x}" for x in lines]


def call_broad(treat: DataFrame, control: DataFrame | None, options: PeakOptions, paired: bool = False, scored: DataFrame | None = None) -> DataFrame:
    """Named broad peaks with their gapped blocks; weak stretches bridge four gaps.  ``scored`` as in ``call_narrow``."""
    options = options if paired else with_length(treat, options)
    scored = scored_track(treat, control, options, paired) if scored is None else scored
    found = regions.broad_peaks(scored, -math.log10(options.q_cutoff), -math.log10(options.broad_cutoff), options.gap, 4 * options.gap, options.least)
    return regions.named(regions.gapped_peaks(found), options.name)


def for_fragments(options: PeakOptions, fragments: DataFrame) -> PeakOptions:
    """The options with fragment and tag length taken from the fragments' mean."""
    size = int(background.mean_fragment(fragments))
    return replace(options, fragment=size, tag=size)


#: Cutoffs of p that a table of cutoffs tells, unless others are asked for.
CUTOFFS = tuple(round(0.3 * k, 1) for k in range(1, 34))


def write_call(treat: DataFrame, control: DataFrame | None, options: PeakOptions, folder: str, paired: bool = False, broad: bool = False, tag: str = "BED", files: tuple[str, str | None] = ("", None), signals: bool = False, cutoffs: Sequence[float] | None = None) -> list[str]:
    """All files of a call, each a folder of the ordered sink under ``folder``; their paths.

    Peaks and their table always; summits of narrow peaks; broad peaks with their
    gapped form; with ``signals`` both tracks; with ``cutoffs`` (``CUTOFFS``, or others)
    what each would have called.  Files of a call without peaks have their headings.
    """
    options = options if paired else with_length(treat, options)
    scored = stored(scored_track(treat, control, options, paired), "call-scores")
    found = stored((call_broad if broad else call_narrow)(treat, control, options, paired, scored), "called-peaks")
    heading = table_header(treat, control, options, paired, broad, tag, files)
    made = [("peaks.xls", writers.peak_table(found), [*heading, writers.table_columns(broad)])]
    if broad:
        made += [("peaks.broadPeak", writers.broad_peak(found), []), ("peaks.gappedPeak", writers.gapped_peak(found), [])]
    else:
        made += [("peaks.narrowPeak", writers.narrow_peak(found), []), ("summits.bed", writers.summits(found), [])]
    if signals:
        made += [(name, writers.bedgraph(track, single=True), []) for name, track in zip(("treat_pileup.bdg", "control_lambda.bdg"), signal_tracks(treat, control, options, paired, scored))]
    if cutoffs is not None:
        told = regions.cutoff_scores(scored, cutoffs, options.gap, options.least)
        made.append(("cutoff_analysis.txt", writers.cutoff_table(told), [writers.CUTOFF_COLUMNS]))
    out = []
    for name, lines, above in made:
        out.append(f"{folder.rstrip('/')}/{options.name}_{name}")
        ordered.write(lines, out[-1], above)
    return out
