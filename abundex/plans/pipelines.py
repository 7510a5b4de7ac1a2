"""The two preparation pipelines, each one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.operators import clean, exposure, normalize
from abundex.operators.exposure import EpisodeRule
from abundex.schemas import AbundanceSet
from abundex.session import cut_lineage


def clean_samples(
    data: AbundanceSet,
    exposures: DataFrame,
    scale_counts: bool = False,
    rarefy_depth: int = 1000,
    seed: int = 1988,
    pattern: str = "Culture",
    replace: bool = True,
) -> AbundanceSet:
    """Select samples, merge repeats, keep exposed ones, then scale and/or rarefy.

    All selection happens on the sample table. The counts are read once for the
    specimens that have any, and joined once, with the samples that are left.
    """
    samples = clean.drop_null_subject(data.samples)
    samples = clean.drop_by_pattern(samples, pattern)
    samples = clean.drop_empty_samples(samples, data.counts)
    flagged = clean.flag_duplicates(samples)
    samples = clean.samples_with_exposure(clean.merged_samples(flagged), exposures)
    left = samples.select(F.col("specimen_id2").alias("specimen_id3"))
    counts = clean.merged_counts(data.counts, flagged.join(left, "specimen_id3", "left_semi"))
    if scale_counts:
        counts = normalize.css_normalize(counts, min_features=2).withColumnRenamed(
            "norm_count", "read_count"
        )
        samples = clean.drop_empty_samples(samples, counts)
    if rarefy_depth > 0:
        # Sizes, slices and starts all read the counts: write the merged table once.
        counts = normalize.rarefy(cut_lineage(counts), rarefy_depth, seed, replace=replace)
        samples = clean.drop_empty_samples(samples, counts)
    taxonomy = data.taxonomy.join(counts.select("otu_id").distinct(), "otu_id", "left_semi")
    return AbundanceSet(counts, samples, taxonomy)


def exposure_history(
    samples: DataFrame,
    exposures: DataFrame,
    max_lag: int,
    rules: Sequence[EpisodeRule] = (),
    combined: Mapping[str, str] = exposure.COFORMULATIONS,
    suppressed_by: Mapping[str, str] = exposure.SUPPRESSED_BY,
    dropped: Sequence[str] = exposure.ALWAYS_DROPPED,
    calendar: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Per subject and study day the nested exposure history; lags count records, or days with ``calendar``.

    ``wanted`` (subject_id, study_day), if given, says for which days; it leaves out no day that they look back to.

    Spans, study days and sub-subjects are settled per exposure row; then the rows
    shrink to one set per subject and day, which is what the ordered steps see.
    """
    spanned = exposure.exposure_right_join(exposure.subject_span(samples), exposures)
    inside = exposure.study_window_filter(spanned)
    rekeyed = exposure.episode_rekey(inside, rules)
    days = exposure.exposure_days(
        rekeyed, combined=combined, suppressed_by=suppressed_by, dropped=dropped
    )
    return exposure.exposure_record(days, max_lag, calendar, wanted)


def rekeyed_samples(samples: DataFrame, rules: Sequence[EpisodeRule]) -> DataFrame:
    """Samples under the same sub-subjects as their exposures."""
    return exposure.episode_rekey(samples, rules)
