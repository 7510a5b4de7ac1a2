"""Hill-number diversity, group proportions and their values at baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.expressions import join_null_safe
from abundex.functions.ordered import lag_in_slices
from abundex.operators.reshape import complete
from abundex.session import cut_lineage

GROUP = ("subject_id", "specimen_type")
SAMPLE_COLUMNS = ("specimen_id2", "subject_id", "specimen_type", "study_day")


def hill_diversity(counts: DataFrame, by: Sequence[str] = ("specimen_id2",)) -> DataFrame:
    """``D1 = exp(-sum(p ln p))`` per specimen.

    With ``N = sum(n)`` the sum is ``ln N - sum(n ln n) / N``: one pass, and both
    sums are combined before the shuffle.
    """
    n = F.col("read_count")
    total = F.sum(n)
    return (
        counts.filter(n > 0)
        .groupBy(*by)
        .agg(F.exp(F.ln(total) - F.sum(n * F.ln(n)) / total).alias("D1"))
    )


def specimen_diversity(samples: DataFrame, counts: DataFrame) -> DataFrame:
    """D1 with the specimen's subject, type and day."""
    return samples.select(*SAMPLE_COLUMNS).join(hill_diversity(counts), "specimen_id2")


def baseline_rows(
    df: DataFrame,
    keys: Sequence[str] = GROUP,
    day: str = "study_day",
    measured: str | None = None,
) -> DataFrame:
    """Rows at the group's smallest day; ties are all kept.

    ``measured`` names a column that has to be there for a day to count. Naming the
    computed column also makes both uses of ``df`` need the same aggregate, which
    Spark then shuffles once.
    """
    counted = F.col(day) if measured is None else F.when(F.col(measured).isNotNull(), F.col(day))
    first = df.groupBy(*keys).agg(F.min(counted).alias(day))
    return join_null_safe(df, first, [*keys, day], "left_semi")


def baseline_diversity(samples: DataFrame, counts: DataFrame) -> DataFrame:
    return baseline_rows(specimen_diversity(samples, counts), measured="D1").select(
        *GROUP, F.col("D1").alias("D1_start")
    )


def lagged_response(
    df: DataFrame,
    value: str = "D1",
    subject: str = "subject_id",
    day: str = "study_day",
    tie: Sequence[str] = ("specimen_id2",),
    out: str = "D1_lag",
) -> DataFrame:
    """Add the subject's previous value and drop the rows that have none."""
    return lag_in_slices(df, [subject], day, tie, value, out).filter(F.col(out).isNotNull())


def response_ratio(
    df: DataFrame, value: str = "D1", lagged: str = "D1_lag", out: str = "D1_delta"
) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value), F.col(lagged)))


def genus_proportions(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Share of each genus in its specimen; features without a genus form one group.

    The window sees one row per genus, not per feature.
    """
    whole = Window.partitionBy("specimen_id2")
    return (
        counts.filter(F.col("read_count") > 0)
        .join(taxonomy.select("otu_id", "Genus"), "otu_id", "left")
        .groupBy("specimen_id2", "Genus")
        .agg(F.sum("read_count").alias("genus_reads"))
        .withColumn("total_reads", F.sum("genus_reads").over(whole))
        .withColumn("genus_prop", F.col("genus_reads") / F.col("total_reads"))
    )


def genus_stain_join(genus_props: DataFrame, stains: DataFrame) -> DataFrame:
    """Attach the stain of each genus; a missing genus matches a missing genus."""
    return join_null_safe(genus_props, stains.select("Genus", "stain"), ["Genus"])


def stain_proportions(genus_props: DataFrame, stains: DataFrame) -> DataFrame:
    return (
        genus_stain_join(genus_props, stains)
        .groupBy("specimen_id2", "stain")
        .agg(F.sum("genus_prop").alias("stain_prop"))
    )


def taxon_proportion(counts: DataFrame, taxonomy: DataFrame, genus: str) -> DataFrame:
    """Share of one genus; specimens without it have no row."""
    n = F.col("read_count")
    reads = F.sum(F.when(F.col("Genus") == genus, n))
    return (
        counts.filter(n > 0)
        .join(taxonomy.select("otu_id", "Genus"), "otu_id", "left")
        .groupBy("specimen_id2")
        .agg(F.sum(n).alias("total_reads"), reads.alias("taxon_reads"))
        .filter(F.col("taxon_reads").isNotNull())
        .withColumn("taxon_prop", F.col("taxon_reads") / F.col("total_reads"))
    )


def starting_stain_proportions(
    samples: DataFrame, counts: DataFrame, taxonomy: DataFrame, stains: DataFrame
) -> DataFrame:
    """Stain shares at baseline, with 0 for the combinations that do not occur.

    The few baseline rows are written before they are completed, which reads them
    several times.
    """
    shares = stain_proportions(genus_proportions(counts, taxonomy), stains)
    dated = shares.join(samples.select(*SAMPLE_COLUMNS), "specimen_id2")
    start = baseline_rows(dated, measured="stain_prop")
    columns = start.select(
        F.col("subject_id").alias("subjects"), "specimen_type", "stain", "stain_prop", "study_day"
    )
    return complete(cut_lineage(columns), ["subjects", "specimen_type", "stain"], {"stain_prop": 0.0})


def starting_taxon_proportion(
    samples: DataFrame, counts: DataFrame, taxonomy: DataFrame, genus: str
) -> DataFrame:
    shares = taxon_proportion(counts, taxonomy, genus)
    dated = shares.join(samples.select(*SAMPLE_COLUMNS), "specimen_id2")
    start = baseline_rows(dated, measured="taxon_prop")
    return start.select(
        F.col("subject_id").alias("subjects"), "specimen_type", "study_day", "taxon_prop"
    )


def dominant_taxon(samples: DataFrame, counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The largest genus, and its share, at each subject's baseline."""
    shares = genus_proportions(counts, taxonomy).filter(F.col("Genus").isNotNull())
    dated = shares.join(samples.select(*SAMPLE_COLUMNS), "specimen_id2")
    start = baseline_rows(dated, measured="genus_prop")
    best = F.min(F.struct((-F.col("genus_prop")).alias("_rest"), F.col("Genus")))
    return (
        start.groupBy(*GROUP)
        .agg(best.alias("_best"))
        .select(
            *GROUP,
            F.col("_best.Genus").alias("dominant_genus"),
            (-F.col("_best._rest")).alias("dom_genus_prop"),
        )
    )
