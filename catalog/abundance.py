"""Queries on set A: counts, samples, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions.expressions import null_or_not_equal, padded_label
from abundex.operators import clean, diversity, frame, normalize, reshape
from abundex.plans.pipelines import clean_samples
from abundex.schemas import AbundanceSet
from abundex.sources import tables
from catalog import roles as r
from catalog.roles import r6, rounded, sql_r6, with_ctes

DEPTH = 50
KEY_COLUMNS = ("specimen_id2", "subject_id", "specimen_type", "study_day")


# --- sources -------------------------------------------------------------------


def s1_read_counts(spark: SparkSession, d: str) -> DataFrame:
    columns = {"specimen_id2": "l_orderkey", "otu_id": "l_partkey", "read_count": "l_quantity"}
    read = tables.read_counts(spark, f"{d}/lineitem.parquet", columns=columns)
    return read.groupBy("specimen_id2", "otu_id").agg(
        F.sum("read_count").cast("long").alias("read_count")
    )


def s1_wide_counts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as a samples x flags table and back to sparse counts."""
    flags = ["A", "N", "R"]
    by_flag = r.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("specimen_id2"),
        F.col("l_returnflag").alias("otu_id"),
        F.col("l_quantity").cast("long").alias("read_count"),
    )
    wide = reshape.wide_counts(by_flag, flags)
    return tables.counts_from_wide(wide, flags)


def s2_read_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    columns = {"otu_id": "p_partkey", "Kingdom": "p_type", "Genus": "p_brand"}
    return tables.read_taxonomy(spark, f"{d}/part.parquet", columns=columns)


def s3_read_exposures(spark: SparkSession, d: str) -> DataFrame:
    columns = {"subject_id": "user_id", "collection_date": "ts", "abx_b": "event_type"}
    read = tables.read_exposures(spark, f"{d}/events.parquet", "parquet", columns)
    return read.withColumn("collection_date", F.to_date("collection_date")).distinct()


def s4_read_samples(spark: SparkSession, d: str) -> DataFrame:
    columns = {
        "specimen_id2": "o_orderkey",
        "subject_id": "o_custkey",
        "specimen_type": "o_orderstatus",
    }
    return tables.read_samples(spark, f"{d}/orders.parquet", "parquet", columns)


def s5_read_stains(spark: SparkSession, d: str) -> DataFrame:
    columns = {"dominant_genus": "p_brand", "stain": "p_type"}
    return tables.read_stains(spark, f"{d}/part.parquet", "parquet", columns).distinct()


# --- selection -----------------------------------------------------------------


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_by_pattern(clean.drop_null_subject(r.raw_samples(spark, d)))


def p1_drop_null_subject(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_null_subject(r.raw_samples(spark, d)).select(*KEY_COLUMNS)


def p2_drop_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_by_pattern(r.raw_samples(spark, d)).select(*KEY_COLUMNS)


def p3_drop_empty_samples(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_empty_samples(r.samples(spark, d), r.counts(spark, d)).select(*KEY_COLUMNS)


def p4_drop_low_feature_samples(spark: SparkSession, d: str) -> DataFrame:
    kept = clean.drop_low_feature_samples(r.samples(spark, d), r.counts(spark, d))
    return kept.select(*KEY_COLUMNS)


def p5_removed_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean.removal_report(r.raw_samples(spark, d), r.counts(spark, d))


def p7_select_rename_drop(spark: SparkSession, d: str) -> DataFrame:
    renamed = r.samples(spark, d).withColumnsRenamed(
        {"specimen_id2": "specimens", "subject_id": "subjects"}
    )
    return renamed.drop("enroll_date", "collection_date")


def p8_specimen_type_filter(spark: SparkSession, d: str) -> DataFrame:
    return frame.specimen_type_filter(r.samples(spark, d), "F").select(*KEY_COLUMNS)


def p9_label_in_list(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.col("Genus").isin("Brand#2", "Brand#11", "Brand#25")
    return r.taxonomy(spark, d).filter(wanted)


def p10_null_or_not_equal(spark: SparkSession, d: str) -> DataFrame:
    return r.taxonomy(spark, d).filter(null_or_not_equal(F.col("Genus"), "Brand#2"))


def p11_non_empty_assert(spark: SparkSession, d: str) -> DataFrame:
    kept = frame.specimen_type_filter(r.samples(spark, d), "O")
    return clean.non_empty(kept, "samples of type O").groupBy("specimen_type").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- joins, keys and merging -----------------------------------------------------


def j1_reconcile_keys(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the reconciled tables; samples without orders lines are left out."""
    kept = clean.reconcile_keys(r.abundance_set(spark, d))
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, df in (
            ("counts", kept.counts),
            ("samples", kept.samples),
            ("taxonomy", kept.taxonomy),
        )
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def u1_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return clean.key_intersection(r.counts(spark, d), r.samples(spark, d), "specimen_id2")


def j2_melt_join_dims(spark: SparkSession, d: str) -> DataFrame:
    melted = reshape.melt_join_dims(
        r.counts(spark, d), r.samples(spark, d), r.taxonomy(spark, d)
    )
    return melted.select(*KEY_COLUMNS, "otu_id", "read_count", "Kingdom", "Genus")


def j3_samples_with_exposure(spark: SparkSession, d: str) -> DataFrame:
    kept = clean.samples_with_exposure(r.samples(spark, d), r.order_exposures(spark, d))
    return kept.select(*KEY_COLUMNS)


def w2_flag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    flagged = clean.flag_duplicates(r.samples(spark, d))
    return flagged.select("specimen_id2", "specimen_id3")


def a3_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    _, counts = clean.merge_duplicates(r.samples(spark, d), r.counts(spark, d))
    return counts


def a3_merged_samples(spark: SparkSession, d: str) -> DataFrame:
    samples, _ = clean.merge_duplicates(r.samples(spark, d), r.counts(spark, d))
    return samples.select(*KEY_COLUMNS, "collection_date")


def f1_string_functions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return r.table(spark, d, "part").select(
        "p_partkey",
        padded_label("sv", key).alias("padded"),
        padded_label("s", key, 2).alias("padded_short"),
        F.concat(key.cast("string"), F.lit("_D")).alias("pasted"),
        F.col("p_name").rlike("red|blue").alias("matched"),
    )


def f8_surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    seq = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return clean.surrogate_feature_keys(r.table(spark, d, "part").select(seq.alias("seq")))


def f9_label_index(spark: SparkSession, d: str) -> DataFrame:
    named = r.samples(spark, d).select(F.col("subject_id").cast("string").alias("subject_id"))
    return frame.label_index(named, "subject_id")


# --- sums and diversity ----------------------------------------------------------


def a1_hill_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.hill_diversity(r.counts(spark, d)), "D1")


def a2_sample_sums(spark: SparkSession, d: str) -> DataFrame:
    return clean.sample_sums(r.counts(spark, d))


def a2_feature_sums(spark: SparkSession, d: str) -> DataFrame:
    return clean.sample_sums(r.counts(spark, d), "otu_id")


def w1_total_reads(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_total_reads(r.counts(spark, d))


def w9_baseline_diversity(spark: SparkSession, d: str) -> DataFrame:
    found = diversity.baseline_diversity(r.samples(spark, d), r.counts(spark, d))
    return rounded(found, "D1_start")


def w4_lagged_response(spark: SparkSession, d: str) -> DataFrame:
    rows = diversity.specimen_diversity(r.samples(spark, d), r.counts(spark, d))
    one_type = frame.specimen_type_filter(rows, "F")
    return rounded(diversity.lagged_response(one_type), "D1", "D1_lag")


def w5_response_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = diversity.specimen_diversity(r.samples(spark, d), r.counts(spark, d))
    one_type = frame.specimen_type_filter(rows, "O")
    ratio = diversity.response_ratio(diversity.lagged_response(one_type))
    return ratio.select("specimen_id2", r6("D1_delta").alias("D1_delta"))


def o1_record_index(spark: SparkSession, d: str) -> DataFrame:
    return clean.record_index(r.samples(spark, d)).select("specimen_id2", "record")


def o2_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    first = clean.first_per_key(
        r.samples(spark, d), ["subject_id"], ["study_day", "specimen_id2"]
    )
    return first.select(*KEY_COLUMNS)


def u4_distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return reshape.specimen_ids(r.samples(spark, d), ["subject_id", "specimen_type"])


# --- genus and stain shares --------------------------------------------------------


def _genus(spark: SparkSession, d: str) -> DataFrame:
    return diversity.genus_proportions(r.counts(spark, d), r.taxonomy(spark, d))


def a4_genus_proportions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_genus(spark, d), "genus_prop")


def j12_genus_stain_join(spark: SparkSession, d: str) -> DataFrame:
    joined = diversity.genus_stain_join(_genus(spark, d), r.stains(spark, d))
    return joined.select("specimen_id2", "Genus", "genus_reads", "stain")


def a5_stain_proportions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diversity.stain_proportions(_genus(spark, d), r.stains(spark, d)), "stain_prop")


def a6_taxon_proportion(spark: SparkSession, d: str) -> DataFrame:
    found = diversity.taxon_proportion(r.counts(spark, d), r.taxonomy(spark, d), "Brand#7")
    return rounded(found, "taxon_prop")


def a6_starting_taxon(spark: SparkSession, d: str) -> DataFrame:
    found = diversity.starting_taxon_proportion(
        r.samples(spark, d), r.counts(spark, d), r.taxonomy(spark, d), "Brand#7"
    )
    return rounded(found, "taxon_prop")


def n9_starting_stains(spark: SparkSession, d: str) -> DataFrame:
    found = diversity.starting_stain_proportions(
        r.samples(spark, d), r.counts(spark, d), r.taxonomy(spark, d), r.stains(spark, d)
    )
    return rounded(found, "stain_prop")


def o5_dominant_taxon(spark: SparkSession, d: str) -> DataFrame:
    found = diversity.dominant_taxon(
        r.samples(spark, d), r.counts(spark, d), r.taxonomy(spark, d)
    )
    return rounded(found, "dom_genus_prop")


# --- reshaping, scaling, pipeline -----------------------------------------------------


def _agg(spark: SparkSession, d: str) -> DataFrame:
    return reshape.phyloseq_to_agglomerated(r.abundance_set(spark, d), "specimen", "feature", "n")


def n1_to_agglomerated(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d).select("specimen", "feature", "n", "subject_id", "Kingdom", "Genus")


def _back(spark: SparkSession, d: str) -> AbundanceSet:
    return reshape.agglomerated_to_phyloseq(
        _agg(spark, d), "feature", "specimen", "n", "Kingdom", "Genus"
    )


def n2_counts(spark: SparkSession, d: str) -> DataFrame:
    return _back(spark, d).counts


def n2_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return _back(spark, d).taxonomy


def n2_samples(spark: SparkSession, d: str) -> DataFrame:
    return _back(spark, d).samples.select(*KEY_COLUMNS)


def n5_gather(spark: SparkSession, d: str) -> DataFrame:
    prices = r.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax"
    )
    return reshape.gather(
        prices, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "key", "value"
    )


def r1_rarefy(spark: SparkSession, d: str) -> DataFrame:
    return normalize.rarefy(r.counts(spark, d), DEPTH)


def r1_rarefy_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Every read at most once."""
    return normalize.rarefy(r.counts(spark, d), DEPTH, replace=False)


def r2_css_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(normalize.css_normalize(r.counts(spark, d), min_features=2), "norm_count")


def _clean_set(spark: SparkSession, d: str, depth: int, **options) -> AbundanceSet:
    data = AbundanceSet(r.counts(spark, d), r.raw_samples(spark, d), r.taxonomy(spark, d))
    return clean_samples(data, r.order_exposures(spark, d), rarefy_depth=depth, **options)


def r3_clean_counts(spark: SparkSession, d: str) -> DataFrame:
    return _clean_set(spark, d, 0).counts


def r3_clean_samples(spark: SparkSession, d: str) -> DataFrame:
    return _clean_set(spark, d, 0).samples.select(*KEY_COLUMNS, "collection_date")


def r3_clean_rarefied(spark: SparkSession, d: str) -> DataFrame:
    return _clean_set(spark, d, DEPTH).counts


def r3_clean_scaled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_clean_set(spark, d, 0, scale_counts=True).counts, "read_count")


QUERIES = {
    "S1_read_counts": s1_read_counts,
    "S1_wide_counts": s1_wide_counts,
    "S2_read_taxonomy": s2_read_taxonomy,
    "S3_read_exposures": s3_read_exposures,
    "S4_read_samples": s4_read_samples,
    "S5_read_stains": s5_read_stains,
    "P1_drop_null_subject": p1_drop_null_subject,
    "P2_drop_by_pattern": p2_drop_by_pattern,
    "P3_drop_empty_samples": p3_drop_empty_samples,
    "P4_drop_low_feature_samples": p4_drop_low_feature_samples,
    "P5_removed_row_counts": p5_removed_row_counts,
    "P7_select_rename_drop": p7_select_rename_drop,
    "P8_specimen_type_filter": p8_specimen_type_filter,
    "P9_label_in_list": p9_label_in_list,
    "P10_null_or_not_equal": p10_null_or_not_equal,
    "P11_non_empty_assert": p11_non_empty_assert,
    "J1_reconcile_keys": j1_reconcile_keys,
    "U1_key_intersection": u1_key_intersection,
    "J2_melt_join_dims": j2_melt_join_dims,
    "J3_samples_with_exposure": j3_samples_with_exposure,
    "W2_flag_duplicates": w2_flag_duplicates,
    "A3_merge_duplicates": a3_merge_duplicates,
    "A3_merged_samples": a3_merged_samples,
    "F1_string_functions": f1_string_functions,
    "F8_surrogate_key": f8_surrogate_key,
    "F9_label_index": f9_label_index,
    "A1_hill_diversity": a1_hill_diversity,
    "A2_sample_sums": a2_sample_sums,
    "A2_feature_sums": a2_feature_sums,
    "W1_total_reads": w1_total_reads,
    "W9_baseline_diversity": w9_baseline_diversity,
    "W4_lagged_response": w4_lagged_response,
    "W5_response_ratio": w5_response_ratio,
    "O1_record_index": o1_record_index,
    "O2_first_per_key": o2_first_per_key,
    "U4_distinct_rows": u4_distinct_rows,
    "A4_genus_proportions": a4_genus_proportions,
    "J12_genus_stain_join": j12_genus_stain_join,
    "A5_stain_proportions": a5_stain_proportions,
    "A6_taxon_proportion": a6_taxon_proportion,
    "A6_starting_taxon": a6_starting_taxon,
    "N9_starting_stains": n9_starting_stains,
    "O5_dominant_taxon": o5_dominant_taxon,
    "N1_to_agglomerated": n1_to_agglomerated,
    "N2_counts": n2_counts,
    "N2_taxonomy": n2_taxonomy,
    "N2_samples": n2_samples,
    "N5_gather": n5_gather,
    "R1_rarefy": r1_rarefy,
    "R1_rarefy_distinct": r1_rarefy_distinct,
    "R2_css_normalize": r2_css_normalize,
    "R3_clean_counts": r3_clean_counts,
    "R3_clean_samples": r3_clean_samples,
    "R3_clean_rarefied": r3_clean_rarefied,
    "R3_clean_scaled": r3_clean_scaled,
}


# --- the same in SQL ---------------------------------------------------------------

_KEYS = ", ".join(KEY_COLUMNS)
_GENUS = """reads AS (
  SELECT c.specimen_id2, t."Genus", CAST(sum(c.read_count) AS BIGINT) AS genus_reads
  FROM counts c LEFT JOIN taxonomy t USING (otu_id) GROUP BY 1, 2),
totals AS (SELECT specimen_id2, CAST(sum(read_count) AS BIGINT) AS total_reads FROM counts GROUP BY 1),
genus AS (
  SELECT g.*, t.total_reads, g.genus_reads / t.total_reads::DOUBLE AS genus_prop
  FROM reads g JOIN totals t USING (specimen_id2))"""
_STAIN = """stain_props AS (
  SELECT g.specimen_id2, s.stain, sum(g.genus_prop) AS stain_prop
  FROM genus g LEFT JOIN stains s ON s."Genus" IS NOT DISTINCT FROM g."Genus" GROUP BY 1, 2)"""
_GENUS_BASE = (r.COUNTS, r.TAXONOMY, _GENUS)
_D1_ROWS = f"""rows1 AS (
  SELECT {", ".join("s." + c for c in KEY_COLUMNS)}, d."D1" FROM samples s JOIN d1 d USING (specimen_id2))"""
_FLAGGED = """flagged AS (
  SELECT *, CASE WHEN count(*) OVER g > 1
    THEN min(CAST(specimen_id2 AS VARCHAR)) OVER g || '_D' ELSE CAST(specimen_id2 AS VARCHAR) END AS specimen_id3
  FROM {source} WINDOW g AS (PARTITION BY subject_id, specimen_type, study_day))"""
_MERGED_COUNTS = """merged AS (
  SELECT f.specimen_id3 AS specimen_id2, c.otu_id, CAST(sum(c.read_count) AS BIGINT) AS read_count
  FROM counts c JOIN flagged f USING (specimen_id2) GROUP BY 1, 2)"""
_MERGED_SAMPLES = """msamples AS (
  SELECT * EXCLUDE (specimen_id2, specimen_id3, pos), specimen_id3 AS specimen_id2 FROM (
    SELECT *, row_number() OVER (PARTITION BY specimen_id3 ORDER BY CAST(specimen_id2 AS VARCHAR)) AS pos FROM flagged)
  WHERE pos = 1)"""
_CLEAN = (
    r.COUNTS,
    r.RAW_SAMPLES,
    r.ORDER_EXPOSURES,
    """chosen AS (
  SELECT * FROM raw WHERE subject_id IS NOT NULL
    AND (specimen_type IS NULL OR specimen_type NOT LIKE '%Culture%')
    AND specimen_id2 IN (SELECT specimen_id2 FROM counts WHERE read_count > 0))""",
    _FLAGGED.format(source="chosen"),
    _MERGED_COUNTS,
    _MERGED_SAMPLES,
    """exposed AS (
  SELECT s.* FROM msamples s WHERE EXISTS (
    SELECT 1 FROM meds m WHERE m.subject_id = s.subject_id AND m.collection_date = s.collection_date))""",
)


_PLACE = """CAST(floor(
    CAST(CAST('0x' || substr(md5(concat_ws('|', specimen_id2, n, '1988')), 1, 15) AS BIGINT) AS HUGEINT)
      * total // 1152921504606846976) AS BIGINT) AS u"""


def _laid_out(source: str) -> str:
    """The features of deep specimens as intervals of reads."""
    return f"""deep AS (
  SELECT specimen_id2, sum(read_count) AS total FROM {source} GROUP BY 1 HAVING sum(read_count) >= {DEPTH}),
spans AS (
  SELECT c.specimen_id2, c.otu_id, c.read_count,
    sum(c.read_count) OVER (PARTITION BY c.specimen_id2 ORDER BY md5(CAST(c.otu_id AS VARCHAR))) AS hi
  FROM {source} c JOIN deep USING (specimen_id2))"""


_HIT = "s.specimen_id2 = p.specimen_id2 AND p.u >= s.hi - s.read_count AND p.u < s.hi"


def _rarefied(source: str) -> tuple[str, str]:
    """Each drawn position looked up in the intervals of the features."""
    ctes = f"""{_laid_out(source)},
picks AS (SELECT specimen_id2, {_PLACE} FROM deep CROSS JOIN range({DEPTH}) t(n))"""
    last = f"""SELECT p.specimen_id2, s.otu_id, count(*) AS read_count
FROM picks p JOIN spans s ON {_HIT} GROUP BY 1, 2"""
    return ctes, last


def _rarefied_distinct(source: str) -> tuple[str, str]:
    """Different positions in the order they are first drawn; the left-out reads of small specimens."""
    ctes = f"""{_laid_out(source)},
wanted AS (
  SELECT *, 2 * {DEPTH} > total AS others, CASE WHEN 2 * {DEPTH} > total THEN total - {DEPTH} ELSE {DEPTH} END AS size FROM deep),
drawn AS (SELECT specimen_id2, n, {_PLACE} FROM wanted CROSS JOIN range({4 * DEPTH + 64}) t(n) WHERE n < 4 * size + 64),
firsts AS (
  SELECT specimen_id2, u, row_number() OVER (PARTITION BY specimen_id2 ORDER BY min(n)) AS pos FROM drawn GROUP BY 1, 2),
picks AS (SELECT f.specimen_id2, f.u FROM firsts f JOIN wanted w USING (specimen_id2) WHERE f.pos <= w.size),
hits AS (
  SELECT s.specimen_id2, s.otu_id, s.read_count, count(p.u) AS n FROM spans s LEFT JOIN picks p ON {_HIT} GROUP BY 1, 2, 3),
kept AS (
  SELECT specimen_id2, otu_id, CAST(CASE WHEN others THEN read_count - n ELSE n END AS BIGINT) AS read_count
  FROM hits JOIN wanted USING (specimen_id2))"""
    return ctes, "SELECT * FROM kept WHERE read_count > 0"


def _scale(source: str) -> str:
    """Sum of each specimen's counts up to its median count."""
    return f"""many AS (SELECT specimen_id2, quantile_cont(read_count, 0.5) AS q FROM {source}
  WHERE read_count > 0 GROUP BY 1 HAVING count(*) > 1),
scale AS (SELECT c.specimen_id2, sum(c.read_count) AS s FROM {source} c JOIN many m USING (specimen_id2)
  WHERE c.read_count <= m.q GROUP BY 1)"""


SQL = {
    "S1_read_counts": with_ctes(r.COUNTS, "SELECT * FROM counts"),
    "S1_wide_counts": """SELECT l_orderkey AS specimen_id2, l_returnflag AS otu_id,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS read_count FROM lineitem GROUP BY 1, 2""",
    "S2_read_taxonomy": """SELECT p_partkey AS otu_id, p_type AS "Kingdom", p_brand AS "Genus" FROM part""",
    "S3_read_exposures": """SELECT DISTINCT user_id AS subject_id, CAST(ts AS DATE) AS collection_date,
  event_type AS abx_b FROM events""",
    "S4_read_samples": """SELECT CAST(o_orderkey AS VARCHAR) AS specimen_id2, CAST(o_custkey AS VARCHAR) AS subject_id,
  o_orderstatus AS specimen_type FROM orders""",
    "S5_read_stains": """SELECT DISTINCT p_brand AS "Genus", p_type AS stain FROM part""",
    "P1_drop_null_subject": with_ctes(
        r.RAW_SAMPLES, f"SELECT {_KEYS} FROM raw WHERE subject_id IS NOT NULL"
    ),
    "P2_drop_by_pattern": with_ctes(
        r.RAW_SAMPLES,
        f"SELECT {_KEYS} FROM raw WHERE specimen_type IS NULL OR specimen_type NOT LIKE '%Culture%'",
    ),
    "P3_drop_empty_samples": with_ctes(
        r.SAMPLES,
        f"SELECT {_KEYS} FROM samples WHERE specimen_id2 IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 0)",
    ),
    "P4_drop_low_feature_samples": with_ctes(
        r.SAMPLES,
        f"""SELECT {_KEYS} FROM samples WHERE specimen_id2 IN (
  SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1)""",
    ),
    "P5_removed_row_counts": with_ctes(
        r.RAW_SAMPLES,
        """features AS (SELECT l_orderkey AS specimen_id2, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1),
step1 AS (SELECT * FROM raw WHERE subject_id IS NOT NULL),
step2 AS (SELECT * FROM step1 WHERE specimen_type IS NULL OR specimen_type NOT LIKE '%Culture%'),
step3 AS (SELECT s.*, f.n FROM step2 s JOIN features f USING (specimen_id2)),
step4 AS (SELECT * FROM step3 WHERE n > 1)""",
        """SELECT * FROM (
  SELECT 'null_subject' AS step, (SELECT count(*) FROM raw) - (SELECT count(*) FROM step1) AS removed
  UNION ALL SELECT 'pattern', (SELECT count(*) FROM step1) - (SELECT count(*) FROM step2)
  UNION ALL SELECT 'empty', (SELECT count(*) FROM step2) - (SELECT count(*) FROM step3)
  UNION ALL SELECT 'low_feature', (SELECT count(*) FROM step3) - (SELECT count(*) FROM step4))""",
    ),
    "P7_select_rename_drop": with_ctes(
        r.SAMPLES,
        "SELECT specimen_id2 AS specimens, subject_id AS subjects, specimen_type, study_day FROM samples",
    ),
    "P8_specimen_type_filter": with_ctes(
        r.SAMPLES, f"SELECT {_KEYS} FROM samples WHERE specimen_type = 'F'"
    ),
    "P9_label_in_list": with_ctes(
        r.TAXONOMY, """SELECT * FROM taxonomy WHERE "Genus" IN ('Brand#2', 'Brand#11', 'Brand#25')"""
    ),
    "P10_null_or_not_equal": with_ctes(
        r.TAXONOMY, """SELECT * FROM taxonomy WHERE "Genus" IS DISTINCT FROM 'Brand#2'"""
    ),
    "P11_non_empty_assert": """SELECT o_orderstatus AS specimen_type, count(*) AS n FROM orders
WHERE o_orderstatus = 'O' GROUP BY 1""",
    "J1_reconcile_keys": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.TAXONOMY,
        "kept AS (SELECT c.* FROM counts c JOIN samples s USING (specimen_id2))",
        """SELECT 'counts' AS part, count(*) AS n FROM kept
UNION ALL SELECT 'samples', count(DISTINCT specimen_id2) FROM kept
UNION ALL SELECT 'taxonomy', count(DISTINCT otu_id) FROM kept JOIN taxonomy t USING (otu_id)""",
    ),
    "U1_key_intersection": """SELECT l_orderkey AS specimen_id2 FROM lineitem INTERSECT SELECT o_orderkey FROM orders""",
    "J2_melt_join_dims": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.TAXONOMY,
        f"""SELECT c.specimen_id2, s.subject_id, s.specimen_type, s.study_day, c.otu_id, c.read_count,
  t."Kingdom", t."Genus"
FROM counts c LEFT JOIN samples s USING (specimen_id2) LEFT JOIN taxonomy t ON t.otu_id = c.otu_id""",
    ),
    "J3_samples_with_exposure": with_ctes(
        r.SAMPLES,
        r.ORDER_EXPOSURES,
        f"""SELECT DISTINCT {", ".join("s." + c for c in KEY_COLUMNS)} FROM samples s
JOIN meds m ON m.subject_id = s.subject_id AND m.collection_date = s.collection_date""",
    ),
    "W2_flag_duplicates": with_ctes(
        r.SAMPLES, _FLAGGED.format(source="samples"), "SELECT specimen_id2, specimen_id3 FROM flagged"
    ),
    "A3_merge_duplicates": with_ctes(
        r.COUNTS, r.SAMPLES, _FLAGGED.format(source="samples"), _MERGED_COUNTS, "SELECT * FROM merged"
    ),
    "A3_merged_samples": with_ctes(
        r.SAMPLES,
        _FLAGGED.format(source="samples"),
        _MERGED_SAMPLES,
        f"SELECT {_KEYS}, collection_date FROM msamples",
    ),
    "F1_string_functions": """SELECT p_partkey,
  'sv' || CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE CAST(p_partkey AS VARCHAR) END AS padded,
  's' || CASE WHEN p_partkey < 100 THEN lpad(CAST(p_partkey AS VARCHAR), 2, '0') ELSE CAST(p_partkey AS VARCHAR) END AS padded_short,
  p_partkey || '_D' AS pasted, (p_name LIKE '%red%' OR p_name LIKE '%blue%') AS matched FROM part""",
    "F8_surrogate_key": """SELECT seq, 'sv' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0')
  ELSE CAST(n AS VARCHAR) END AS otu_id
FROM (SELECT seq, row_number() OVER (ORDER BY md5(seq)) AS n FROM (
  SELECT DISTINCT p_name || '#' || p_partkey AS seq FROM part))""",
    "F9_label_index": """SELECT subject_id, dense_rank() OVER (ORDER BY subject_id) AS idx
FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject_id FROM orders)""",
    "A1_hill_diversity": with_ctes(
        r.COUNTS, r.DIVERSITY, f'SELECT specimen_id2, {sql_r6(chr(34) + "D1" + chr(34))} AS "D1" FROM d1'
    ),
    "A2_sample_sums": """SELECT l_orderkey AS specimen_id2, CAST(sum(l_quantity) AS BIGINT) AS total_reads
FROM lineitem GROUP BY 1""",
    "A2_feature_sums": """SELECT l_partkey AS otu_id, CAST(sum(l_quantity) AS BIGINT) AS total_reads
FROM lineitem GROUP BY 1""",
    "W1_total_reads": with_ctes(
        r.COUNTS,
        "SELECT *, CAST(sum(read_count) OVER (PARTITION BY specimen_id2) AS BIGINT) AS total_reads FROM counts",
    ),
    "W9_baseline_diversity": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.DIVERSITY,
        _D1_ROWS,
        f"""SELECT subject_id, specimen_type, {sql_r6('"D1"')} AS "D1_start" FROM (
  SELECT *, rank() OVER (PARTITION BY subject_id, specimen_type ORDER BY study_day) AS pos FROM rows1) WHERE pos = 1""",
    ),
    "W4_lagged_response": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.DIVERSITY,
        _D1_ROWS,
        f"""SELECT {_KEYS}, {sql_r6('"D1"')} AS "D1", {sql_r6("before")} AS "D1_lag" FROM (
  SELECT *, lag("D1") OVER (PARTITION BY subject_id ORDER BY study_day, specimen_id2) AS before
  FROM rows1 WHERE specimen_type = 'F') WHERE before IS NOT NULL""",
    ),
    "W5_response_ratio": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.DIVERSITY,
        _D1_ROWS,
        f"""SELECT specimen_id2, {sql_r6('"D1" / before')} AS "D1_delta" FROM (
  SELECT *, lag("D1") OVER (PARTITION BY subject_id ORDER BY study_day, specimen_id2) AS before
  FROM rows1 WHERE specimen_type = 'O') WHERE before IS NOT NULL""",
    ),
    "O1_record_index": with_ctes(
        r.SAMPLES,
        """SELECT specimen_id2, row_number() OVER (
  PARTITION BY subject_id ORDER BY study_day, specimen_id2) AS record FROM samples""",
    ),
    "O2_first_per_key": with_ctes(
        r.SAMPLES,
        f"""SELECT {_KEYS} FROM (SELECT *, row_number() OVER (
  PARTITION BY subject_id ORDER BY study_day, specimen_id2) AS pos FROM samples) WHERE pos = 1""",
    ),
    "U4_distinct_rows": "SELECT DISTINCT o_custkey AS subject_id, o_orderstatus AS specimen_type FROM orders",
    "A4_genus_proportions": with_ctes(
        *_GENUS_BASE,
        f"""SELECT specimen_id2, "Genus", genus_reads, total_reads, {sql_r6("genus_prop")} AS genus_prop FROM genus""",
    ),
    "J12_genus_stain_join": with_ctes(
        *_GENUS_BASE,
        r.STAINS,
        """SELECT g.specimen_id2, g."Genus", g.genus_reads, s.stain
FROM genus g LEFT JOIN stains s ON s."Genus" IS NOT DISTINCT FROM g."Genus" """,
    ),
    "A5_stain_proportions": with_ctes(
        *_GENUS_BASE,
        r.STAINS,
        _STAIN,
        f"SELECT specimen_id2, stain, {sql_r6('stain_prop')} AS stain_prop FROM stain_props",
    ),
    "A6_taxon_proportion": with_ctes(
        *_GENUS_BASE,
        f"""SELECT specimen_id2, total_reads, genus_reads AS taxon_reads, {sql_r6("genus_prop")} AS taxon_prop
FROM genus WHERE "Genus" = 'Brand#7'""",
    ),
    "A6_starting_taxon": with_ctes(
        *_GENUS_BASE,
        r.SAMPLES,
        """found AS (SELECT s.subject_id, s.specimen_type, s.study_day, g.genus_prop
  FROM genus g JOIN samples s USING (specimen_id2) WHERE g."Genus" = 'Brand#7')""",
        f"""SELECT subject_id AS subjects, specimen_type, study_day, {sql_r6("genus_prop")} AS taxon_prop FROM (
  SELECT *, rank() OVER (PARTITION BY subject_id, specimen_type ORDER BY study_day) AS pos FROM found) WHERE pos = 1""",
    ),
    "N9_starting_stains": with_ctes(
        *_GENUS_BASE,
        r.STAINS,
        r.SAMPLES,
        _STAIN,
        """ranked AS (
  SELECT s.subject_id AS subjects, s.specimen_type, s.study_day, p.stain, p.stain_prop,
    rank() OVER (PARTITION BY s.subject_id, s.specimen_type ORDER BY s.study_day) AS pos
  FROM stain_props p JOIN samples s USING (specimen_id2)),
start AS (SELECT * EXCLUDE (pos) FROM ranked WHERE pos = 1),
grid AS (SELECT * FROM (SELECT DISTINCT subjects FROM start)
  CROSS JOIN (SELECT DISTINCT specimen_type FROM start) CROSS JOIN (SELECT DISTINCT stain FROM start))""",
        f"""SELECT g.subjects, g.specimen_type, g.stain, {sql_r6("coalesce(s.stain_prop, 0)")} AS stain_prop, s.study_day
FROM grid g LEFT JOIN start s ON s.subjects = g.subjects AND s.specimen_type = g.specimen_type
  AND s.stain IS NOT DISTINCT FROM g.stain""",
    ),
    "O5_dominant_taxon": with_ctes(
        *_GENUS_BASE,
        r.SAMPLES,
        """found AS (
  SELECT s.subject_id, s.specimen_type, g."Genus", g.genus_prop,
    rank() OVER (PARTITION BY s.subject_id, s.specimen_type ORDER BY s.study_day) AS day_pos
  FROM genus g JOIN samples s USING (specimen_id2) WHERE g."Genus" IS NOT NULL)""",
        f"""SELECT subject_id, specimen_type, "Genus" AS dominant_genus, {sql_r6("genus_prop")} AS dom_genus_prop FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, specimen_type ORDER BY genus_prop DESC, "Genus") AS pos
  FROM found WHERE day_pos = 1) WHERE pos = 1""",
    ),
    "N1_to_agglomerated": with_ctes(
        r.COUNTS,
        r.SAMPLES,
        r.TAXONOMY,
        """SELECT c.specimen_id2 AS specimen, c.otu_id AS feature, c.read_count AS n, s.subject_id,
  t."Kingdom", t."Genus"
FROM counts c LEFT JOIN samples s USING (specimen_id2) LEFT JOIN taxonomy t ON t.otu_id = c.otu_id
WHERE c.read_count > 0""",
    ),
    "N2_counts": with_ctes(r.COUNTS, "SELECT * FROM counts WHERE read_count > 0"),
    "N2_taxonomy": with_ctes(
        r.TAXONOMY, "SELECT * FROM taxonomy WHERE otu_id IN (SELECT l_partkey FROM lineitem)"
    ),
    "N2_samples": with_ctes(
        r.SAMPLES,
        f"SELECT {_KEYS} FROM samples WHERE specimen_id2 IN (SELECT l_orderkey FROM lineitem)",
    ),
    "N5_gather": """SELECT l_orderkey, l_linenumber, 'l_discount' AS key, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
    "R1_rarefy": with_ctes(r.COUNTS, *_rarefied("counts")),
    "R1_rarefy_distinct": with_ctes(r.COUNTS, *_rarefied_distinct("counts")),
    "R2_css_normalize": with_ctes(
        r.COUNTS,
        _scale("counts"),
        f"""SELECT c.specimen_id2, c.otu_id, {sql_r6("c.read_count / s.s::DOUBLE * 1000")} AS norm_count
FROM counts c JOIN scale s USING (specimen_id2)""",
    ),
    "R3_clean_scaled": with_ctes(
        *_CLEAN,
        "left_over AS (SELECT m.* FROM merged m WHERE m.specimen_id2 IN (SELECT specimen_id2 FROM exposed))",
        _scale("left_over"),
        f"""SELECT c.specimen_id2, c.otu_id, {sql_r6("c.read_count / s.s::DOUBLE * 1000")} AS read_count
FROM left_over c JOIN scale s USING (specimen_id2)""",
    ),
    "R3_clean_counts": with_ctes(
        *_CLEAN, "SELECT m.* FROM merged m WHERE m.specimen_id2 IN (SELECT specimen_id2 FROM exposed)"
    ),
    "R3_clean_samples": with_ctes(*_CLEAN, f"SELECT {_KEYS}, collection_date FROM exposed"),
    "R3_clean_rarefied": with_ctes(
        *_CLEAN,
        "final AS (SELECT m.* FROM merged m WHERE m.specimen_id2 IN (SELECT specimen_id2 FROM exposed))",
        *_rarefied("final"),
    ),
}
