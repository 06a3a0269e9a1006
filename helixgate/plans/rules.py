"""Findings: fixed rules over a sample's summary, with evidence from its flagged records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import records as R

EVIDENCE_LIMIT = 20


@dataclass(frozen=True)
class Finding:
    id: str
    severity: str
    category: str
    confidence: str
    needs_followup: bool
    message: str
    reason: str


#: Findings in the order in which they are reported.
FINDINGS = (
    Finding("duplicate_ids", "critical", "duplication", "high", False, "record ids occur more than once", "id was used by an earlier record"),
    Finding("duplicate_first_token_ids", "critical", "duplication", "high", False, "first header words occur more than once", "first header word was used by an earlier record"),
    Finding("unsafe_ids", "major", "validity", "moderate", False, "record ids hold characters that paths or tables may not bear", "unsafe characters in the id"),
    Finding("long_headers", "minor", "validity", "moderate", False, "headers exceed the usual length limit", "long header"),
    Finding("reserved_header_chars", "minor", "validity", "moderate", False, "headers hold characters that tools reserve", "reserved characters in the header"),
    Finding("invalid_chars", "critical", "validity", "high", False, "records hold symbols outside the nucleotide alphabet", "invalid symbols"),
    Finding("high_n_rate", "major", "composition", "high", False, "too many bases are unknown (N)", "share of N above the limit"),
    Finding("tiny_contigs", "minor", "structure", "moderate", False, "records are shorter than the least length", "short record"),
    Finding("gap_runs", "major", "structure", "high", False, "runs of N exceed the longest allowed gap", "long run of N"),
    Finding("terminal_ns", "major", "structure", "moderate", False, "records begin or end with N", "N at an end"),
    Finding("gap_pattern_warnings", "minor", "structure", "moderate", False, "runs of exactly 100 N look like scaffold gaps", "run of exactly 100 N"),
    Finding("expected_size_outlier", "major", "structure", "moderate", True, "length without gaps is far from the expected size", ""),
    Finding("duplicate_sequences", "minor", "duplication", "high", False, "sequences occur more than once", "sequence was given by an earlier record"),
    Finding("gc_outliers", "major", "composition", "moderate", True, "GC content of records is far from the sample's", "GC outlier"),
    Finding("length_outliers", "minor", "structure", "moderate", False, "lengths of records are far from the sample's", "length outlier"),
    Finding("composite_anomalies", "major", "composition", "moderate", True, "records show several unusual signs at once", "several signs"),
)
STRUCTURE = Finding("invalid_fasta_structure", "critical", "validity", "high", False, "the file is not valid FASTA", "")
COHORT = ("cohort_total_length_outliers", "cohort_gc_outliers")
BY_ID = {f.id: f for f in (*FINDINGS, STRUCTURE)}


def _affected(p: R.Profile) -> dict[str, tuple[Column, Column]]:
    """id -> (trigger, affected count) over summary columns."""
    c = F.col
    some = lambda name: (c(name) > 0, c(name))
    global_n = (c("global_n_fraction") > 0) & (c("global_n_fraction") >= p.high_n_global)
    size = F.lit(False)
    if p.expected_size is not None:
        low, high = p.expected_size * (1 - p.expected_tolerance), p.expected_size * (1 + p.expected_tolerance)
        size = (c("ungapped_total_length").cast("double") < low) | (c("ungapped_total_length").cast("double") > high)
    return {
        "duplicate_ids": some("duplicate_id_count"),
        "duplicate_first_token_ids": some("duplicate_first_token_id_count"),
        "unsafe_ids": some("unsafe_id_count"),
        "long_headers": some("long_header_count"),
        "reserved_header_chars": some("reserved_header_char_count"),
        "invalid_chars": some("invalid_sequence_count"),
        "high_n_rate": (global_n | (c("high_n_sequence_count") > 0), F.when(c("high_n_sequence_count") > 0, c("high_n_sequence_count")).otherwise(c("sequence_count"))),
        "tiny_contigs": some("tiny_contig_count"),
        "gap_runs": (c("max_gap_run") > p.max_gap_run, F.greatest(c("long_gap_sequence_count"), F.lit(1))),
        "terminal_ns": some("terminal_n_sequence_count"),
        "gap_pattern_warnings": some("gap_pattern_sequence_count"),
        "expected_size_outlier": (size, F.lit(1)),
        "duplicate_sequences": some("duplicate_sequence_count"),
        "gc_outliers": some("gc_outlier_count"),
        "length_outliers": some("length_outlier_count"),
        "composite_anomalies": some("composite_anomaly_count"),
    }


def _predicates(p: R.Profile) -> dict[str, Column]:
    """id -> which flagged records are its evidence."""
    return {
        "duplicate_ids": F.col("duplicate_id"),
        "duplicate_first_token_ids": F.col("duplicate_first_token_id"),
        "unsafe_ids": F.col("unsafe_id"),
        "long_headers": F.col("long_header"),
        "reserved_header_chars": F.col("reserved_header_chars"),
        "invalid_chars": F.col("invalid_count") > 0,
        "high_n_rate": R.high_n(p),
        "tiny_contigs": R.tiny(p),
        "gap_runs": R.long_gap(p),
        "terminal_ns": R.terminal_n(),
        "gap_pattern_warnings": F.col("gap_run_100_count") > 0,
        "duplicate_sequences": F.col("duplicate_sequence"),
        "gc_outliers": F.col("gc_outlier"),
        "length_outliers": F.col("length_outlier"),
        "composite_anomalies": F.col("composite_anomaly"),
    }


def findings(summary: DataFrame, p: R.Profile = R.Profile()) -> DataFrame:
    """sample_id, position, finding_id, severity, category, confidence, needs_followup, affected
    records and their share: one row per finding that a sample shows."""
    rules = _affected(p)
    rows = []
    for n, f in enumerate(FINDINGS):
        trigger, count = rules[f.id]
        one = F.struct(
            F.lit(n).alias("position"), F.lit(f.id).alias("finding_id"), F.lit(f.severity).alias("severity"), F.lit(f.category).alias("category"),
            F.lit(f.confidence).alias("confidence"), F.lit(f.needs_followup).alias("needs_followup"), count.cast("long").alias("affected_count"),
        )
        rows.append(F.when(trigger, one))
    long = summary.select("sample_id", "sequence_count", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f"))
    share = F.when(F.col("f.finding_id") == "expected_size_outlier", F.lit(1.0)).otherwise(F.col("f.affected_count").cast("double") / F.col("sequence_count"))
    return long.select("sample_id", "f.*", share.alias("affected_fraction"))


def signals(p: R.Profile) -> Column:
    """Signs of a composite anomaly, in order."""
    return F.filter(
        F.array(
            F.when(F.col("gc_outlier"), "gc_outlier"), F.when(R.high_n(p), "high_n"), F.when(F.col("length_outlier"), "length_outlier"),
            F.when(F.col("duplicate_sequence"), "duplicate_sequence"), F.when(F.col("invalid_count") > 0, "invalid_chars"), F.when(R.long_gap(p), "gap_run"),
        ),
        lambda s: s.isNotNull(),
    )


def evidence(rows: DataFrame, found: DataFrame, p: R.Profile = R.Profile(), limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """The first ``limit`` records of each finding in record order, one row per record. A sample
    with a high overall N rate and no such record shows its first records."""
    which = _predicates(p)
    tags = F.filter(F.array(*(F.when(cond, F.lit(k)) for k, cond in which.items()), F.lit("high_n_rate/all")), lambda t: t.isNotNull())
    # per sample the tags that its findings ask for, 16 at most: only their records are ranked
    high = rows.groupBy("sample_id").agg(F.count_if(R.high_n(p)).alias("__high"))
    tag = F.when((F.col("finding_id") == "high_n_rate") & (F.col("__high") == 0), F.lit("high_n_rate/all")).otherwise(F.col("finding_id"))
    asked = found.where(F.col("finding_id").isin(*which)).join(high, "sample_id").groupBy("sample_id").agg(F.collect_set(tag).alias("__asked"))
    shown = rows.join(asked, "sample_id").select(
        "sample_id", "record_idx", "id", "length", "invalid_count", "max_gap_run", "gc_percent", "gc_zscore", "n_fraction", "terminal_n_prefix", "terminal_n_suffix",
        signals(p).alias("signals"), F.explode(F.array_intersect(tags, "__asked")).alias("tag"),
    )
    w = W.partitionBy("sample_id", "tag").orderBy("record_idx")
    first = shown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return first.withColumn("finding_id", F.regexp_replace("tag", "/all$", "")).drop("tag")
