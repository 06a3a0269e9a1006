"""Comparison of samples: one row per sample, cohort counts and outliers among samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import round2
from ..operators.records import Profile
from .rules import FINDINGS, STRUCTURE


METRICS = ("sequence_count", "total_length", "n50", "n90", "gc_percent", "n_percent", "duplicate_id_count", "invalid_sequence_count", "high_n_sequence_count", "tiny_contig_count", "max_gap_run", "gc_outlier_count", "length_outlier_count")


def overall(ready: DataFrame) -> DataFrame:
    """Per sample: categories with their status, in order, and all blockers by finding and category."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "category", "status", "blockers")))
    flat = F.flatten(F.transform(F.col("c"), lambda c: F.transform(c["blockers"], lambda b: F.struct(F.substring_index(b, ".", -1).alias("id"), c["ordinal"].alias("n"), b.alias("b")))))
    place = F.create_map(*(x for n, f in enumerate((*FINDINGS, STRUCTURE)) for x in (F.lit(f.id), F.lit(n))))
    ordered = F.array_sort(F.transform(flat, lambda x: F.struct(place[x["id"]].alias("at"), x["n"].alias("n"), x["b"].alias("b"))))
    per = ready.groupBy("sample_id").agg(rows.alias("c"))
    status = lambda c: F.concat(c["category"], F.lit(":"), c["status"])
    return per.select(
        "sample_id",
        F.transform("c", status).alias("readiness_categories"),
        F.map_from_entries(F.transform("c", lambda c: F.struct(c["category"], c["status"]))).alias("by_category"),
        F.transform(ordered, lambda x: x["b"]).alias("readiness_blockers"),
    )


def cohort_samples(summary: DataFrame, verdict: DataFrame, ready: DataFrame, tools: DataFrame, target: str | None = None) -> DataFrame:
    """The row of each sample in a comparison. Tables have neither path nor checksum: the path is
    the sample's name, the checksum empty."""
    gate = verdict.select("sample_id", "status", "top_findings")
    wide = summary.join(gate, "sample_id").join(overall(ready), "sample_id").join(tools, "sample_id")
    return wide.select(
        "sample_id", F.col("sample_id").alias("input_path"), F.col("status").alias("verdict"), F.col("status").alias("gate_status"),
        F.when(F.size("readiness_blockers") > 0, "FAIL").otherwise(F.col("status")).alias("readiness_status"),
        F.lit(target).cast("string").alias("submission_target"), F.col("by_category")["submission"].alias("submission_status"), "readiness_categories",
        *METRICS, F.size("top_findings").cast("long").alias("finding_count"), F.col("top_findings").alias("finding_ids"), "readiness_blockers",
        F.col("tools").alias("recommended_next_tools"), F.lit("").alias("input_sha256"),
    )


def cohort_summary(samples: DataFrame) -> DataFrame:
    """Counts by status and the worst gate status; one row."""
    rank = {"PASS": 0, "WARN": 1, "FAIL": 2}
    order = F.when(F.col("gate_status") == "FAIL", rank["FAIL"]).when(F.col("gate_status") == "WARN", rank["WARN"]).otherwise(rank["PASS"])
    worst = F.coalesce(F.max(order), F.lit(0))
    count = lambda c, s: F.count_if(F.col(c) == s)
    return samples.agg(
        F.count("*").alias("sample_count"),
        *(count("gate_status", s).alias(f"{s.lower()}_count") for s in rank),
        *(count("submission_status", s).alias(f"submission_{s.lower()}_count") for s in rank),
        F.element_at(F.array(*(F.lit(s) for s in rank)), worst + 1).alias("worst_status"),
    )


def cohort_outliers(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """sample_id, finding_id, value of samples that stand out by total length (quartile fences)
    or by GC (z-score); failed samples with zero values take part."""
    x = F.round(F.col("gc_percent") * 100, 0).cast("decimal(38,0)")
    stats = samples.agg(F.count("*").alias("n"), F.percentile("total_length", [0.25, 0.75]).alias("q"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    both = samples.select("sample_id", "total_length", "gc_percent").crossJoin(F.broadcast(stats))  # stats is one row
    n = F.col("n").cast("double")
    mean, sd = F.col("s1").cast("double") / n / 100.0, F.sqrt((F.col("n").cast("decimal(20,0)") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (n * n) / 10000.0)
    z = F.abs(F.col("gc_percent") - mean) / F.nullif(sd, F.lit(0.0))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    iqr = q3 - q1
    far = (F.col("n") >= 4) & (iqr > 0) & ((F.col("total_length") < q1 - p.iqr_multiplier * iqr) | (F.col("total_length") > q3 + p.iqr_multiplier * iqr))
    odd = (F.col("n") >= 3) & (z >= p.cohort_gc_zscore)
    hit = F.array(
        F.when(far, F.struct(F.lit("cohort_total_length_outliers").alias("finding_id"), F.col("total_length").cast("double").alias("value"))),
        F.when(odd, F.struct(F.lit("cohort_gc_outliers").alias("finding_id"), F.col("gc_percent").alias("value"))),
    )
    return both.select("sample_id", F.explode(F.filter(hit, lambda h: h.isNotNull())).alias("h")).select("sample_id", "h.finding_id", round2(F.col("h.value")).alias("value"))
