"""Verdicts, gates, readiness and follow-up: set logic over the findings of each sample."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guidance import GUIDANCE
from .rules import BY_ID, COHORT, FINDINGS, STRUCTURE

#: Findings on which each gate fails.
PIPELINE = ("duplicate_first_token_ids", "duplicate_ids", "high_n_rate", "invalid_chars", "invalid_fasta_structure")
GENERIC = ("duplicate_first_token_ids", "duplicate_ids", "invalid_chars", "invalid_fasta_structure", "unsafe_ids")
NCBI = (*GENERIC, "reserved_header_chars")
GATES = {("none", None): (), ("pipeline", None): PIPELINE, ("submission", "generic"): GENERIC, ("submission", "ncbi"): NCBI}

#: Readiness categories in order, and those that a finding touches.
CATEGORIES = ("file", "structure", "alphabet", "index", "assembly", "submission", "machine")
_INDEX, _ASSEMBLY = ("index", "submission"), ("assembly", "submission")
TOUCHES = {
    "invalid_fasta_structure": ("file", "structure", "submission"),
    "invalid_chars": ("alphabet", "submission"),
    "duplicate_ids": _INDEX,
    "duplicate_first_token_ids": _INDEX,
    "unsafe_ids": _INDEX,
    "long_headers": _INDEX,
    "reserved_header_chars": _INDEX,
    "terminal_ns": _ASSEMBLY,
    "gap_pattern_warnings": _ASSEMBLY,
    "gap_runs": _ASSEMBLY,
    "high_n_rate": _ASSEMBLY,
    "tiny_contigs": _ASSEMBLY,
    "gc_outliers": ("assembly",),
    "length_outliers": ("assembly",),
    "composite_anomalies": ("assembly",),
    "expected_size_outlier": ("assembly",),
}

#: Routing hints of findings as (condition, route, needs an external database).
_DEDUP = (("duplication_issue", "deduplicate_or_rename_records", False),)
_FIX = ("submission_readiness_failure", "fix_fasta_before_official_validation", False)
_HEADERS = (("header_compatibility_warning", "review_headers_before_database_or_submission", False), _FIX)
_REPAIR = (("validity_failure", "repair_fasta_before_downstream_qc", False),)
_GAPS = (("assembly_ambiguity", "gap_closing_or_polishing_review", False),)
_ENDS = (("submission_readiness_warning", "review_gap_and_terminal_n_patterns", False),)
_TRIAGE = (("composition_anomaly", "contamination_or_cobiont_triage", True),)
HINTS = {
    "duplicate_ids": _DEDUP,
    "duplicate_sequences": _DEDUP,
    "duplicate_first_token_ids": (("index_readiness_failure", "rename_records_before_indexing", False), _FIX),
    "unsafe_ids": _HEADERS,
    "long_headers": _HEADERS,
    "reserved_header_chars": _HEADERS,
    "invalid_chars": _REPAIR,
    "invalid_fasta_structure": _REPAIR,
    "high_n_rate": _GAPS,
    "gap_runs": _GAPS,
    "terminal_ns": _ENDS,
    "gap_pattern_warnings": _ENDS,
    "expected_size_outlier": (("expected_size_warning", "run_submission_or_contamination_followup", True),),
    "tiny_contigs": (("small_record_review", "review_or_filter_short_records", False),),
    "length_outliers": (("length_outlier", "record_length_review", False),),
    "gc_outliers": _TRIAGE,
    "composite_anomalies": _TRIAGE,
}

#: Actions of findings as (action, tool, needs an external database).
_RENAME, _NORMAL = (("rename_records", "seqkit", False),), (("normalize_headers", "seqkit", False),)
_INSPECT = ("inspect_records", "seqkit", False)
ACTIONS = {
    "duplicate_ids": _RENAME,
    "duplicate_first_token_ids": _RENAME,
    "unsafe_ids": _NORMAL,
    "long_headers": _NORMAL,
    "reserved_header_chars": _NORMAL,
    "invalid_chars": (("correct_symbols", "seqkit", False),),
    "high_n_rate": (_INSPECT, ("run_assembly_qc", "QUAST", False)),
    "tiny_contigs": (("filter_or_review_records", "seqkit", False),),
    "gap_runs": (("inspect_gap_regions", "QUAST", False),),
    "terminal_ns": (("review_terminal_ns", "seqkit", False),),
    "gap_pattern_warnings": (("review_gap_patterns", "QUAST", False),),
    "expected_size_outlier": (("review_expected_size", "NCBI expected genome size check", True),),
    "duplicate_sequences": (("deduplicate_or_confirm", "seqkit", False),),
    "gc_outliers": (("inspect_records", "BlobToolKit", True), ("compare_kmers_or_taxonomy", "sourmash", True)),
    "length_outliers": (_INSPECT,),
    "composite_anomalies": (("prioritize_records", "BlobToolKit", True),),
    "invalid_fasta_structure": (("repair_fasta_structure", "parser-aware cleanup script", False),),
}
PASS_TOOLS = ("QUAST", "BUSCO", "BlobToolKit")
VALIDATOR_FINDINGS = ("duplicate_first_token_ids", "unsafe_ids", "long_headers", "reserved_header_chars", "terminal_ns", "gap_pattern_warnings")
SCREEN_FINDINGS = ("high_n_rate", "gap_runs")


def fail_on(gate: str = "none", target: str | None = None, explicit: Iterable[str] = ()) -> list[str]:
    """Sorted union of the gate's findings and those named, each of which may be a comma list."""
    if gate == "submission":
        target = target or "generic"
    preset = GATES.get((gate, target if gate == "submission" else None))
    if preset is None:
        raise ValueError(f"unknown gate: {gate} {target or ''}".strip())
    named = {x.strip() for e in explicit for x in e.split(",")} - {""}
    return sorted(named | set(preset))


def _blocking(rules: list[str]) -> Column:
    return (F.col("severity") == "critical") | F.col("finding_id").isin(*rules) if rules else F.col("severity") == "critical"


def _ids(cond: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.when(cond, F.struct("position", "finding_id"))))
    return F.transform(rows, lambda r: r["finding_id"])


def verdicts(samples: DataFrame, found: DataFrame, rules: list[str]) -> DataFrame:
    """Per sample (all of ``samples``): status, reasons, blocking and advisory findings."""
    block = _blocking(rules)
    per = found.groupBy("sample_id").agg(_ids(F.lit(True)).alias("all"), _ids(block).alias("blocking_findings"), _ids(~block).alias("advisory_findings"))
    none = F.array().cast("array<string>")
    rows = samples.select("sample_id").join(per, "sample_id", "left")
    full = rows.select("sample_id", *(F.coalesce(c, none).alias(c) for c in ("all", "blocking_findings", "advisory_findings")))
    status = F.when(F.size("blocking_findings") > 0, "FAIL").when(F.size("all") > 0, "WARN").otherwise("PASS")
    return full.select(
        "sample_id",
        status.alias("status"),
        F.when(status == "FAIL", F.col("blocking_findings")).otherwise(F.col("all")).alias("reasons"),
        "blocking_findings",
        "advisory_findings",
        F.col("all").alias("top_findings"),
        (status == "PASS").alias("safe_for_downstream"),
    )


def _touch(ids: Iterable[str]) -> Column:
    m = F.create_map(*(x for k in ids for x in (F.lit(k), F.array(*(F.lit(c) for c in TOUCHES.get(k, ("machine",)))))))
    return F.coalesce(m[F.col("finding_id")], F.array(F.lit("machine")))


def readiness(samples: DataFrame, found: DataFrame, rules: list[str]) -> DataFrame:
    """sample_id, ordinal, category, status, blockers: seven rows per sample."""
    hit = found.withColumn("category_id", F.explode(_touch(BY_ID))).withColumn("block", _blocking(rules))
    per = hit.groupBy("sample_id", "category_id").agg(
        F.max("block").alias("failed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("block"), F.struct("position", "finding_id")))), lambda r: r["finding_id"]).alias("ids"),
    )
    every = samples.select("sample_id", F.posexplode(F.array(*(F.lit(c) for c in CATEGORIES))).alias("ordinal", "category_id"))
    out = every.join(per, ["sample_id", "category_id"], "left")
    status = F.when(F.col("failed"), "FAIL").when(F.col("failed").isNotNull(), "WARN").otherwise("PASS")
    blockers = F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.concat(F.col("category_id"), F.lit("."), i))
    return out.select("sample_id", "ordinal", F.col("category_id").alias("category"), status.alias("status"), blockers.alias("blockers"))


def _per_finding(found: DataFrame, table: dict, fields: tuple[str, ...]) -> DataFrame:
    """One row per sample, finding and entry of a small fixed table."""
    values = [F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, row))) for row in rows)) for rows in table.values()]
    m = F.create_map(*(x for k, v in zip(table, values) for x in (F.lit(k), v)))
    return found.select("sample_id", "position", "finding_id", F.posexplode(m[F.col("finding_id")]).alias("nth", "e")).select("sample_id", "position", "finding_id", "nth", "e.*")


def actions(found: DataFrame) -> DataFrame:
    return _per_finding(found, ACTIONS, ("action_type", "recommended_tool", "requires_external_database"))


def routing_hints(found: DataFrame) -> DataFrame:
    """Distinct hints of each sample in the order in which findings first ask for them."""
    rows = _per_finding(found, HINTS, ("condition", "suggested_route", "requires_external_database"))
    keys = ["sample_id", "condition", "suggested_route", "requires_external_database"]
    first = rows.groupBy(*keys).agg(F.min(F.col("position") * 10 + F.col("nth")).alias("first_position"))
    return first.select(*keys, "first_position")


def recommended_tools(samples: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, tools: in order, each once. Samples without findings get the standard three."""
    rows = actions(found)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", "nth", c))), lambda r: r[c])
    per = rows.groupBy("sample_id").agg(
        ordered("recommended_tool").alias("t"),
        F.max(F.col("finding_id").isin(*VALIDATOR_FINDINGS)).alias("validator"),
        F.max(F.col("finding_id").isin(*SCREEN_FINDINGS)).alias("screen"),
    )
    none = F.array().cast("array<string>")
    more = F.concat(F.when(F.col("validator"), F.array(F.lit("official submission validator"))).otherwise(none), F.when(F.col("screen"), F.array(F.lit("NCBI FCS"))).otherwise(none))
    return samples.select("sample_id").join(per, "sample_id", "left").select(
        "sample_id", F.when(F.col("t").isNull(), F.array(*(F.lit(t) for t in PASS_TOOLS))).otherwise(F.array_distinct(F.concat("t", more))).alias("tools")
    )


def catalog(spark: SparkSession) -> DataFrame:
    """All findings with their fixed properties and first action."""
    rows = [(n, f.id, f.severity, f.category, f.confidence, f.needs_followup, ACTIONS[f.id][0][0]) for n, f in enumerate((*FINDINGS, STRUCTURE))]
    return spark.createDataFrame(rows, "position int, finding_id string, severity string, category string, confidence string, needs_followup boolean, first_action string")


#: What follows a cohort finding, as in ACTIONS, and whether it needs another tool.
COHORT_ACTIONS = {
    "cohort_total_length_outliers": ("review_cohort_length_distribution", "structure", "moderate", False),
    "cohort_gc_outliers": ("review_cohort_gc_distribution", "composition", "moderate", True),
}


def suggested(finding_id: str) -> list[dict]:
    """The actions of a finding as reports give them."""
    g = GUIDANCE[finding_id]
    if finding_id in COHORT:
        return [{"action_type": COHORT_ACTIONS[finding_id][0], "target": g.target, "reason": g.reason, "recommended_tool": "helixgate compare", "requires_external_database": False}]
    return [{"action_type": a, "target": g.target, "reason": g.reason, "recommended_tool": tool, "requires_external_database": db} for a, tool, db in ACTIONS[finding_id]]


def explain(finding_id: str) -> dict:
    """What the catalog says of one finding."""
    if finding_id not in GUIDANCE:
        raise KeyError(f"unknown finding: {finding_id}")
    g = GUIDANCE[finding_id]
    if finding_id in COHORT:
        _, category, confidence, follow = COHORT_ACTIONS[finding_id]
        fixed = {"severity": "minor", "category": category, "confidence": confidence, "needs_followup": follow, "scope": "cohort", "message": "samples stand out from the others"}
        more = {}
    else:
        f = BY_ID[finding_id]
        fixed = {"severity": f.severity, "category": f.category, "confidence": f.confidence, "needs_followup": f.needs_followup, "scope": "sample", "message": f.message}
        more = {
            "readiness": list(TOUCHES.get(f.id, ("machine",))),
            "routing_hints": [dict(zip(("condition", "suggested_route", "requires_external_database"), h)) for h in HINTS[f.id]],
        }
    return {
        "id": finding_id, **fixed, "profile": "assembly", "verdict_effect": "fail" if fixed["severity"] == "critical" else "warn", "meaning": g.meaning, "why_it_matters": g.why,
        "evidence_fields": list(g.evidence), "actions": suggested(finding_id), "cannot_conclude": list(g.cannot_conclude), **more,
    }
