"""Whole reports: one for each file or sample, and one for a cohort.

Executors do all work on records; the driver receives a row per sample, a finding list and at most
20 evidence records per finding, and 5000 plot points, and puts the nested report together.
"""

from __future__ import annotations

import os
import time
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import utc_seconds
from ..operators import records as R
from ..sources.fasta import file_fingerprints, read_fasta
from ..store import store
from . import cohort, policy, rules

SCHEMA_VERSION = "0.5.0"
TOOL = {"name": "helixgate", "version": "0.1.0"}
RANK = {"PASS": 0, "WARN": 1, "FAIL": 2}
SUMMARY = (
    "sequence_count", "total_length", "min_length", "max_length", "mean_length", "median_length", "n50", "n90", "l50", "l90", "gc_percent", "at_percent", "n_percent",
    "ambiguity_percent", "duplicate_id_count", "duplicate_first_token_id_count", "duplicate_sequence_count", "unsafe_id_count", "long_header_count",
    "reserved_header_char_count", "invalid_sequence_count", "high_n_sequence_count", "tiny_contig_count", "terminal_n_sequence_count",
    "repeated_gap_pattern_sequence_count", "max_gap_run", "ungapped_total_length",
)
FLOATS = {"mean_length", "median_length", "gc_percent", "at_percent", "n_percent", "ambiguity_percent"}
SCOPE = {
    "checks": ["structure and alphabet", "identifiers and headers", "lengths, gaps and composition", "duplicates and outliers"],
    "does_not": ["search for contamination", "judge completeness", "compare with a reference genome", "replace official validation"],
}


@dataclass(frozen=True)
class Config:
    profile: R.Profile = R.Profile()
    gate: str = "none"
    submission_target: str | None = None
    fail_on: tuple[str, ...] = ()
    threads: int = 1
    command: str = ""
    timestamp: str | None = field(default_factory=lambda: os.environ.get("HELIXGATE_TIMESTAMP"))

    def __post_init__(self):
        if self.threads < 1:
            raise ValueError("threads must be at least 1")
        policy.fail_on(self.gate, self.submission_target, self.fail_on)

    @property
    def target(self) -> str | None:
        return self.submission_target or ("generic" if self.gate == "submission" else None)

    @property
    def rules(self) -> list[str]:
        return policy.fail_on(self.gate, self.target if self.gate == "submission" else None, self.fail_on)


def _evidence_record(row, finding_id: str) -> dict:
    """The fields that matter for a finding; empty ones are left out."""
    out = {"id": row["id"], "length": row["length"], "reason": rules.BY_ID[finding_id].reason}
    if finding_id == "invalid_chars":
        out["invalid_count"] = row["invalid_count"]
    if finding_id in ("gap_runs", "gap_pattern_warnings"):
        out["max_gap_run"] = row["max_gap_run"]
    if finding_id in ("tiny_contigs", "gc_outliers", "length_outliers", "composite_anomalies"):
        out["gc_percent"] = row["gc_percent"]
    if finding_id in ("gc_outliers", "length_outliers", "composite_anomalies") and row["gc_zscore"] is not None:
        out["gc_zscore"] = row["gc_zscore"]
    if finding_id in ("high_n_rate", "terminal_ns", "gc_outliers", "length_outliers", "composite_anomalies"):
        out["n_fraction"] = row["n_fraction"]
        out["n_percent"] = float(f"{row['n_fraction'] * 100:.2f}")
    signs = {
        "unsafe_ids": ["unsafe_id"] if row["unsafe_id"] else [],
        "long_headers": [s for s in ("long_header", "reserved_header_chars") if row[s]],
        "reserved_header_chars": [s for s in ("long_header", "reserved_header_chars") if row[s]],
        "terminal_ns": [f"{s}={row[s]}" for s in ("terminal_n_prefix", "terminal_n_suffix") if row[s]],
        "gap_pattern_warnings": [f"gap_run_100_count={row['gap_run_100_count']}"],
        "composite_anomalies": row["signals"],
    }.get(finding_id)
    return out | ({"signals": list(signs)} if signs else {})


def _finding(f, evidence: list[dict]) -> dict:
    known = rules.BY_ID[f["finding_id"]]
    return {
        "id": known.id, "severity": known.severity, "category": known.category, "confidence": known.confidence, "needs_followup": known.needs_followup,
        "message": f"{f['affected_count']}: {known.message}", "affected_count": f["affected_count"], "affected_fraction": f["affected_fraction"],
        "evidence": {"total_records": 0 if known.id == "expected_size_outlier" else f["affected_count"], "truncated": known.id != "expected_size_outlier" and f["affected_count"] > len(evidence), "records": evidence},
        "actions": policy.suggested(known.id),
    }


def reports(records: DataFrame, config: Config = Config(), points: int = 5000) -> dict[str, dict]:
    """sample_id -> report, from records of any number of samples in one set of jobs."""
    p = config.profile
    rows = R.flagged(records, p)
    summary = store(R.summary(rows, p), "summary")
    found = store(rules.findings(summary, p), "findings")
    verdicts = {r["sample_id"]: r for r in policy.verdicts(summary, found, config.rules).collect()}
    ready, tools, hints, listed, shown, bins, plot = (defaultdict(list) for _ in range(7))
    for r in policy.readiness(summary, found, config.rules).collect():
        ready[r["sample_id"]].append(r)
    for r in policy.recommended_tools(summary, found).collect():
        tools[r["sample_id"]] = list(r["tools"])
    for r in policy.routing_hints(found).collect():
        hints[r["sample_id"]].append(r)
    for r in found.collect():
        listed[r["sample_id"]].append(r)
    for r in rules.evidence(rows, found, p).join(rows.select("sample_id", "record_idx", "unsafe_id", "long_header", "reserved_header_chars", "gap_run_100_count"), ["sample_id", "record_idx"]).collect():
        shown[r["sample_id"], r["finding_id"]].append(r)
    for r in R.length_histogram(rows).collect():
        bins[r["sample_id"]].append(r)
    for r in R.gc_length_points(rows, p, points).collect():
        plot[r["sample_id"]].append(r)
    out = {}
    for s in summary.collect():
        name = s["sample_id"]
        v = verdicts[name]
        values = {k: s["gap_pattern_sequence_count" if k.startswith("repeated") else k] for k in SUMMARY}
        findings = [_finding(f, [_evidence_record(e, f["finding_id"]) for e in sorted(shown[name, f["finding_id"]], key=lambda e: e["rank"])]) for f in sorted(listed[name], key=lambda f: f["position"])]
        plots = {
            "length_histogram": [{k: b[k] for k in ("start", "end", "record_count", "total_length")} for b in sorted(bins[name], key=lambda b: b["bin"])],
            "gc_length": [{"id": x["id"], "length": x["length"], "gc_percent": x["gc_percent"], "flags": list(x["flags"])} for x in sorted(plot[name], key=lambda x: x["rank"])],
        }
        out[name] = _report(name, config, v, sorted(ready[name], key=lambda r: r["ordinal"]), tools[name], sorted(hints[name], key=lambda h: h["first_position"]), values, plots, findings)
    return out


def _report(name, config, v, ready, tools, hints, values, plots, findings) -> dict:
    p = config.profile
    blockers = [b for r in ready for b in r["blockers"]]
    order = {f["id"]: n for n, f in enumerate(findings)}
    categories = [{"id": r["category"], "status": r["status"], "blockers": list(r["blockers"])} | ({"target": config.target} if r["category"] == "submission" and config.target else {}) for r in ready]
    return {
        "schema_version": SCHEMA_VERSION,
        "tool": TOOL,
        "input": {"path": name, "profile": p.name},
        "verdict": {"status": v["status"], "reasons": list(v["reasons"])},
        "gate": {"mode": config.gate, "submission_target": config.target, "status": v["status"], "fail_on": config.rules, "blocking_findings": list(v["blocking_findings"]), "advisory_findings": list(v["advisory_findings"])},
        "readiness": {"status": "FAIL" if blockers else v["status"], "blockers": sorted(blockers, key=lambda b: order.get(b.partition(".")[2], 0)), "categories": categories},
        "machine_summary": {
            "safe_for_downstream": v["status"] == "PASS",
            "top_findings": list(v["top_findings"]),
            "recommended_next_tools": tools,
            "routing_hints": [{k: h[k] for k in ("condition", "suggested_route", "requires_external_database")} for h in hints],
        },
        "scope": SCOPE,
        "provenance": {
            "command": config.command or os.environ.get("HELIXGATE_COMMAND", ""),
            "threads": config.threads,
            "fail_on": config.rules,
            "thresholds": {k: x for k, x in asdict(p).items() if k not in ("name", "expected_size")},
        },
        "summary": values,
        "plots": plots,
        "findings": findings,
    }


def _invalid(name: str, message: str, config: Config) -> dict:
    """The report of a file that is not FASTA: one critical finding and zero values."""
    f = {"finding_id": rules.STRUCTURE.id, "affected_count": 0, "affected_fraction": 0.0}
    hit = policy.TOUCHES[rules.STRUCTURE.id]
    ready = [{"category": c, "status": "FAIL" if c in hit else "PASS", "blockers": [f"{c}.{rules.STRUCTURE.id}"] if c in hit else []} for c in policy.CATEGORIES]
    v = {"status": "FAIL", "reasons": [rules.STRUCTURE.id], "blocking_findings": [rules.STRUCTURE.id], "advisory_findings": [], "top_findings": [rules.STRUCTURE.id]}
    hints = [dict(zip(("condition", "suggested_route", "requires_external_database"), h)) for h in policy.HINTS[rules.STRUCTURE.id]]
    zero = {k: 0.0 if k in FLOATS else 0 for k in SUMMARY}
    out = _report(name, config, v, ready, [a[1] for a in policy.ACTIONS[rules.STRUCTURE.id]], hints, zero, {"length_histogram": [], "gc_length": []}, [_finding(f, [])])
    out["findings"][0]["message"] = message
    return out


def check(spark: SparkSession, paths: list[str] | str, config: Config = Config()) -> dict[str, dict]:
    """path -> report for FASTA files; files with structural errors get a failing report."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    began, started = time.monotonic(), utc_seconds(config.timestamp)
    records, problems = read_fasta(spark, paths)
    bad = {r["path"]: r for r in problems.collect()}
    names = {p: n for p, n in _sample_ids(spark, paths)}
    if len(set(names.values())) < len(paths):
        raise ValueError("two inputs have the same sample name")
    made = reports(records, config) if len(bad) < len(paths) else {}
    prints = {r["path"]: r for r in file_fingerprints(spark, paths).collect()}
    out = {}
    for p in paths:
        report = _invalid(names[p], bad[p]["message"], config) if p in bad else made[names[p]]
        known = next((v for k, v in prints.items() if k == p or k.endswith("/" + p.lstrip("/"))), None)
        report["input"] = {"path": p, "profile": config.profile.name}
        report["provenance"] |= {
            "started_at": started,
            "duration_ms": 0 if config.timestamp else int((time.monotonic() - began) * 1000),
            "input_bytes": known["bytes"] if known else 0,
            "input_sha256": known["sha256"] if known else "",
        }
        out[p] = report
    return out


def _sample_ids(spark: SparkSession, paths: list[str]):
    from ..functions.naming import sample_id

    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", sample_id(F.col("path")).alias("s"))
    return [(r["path"], r["s"]) for r in df.collect()]


def _worst(statuses) -> str:
    return max(statuses, key=RANK.__getitem__, default="PASS")


def compare(spark: SparkSession, paths: list[str], config: Config = Config()) -> dict:
    """The cohort report over two files or more, in the order given."""
    if len(paths) < 2:
        raise ValueError("a comparison needs at least two inputs")
    names = dict(_sample_ids(spark, paths))
    samples = []
    for path, r in check(spark, paths, config).items():
        s = r["summary"]
        submission = next(c for c in r["readiness"]["categories"] if c["id"] == "submission")
        count = {f["id"]: f["affected_count"] for f in r["findings"]}
        samples.append(
            {
                "sample_id": names[path], "input_path": path, "verdict": r["verdict"]["status"], "gate_status": r["gate"]["status"], "readiness_status": r["readiness"]["status"],
                "submission_target": config.target, "submission_status": submission["status"], "readiness_categories": r["readiness"]["categories"],
                **{k: s[k] for k in ("sequence_count", "total_length", "n50", "n90", "gc_percent", "n_percent", "duplicate_id_count", "invalid_sequence_count", "high_n_sequence_count", "tiny_contig_count", "max_gap_run")},
                "gc_outlier_count": count.get("gc_outliers", 0), "length_outlier_count": count.get("length_outliers", 0), "finding_count": len(r["findings"]),
                "finding_ids": [f["id"] for f in r["findings"]], "readiness_blockers": r["readiness"]["blockers"], "recommended_next_tools": r["machine_summary"]["recommended_next_tools"],
                "input_sha256": r["provenance"]["input_sha256"],
            }
        )
    tally = lambda k, v: sum(s[k] == v for s in samples)
    frame = spark.createDataFrame([(s["sample_id"], s["total_length"], float(s["gc_percent"])) for s in samples], "sample_id string, total_length long, gc_percent double")
    odd = defaultdict(list)
    for r in cohort.cohort_outliers(frame, config.profile).collect():
        odd[r["finding_id"]].append(r)
    place = {s["sample_id"]: n for n, s in enumerate(samples)}
    value = {"cohort_total_length_outliers": ("total_length", int), "cohort_gc_outliers": ("gc_percent", float)}
    findings = [
        {
            "id": k, "severity": "minor", "affected_count": len(odd[k]),
            "evidence": [{"sample_id": r["sample_id"], value[k][0]: value[k][1](r["value"]), "reason": "unlike the other samples"} for r in sorted(odd[k], key=lambda r: place[r["sample_id"]])],
        }
        for k in rules.COHORT if odd[k]
    ]
    return {
        "schema_version": SCHEMA_VERSION,
        "report_type": "compare",
        "tool": TOOL,
        "input": {"profile": config.profile.name, "sample_count": len(samples)},
        "summary": {
            "sample_count": len(samples),
            "pass_count": tally("gate_status", "PASS"), "warn_count": tally("gate_status", "WARN"), "fail_count": tally("gate_status", "FAIL"),
            "submission_ready_count": tally("submission_status", "PASS"), "submission_warn_count": tally("submission_status", "WARN"), "submission_fail_count": tally("submission_status", "FAIL"),
        },
        "samples": samples,
        "cohort_findings": findings,
    }


def exit_code(report: dict) -> int:
    """0, 1 or 2 for PASS, WARN and FAIL; of a cohort the worst gate status."""
    if report.get("report_type") == "compare":
        return RANK[_worst(s["gate_status"] for s in report["samples"])]
    return RANK[report["verdict"]["status"]]
