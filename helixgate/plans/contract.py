"""What reports look like and what findings mean, for programs that read them."""

from __future__ import annotations

from dataclasses import fields

from ..operators.records import Profile
from .cohort import METRICS
from .policy import CATEGORIES, explain
from .report import FLOATS, SCHEMA_VERSION, SUMMARY
from .rules import BY_ID, COHORT


def finding_catalog() -> dict:
    return {"schema_version": SCHEMA_VERSION, "findings": [explain(k) for k in (*BY_ID, *COHORT)]}


STATUS = {"enum": ["PASS", "WARN", "FAIL"]}
TEXT, TEXTS, COUNT, NUMBER, FLAG = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer", "minimum": 0}, {"type": "number"}, {"type": "boolean"}
MAYBE = {"type": ["string", "null"]}


def _obj(props: dict, optional: dict | None = None) -> dict:
    """A closed object; ``optional`` properties may be left out."""
    return {"type": "object", "properties": props | (optional or {}), "required": list(props), "additionalProperties": False}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


def _counts(names) -> dict:
    return {k: NUMBER if k in FLOATS else COUNT for k in names}


def report_schema() -> dict:
    """JSON Schema of reports and comparisons. All objects are closed."""
    action = _obj({"action_type": TEXT, "target": TEXT, "reason": TEXT, "recommended_tool": TEXT, "requires_external_database": FLAG})
    hint = _obj({"condition": TEXT, "suggested_route": TEXT, "requires_external_database": FLAG})
    category = _obj({"id": {"enum": list(CATEGORIES)}, "status": STATUS, "blockers": TEXTS}, {"target": TEXT})
    record = _obj({"id": TEXT, "length": COUNT, "reason": TEXT}, {"invalid_count": COUNT, "max_gap_run": COUNT, "gc_percent": NUMBER, "gc_zscore": NUMBER, "n_fraction": NUMBER, "n_percent": NUMBER, "signals": TEXTS})
    finding = _obj(
        {
            "id": {"enum": list(BY_ID)}, "severity": {"enum": ["minor", "major", "critical"]}, "category": TEXT, "confidence": {"enum": ["moderate", "high"]}, "needs_followup": FLAG, "message": TEXT,
            "affected_count": COUNT, "affected_fraction": NUMBER, "evidence": _obj({"total_records": COUNT, "truncated": FLAG, "records": _list(record)}), "actions": _list(action),
        }
    )
    thresholds = {f.name: NUMBER for f in fields(Profile) if f.name not in ("name", "expected_size")}
    tool = _obj({"name": TEXT, "version": TEXT})
    single = _obj(
        {
            "schema_version": {"const": SCHEMA_VERSION}, "tool": tool, "input": _obj({"path": TEXT, "profile": {"const": "assembly"}}), "verdict": _obj({"status": STATUS, "reasons": TEXTS}),
            "gate": _obj({"mode": {"enum": ["none", "pipeline", "submission"]}, "submission_target": MAYBE, "status": STATUS, "fail_on": TEXTS, "blocking_findings": TEXTS, "advisory_findings": TEXTS}),
            "readiness": _obj({"status": STATUS, "blockers": TEXTS, "categories": _list(category)}),
            "machine_summary": _obj({"safe_for_downstream": FLAG, "top_findings": TEXTS, "recommended_next_tools": TEXTS, "routing_hints": _list(hint)}),
            "scope": _obj({"checks": TEXTS, "does_not": TEXTS}),
            "provenance": _obj(
                {"command": TEXT, "threads": {"type": "integer", "minimum": 1}, "fail_on": TEXTS, "thresholds": _obj(thresholds)},
                {"started_at": TEXT, "duration_ms": COUNT, "input_bytes": COUNT, "input_sha256": TEXT},
            ),
            "summary": _obj(_counts(SUMMARY)),
            "plots": _obj({
                "length_histogram": _list(_obj({"start": COUNT, "end": COUNT, "record_count": COUNT, "total_length": COUNT})),
                "gc_length": _list(_obj({"id": TEXT, "length": COUNT, "gc_percent": NUMBER, "flags": TEXTS})),
            }),
            "findings": _list(finding),
        }
    )
    sample = _obj(
        {
            "sample_id": TEXT, "input_path": TEXT, "verdict": STATUS, "gate_status": STATUS, "readiness_status": STATUS, "submission_target": MAYBE, "submission_status": STATUS,
            "readiness_categories": _list(category), **_counts(METRICS), "n_percent": NUMBER, "finding_count": COUNT, "finding_ids": TEXTS, "readiness_blockers": TEXTS,
            "recommended_next_tools": TEXTS, "input_sha256": TEXT,
        }
    )
    odd = _obj({"id": {"enum": list(COHORT)}, "severity": {"const": "minor"}, "affected_count": COUNT, "evidence": _list(_obj({"sample_id": TEXT, "reason": TEXT}, {"total_length": COUNT, "gc_percent": NUMBER}))})
    tallies = ("sample_count", "pass_count", "warn_count", "fail_count", "submission_ready_count", "submission_warn_count", "submission_fail_count")
    many = _obj(
        {
            "schema_version": {"const": SCHEMA_VERSION}, "report_type": {"const": "compare"}, "tool": tool, "input": _obj({"profile": {"const": "assembly"}, "sample_count": COUNT}),
            "summary": _obj(dict.fromkeys(tallies, COUNT)), "samples": _list(sample), "cohort_findings": _list(odd),
        }
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "oneOf": [single, many]}
