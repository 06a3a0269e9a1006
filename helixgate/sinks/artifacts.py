"""Report artifacts: JSON, TSV, MultiQC and HTML, written by the driver from one report."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import table_sample_name
from ..plans.cohort import overall
from ..plans.policy import CATEGORIES, TOUCHES
from ..plans.report import FLOATS, SCHEMA_VERSION, SUMMARY


def display(v) -> str:
    """Numbers without a needless fraction; nothing as a dot."""
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return "." if v is None or v == "" else str(v)


def _count(report: dict, finding_id: str) -> int:
    return next((f["affected_count"] for f in report["findings"] if f["id"] == finding_id), 0)


def _category(report: dict, name: str) -> dict:
    return next(c for c in report["readiness"]["categories"] if c["id"] == name)


def submission_partition(report: dict) -> tuple[list[str], list[str]]:
    """Findings that touch submission, split into those that block it and the rest."""
    blockers = {b.removeprefix("submission.") for b in report["readiness"]["blockers"] if b.startswith("submission.")}
    ids = [f["id"] for f in report["findings"] if "submission" in TOUCHES.get(f["id"], ())]
    return [i for i in ids if i in blockers], [i for i in ids if i not in blockers]


def tsv_rows(report: dict) -> list[tuple[str, str]]:
    gate, ready = report["gate"], report["readiness"]
    blocking, advisory = submission_partition(report)
    rows = [
        ("schema_version", report["schema_version"]), ("profile", report["input"]["profile"]), ("verdict", report["verdict"]["status"]),
        ("gate_mode", gate["mode"]), ("gate_status", gate["status"]), ("gate_blocking_findings", ",".join(gate["blocking_findings"])), ("gate_advisory_findings", ",".join(gate["advisory_findings"])),
        ("readiness_status", ready["status"]), ("readiness_blockers", ",".join(ready["blockers"])),
        *((f"readiness_{c['id']}_status", c["status"]) for c in ready["categories"]),
        ("submission_target", gate["submission_target"]), ("submission_status", _category(report, "submission")["status"]),
        ("submission_blocking_findings", ",".join(blocking)), ("submission_advisory_findings", ",".join(advisory)),
        ("unsafe_identifier_count", report["summary"]["unsafe_id_count"]), ("long_identifier_count", report["summary"]["long_header_count"]),
        ("submission_duplicate_first_token_id_count", report["summary"]["duplicate_first_token_id_count"]), ("gap_like_n_run_count", report["summary"]["repeated_gap_pattern_sequence_count"]),
        ("input_sha256", report["provenance"].get("input_sha256", "")),
        *((k, report["summary"][k]) for k in SUMMARY),
        ("gc_outlier_count", _count(report, "gc_outliers")), ("length_outlier_count", _count(report, "length_outliers")),
        ("composite_anomaly_count", _count(report, "composite_anomalies")), ("finding_count", len(report["findings"])),
    ]
    return [(k, display(v)) for k, v in rows]


def _shown(name: str) -> Column:
    """A number of the summary as text: two decimals at most, none that is needless."""
    column = F.col("gap_pattern_sequence_count" if name.startswith("repeated") else name)
    return F.regexp_replace(column.cast("decimal(38,2)").cast("string"), r"\.?0+$", "") if name in FLOATS else column.cast("string")


def tsv_table(summary: DataFrame, found: DataFrame, verdict: DataFrame, ready: DataFrame, gate: str, target: str | None, profile: str = "assembly") -> DataFrame:
    """sample_id, metric, value of all samples at once: the metrics of ``tsv_rows`` for tables."""
    touches = F.col("finding_id").isin(*(k for k, v in TOUCHES.items() if "submission" in v))
    order = F.array_sort(F.collect_list(F.when(touches, F.struct("position", "finding_id"))))
    listed = found.groupBy("sample_id").agg(F.transform(order, lambda x: x["finding_id"]).alias("touching"), F.count("*").alias("finding_count"))
    wide = summary.join(verdict, "sample_id").join(overall(ready), "sample_id").join(listed, "sample_id", "left")
    joined = lambda c: F.array_join(c, ",")
    touching = F.coalesce("touching", F.array().cast("array<string>"))
    blocking = F.array_intersect(touching, "blocking_findings")
    rows = {
        "schema_version": F.lit(SCHEMA_VERSION), "profile": F.lit(profile), "verdict": F.col("status"), "gate_mode": F.lit(gate), "gate_status": F.col("status"),
        "gate_blocking_findings": joined(F.col("blocking_findings")), "gate_advisory_findings": joined(F.col("advisory_findings")),
        "readiness_status": F.when(F.size("readiness_blockers") > 0, "FAIL").otherwise(F.col("status")), "readiness_blockers": joined(F.col("readiness_blockers")),
        **{f"readiness_{c}_status": F.col("by_category")[c] for c in CATEGORIES},
        "submission_target": F.lit(target).cast("string"), "submission_status": F.col("by_category")["submission"],
        "submission_blocking_findings": joined(blocking), "submission_advisory_findings": joined(F.array_except(touching, blocking)),
        "unsafe_identifier_count": _shown("unsafe_id_count"), "long_identifier_count": _shown("long_header_count"),
        "submission_duplicate_first_token_id_count": _shown("duplicate_first_token_id_count"), "gap_like_n_run_count": _shown("repeated_gap_pattern_sequence_count"), "input_sha256": F.lit(""),
        **{k: _shown(k) for k in SUMMARY},
        **{k: _shown(k) for k in ("gc_outlier_count", "length_outlier_count", "composite_anomaly_count")}, "finding_count": F.coalesce("finding_count", F.lit(0)).cast("string"),
    }
    entries = F.array(*(F.struct(F.lit(k).alias("metric"), F.when(v != "", v).otherwise(F.lit(".")).alias("value")) for k, v in rows.items()))
    return wide.select("sample_id", F.explode(entries).alias("m")).select("sample_id", "m.metric", "m.value")


def tsv(report: dict) -> str:
    return "metric\tvalue\n" + "".join(f"{k}\t{v}\n" for k, v in tsv_rows(report))


COMPARE_COLUMNS = (
    "sample_id", "input_path", "verdict", "gate_status", "readiness_status", "submission_target", "submission_status", "submission_ready_count", "submission_warn_count",
    "submission_fail_count", "sequence_count", "total_length", "n50", "n90", "gc_percent", "n_percent", "duplicate_id_count", "invalid_sequence_count", "high_n_sequence_count",
    "tiny_contig_count", "max_gap_run", "gc_outlier_count", "length_outlier_count", "finding_count", "readiness_blockers", "recommended_next_tools", "input_sha256",
)


def _compare_rows(report: dict) -> list[dict]:
    totals = {k: report["summary"][k] for k in COMPARE_COLUMNS if k in report["summary"]}
    return [s | totals | {k: ",".join(s[k]) for k in ("readiness_blockers", "recommended_next_tools")} for s in report["samples"]]


def compare_tsv(report: dict) -> str:
    clean = lambda v: (v if isinstance(v, str) else display(v)).translate({9: " ", 10: " ", 13: " "})
    rows = [[clean(r[c]) for c in COMPARE_COLUMNS] for r in _compare_rows(report)]
    return "\n".join("\t".join(x) for x in [list(COMPARE_COLUMNS), *rows]) + "\n"


def _table(title: str, columns: list[str], data: dict) -> str:
    headers = {c: {"title": c.replace("_", " ").capitalize()} for c in sorted(columns)}
    return json.dumps(
        {"id": "helixgate", "section_name": "Helixgate", "description": title, "plot_type": "table", "pconfig": {"id": "helixgate_summary", "title": title, "headers": headers}, "data": dict(sorted(data.items()))},
        indent=2,
        ensure_ascii=False,
    )


def multiqc(report: dict) -> str:
    s, gate = report["summary"], report["gate"]
    row = {
        "verdict": report["verdict"]["status"], "gate_mode": gate["mode"], "gate_status": gate["status"], "gate_blocking_findings": ",".join(gate["blocking_findings"]),
        "readiness_status": report["readiness"]["status"], "readiness_blockers": ",".join(report["readiness"]["blockers"]), "submission_target": gate["submission_target"] or ".",
        "submission_status": _category(report, "submission")["status"], "unsafe_identifier_count": s["unsafe_id_count"], "long_identifier_count": s["long_header_count"],
        "duplicate_first_token_id_count": s["duplicate_first_token_id_count"], "gap_like_n_run_count": s["repeated_gap_pattern_sequence_count"],
        **{k: s[k] for k in ("sequence_count", "total_length", "n50", "n90", "gc_percent", "n_percent", "duplicate_id_count", "invalid_sequence_count", "high_n_sequence_count", "tiny_contig_count", "max_gap_run")},
        "gc_outlier_count": _count(report, "gc_outliers"), "length_outlier_count": _count(report, "length_outliers"), "composite_anomaly_count": _count(report, "composite_anomalies"),
        "finding_count": len(report["findings"]),
    }
    return _table("Preflight summary", list(row), {table_sample_name(report["input"]["path"]): row})


def compare_multiqc(report: dict) -> str:
    keep = [c for c in COMPARE_COLUMNS if c not in ("sample_id", "input_path", "input_sha256")]
    data = {r["sample_id"]: {c: "." if r[c] is None else r[c] for c in keep} for r in _compare_rows(report)}
    return _table("Cohort summary", keep, data) + "\n"


def escape(text) -> str:
    return html.escape(str(text), quote=True).replace("&#x27;", "&#39;")


_STYLE = "body{font:15px/1.5 sans-serif;margin:2rem;max-width:70rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}.PASS{color:#176f2c}.WARN{color:#8a5a00}.FAIL{color:#b00020}pre{overflow:auto;background:#f6f6f6;padding:1rem}"


def _grid(head: list[str], rows: list[list]) -> str:
    cell = lambda x: f"<td class='{x}'>{escape(display(x))}</td>" if x in ("PASS", "WARN", "FAIL") else f"<td>{escape(display(x))}</td>"
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


def histogram_svg(bins: list[dict], width: int = 640, height: int = 200) -> str:
    if not bins:
        return "<p>No lengths.</p>"
    most, step = max(b["record_count"] for b in bins) or 1, width / len(bins)
    bars = "".join(
        f"<rect x='{k * step + 1:.1f}' y='{height - b['record_count'] / most * height:.1f}' width='{step - 2:.1f}' height='{b['record_count'] / most * height:.1f}'><title>{b['start']}-{b['end']}: {b['record_count']}</title></rect>"
        for k, b in enumerate(bins)
    )
    return f"<svg role='img' aria-label='Lengths' viewBox='0 0 {width} {height}' width='{width}' fill='#4669a8'>{bars}</svg>"


def scatter_svg(points: list[dict], width: int = 640, height: int = 300) -> str:
    if not points:
        return "<p>No points.</p>"
    most = max(p["length"] for p in points) or 1
    dots = "".join(
        f"<circle cx='{p['length'] / most * (width - 8) + 4:.1f}' cy='{height - 4 - p['gc_percent'] / 100 * (height - 8):.1f}' r='3' fill='{'#b00020' if p['flags'] else '#4669a8'}'><title>{escape(p['id'])} {p['length']} {p['gc_percent']} {escape(','.join(p['flags']))}</title></circle>"
        for p in points
    )
    return f"<svg role='img' aria-label='GC against length' viewBox='0 0 {width} {height}' width='{width}'>{dots}</svg>"


def _page(title: str, parts: list[tuple[str, str]]) -> str:
    body = "".join(f"<section><h2>{escape(h)}</h2>{x}</section>" for h, x in parts)
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>\n"


def _list(items) -> str:
    return "<ul>" + "".join(f"<li>{escape(x)}</li>" for x in items) + "</ul>" if items else "<p>none</p>"


def html_report(report: dict) -> str:
    gate, ready, machine = report["gate"], report["readiness"], report["machine_summary"]
    findings = []
    for f in report["findings"]:
        fields = sorted({k for r in f["evidence"]["records"] for k in r} - {"id"})
        rows = [[r.get("id"), *(",".join(v) if isinstance(v := r.get(k), list) else v for k in fields)] for r in f["evidence"]["records"]]
        acts = _grid(["action", "tool", "external database"], [[a["action_type"], a["recommended_tool"], a["requires_external_database"]] for a in f["actions"]])
        findings.append(f"<h3>{escape(f['id'])} ({escape(f['severity'])})</h3><p>{escape(f['message'])}</p>" + (_grid(["id", *fields], rows) if rows else "") + acts)
    blocking, advisory = submission_partition(report)
    return _page(
        f"Preflight report: {report['input']['path']}",
        [
            ("Verdict", f"<p class='{report['verdict']['status']}'>{report['verdict']['status']}</p>" + _list(report["verdict"]["reasons"])),
            ("Gate", _grid(["mode", "target", "status"], [[gate["mode"], gate["submission_target"], gate["status"]]]) + "<p>Blocking</p>" + _list(gate["blocking_findings"]) + "<p>Advisory</p>" + _list(gate["advisory_findings"])),
            ("Submission", f"<p class='{(s := _category(report, 'submission')['status'])}'>{s}</p><p>Blocking</p>{_list(blocking)}<p>Advisory</p>{_list(advisory)}"),
            ("Readiness", _grid(["category", "status", "blockers"], [[c["id"], c["status"], ",".join(c["blockers"])] for c in ready["categories"]])),
            ("For machines", f"<p>Safe for downstream: {machine['safe_for_downstream']}</p>" + _list(machine["recommended_next_tools"]) + _list(f"{h['condition']}: {h['suggested_route']}" for h in machine["routing_hints"])),
            ("Summary", _grid(["metric", "value"], [[k, v] for k, v in report["summary"].items()])),
            ("Scope", "<p>Checks</p>" + _list(report["scope"]["checks"]) + "<p>Does not</p>" + _list(report["scope"]["does_not"])),
            ("Plots", histogram_svg(report["plots"]["length_histogram"]) + scatter_svg(report["plots"]["gc_length"])),
            ("Findings", "".join(findings) or "<p>none</p>"),
            ("JSON", f"<pre>{escape(json.dumps(report, indent=2, ensure_ascii=False))}</pre>"),
        ],
    )


def compare_html(report: dict) -> str:
    samples = report["samples"]
    cats = [c["id"] for c in samples[0]["readiness_categories"]] if samples else []
    matrix = _grid(["sample", "gate", "readiness", *cats], [[s["sample_id"], s["gate_status"], s["readiness_status"], *(c["status"] for c in s["readiness_categories"])] for s in samples])
    charts = []
    for k in ("total_length", "n50", "gc_percent", "n_percent", "finding_count"):
        most = max((float(s[k]) for s in samples), default=0) or 1
        bars = "".join(f"<tr><td>{escape(s['sample_id'])}</td><td><svg width='{300 * float(s[k]) / most:.0f}' height='12'><rect width='100%' height='12' fill='#4669a8'/></svg> {escape(display(s[k]))}</td></tr>" for s in samples)
        charts.append(f"<h3>{k}</h3><table>{bars}</table>")
    tools = list(dict.fromkeys(t for s in samples for t in s["recommended_next_tools"]))
    found = "".join(f"<h3>{escape(f['id'])}</h3><pre>{escape(json.dumps(f['evidence'], indent=2, ensure_ascii=False))}</pre>" for f in report["cohort_findings"])
    return _page("Cohort report", [("Summary", _grid(["count", "value"], [[k, v] for k, v in report["summary"].items()])), ("Readiness", matrix), ("Charts", "".join(charts)), ("Cohort findings", found or "<p>none</p>"), ("Suggested tools", _list(tools))])


def validate_paths(paths: list[str]) -> None:
    """Outputs must differ, and their folders exist, before anything is written."""
    plain = [os.path.normpath(os.path.abspath(p)) for p in paths]
    if len(set(plain)) < len(plain):
        raise ValueError("two outputs have the same path")
    for p in plain:
        if not os.path.isdir(os.path.dirname(p)):
            raise ValueError(f"the folder of an output does not exist: {p}")


def write_all(report: dict, html_path: str, json_path: str, tsv_path: str, multiqc_path: str) -> None:
    """The four artifacts of a report or of a comparison."""
    validate_paths([html_path, json_path, tsv_path, multiqc_path])
    many = report.get("report_type") == "compare"
    texts = {
        json_path: json.dumps(report, indent=2, ensure_ascii=False) + "\n" * many,
        tsv_path: compare_tsv(report) if many else tsv(report),
        multiqc_path: compare_multiqc(report) if many else multiqc(report),
        html_path: compare_html(report) if many else html_report(report),
    }
    for path, text in texts.items():
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
