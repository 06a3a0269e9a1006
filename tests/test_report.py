import json

import pytest

from helixgate import cli
from helixgate.operators.records import Profile
from helixgate.plans import contract, policy
from helixgate.plans.report import Config, check, compare, exit_code
from helixgate.sinks import artifacts
from helixgate.sources.fasta import RECORDS, read_multiqc
from helixgate.streaming.watch import stream_totals, watch

CLEAN = f">c0\n{'ACGT' * 60}\n>c1\n{'AACCGGTT' * 30}\n"
BROKEN = ">a\n>b\nACGT\n"
PROBLEM = ">a one\nACGTXZ\n>a two\nNNNNNNNN\n>c\nAC" + "N" * 101 + "GT\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("fasta")
    out = {}
    for name, data in (("clean", CLEAN), ("broken", BROKEN), ("problem", PROBLEM)):
        (top / f"{name}.fa").write_text(data)
        out[name] = str(top / f"{name}.fa")
    return out


@pytest.fixture(scope="module")
def made(spark, files):
    return check(spark, list(files.values()), Config(Profile(min_contig_length=1), gate="submission", timestamp="2024-01-01T00:00:00Z"))


def test_verdicts_and_exit_codes(made, files):
    assert {n: made[p]["verdict"]["status"] for n, p in files.items()} == {"clean": "PASS", "broken": "FAIL", "problem": "FAIL"}
    assert [exit_code(made[files[n]]) for n in ("clean", "problem")] == [0, 2]
    assert made[files["clean"]]["machine_summary"]["recommended_next_tools"] == ["QUAST", "BUSCO", "BlobToolKit"]


def test_findings_of_the_problem_file(made, files):
    r = made[files["problem"]]
    ids = [f["id"] for f in r["findings"]]
    assert ids == ["duplicate_ids", "duplicate_first_token_ids", "invalid_chars", "high_n_rate", "gap_runs", "terminal_ns", "composite_anomalies"]
    by = {f["id"]: f for f in r["findings"]}
    assert by["duplicate_ids"]["evidence"] == {"total_records": 1, "truncated": False, "records": [{"id": "a", "length": 8, "reason": "id was used by an earlier record"}]}
    assert by["high_n_rate"]["affected_count"] == 2
    assert by["terminal_ns"]["evidence"]["records"][0]["signals"] == ["terminal_n_prefix=8", "terminal_n_suffix=8"]
    assert r["gate"]["blocking_findings"] == ["duplicate_ids", "duplicate_first_token_ids", "invalid_chars"]
    assert r["readiness"]["status"] == "FAIL"
    assert [c["status"] for c in r["readiness"]["categories"]] == ["PASS", "PASS", "FAIL", "FAIL", "WARN", "FAIL", "PASS"]
    assert r["readiness"]["categories"][5]["target"] == "generic"
    assert (r["summary"]["n50"], r["summary"]["max_gap_run"], r["summary"]["sequence_count"]) == (105, 101, 3)


def test_structural_errors_fail(made, files):
    r = made[files["broken"]]
    assert [f["id"] for f in r["findings"]] == ["invalid_fasta_structure"] and "without sequence: a" in r["findings"][0]["message"]
    assert r["summary"]["total_length"] == 0 and r["plots"] == {"length_histogram": [], "gc_length": []}
    assert r["provenance"]["input_bytes"] == len(BROKEN)


def test_artifacts(spark, made, files, tmp_path):
    r = made[files["problem"]]
    paths = [str(tmp_path / f"r.{x}") for x in ("html", "json", "tsv", "mqc.json")]
    artifacts.write_all(r, *paths)
    assert json.loads((tmp_path / "r.json").read_text()) == r
    tsv = dict(x.split("\t") for x in (tmp_path / "r.tsv").read_text().splitlines())
    assert len(tsv) == 57 and tsv["verdict"] == "FAIL" and tsv["mean_length"] == "39.67" and tsv["gate_advisory_findings"].startswith("high_n_rate")
    table = json.loads((tmp_path / "r.mqc.json").read_text())
    assert len(table["data"]["problem"]) == 27
    assert "<svg" in (tmp_path / "r.html").read_text()
    assert read_multiqc(spark, paths[3]).first()["plot_type"] == "table"
    with pytest.raises(ValueError):
        artifacts.write_all(r, paths[0], paths[0], paths[2], paths[3])
    assert artifacts.escape("<'\"&>") == "&lt;&#39;&quot;&amp;&gt;"
    assert [artifacts.display(v) for v in (16.0, 16.5, None, 7)] == ["16", "16.5", ".", "7"]


def test_comparison(spark, files, tmp_path):
    r = compare(spark, [files["problem"], files["clean"]], Config(gate="pipeline"))
    assert [s["sample_id"] for s in r["samples"]] == ["problem", "clean"]
    assert (r["summary"]["pass_count"], r["summary"]["fail_count"], exit_code(r)) == (1, 1, 2)
    assert len(artifacts.compare_tsv(r).splitlines()[0].split("\t")) == 27
    artifacts.write_all(r, *(str(tmp_path / f"c.{x}") for x in ("html", "json", "tsv", "mqc.json")))
    with pytest.raises(ValueError):
        compare(spark, [files["clean"]])


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None), "array": list, "object": dict}


def fits(value, schema, at="$"):
    """As much of JSON Schema as the contract uses."""
    if "const" in schema:
        assert value == schema["const"], at
    if "enum" in schema:
        assert value in schema["enum"], at
    kinds = schema.get("type", [])
    if kinds:
        assert any(isinstance(value, KINDS[k]) and (k == "boolean" or not isinstance(value, bool)) for k in ([kinds] if isinstance(kinds, str) else kinds)), (at, value)
    if isinstance(value, list):
        for n, x in enumerate(value):
            fits(x, schema["items"], f"{at}[{n}]")
    if isinstance(value, dict):
        assert schema["additionalProperties"] is False and set(schema["required"]) <= set(value) <= set(schema["properties"]), (at, set(value) ^ set(schema["properties"]))
        for k, x in value.items():
            fits(x, schema["properties"][k], f"{at}.{k}")


def test_reports_fit_the_contract(spark, made, files):
    single, many = contract.report_schema()["oneOf"]
    for r in made.values():
        fits(r, single)
    fits(compare(spark, [files["problem"], files["clean"]]), many)
    for f in contract.finding_catalog()["findings"]:
        assert all(f[k] for k in ("meaning", "why_it_matters", "evidence_fields", "cannot_conclude", "actions"))
        assert all(a["target"] and a["reason"] for a in f["actions"])


def test_gates_and_contract():
    assert policy.fail_on("submission", "ncbi", ["tiny_contigs, x"]) == sorted([*policy.NCBI, "tiny_contigs", "x"])
    with pytest.raises(ValueError):
        policy.fail_on("nightly")
    with pytest.raises(KeyError):
        policy.explain("nothing")
    assert len(contract.finding_catalog()["findings"]) == 19
    assert contract.report_schema()["oneOf"][0]["additionalProperties"] is False


def test_cli(files, tmp_path, monkeypatch, capsys, spark):
    monkeypatch.chdir(tmp_path)
    assert cli.main([files["clean"]]) == 0 and (tmp_path / "helixgate.json").exists()
    assert cli.main(["--explain-finding", "gap_runs"]) == 0 and "QUAST" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "clean.fa"), "--profile", "protein"]) == 3
    assert cli.main([]) == 3


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", n, None, f"r{n}", f"r{n}", "ACGTN" * 50) for n in range(4)]
    spark.createDataFrame(rows, RECORDS).write.parquet(src)
    got = []
    watch(spark, src, str(tmp_path / "cp"), lambda r, n: got.append(r), once=True).awaitTermination(120)
    assert got[0]["s"]["summary"]["sequence_count"] == 4
    q = stream_totals(spark, src).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("totals").first()["total_length"] == 1000
