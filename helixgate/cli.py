"""Command line: check one file, compare several, or print the contract.

    python -m helixgate.cli sample.fa --gate pipeline
    python -m helixgate.cli compare a.fa b.fa.gz
    python -m helixgate.cli --explain-finding high_n_rate

Exit codes: 0 pass, 1 warn, 2 fail, 3 the tool could not do its work.
"""

from __future__ import annotations

import argparse
import json
import sys

from .functions.naming import parse_expected_size
from .operators.records import Profile
from .plans import contract
from .plans.policy import explain
from .plans.report import Config, check, compare, exit_code
from .sinks.artifacts import validate_paths, write_all


def parser(many: bool) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixgate compare" if many else "helixgate")
    p.add_argument("inputs", nargs="+" if many else "?")
    p.add_argument("--profile", default="assembly")
    p.add_argument("--gate", choices=("none", "pipeline", "submission"), default="none")
    p.add_argument("--submission-target", choices=("generic", "ncbi"))
    p.add_argument("--fail-on", action="append", default=[])
    p.add_argument("--max-n-rate", type=float, default=0.05)
    p.add_argument("--min-contig-length", type=int, default=200)
    p.add_argument("--expected-size", type=parse_expected_size)
    p.add_argument("--expected-size-tolerance", type=float, default=0.25)
    p.add_argument("--threads", type=int, default=1)
    stem = "helixgate-compare" if many else "helixgate"
    for option, end in (("--out", "html"), ("--json", "json"), ("--tsv", "tsv"), ("--multiqc", "multiqc.json")):
        p.add_argument(option, default=f"{stem}.{end}")
    if not many:
        g = p.add_mutually_exclusive_group()
        g.add_argument("--schema", action="store_true")
        g.add_argument("--finding-catalog", action="store_true")
        g.add_argument("--explain-finding", metavar="ID")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    many = argv[:1] == ["compare"]
    if not many and "compare" in argv:
        print("helixgate: options of a comparison stand after the word compare", file=sys.stderr)
        return 3
    a = parser(many).parse_args(argv[many:])
    try:
        if not many and (a.schema or a.finding_catalog or a.explain_finding):
            out = contract.report_schema() if a.schema else contract.finding_catalog() if a.finding_catalog else explain(a.explain_finding)
            print(json.dumps(out, indent=2))
            return 0
        if not a.inputs:
            raise ValueError("an input file is needed")
        profile = Profile(a.profile, high_n_global=a.max_n_rate, min_contig_length=a.min_contig_length, expected_size=a.expected_size, expected_tolerance=a.expected_size_tolerance)
        config = Config(profile, a.gate, a.submission_target, tuple(a.fail_on), a.threads, "helixgate " + " ".join(argv))
        outputs = (a.out, a.json, a.tsv, a.multiqc)
        validate_paths(list(outputs))
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("helixgate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        report = compare(spark, a.inputs, config) if many else check(spark, [a.inputs], config)[a.inputs]
        write_all(report, *outputs)
        return exit_code(report)
    except (ValueError, KeyError, OSError) as e:
        print(f"helixgate: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
