"""The engine's operators as queries over the driver's tables, and the same in DuckDB SQL.

The table of documents stands in for FASTA files: a sample per source, a record per document.
Views of it: ``iupac`` keeps nucleotide letters only, ``raw`` keeps the text less its line ends,
``by_lang`` repeats ids, and ``headers`` has headers of running text. Documents whose view holds no symbol are no
records and stay out; ``structure_problems`` lists them, as a FASTA file with such a record is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expected as E
from .functions.sequence import LOWER, UPPER, ascii_upper, register_sql
from .operators import records as R
from .plans import cohort as C
from .plans import policy as P
from .plans import rules as Q
from .sinks.artifacts import tsv_table
from .sources.fasta import from_table, read_fasta, spread, write_text
from .store import fresh_path, store

PROFILE = R.Profile()
SIZED = R.Profile(expected_size=60_000)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*cols or "*"))


_LETTERS = "ACGTUNMRWSYKVHDB"
#: What tells without building a view's sequence that it has a symbol.
_HAS = {"bases": f"[{_LETTERS}{_LETTERS.lower()}]", "lines": r"[^\r\n]|\r(?!\r*\n)"}


def _views(view: str):
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("string")
    header = {
        "iupac": F.concat_ws(" ", number, "source"),
        "raw": F.concat_ws(" ", number, "source"),
        "by_lang": F.concat_ws(" ", "lang", number),
        "headers": F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")),
    }[view]
    if view in ("raw", "headers"):
        return header, F.regexp_replace(text, r"\r*\n", ""), text.rlike(_HAS["lines"])
    return header, ascii_upper(F.regexp_replace(text, f"[^{_LETTERS}{_LETTERS.lower()}]+", "")), text.rlike(_HAS["bases"])


def records(spark: SparkSession, sf_dir: str, view: str = "iupac") -> DataFrame:
    header, sequence, has = _views(view)
    cut = documents(spark, sf_dir, "source", "doc_id", "lang", "text").where(has).select("source", "doc_id", header.alias("header"), sequence.alias("sequence"))
    ident = F.regexp_extract("header", r"^([^ ]+)", 1)
    return from_table(cut, F.col("source"), F.col("doc_id"), ident, F.col("header"), F.col("sequence"))


def structure_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a FASTA reader refuses, as they have no sequence, and their samples' finding."""
    _, _, has = _views("iupac")
    empty = documents(spark, sf_dir, "source", "doc_id", "text").where(~has)
    f = Q.STRUCTURE
    return empty.select(F.col("source").alias("sample_id"), F.col("doc_id").cast("string").alias("id"), F.lit(f.id).alias("finding_id"), F.lit(f.severity).alias("severity"))


def _flagged(spark, sf_dir, view="iupac", p=PROFILE):
    return R.flagged(records(spark, sf_dir, view), p)


def _found(spark, sf_dir, p=PROFILE):
    s = store(R.summary(_flagged(spark, sf_dir, p=p), p), "summary")
    return s, Q.findings(s, p)


def _text(df: DataFrame, *cols: str) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


FEATURES = ["sample_id", "record_idx", "id", "length", "gc_count", "at_count", "n_count", "ambiguity_count", "invalid_count", "max_gap_run", "gap_run_100_count", "terminal_n_prefix", "terminal_n_suffix", "n_fraction", "gc_percent"]
SUMMARY = [
    "sample_id", "sequence_count", "total_length", "min_length", "max_length", "mean_length", "median_length", "n50", "n90", "l50", "l90", "gc_percent", "at_percent", "n_percent",
    "ambiguity_percent", "ungapped_total_length", "max_gap_run", "duplicate_id_count", "duplicate_first_token_id_count", "duplicate_sequence_count", "invalid_sequence_count",
    "high_n_sequence_count", "tiny_contig_count", "terminal_n_sequence_count", "gap_pattern_sequence_count", "gc_outlier_count", "length_outlier_count", "composite_anomaly_count",
]


def assembly_summary(spark, sf_dir):
    return R.summary(_flagged(spark, sf_dir)).select(*SUMMARY)


def record_features(spark, sf_dir, view="iupac"):
    return R.features(records(spark, sf_dir, view)).select(*FEATURES)


def _columns(*cols, where=None, view="iupac"):
    def query(spark, sf_dir):
        rows = _flagged(spark, sf_dir, view)
        return (rows.where(where) if where is not None else rows).select(*cols)

    return query


def _features(*cols, where=None, view="iupac"):
    """Queries that need no flags read features alone: no shuffle."""

    def query(spark, sf_dir):
        rows = R.features(records(spark, sf_dir, view))
        return (rows.where(where) if where is not None else rows).select(*cols)

    return query


def _verdict(gate, target=None):
    def query(spark, sf_dir):
        s, found = _found(spark, sf_dir)
        v = P.verdicts(s, found, P.fail_on(gate, target))
        return _text(v, "reasons", "blocking_findings", "advisory_findings").drop("top_findings")

    return query


def readiness(spark, sf_dir):
    s, found = _found(spark, sf_dir)
    return _text(P.readiness(s, found, P.fail_on("submission", "ncbi") + ["high_n_rate"]), "blockers")


def evidence_top20(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    found = Q.findings(R.summary(rows))
    return _text(Q.evidence(rows, found), "signals").select("sample_id", "finding_id", "rank", "record_idx", "id", "length", "gc_percent", "gc_zscore", "n_fraction", "max_gap_run", "signals")


PIPELINE_RULES = P.fail_on("pipeline")


def _cohort(spark, sf_dir):
    s, found = _found(spark, sf_dir)
    return C.cohort_samples(s, P.verdicts(s, found, PIPELINE_RULES), P.readiness(s, found, PIPELINE_RULES), P.recommended_tools(s, found))


def cohort_samples(spark, sf_dir):
    return _text(_cohort(spark, sf_dir), "readiness_categories", "finding_ids", "readiness_blockers", "recommended_next_tools")


def tsv_long(spark, sf_dir):
    s, found = _found(spark, sf_dir)
    return tsv_table(s, found, P.verdicts(s, found, PIPELINE_RULES), P.readiness(s, found, PIPELINE_RULES), "pipeline", None)


def sql_functions(spark, sf_dir):
    register_sql(spark)
    records(spark, sf_dir).createOrReplaceTempView("hg_records")
    return spark.sql(
        "SELECT sample_id, record_idx, hg_gc_count(sequence) AS gc_count, hg_n_count(sequence) AS n_count, CAST(hg_max_gap_run(sequence) AS BIGINT) AS max_gap_run,"
        " hg_percent(hg_gc_count(sequence), octet_length(sequence)) AS gc_percent, hg_sequence_hash(sequence) AS seq_hash FROM hg_records"
    )


def fail_on_union(spark, sf_dir):
    rows = [(g, t or "", ",".join(P.fail_on(g, t, ["tiny_contigs, gap_runs"]))) for g, t in (("none", None), ("pipeline", None), ("submission", "generic"), ("submission", "ncbi"))]
    return spark.createDataFrame(rows, "gate string, target string, fail_on string")


# ---------------------------------------------------------------- FASTA files

#: Small files that show what the tables cannot: every structural error and finding.
FASTA = {
    "dup.fa": ">a one\nACGTACGTAC\n>a two\nGGGGCCCCAA\n>b/c\nACGTACGTAC\n>d|e x;y\nACGTNNACGT\n",
    "bad.fasta": ">x\nACGTZZ\nQQ\n>y\nNNNNNNNNNN\n>z\n" + "ACGT" * 50 + "N" * 101 + "ACGT" * 50 + "\n",
    "long.fa": ">" + "h" * 256 + "\n" + "ACGT" * 60 + "\n>g\n" + "ACGT" * 60 + "N" * 100 + "ACGT" * 60 + "\n",
    "lines.fa": "\r\n\n>p first\r\nAC GT\r\n\r\nnn\n>q\tsecond\nRYKM\n",
    "stray.fa": "\nACGT\n>a\nACGT\n",
    "header.fa": ">a\nACGT\n>\nACGT\n",
    "empty.fa": ">a\n>b\nACGT\n",
    "end.fa": ">a\nACGT\n>b\n",
    "none.fa": "\n\n",
}


def _fasta_files(spark, names=None) -> list[str]:
    folder = fresh_path(spark, "fasta")
    return [write_text(spark, f"{folder}/{name}", FASTA[name]) for name in names or FASTA]


def _good_files(spark):
    return read_fasta(spark, _fasta_files(spark, ["dup.fa", "bad.fasta", "long.fa", "lines.fa"]), lines=True)[0]


def fasta_problems(spark, sf_dir):
    problems = read_fasta(spark, _fasta_files(spark))[1]
    return problems.select("sample_id", "line")


def fasta_findings(spark, sf_dir):
    s = R.summary(R.flagged(_good_files(spark)))
    return Q.findings(s).select("sample_id", "finding_id", "severity", "affected_count")


def fasta_flags(spark, sf_dir):
    rows = R.flagged(_good_files(spark))
    return rows.select("sample_id", "record_idx", "id", "length", "duplicate_id", "duplicate_first_token_id", "duplicate_sequence", "unsafe_id", "long_header", "reserved_header_chars", "invalid_count", "max_gap_run", "gap_run_100_count")


#: Total lengths and GC of samples, of which the last differ.
COHORT = [("s1", 100_000, 50.0), ("s2", 101_000, 50.2), ("s3", 99_500, 49.8), ("s4", 102_000, 50.1), ("s5", 1_000_000, 50.0), ("s6", 100_500, 80.0)]


def cohort_outliers_fixed(spark, sf_dir):
    return C.cohort_outliers(spark.createDataFrame(COHORT, "sample_id string, total_length long, gc_percent double"))


def _as_fasta(spark, sf_dir, codec):
    """The documents' letters as FASTA files, 60 to a line."""
    folder = fresh_path(spark, "documents-fasta")
    line = F.concat(F.lit(">"), "header", F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n"))
    records(spark, sf_dir).select(line.alias("value")).write.option("compression", codec).text(folder)
    found, problems = read_fasta(spark, sorted(spark.read.text(folder).inputFiles()))
    if not problems.isEmpty():
        raise ValueError("these files have no structural errors")
    return R.features(found).select("id", "header", "length", "gc_count", "n_count", "max_gap_run", "seq_hash")


QUERIES = {
    "assembly_summary": assembly_summary,
    "record_features": record_features,
    "raw_record_features": lambda s, d: record_features(s, d, "raw"),
    "composition_percent": lambda s, d: R.summary(_flagged(s, d)).select("sample_id", "gc_percent", "at_percent", "n_percent", "ambiguity_percent", "ungapped_total_length"),
    "gap_runs": _features("sample_id", "record_idx", "max_gap_run", "gap_run_100_count", where="max_gap_run > 0"),
    "terminal_n": _features("sample_id", "record_idx", "terminal_n_prefix", "terminal_n_suffix", where="terminal_n_prefix > 0 OR terminal_n_suffix > 0"),
    "header_flags": _features("sample_id", "record_idx", "unsafe_id", "long_header", "reserved_header_chars", view="headers"),
    "first_token_ids": _features("sample_id", "record_idx", "first_token_id", view="by_lang"),
    "duplicate_ids": _columns("sample_id", "record_idx", "id", where="duplicate_id", view="by_lang"),
    "duplicate_sequences": _columns("sample_id", "record_idx", where="duplicate_sequence"),
    "sha256_fingerprint": _features("sample_id", "record_idx", "seq_hash"),
    "nx_lx": lambda s, d: R.nx_lx(R.length_counts(R.features(records(s, d)))),
    "median_length": lambda s, d: R.summary(_flagged(s, d)).select("sample_id", "median_length", "mean_length"),
    "length_histogram": lambda s, d: R.length_histogram(R.features(records(s, d))),
    "gc_length_topk": lambda s, d: _text(R.gc_length_points(_flagged(s, d)), "flags"),
    "gc_zscore": _columns("sample_id", "record_idx", "gc_zscore"),
    "gc_outliers": _columns("sample_id", "record_idx", "gc_percent", "gc_zscore", where="gc_outlier"),
    "length_outliers": _columns("sample_id", "record_idx", "length", where="length_outlier"),
    "composite_anomalies": _columns("sample_id", "record_idx", where="composite_anomaly"),
    "high_n_records": _features("sample_id", "record_idx", "n_fraction", where="n_fraction >= 0.2D"),
    "tiny_contigs": _features("sample_id", "record_idx", "length", where="length < 200"),
    "invalid_records": _features("sample_id", "record_idx", "invalid_count", where="invalid_count > 0", view="raw"),
    "expected_size": lambda s, d: _found(s, d, SIZED)[1].where("finding_id = 'expected_size_outlier'").select("sample_id", "affected_count", "affected_fraction"),
    "findings": lambda s, d: _found(s, d)[1],
    "evidence_top20": evidence_top20,
    "verdict": _verdict("none"),
    "gate_pipeline": _verdict("pipeline"),
    "gate_submission": _verdict("submission", "ncbi"),
    "readiness": readiness,
    "routing_hints": lambda s, d: P.routing_hints(_found(s, d)[1]),
    "finding_actions": lambda s, d: P.actions(_found(s, d)[1]),
    "recommended_tools": lambda s, d: _text(P.recommended_tools(*_found(s, d)), "tools"),
    "cohort_samples": cohort_samples,
    "cohort_summary": lambda s, d: C.cohort_summary(_cohort(s, d)),
    "cohort_outliers": lambda s, d: C.cohort_outliers(_cohort(s, d)),
    "tsv_long": tsv_long,
    "sql_functions": sql_functions,
    "finding_catalog": lambda s, d: P.catalog(s),
    "catalog_lookup": lambda s, d: P.catalog(s).where("finding_id = 'gap_runs'"),
    "fail_on_union": fail_on_union,
    "structure_problems": structure_problems,
    "fasta_features": lambda s, d: _as_fasta(s, d, "none"),
    "fasta_gzip_features": lambda s, d: _as_fasta(s, d, "gzip"),
    "fasta_problems": fasta_problems,
    "fasta_records": lambda s, d: _good_files(s).select("sample_id", "record_idx", "header_line", "id", F.length("header").alias("header_length"), F.length("sequence").alias("sequence_length")),
    "fasta_flags": fasta_flags,
    "fasta_findings": fasta_findings,
    "cohort_outliers_fixed": cohort_outliers_fixed,
}

# ---------------------------------------------------------------- the same in DuckDB SQL

_UP = f"translate({{}}, '{LOWER}', '{UPPER}')"
_BASES = f"regexp_replace({_UP.format("coalesce(text, '')")}, '[^ACGTUNMRWSYKVHDB]', '', 'g')"
_LINES = "regexp_replace(coalesce(text, ''), '\\r*\\n', '', 'g')"


def _rec(view: str) -> str:
    header = {
        "iupac": "concat_ws(' ', doc_id::VARCHAR, source)",
        "raw": "concat_ws(' ', doc_id::VARCHAR, source)",
        "by_lang": "concat_ws(' ', lang, doc_id::VARCHAR)",
        "headers": "trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'))",
    }[view]
    sequence = _LINES if view in ("raw", "headers") else _BASES
    u = _UP.format("sequence")
    return f"""
WITH rec AS (SELECT source AS sample_id, doc_id AS record_idx, {header} AS header, {sequence} AS sequence FROM documents),
uu AS (SELECT *, regexp_extract(header, '^([^ ]+)', 1) AS id, {u} AS u FROM rec WHERE sequence <> ''),
cnt AS (SELECT sample_id, record_idx, id, header, strlen(sequence) AS length, u,
    length(u) - length(translate(u, 'GC', '')) AS gc_count, length(u) - length(translate(u, 'ATU', '')) AS at_count,
    length(u) - length(translate(u, 'N', '')) AS n_count, length(u) - length(translate(u, 'NMRWSYKVHDB', '')) AS ambiguity_count,
    list_transform(regexp_extract_all(u, 'N+'), lambda r: length(r)) AS runs FROM uu),
feat AS (SELECT sample_id, record_idx, id, header, length, gc_count, at_count, n_count, ambiguity_count,
    length - gc_count - at_count - ambiguity_count AS invalid_count,
    coalesce(list_max(runs), 0)::BIGINT AS max_gap_run, len(list_filter(runs, lambda r: r = 100))::BIGINT AS gap_run_100_count,
    length(regexp_extract(u, '^N+')) AS terminal_n_prefix, length(regexp_extract(u, 'N+$')) AS terminal_n_suffix,
    n_count::DOUBLE / length AS n_fraction, round(gc_count::DOUBLE / length * 100e0 * 100e0) / 100e0 AS gc_percent, sha256(u) AS seq_hash,
    regexp_matches(id, '^\\s|\\s$|[\\p{{Cc}}/\\\\]') AS unsafe_id, length(header) > 255 AS long_header, regexp_matches(header, '[|;"''`<>]|\\S\\s*\\t\\s*\\S') AS reserved_header_chars FROM cnt)"""


_FLAG = """,
dup AS (SELECT *, record_idx > min(record_idx) OVER (PARTITION BY sample_id, id) AS duplicate_id,
    record_idx > min(record_idx) OVER (PARTITION BY sample_id, seq_hash) AS duplicate_sequence FROM feat),
st AS (SELECT sample_id, count(*) AS n, quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3, quantile_cont(length, 0.5) AS mid,
    sum(round(gc_percent * 100e0)::HUGEINT) AS s1, sum(round(gc_percent * 100e0)::HUGEINT * round(gc_percent * 100e0)::HUGEINT) AS s2 FROM feat GROUP BY 1),
st2 AS (SELECT *, s1::DOUBLE / n / 100e0 AS gc_mean, sqrt((n * s2 - s1 * s1)::DOUBLE / (n::DOUBLE * n::DOUBLE) / 10000e0) AS gc_sd FROM st),
z AS (SELECT d.*, CASE WHEN n >= 3 AND gc_sd > 0 THEN abs((gc_percent - gc_mean) / gc_sd) END AS z,
    n >= 4 AND q3 > q1 AND (length < q1 - 1.5e0 * (q3 - q1) OR length > q3 + 1.5e0 * (q3 - q1)) AS length_outlier FROM dup d JOIN st2 USING (sample_id)),
zz AS (SELECT *, round(z * 100e0) / 100e0 AS gc_zscore, coalesce(z >= 3e0, false) AS gc_outlier FROM z),
flag AS (SELECT *, (gc_outlier OR n_fraction >= 0.2e0) AND (length_outlier OR duplicate_sequence OR invalid_count > 0 OR max_gap_run > 100) AS composite_anomaly FROM zz)"""

_SUM = """,
ranked AS (SELECT sample_id, length, sum(length) OVER w AS cum, row_number() OVER w AS rnk, sum(length) OVER (PARTITION BY sample_id) AS tot
    FROM feat WINDOW w AS (PARTITION BY sample_id ORDER BY length DESC, record_idx ROWS UNBOUNDED PRECEDING)),
nx AS (SELECT sample_id, max(CASE WHEN 2 * cum >= tot THEN length END) AS n50, min(CASE WHEN 2 * cum >= tot THEN rnk END) AS l50,
    max(CASE WHEN 10 * cum > 9 * tot THEN length END) AS n90, min(CASE WHEN 10 * cum > 9 * tot THEN rnk END) AS l90 FROM ranked GROUP BY 1),
agg AS (SELECT sample_id, count(*) AS sequence_count, sum(length)::BIGINT AS total_length, min(length) AS min_length, max(length) AS max_length,
    round(sum(length)::DOUBLE / count(*) * 100e0) / 100e0 AS mean_length, round(quantile_cont(length, 0.5) * 100e0) / 100e0 AS median_length,
    round(sum(gc_count)::DOUBLE / sum(length)::DOUBLE * 100e0 * 100e0) / 100e0 AS gc_percent, round(sum(at_count)::DOUBLE / sum(length)::DOUBLE * 100e0 * 100e0) / 100e0 AS at_percent,
    round(sum(n_count)::DOUBLE / sum(length)::DOUBLE * 100e0 * 100e0) / 100e0 AS n_percent, round(sum(ambiguity_count)::DOUBLE / sum(length)::DOUBLE * 100e0 * 100e0) / 100e0 AS ambiguity_percent,
    (sum(length) - sum(n_count))::BIGINT AS ungapped_total_length, max(max_gap_run) AS max_gap_run, count_if(duplicate_id)::BIGINT AS duplicate_id_count,
    count_if(duplicate_id)::BIGINT AS duplicate_first_token_id_count, count_if(duplicate_sequence)::BIGINT AS duplicate_sequence_count, count_if(invalid_count > 0)::BIGINT AS invalid_sequence_count,
    count_if(unsafe_id)::BIGINT AS unsafe_id_count, count_if(long_header)::BIGINT AS long_header_count, count_if(reserved_header_chars)::BIGINT AS reserved_header_char_count,
    count_if(n_fraction >= 0.2e0)::BIGINT AS high_n_sequence_count, count_if(length < 200)::BIGINT AS tiny_contig_count, count_if(terminal_n_prefix > 0 OR terminal_n_suffix > 0)::BIGINT AS terminal_n_sequence_count,
    count_if(gap_run_100_count > 0)::BIGINT AS gap_pattern_sequence_count, count_if(max_gap_run > 100)::BIGINT AS long_gap_sequence_count, count_if(gc_outlier)::BIGINT AS gc_outlier_count,
    count_if(length_outlier)::BIGINT AS length_outlier_count, count_if(composite_anomaly)::BIGINT AS composite_anomaly_count, sum(n_count)::DOUBLE / sum(length)::DOUBLE AS global_n_fraction
    FROM flag GROUP BY 1),
summary AS (SELECT * FROM agg JOIN nx USING (sample_id))"""


def _trigger(expected: int | None) -> dict[str, tuple[str, str]]:
    size = "false" if expected is None else f"ungapped_total_length < {expected * 0.75}e0 OR ungapped_total_length > {expected * 1.25}e0"
    return {
        "duplicate_ids": ("duplicate_id_count > 0", "duplicate_id_count"),
        "duplicate_first_token_ids": ("duplicate_first_token_id_count > 0", "duplicate_first_token_id_count"),
        "unsafe_ids": ("unsafe_id_count > 0", "unsafe_id_count"),
        "long_headers": ("long_header_count > 0", "long_header_count"),
        "reserved_header_chars": ("reserved_header_char_count > 0", "reserved_header_char_count"),
        "invalid_chars": ("invalid_sequence_count > 0", "invalid_sequence_count"),
        "high_n_rate": ("(global_n_fraction > 0 AND global_n_fraction >= 0.05e0) OR high_n_sequence_count > 0", "CASE WHEN high_n_sequence_count > 0 THEN high_n_sequence_count ELSE sequence_count END"),
        "tiny_contigs": ("tiny_contig_count > 0", "tiny_contig_count"),
        "gap_runs": ("max_gap_run > 100", "greatest(long_gap_sequence_count, 1)"),
        "terminal_ns": ("terminal_n_sequence_count > 0", "terminal_n_sequence_count"),
        "gap_pattern_warnings": ("gap_pattern_sequence_count > 0", "gap_pattern_sequence_count"),
        "expected_size_outlier": (size, "1"),
        "duplicate_sequences": ("duplicate_sequence_count > 0", "duplicate_sequence_count"),
        "gc_outliers": ("gc_outlier_count > 0", "gc_outlier_count"),
        "length_outliers": ("length_outlier_count > 0", "length_outlier_count"),
        "composite_anomalies": ("composite_anomaly_count > 0", "composite_anomaly_count"),
    }


def _found_sql(expected: int | None = None) -> str:
    parts = []
    for k, (when, count) in _trigger(expected).items():
        share = "1e0" if k == "expected_size_outlier" else f"({count})::DOUBLE / sequence_count"
        parts.append(f"SELECT sample_id, '{k}' AS finding_id, ({count})::BIGINT AS affected_count, {share} AS affected_fraction FROM summary WHERE {when}")
    union = "\nUNION ALL ".join(parts)
    return f""",
catalog(position, finding_id, severity, category, confidence, needs_followup, first_action) AS (VALUES {E.CATALOG}),
found AS (SELECT sample_id, position, finding_id, severity, category, confidence, needs_followup, affected_count, affected_fraction FROM ({union}) JOIN catalog USING (finding_id))"""


def _verdict_sql(rules) -> str:
    return f""",
vv AS (SELECT s.sample_id, coalesce(string_agg(finding_id, ',' ORDER BY position), '') AS every,
    coalesce(string_agg(finding_id, ',' ORDER BY position) FILTER (WHERE severity = 'critical' OR finding_id IN ({rules})), '') AS blocking_findings,
    coalesce(string_agg(finding_id, ',' ORDER BY position) FILTER (WHERE NOT (severity = 'critical' OR finding_id IN ({rules}))), '') AS advisory_findings, count(finding_id) AS finding_count
    FROM summary s LEFT JOIN found f USING (sample_id) GROUP BY 1),
verdict AS (SELECT *, CASE WHEN blocking_findings <> '' THEN 'FAIL' WHEN every <> '' THEN 'WARN' ELSE 'PASS' END AS status FROM vv)"""


_VERDICT_OUT = "SELECT sample_id, status, CASE WHEN status = 'FAIL' THEN blocking_findings ELSE every END AS reasons, blocking_findings, advisory_findings, status = 'PASS' AS safe_for_downstream FROM verdict"


def _readiness_sql(rules: str) -> str:
    return f""",
touch(finding_id, category) AS (VALUES {E.TOUCH}), cats(ordinal, category) AS (VALUES {E.CATEGORIES}),
hit AS (SELECT sample_id, touch.category, bool_or(severity = 'critical' OR finding_id IN ({rules})) AS failed,
    coalesce(string_agg(touch.category || '.' || finding_id, ',' ORDER BY position) FILTER (WHERE severity = 'critical' OR finding_id IN ({rules})), '') AS blockers FROM found JOIN touch USING (finding_id) GROUP BY 1, 2),
ready AS (SELECT sample_id, ordinal, category, CASE WHEN failed THEN 'FAIL' WHEN failed IS NOT NULL THEN 'WARN' ELSE 'PASS' END AS status, coalesce(blockers, '') AS blockers
    FROM summary CROSS JOIN cats LEFT JOIN hit USING (sample_id, category)),
statuses AS (SELECT sample_id, string_agg(category || ':' || status, ',' ORDER BY ordinal) AS categories, {", ".join(f"max(status) FILTER (WHERE category = '{c}') AS {c}_status" for c in ("file", "structure", "alphabet", "index", "assembly", "submission", "machine"))} FROM ready GROUP BY 1),
blocked AS (SELECT s.sample_id, coalesce(string_agg(touch.category || '.' || f.finding_id, ',' ORDER BY f.position, c.ordinal) FILTER (WHERE f.severity = 'critical' OR f.finding_id IN ({rules})), '') AS blockers
    FROM summary s LEFT JOIN found f USING (sample_id) LEFT JOIN touch ON touch.finding_id = f.finding_id LEFT JOIN cats c ON c.category = touch.category GROUP BY 1),
subs AS (SELECT s.sample_id, coalesce(string_agg(f.finding_id, ',' ORDER BY f.position) FILTER (WHERE f.severity = 'critical' OR f.finding_id IN ({rules})), '') AS sub_block,
    coalesce(string_agg(f.finding_id, ',' ORDER BY f.position) FILTER (WHERE NOT (f.severity = 'critical' OR f.finding_id IN ({rules}))), '') AS sub_rest
    FROM summary s LEFT JOIN (SELECT * FROM found WHERE finding_id IN (SELECT finding_id FROM touch WHERE category = 'submission')) f USING (sample_id) GROUP BY 1)"""


_ADVICE = f""",
acts(finding_id, nth, action_type, tool, ext) AS (VALUES {E.ACTIONS}),
asks AS (SELECT sample_id, position * 10 + nth AS o, tool FROM found JOIN acts USING (finding_id)
UNION ALL SELECT sample_id, 1000 AS o, 'official submission validator' AS tool FROM found WHERE finding_id IN ({E.VALIDATOR})
UNION ALL SELECT sample_id, 1001 AS o, 'NCBI FCS' AS tool FROM found WHERE finding_id IN ({E.SCREEN})),
firsts AS (SELECT sample_id, tool, min(o) AS o FROM asks GROUP BY 1, 2),
advice AS (SELECT s.sample_id, coalesce(string_agg(tool, ',' ORDER BY o), '{E.PASS_TOOLS}') AS tools FROM summary s LEFT JOIN firsts USING (sample_id) GROUP BY 1)"""


def _oracles() -> dict[str, str]:
    base, raw, lang, head = (_rec(v) for v in ("iupac", "raw", "by_lang", "headers"))
    flag, full = base + _FLAG, base + _FLAG + _SUM
    found = full + _found_sql()
    feats = ", ".join(FEATURES)
    cohort = found + _verdict_sql(E.PIPELINE) + _readiness_sql(E.PIPELINE) + """,
co AS (SELECT s.*, v.status AS gate_status, v.finding_count, r.status AS submission_status FROM summary s JOIN verdict v USING (sample_id) JOIN ready r USING (sample_id) WHERE r.category = 'submission')"""
    tags = {"high_n_rate": "n_fraction >= 0.2e0", "tiny_contigs": "length < 200", "gap_runs": "max_gap_run > 100", "terminal_ns": "terminal_n_prefix > 0 OR terminal_n_suffix > 0", "gap_pattern_warnings": "gap_run_100_count > 0", "duplicate_sequences": "duplicate_sequence", "gc_outliers": "gc_outlier", "length_outliers": "length_outlier", "composite_anomalies": "composite_anomaly"}
    signals = "concat_ws(',', CASE WHEN gc_outlier THEN 'gc_outlier' END, CASE WHEN n_fraction >= 0.2e0 THEN 'high_n' END, CASE WHEN length_outlier THEN 'length_outlier' END, CASE WHEN duplicate_sequence THEN 'duplicate_sequence' END, CASE WHEN invalid_count > 0 THEN 'invalid_chars' END, CASE WHEN max_gap_run > 100 THEN 'gap_run' END)"
    shown = "\nUNION ALL ".join(f"SELECT '{k}' AS finding_id, flag.* FROM flag WHERE {v}" for k, v in tags.items())
    shown += "\nUNION ALL SELECT 'high_n_rate' AS finding_id, flag.* FROM flag JOIN summary USING (sample_id) WHERE high_n_sequence_count = 0"
    flags = "concat_ws(',', CASE WHEN length < 200 THEN 'tiny_contig' END, CASE WHEN n_fraction >= 0.2e0 THEN 'high_n' END, CASE WHEN gc_outlier THEN 'gc_outlier' END, CASE WHEN length_outlier THEN 'length_outlier' END, CASE WHEN composite_anomaly THEN 'composite_anomaly' END)"
    status = lambda c, s: f"count_if({c} = '{s}')::BIGINT"
    whole = found + _verdict_sql(E.PIPELINE) + _readiness_sql(E.PIPELINE) + _ADVICE + """,
every_metric AS (SELECT * FROM summary JOIN verdict USING (sample_id) JOIN statuses USING (sample_id) JOIN blocked USING (sample_id) JOIN subs USING (sample_id) JOIN advice USING (sample_id))"""
    catalog = f"(VALUES {E.CATALOG}) t(position, finding_id, severity, category, confidence, needs_followup, first_action)"
    return {
        "assembly_summary": f"{full} SELECT {', '.join(SUMMARY)} FROM summary",
        "record_features": f"{base} SELECT {feats} FROM feat",
        "raw_record_features": f"{raw} SELECT {feats} FROM feat",
        "composition_percent": f"{full} SELECT sample_id, gc_percent, at_percent, n_percent, ambiguity_percent, ungapped_total_length FROM summary",
        "gap_runs": f"{base} SELECT sample_id, record_idx, max_gap_run, gap_run_100_count FROM feat WHERE max_gap_run > 0",
        "terminal_n": f"{base} SELECT sample_id, record_idx, terminal_n_prefix, terminal_n_suffix FROM feat WHERE terminal_n_prefix > 0 OR terminal_n_suffix > 0",
        "header_flags": f"{head} SELECT sample_id, record_idx, unsafe_id, long_header, reserved_header_chars FROM feat",
        "first_token_ids": f"{lang} SELECT sample_id, record_idx, id AS first_token_id FROM feat",
        "duplicate_ids": f"{lang}{_FLAG} SELECT sample_id, record_idx, id FROM flag WHERE duplicate_id",
        "duplicate_sequences": f"{flag} SELECT sample_id, record_idx FROM flag WHERE duplicate_sequence",
        "sha256_fingerprint": f"{base} SELECT sample_id, record_idx, seq_hash FROM feat",
        "nx_lx": f"{full} SELECT sample_id, n50, l50, n90, l90 FROM nx",
        "median_length": f"{full} SELECT sample_id, median_length, mean_length FROM summary",
        "length_histogram": f"""{base}, sp AS (SELECT sample_id, min(length) AS lo, max(length) AS hi FROM feat GROUP BY 1),
sh AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - lo + 10) // 10 END AS width FROM sp),
ev AS (SELECT *, unnest(range(0, (hi - lo) // width + 1)) AS bin FROM sh)
SELECT e.sample_id, e.bin, lo + e.bin * width AS start, least(lo + e.bin * width + width - 1, hi) AS "end", count(f.length) AS record_count, coalesce(sum(f.length), 0)::BIGINT AS total_length
FROM ev e LEFT JOIN feat f ON f.sample_id = e.sample_id AND (f.length - lo) // width = e.bin GROUP BY e.sample_id, e.bin, lo, hi, width""",
        "gc_length_topk": f'{flag}, t AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY length DESC, id, record_idx) AS "rank" FROM flag) SELECT sample_id, "rank", id, length, gc_percent, {flags} AS flags FROM t WHERE "rank" <= 5000',
        "gc_zscore": f"{flag} SELECT sample_id, record_idx, gc_zscore FROM flag",
        "gc_outliers": f"{flag} SELECT sample_id, record_idx, gc_percent, gc_zscore FROM flag WHERE gc_outlier",
        "length_outliers": f"{flag} SELECT sample_id, record_idx, length FROM flag WHERE length_outlier",
        "composite_anomalies": f"{flag} SELECT sample_id, record_idx FROM flag WHERE composite_anomaly",
        "high_n_records": f"{base} SELECT sample_id, record_idx, n_fraction FROM feat WHERE n_fraction >= 0.2e0",
        "tiny_contigs": f"{base} SELECT sample_id, record_idx, length FROM feat WHERE length < 200",
        "invalid_records": f"{raw} SELECT sample_id, record_idx, invalid_count FROM feat WHERE invalid_count > 0",
        "expected_size": f"{full}{_found_sql(60_000)} SELECT sample_id, affected_count, affected_fraction FROM found WHERE finding_id = 'expected_size_outlier'",
        "findings": f"{found} SELECT * FROM found",
        "evidence_top20": f"""{found}, shown AS ({shown}), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, finding_id ORDER BY record_idx) AS "rank", {signals} AS signals FROM shown)
SELECT r.sample_id, finding_id, "rank", record_idx, id, length, gc_percent, gc_zscore, n_fraction, max_gap_run, signals FROM r SEMI JOIN found USING (sample_id, finding_id) WHERE "rank" <= 20""",
        "verdict": f"{found}{_verdict_sql("''")} {_VERDICT_OUT}",
        "gate_pipeline": f"{found}{_verdict_sql(E.PIPELINE)} {_VERDICT_OUT}",
        "gate_submission": f"{found}{_verdict_sql(E.NCBI)} {_VERDICT_OUT}",
        "readiness": f"{found}{_readiness_sql(E.NCBI_AND_N)} SELECT * FROM ready",
        "routing_hints": f"{found}, hints(finding_id, nth, condition, suggested_route, requires_external_database) AS (VALUES {E.HINTS}) SELECT sample_id, condition, suggested_route, requires_external_database, min(position * 10 + nth) AS first_position FROM found JOIN hints USING (finding_id) GROUP BY 1, 2, 3, 4",
        "finding_actions": f"{found}, acts(finding_id, nth, action_type, recommended_tool, requires_external_database) AS (VALUES {E.ACTIONS}) SELECT sample_id, position, finding_id, nth, action_type, recommended_tool, requires_external_database FROM found JOIN acts USING (finding_id)",
        "recommended_tools": f"{found}{_ADVICE} SELECT sample_id, tools FROM advice",
        "cohort_samples": f"""{whole} SELECT sample_id, sample_id AS input_path, status AS verdict, status AS gate_status, CASE WHEN blockers <> '' THEN 'FAIL' ELSE status END AS readiness_status, NULL::VARCHAR AS submission_target,
submission_status, categories AS readiness_categories, {", ".join(C.METRICS)}, finding_count, every AS finding_ids, blockers AS readiness_blockers, tools AS recommended_next_tools, '' AS input_sha256 FROM every_metric""",
        "cohort_summary": f"{cohort} SELECT count(*) AS sample_count, "
        + ", ".join([f"{status('gate_status', s)} AS {s.lower()}_count" for s in ("PASS", "WARN", "FAIL")] + [f"{status('submission_status', s)} AS submission_{s.lower()}_count" for s in ("PASS", "WARN", "FAIL")])
        + ", CASE WHEN bool_or(gate_status = 'FAIL') THEN 'FAIL' WHEN bool_or(gate_status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS worst_status FROM co",
        "cohort_outliers": f"""{full}, cs AS (SELECT count(*) AS n, quantile_cont(total_length, 0.25) AS q1, quantile_cont(total_length, 0.75) AS q3, sum(round(gc_percent * 100e0)::HUGEINT) AS s1, sum(round(gc_percent * 100e0)::HUGEINT * round(gc_percent * 100e0)::HUGEINT) AS s2 FROM summary),
cz AS (SELECT sample_id, total_length, gc_percent, n, q1, q3, abs(gc_percent - s1::DOUBLE / n / 100e0) / nullif(sqrt((n * s2 - s1 * s1)::DOUBLE / (n::DOUBLE * n::DOUBLE) / 10000e0), 0) AS z FROM summary CROSS JOIN cs)
SELECT sample_id, 'cohort_total_length_outliers' AS finding_id, total_length::DOUBLE AS value FROM cz WHERE n >= 4 AND q3 > q1 AND (total_length < q1 - 1.5e0 * (q3 - q1) OR total_length > q3 + 1.5e0 * (q3 - q1))
UNION ALL SELECT sample_id, 'cohort_gc_outliers', gc_percent FROM cz WHERE n >= 3 AND z >= 2e0""",
        "tsv_long": f"""{whole} SELECT sample_id, m.metric, CASE WHEN m.value IS NULL OR m.value = '' THEN '.' ELSE m.value END AS value
FROM (SELECT sample_id, unnest([{", ".join(f"{{'metric': '{k}', 'value': {v}}}" for k, v in E.TSV.items())}]) AS m FROM every_metric)""",
        "sql_functions": f"{base} SELECT sample_id, record_idx, gc_count, n_count, max_gap_run, gc_percent, seq_hash FROM feat",
        "finding_catalog": f"SELECT * FROM {catalog}",
        "catalog_lookup": f"SELECT * FROM {catalog} WHERE finding_id = 'gap_runs'",
        "fail_on_union": f"SELECT * FROM (VALUES {E.FAIL_ON}) t(gate, target, fail_on)",
        "structure_problems": f"SELECT source AS sample_id, doc_id::VARCHAR AS id, 'invalid_fasta_structure' AS finding_id, 'critical' AS severity FROM documents WHERE {_BASES} = ''",
        "fasta_features": f"{base} SELECT id, header, length, gc_count, n_count, max_gap_run, seq_hash FROM feat",
        "fasta_gzip_features": f"{base} SELECT id, header, length, gc_count, n_count, max_gap_run, seq_hash FROM feat",
        **E.FASTA,
    }


ORACLES = _oracles()
