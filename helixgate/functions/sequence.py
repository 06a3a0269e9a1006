"""Functions over sequences, ids and headers. Headers stay inside JVM expressions; sequences take one
Arrow pass."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The letters of each class of base.
GC, AT, N = "GC", "ATU", "N"
AMBIGUOUS = "NMRWSYKVHDB"


def ascii_upper(s: Column) -> Column:
    """Upper case of a-z alone; other characters stay."""
    return F.translate(s, LOWER, UPPER)


#: What one pass over a sequence counts, with its type.
COUNTS = {
    "length": "long", "gc_count": "long", "at_count": "long", "n_count": "long", "ambiguity_count": "long", "max_gap_run": "long",
    "gap_run_100_count": "long", "terminal_n_prefix": "long", "terminal_n_suffix": "long", "seq_hash": "string",
}
_RUNS = re.compile(b"N+")


def sequence_counts(data: bytes) -> tuple:
    """COUNTS of one sequence: bytes, letters of each class in either case, runs of N, N at both ends,
    and SHA-256 of the sequence with a-z in upper case."""
    u = data.upper()  # of bytes: a-z alone
    size = len(u)
    has = lambda letters: size - len(u.translate(None, letters.encode()))
    n = has(N)
    runs = [r.end() - r.start() for r in _RUNS.finditer(u)] if n else []
    ends = (size - len(u.lstrip(b"N")), size - len(u.rstrip(b"N"))) if n else (0, 0)
    return (size, has(GC), has(AT), n, has(AMBIGUOUS), max(runs, default=0), runs.count(100), *ends, hashlib.sha256(u).hexdigest())


def with_counts(records: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and COUNTS of every record. One vectorised pass in place of a dozen expressions that
    each walk the sequence by characters; sequences leave the JVM 256 at a time and don't come back."""
    slim = records.select(*keep, "sequence")
    kinds = dict(slim.dtypes)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*(sequence_counts(x or b"") for x in part.column("sequence").cast(pa.binary()).to_pylist())))
                counts = [pa.array(c, pa.string() if COUNTS[k] == "string" else pa.int64()) for k, c in zip(COUNTS, found)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + counts, names=[*keep, *COUNTS])

    return slim.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", " + ", ".join(f"{k} {t}" for k, t in COUNTS.items()))


def round2(x: Column) -> Column:
    """Two decimals, half away from zero on the product, as binary doubles give it."""
    return F.round(x * 100.0, 0) / 100.0


def fraction(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(total, F.lit(0)).cast("double"))


def percent(part: Column, total: Column) -> Column:
    return round2(fraction(part, total) * 100.0)


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"(?U)^(\S+)", 1)


def unsafe_id(id_: Column) -> Column:
    """White space of any script at an end, control characters or slashes."""
    return id_.rlike(r"(?U)^\s|\s\z|[\p{Cc}/\\]")


def long_header(header: Column, limit: int = 255) -> Column:
    return F.length(header) > limit


def reserved_header_chars(header: Column) -> Column:
    """Reserved characters, or a tab inside the header."""
    return header.rlike(r"(?U)[|;\"'`<>]|\S\s*\t\s*\S")


#: name -> Column function, for those that make sense by themselves in SQL.
SQL_FUNCTIONS = {
    "hg_gc_count": ("s STRING", "BIGINT", "length(s) - length(translate(s, 'GCgc', ''))"),
    "hg_n_count": ("s STRING", "BIGINT", "length(s) - length(translate(s, 'Nn', ''))"),
    "hg_round2": ("x DOUBLE", "DOUBLE", "round(x * 100D, 0) / 100D"),
    "hg_percent": ("part BIGINT, total BIGINT", "DOUBLE", "CASE WHEN total = 0 THEN 0D ELSE round(CAST(part AS DOUBLE) / total * 100D * 100D, 0) / 100D END"),
    "hg_max_gap_run": ("s STRING", "INT", "coalesce(array_max(transform(regexp_extract_all(upper(s), 'N+', 0), r -> length(r))), 0)"),
    "hg_sequence_hash": ("s STRING", "STRING", f"sha2(translate(s, '{LOWER}', '{UPPER}'), 256)"),
}


def register_sql(spark) -> None:
    """The functions above as temporary SQL functions, inlined by Catalyst."""
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
