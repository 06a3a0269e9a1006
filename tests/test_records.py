import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgate.operators import records as R
from helixgate.sources.fasta import from_records


def feature_rows(spark, sequences, headers=None):
    headers = headers or [f"r{k}" for k in range(len(sequences))]
    rows = [(h.split()[0] if h.split() else "", h, s) for h, s in zip(headers, sequences)]
    return from_records(spark, rows)


def brute(s):
    u = "".join(c.upper() if c.isascii() else c for c in s)
    size, gc, at, n = len(s.encode()), sum(u.count(c) for c in "GC"), sum(u.count(c) for c in "ATU"), u.count("N")
    amb = n + sum(u.count(c) for c in "MRWSYKVHDB")
    runs = [len(x) for x in re.findall("N+", u)]
    r2 = lambda v: math.floor(v * 100 + 0.5) / 100
    return (
        size, gc, at, n, amb, size - gc - at - amb, max(runs, default=0), sum(x == 100 for x in runs),
        len(re.match("N*", u)[0]), len(u) - len(u.rstrip("N")), n / size if size else 0.0, r2(gc / size * 100) if size else 0.0, hashlib.sha256(u.encode()).hexdigest(),
    )


NAMES = ["length", "gc_count", "at_count", "n_count", "ambiguity_count", "invalid_count", "max_gap_run", "gap_run_100_count", "terminal_n_prefix", "terminal_n_suffix", "n_fraction", "gc_percent", "seq_hash"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ACGTUNnacgtRYK-* é\t9", max_size=40), min_size=1, max_size=25))
def test_features_equal_brute_force(spark, sequences):
    sequences = [*sequences, "N" * 100, "A" + "n" * 100 + "C" + "N" * 101]
    got = R.features(feature_rows(spark, sequences)).orderBy("record_idx").select(*NAMES).collect()
    for r, s in zip(got, sequences):
        assert tuple(r) == brute(s)


def test_header_flags(spark):
    headers = ["ok", "a/b x", "a\\b", "tab\there", "semi;colon", "x" * 256, "x" * 255, "quote'd"]
    got = R.features(feature_rows(spark, ["A"] * len(headers), headers)).orderBy("record_idx").collect()
    assert [r["unsafe_id"] for r in got] == [False, True, True, False, False, False, False, False]
    assert [r["long_header"] for r in got] == [False] * 5 + [True, False, False]
    assert [r["reserved_header_chars"] for r in got] == [False, False, False, True, True, False, False, True]


def nx(lengths, f):
    total, run = sum(lengths), 0
    for k, x in enumerate(sorted(lengths, reverse=True), 1):
        run += x
        if (2 * run >= total) if f == 50 else (10 * run > 9 * total):
            return x, k
    return 0, 0


@pytest.mark.parametrize("lengths", [[10, 80, 20, 40], [50, 40, 30, 20, 10], [5], [90, 10], [9] * 10, [1, 1, 2, 2, 2, 90], [100, 100, 100, 7], list(range(1, 60))])
def test_nx(spark, lengths):
    counts = R.length_counts(R.features(feature_rows(spark, ["A" * n for n in lengths])))
    r = R.nx_lx(counts).first()
    assert ((r["n50"], r["l50"]), (r["n90"], r["l90"])) == (nx(lengths, 50), nx(lengths, 90))


def test_duplicates_outliers_and_composites(spark):
    balanced = [("ACGT" * 300)[: 900 + 24 * k] for k in range(11)]
    rows = R.flagged(feature_rows(spark, [*balanced, "G" * 10_000, balanced[0]])).orderBy("record_idx").collect()
    assert [r["record_idx"] for r in rows if r["duplicate_sequence"]] == [12]
    assert [r["record_idx"] for r in rows if r["gc_outlier"]] == [11] == [r["record_idx"] for r in rows if r["length_outlier"]]
    assert [r["record_idx"] for r in rows if r["composite_anomaly"]] == [11]
    same = R.flagged(feature_rows(spark, ["ACGT"] * 5, ["a x", "a y", "b", "c", "a"])).orderBy("record_idx").collect()
    assert [r["duplicate_id"] for r in same] == [False, True, False, False, True]
    assert all(r["gc_zscore"] is None and not r["length_outlier"] for r in same)


def test_quartile_fences(spark):
    lengths = [1, 100, 101, 102, 103, 104, 105, 10_000]
    rows = R.flagged(feature_rows(spark, ["A" * n for n in lengths])).orderBy("record_idx").collect()
    assert [r["record_idx"] for r in rows if r["length_outlier"]] == [0, 7]


def test_histogram_keeps_empty_bins(spark):
    h = R.length_histogram(R.features(feature_rows(spark, ["A" * n for n in (1, 2, 100)]))).orderBy("bin").collect()
    assert [b["record_count"] for b in h] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert (h[0]["start"], h[0]["end"], h[-1]["end"]) == (1, 10, 100)
    one = R.length_histogram(R.features(feature_rows(spark, ["AA", "CC"]))).collect()
    assert [(b["start"], b["end"], b["record_count"], b["total_length"]) for b in one] == [(2, 2, 2, 4)]


def test_profiles_are_checked():
    for bad in ({"name": "protein"}, {"high_n_global": 1.5}, {"expected_tolerance": float("inf")}):
        with pytest.raises(ValueError):
            R.Profile(**bad)
