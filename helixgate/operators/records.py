"""Per-record features and flags, per-sample statistics, plots.

Sequences are reduced to features before anything is shuffled. No sample's records are sorted or
gathered whole: duplicates compare with the least record number of their key, order statistics and
Nx work on counts per distinct length (of which a sample holds as many as it has lengths), spread
comes from exact sums, and plot points are cut to the longest records by length counts and in salted
parts before the few that are left are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequence as S
from ..store import store


@dataclass(frozen=True)
class Profile:
    """Thresholds of the assembly profile."""

    name: str = "assembly"
    high_n_sequence: float = 0.20
    high_n_global: float = 0.05
    min_contig_length: int = 200
    max_gap_run: int = 100
    gc_zscore: float = 3.0
    iqr_multiplier: float = 1.5
    cohort_gc_zscore: float = 2.0
    expected_size: int | None = None
    expected_tolerance: float = 0.25

    def __post_init__(self):
        if self.name != "assembly":
            raise ValueError(f"unknown profile: {self.name}")
        if not 0 <= self.high_n_global <= 1:
            raise ValueError("the N rate must lie in [0, 1]")
        if not 0 <= self.expected_tolerance < float("inf"):
            raise ValueError("the tolerance must be finite and not negative")


def features(records: DataFrame) -> DataFrame:
    """One narrow row per record; the sequence itself is left behind here."""
    counted = S.with_counts(records, ["sample_id", "record_idx", "id", "header"])
    return counted.select(
        "sample_id", "record_idx", "id", "header", S.first_token(F.col("header")).alias("first_token_id"), "length", "gc_count", "at_count", "n_count", "ambiguity_count",
        (F.col("length") - F.col("gc_count") - F.col("at_count") - F.col("ambiguity_count")).alias("invalid_count"),
        "max_gap_run", "gap_run_100_count", "terminal_n_prefix", "terminal_n_suffix",
        S.fraction(F.col("n_count"), F.col("length")).alias("n_fraction"),
        S.percent(F.col("gc_count"), F.col("length")).alias("gc_percent"),
        "seq_hash", S.unsafe_id(F.col("id")).alias("unsafe_id"), S.long_header(F.col("header")).alias("long_header"),
        S.reserved_header_chars(F.col("header")).alias("reserved_header_chars"),
    )


DUPLICATES = {"id": "duplicate_id", "first_token_id": "duplicate_first_token_id", "seq_hash": "duplicate_sequence"}


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Flags the second and later records of each id, first token and sequence of a sample. All three
    keys go through one aggregate; only keys seen twice meet the records again."""
    keys = F.array(*(F.struct(F.lit(flag).alias("flag"), F.col(key).alias("key")) for key, flag in DUPLICATES.items()))
    long = rows.select("sample_id", "record_idx", F.explode(keys).alias("k")).select("sample_id", "record_idx", "k.flag", "k.key")
    first = long.groupBy("sample_id", "flag", "key").agg(F.min("record_idx").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    later = long.join(first, ["sample_id", "flag", "key"]).where("record_idx > __first")
    flags = later.groupBy("sample_id", "record_idx").agg(*(F.bool_or(F.col("flag") == flag).alias(flag) for flag in DUPLICATES.values()))
    marked = rows.join(flags, ["sample_id", "record_idx"], "left")
    return marked.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in DUPLICATES.values()})


def high_n(p: Profile) -> Column:
    return F.col("n_fraction") >= p.high_n_sequence


def long_gap(p: Profile) -> Column:
    return F.col("max_gap_run") > p.max_gap_run


def tiny(p: Profile) -> Column:
    return F.col("length") < p.min_contig_length


def terminal_n() -> Column:
    return (F.col("terminal_n_prefix") > 0) | (F.col("terminal_n_suffix") > 0)


def length_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id", "length").agg(F.count("*").alias("n"))


def nx_lx(counts: DataFrame) -> DataFrame:
    """N50, L50, N90 and L90 in whole numbers. The 90 % target lies just above 9/10 of the total,
    so a prefix that sums to exactly 9/10 doesn't reach it; one of exactly half does reach N50."""
    w = W.partitionBy("sample_id")
    before = w.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    run = counts.select(
        "sample_id",
        "length",
        "n",
        F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)).alias("sum_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum(F.col("length") * F.col("n")).over(w).alias("total"),
    )
    end = F.col("sum_before") + F.col("length") * F.col("n")
    # how many records of this length it takes to reach the target
    k50 = F.greatest(F.expr("cast(ceil((total - 2 * sum_before) / cast(2 * greatest(length, 1) as decimal(38,0))) as long)"), F.lit(1))
    k90 = F.expr("(9 * total - 10 * sum_before) div (10 * greatest(length, 1))") + 1
    # the one length at which the target is reached
    at50 = (2 * end >= F.col("total")) & (2 * F.col("sum_before") < F.col("total"))
    at90 = (10 * end > 9 * F.col("total")) & (10 * F.col("sum_before") <= 9 * F.col("total"))
    return run.groupBy("sample_id").agg(
        F.coalesce(F.max(F.when(at50, F.col("length"))), F.lit(0)).alias("n50"),
        F.coalesce(F.min(F.when(at50, F.col("n_before") + k50)), F.lit(0)).alias("l50"),
        F.coalesce(F.max(F.when(at90, F.col("length"))), F.lit(0)).alias("n90"),
        F.coalesce(F.min(F.when(at90, F.col("n_before") + k90)), F.lit(0)).alias("l90"),
    )


def sample_stats(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per sample what outlier rules need: quartiles of length, mean and spread of GC."""
    quart = counts.groupBy("sample_id").agg(F.percentile("length", [0.25, 0.75], F.col("n")).alias("q"), F.percentile("length", 0.5, F.col("n")).alias("mid"))
    x = F.round(F.col("gc_percent") * 100, 0).cast("decimal(38,0)")
    spread = rows.groupBy("sample_id").agg(F.count("*").alias("records"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    n = F.col("records").cast("double")
    mean = F.col("s1").cast("double") / n / 100.0
    # n * s2 - s1 * s1 is exact, and nil exactly if all values are equal
    var = (F.col("records").cast("decimal(20,0)") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (n * n) / 10000.0
    return spread.join(quart, "sample_id").select(
        "sample_id", "records", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "mid", mean.alias("gc_mean"), F.sqrt(var).alias("gc_sd")
    )


def with_outliers(rows: DataFrame, p: Profile = Profile(), counts: DataFrame | None = None) -> DataFrame:
    """Adds gc_zscore, gc_outlier, length_outlier and composite_anomaly."""
    stats = sample_stats(rows, length_counts(rows) if counts is None else counts)
    z = F.when((F.col("records") >= 3) & (F.col("gc_sd") > 0), F.abs((F.col("gc_percent") - F.col("gc_mean")) / F.nullif("gc_sd", F.lit(0.0))))
    iqr = F.col("q3") - F.col("q1")
    far = (F.col("length") < F.col("q1") - p.iqr_multiplier * iqr) | (F.col("length") > F.col("q3") + p.iqr_multiplier * iqr)
    out = rows.join(stats, "sample_id").withColumns(
        {
            "gc_zscore": S.round2(z),
            "gc_outlier": F.coalesce(z >= p.gc_zscore, F.lit(False)),
            "length_outlier": (F.col("records") >= 4) & (iqr > 0) & far,
        }
    )
    anomaly = (F.col("gc_outlier") | high_n(p)) & (F.col("length_outlier") | F.col("duplicate_sequence") | (F.col("invalid_count") > 0) | long_gap(p))
    return out.withColumn("composite_anomaly", anomaly).drop("records", "q1", "q3", "mid", "gc_mean", "gc_sd")


def flagged(records: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Features with all flags. Texts are read once: features, and then flagged rows, are stored as
    narrow tables, on which the several passes of flags, statistics and rules are cheap."""
    return store(with_outliers(with_duplicates(store(features(records), "features")), p), "flagged")


def summary(rows: DataFrame, p: Profile = Profile()) -> DataFrame:
    """One row per sample from flagged rows: one hash aggregate and one over length counts."""
    counts = length_counts(rows)
    base = rows.groupBy("sample_id").agg(
        F.count("*").alias("sequence_count"),
        F.sum("length").alias("total_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.sum("gc_count").alias("gc"),
        F.sum("at_count").alias("at"),
        F.sum("n_count").alias("n"),
        F.sum("ambiguity_count").alias("ambiguity"),
        F.max("max_gap_run").alias("max_gap_run"),
        F.count_if("duplicate_id").alias("duplicate_id_count"),
        F.count_if("duplicate_first_token_id").alias("duplicate_first_token_id_count"),
        F.count_if("duplicate_sequence").alias("duplicate_sequence_count"),
        F.count_if("unsafe_id").alias("unsafe_id_count"),
        F.count_if("long_header").alias("long_header_count"),
        F.count_if("reserved_header_chars").alias("reserved_header_char_count"),
        F.count_if(F.col("invalid_count") > 0).alias("invalid_sequence_count"),
        F.count_if(high_n(p)).alias("high_n_sequence_count"),
        F.count_if(tiny(p)).alias("tiny_contig_count"),
        F.count_if(terminal_n()).alias("terminal_n_sequence_count"),
        F.count_if(F.col("gap_run_100_count") > 0).alias("gap_pattern_sequence_count"),
        F.count_if(long_gap(p)).alias("long_gap_sequence_count"),
        F.count_if("gc_outlier").alias("gc_outlier_count"),
        F.count_if("length_outlier").alias("length_outlier_count"),
        F.count_if("composite_anomaly").alias("composite_anomaly_count"),
    )
    mid = counts.groupBy("sample_id").agg(F.percentile("length", 0.5, F.col("n")).alias("mid"))
    t = F.col("total_length")
    wide = base.join(mid, "sample_id").join(nx_lx(counts), "sample_id")
    return wide.select(
        "sample_id", "sequence_count", "total_length", "min_length", "max_length",
        S.round2(t.cast("double") / F.col("sequence_count")).alias("mean_length"),
        S.round2(F.col("mid")).alias("median_length"),
        "n50", "n90", "l50", "l90",
        S.percent(F.col("gc"), t).alias("gc_percent"), S.percent(F.col("at"), t).alias("at_percent"),
        S.percent(F.col("n"), t).alias("n_percent"), S.percent(F.col("ambiguity"), t).alias("ambiguity_percent"),
        (t - F.col("n")).alias("ungapped_total_length"), "max_gap_run",
        *(c for c in base.columns if c.endswith("_count") and c != "sequence_count"),
        S.fraction(F.col("n"), t).alias("global_n_fraction"),
    )


def length_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """At most ``bins`` equal whole-number bins of length per sample; empty ones are kept."""
    counts = length_counts(rows)
    span = counts.groupBy("sample_id").agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    width = F.expr(f"(hi - lo + 1 + {bins - 1}) div {bins}")
    shaped = span.withColumn("width", F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(width)).withColumn("last", F.expr("(hi - lo) div width"))
    filled = counts.join(shaped, "sample_id").groupBy("sample_id", F.expr("(length - lo) div width").alias("bin")).agg(F.sum("n").alias("record_count"), F.sum(F.col("length") * F.col("n")).alias("total_length"))
    every = shaped.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start = F.col("lo") + F.col("bin") * F.col("width")
    return every.join(filled, ["sample_id", "bin"], "left").select(
        "sample_id", "bin", start.alias("start"), F.least(start + F.col("width") - 1, F.col("hi")).alias("end"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("total_length", F.lit(0)).alias("total_length"),
    )


def gc_length_points(rows: DataFrame, p: Profile = Profile(), limit: int = 5000, salts: int = 64) -> DataFrame:
    """The ``limit`` longest records of each sample with their flags, for a GC against length plot.

    Counts per length tell from which length on records can be among them; what is left, ties
    included, is cut to ``limit`` in salted parts and then ranked."""
    down = W.partitionBy("sample_id").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    longer = length_counts(rows).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    least = longer.where(F.col("before") < limit).groupBy("sample_id").agg(F.min("length").alias("__least"))
    long = rows.join(least, "sample_id").where("length >= __least").withColumn("__part", F.pmod(F.xxhash64("record_idx"), F.lit(salts)))
    order = (F.desc("length"), "id", "record_idx")
    flags = F.filter(
        F.array(
            F.when(tiny(p), "tiny_contig"), F.when(high_n(p), "high_n"), F.when(F.col("gc_outlier"), "gc_outlier"),
            F.when(F.col("length_outlier"), "length_outlier"), F.when(F.col("composite_anomaly"), "composite_anomaly"),
        ),
        lambda f: f.isNotNull(),
    )
    cut = long.select("sample_id", "__part", "record_idx", "id", "length", "gc_percent", flags.alias("flags"))
    cut = cut.withColumn("rank", F.row_number().over(W.partitionBy("sample_id", "__part").orderBy(*order))).where(F.col("rank") <= limit)
    top = cut.withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(*order))).where(F.col("rank") <= limit)
    return top.select("sample_id", "rank", "id", "length", "gc_percent", "flags")
