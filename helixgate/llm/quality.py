"""Quality rules: fixed limits, then robust multivariate outliers.

Per document the base statistics are exact counts over the whole text. Documents that pass
the fixed limits get a vector of transformed statistics; per (language, source) group a
minimum-covariance-determinant (MCD) estimate of location and scatter is computed over *all*
rows of the group, and a document is rejected when its squared Mahalanobis distance exceeds
``cutoff``.

The MCD is the deterministic variant with a regularised determinant: three starts (medians and MADs
alone, with the correlations of tanh scores, and with those of spatial signs) each take concentration
steps until the determinant of their scatter falls no more, and the start with the least determinant
is kept. ``floor_sd`` is added to every scatter, since repeats are nil in most texts and their own
spread in the subset may be nil. Rows within the 97.5 % point of chi-square then give the final mean
and scatter, scaled to a normal sample's median, and a document is rejected when its squared distance
exceeds the point of chi-square that a share ``tail`` of a normal sample would exceed.

A concentration step never gathers a group: distances are counted in fine logarithmic bins (group,
bin), at most some thousands to a group, the bin that completes the h-subset is found over those
counts, and the subset's moments are sums of products. Vector entries are fixed-point integers, so
sums are exact and reruns agree bit for bit whatever the partitioning. A group that holds most
rows is pre-aggregated map-side like any other.

Defined results: null text counts as no words (and fails the limits); very long texts are counted whole;
null language or source is a group of its own; rows whose distances tie share a bin and enter a subset
together; groups under ``min_group`` rows use the pool of such groups of their language, then the
whole language, then all rows, however few; repeated rows are judged one by one; extra columns,
whatever their names, are kept by ``filter_documents`` and ignored by ``quality_rules``; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import discard, materialize, read, slices, tidied

SYMBOLS = b"#*$%&|<>"
_WS = b" \t\n\x0b\x0c\r"
_CONT = bytes(range(0x80, 0xC0))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
DIMS = 5


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: rows that a group needs for an estimate of its own
    min_group: int = 200
    #: share of a group's rows in the concentrated subset
    subset: float = 0.75
    #: concentration steps at most; determinants settle well before
    max_steps: int = 30
    #: a start has settled when a step lowers the logarithm of its determinant by no more
    tolerance: float = 1e-4
    #: share of a normal sample that would be rejected
    tail: float = 1e-9
    #: spread that is ordinary in any group, per entry in fixed-point units (1000 = 1.0)
    floor_sd: tuple[int, ...] = (60, 60, 150, 150, 60)

    @property
    def cutoff(self) -> float:
        return chi_square_point(self.tail)


def chi_square_point(tail: float) -> float:
    """The value that chi-square with DIMS = 5 degrees of freedom exceeds with probability ``tail``."""

    def exceeds(x):
        return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if exceeds(mid) > tail else (low, mid)
    return low


def text_stats(data: bytes) -> tuple[int, ...]:
    """The counts of STATS for one UTF-8 text."""
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    if n > 5:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        win = h[: n - 4] * _MIX[0]
        for k in range(1, 5):
            win = (win ^ (win >> np.uint64(29))) * _MIX[k] + h[k : n - 4 + k]
        order = np.argsort(win)
        win = win[order]
        same = win[1:] == win[:-1]
        if same.any():
            twice = np.zeros(len(win), bool)
            twice[1:] |= same
            twice[:-1] |= same
            covered = np.zeros(n + 1, np.int64)
            starts = order[twice]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + 5, -1)
            repeat = int((np.cumsum(covered)[:n] > 0).sum())
    return (
        n,
        len(data.translate(None, _WS + _CONT)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def with_stats(docs: DataFrame) -> DataFrame:
    """Every document as a struct ``doc`` beside its base counts, so that no column of the
    documents can clash with one of ours."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    kind = packed.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            doc = batch.column(0)
            texts = doc.field("text").cast(pa.binary()).to_pylist()
            rows = np.array([text_stats(x or b"") for x in texts], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["doc", *STATS])

    return packed.mapInArrow(tidied(run), f"doc {kind}, " + ", ".join(f"{s} long" for s in STATS))


def _vector() -> list[F.Column]:
    """Transformed statistics in fixed point. Pseudo-counts keep short texts near the middle."""
    words, lines = F.col("n_words").cast("double"), F.col("n_lines").cast("double")
    entries = [
        (F.col("word_chars") + 250.0) / (words + 50.0),
        F.log1p(20.0 * F.col("n_symbols") / (words + 20.0)),
        F.log1p(5.0 * F.col("n_dup_lines") / (lines + 5.0)),
        F.log1p(5.0 * F.col("n_repeat_words") / (words + 20.0)),
        F.log1p(20.0 * F.col("n_upper") / (F.col("word_chars") + 100.0)),
    ]
    return [F.round(e * 1000).cast("long").alias(f"x{k}") for k, e in enumerate(entries)]


def _fits(rules: Rules) -> F.Column:
    return ~((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def _keys() -> dict[str, F.Column]:
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return {"l": mark("doc.lang"), "s": mark("doc.source")}


def _groups(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(uses, members): l, s and the group ``g`` whose estimate their rows use, and l, s and each group
    ``g`` that they are members of. Small groups are members of their pool too, and of their language
    or of all rows where some group falls back on these."""
    sizes = materialize(rows.groupBy("l", "s").agg(F.count("*").alias("n")), "quality-sizes")
    sums = sizes.groupBy("l").agg(F.sum(F.when(F.col("n") < rules.min_group, F.col("n"))).alias("p"), F.sum("n").alias("whole"))
    own, pool, whole = F.to_json(F.struct("l", "s")), F.to_json(F.struct("l", F.lit("few").alias("of"))), F.to_json(F.struct("l", F.lit("all").alias("of")))
    enough = lambda c: F.col(c) >= rules.min_group
    uses = sizes.join(sums, "l").select("l", "s", "n", F.when(enough("n"), own).when(enough("p"), pool).when(enough("whole"), whole).otherwise(F.lit("{}")).alias("g"))
    uses = materialize(uses, "quality-groups")
    may = F.array(own, F.when(F.col("n") < rules.min_group, pool), whole, F.lit("{}"))
    members = uses.select("l", "s", F.explode(F.filter(may, lambda x: x.isNotNull())).alias("g")).join(uses.select("g").distinct(), "g", "left_semi")
    return uses.select("l", "s", "g"), members


def _nth(counts: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per ``keys`` the least ``value`` at which the counts ``n`` add up to ``share`` of all."""
    w = W.partitionBy(*keys)
    return (
        counts.withColumn("__c", F.sum("n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__t", F.sum("n").over(w))
        .where(F.col("__c") >= F.ceil(F.col("__t") * share))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )


def _distance() -> F.Column:
    d = [F.col(f"x{k}") - F.col("mean")[k] for k in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        inner = F.lit(0.0)
        for j in range(DIMS):
            inner = inner + F.col("inv")[i * DIMS + j] * d[j]
        total = total + d[i] * inner
    return total


def _bin() -> F.Column:
    return F.floor(F.log2(1 + F.col("d2") * 16) * 64).cast("int")


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
    products = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), *sums, *products)


def _scatter(r) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a row of ``_moments``."""
    n = int(r.n)
    s = [int(getattr(r, f"s{i}")) for i in range(DIMS)]
    cov = np.empty((DIMS, DIMS))
    for i in range(DIMS):
        for j in range(i, DIMS):
            cov[i, j] = cov[j, i] = (n * int(getattr(r, f"p{i}{j}")) - s[i] * s[j]) / (n * n)  # whole numbers up to here
    return np.array(s) / n, cov


PARAMS = "g string, start int, mean array<double>, inv array<double>, logdet double"


def _row(g, start, mean, cov) -> tuple:
    return g, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _solve(moments: DataFrame, rules: Rules) -> DataFrame:
    """PARAMS of every group and start from its sums: one small row for each."""
    floor2 = np.diag([float(x) ** 2 for x in rules.floor_sd])

    def run(frames):
        for f in frames:
            out = [_row(r.g, r.start, *((mean, cov + floor2))) for r in f.itertuples(index=False) for mean, cov in [_scatter(r)]]
            yield pd.DataFrame(out, columns=["g", "start", "mean", "inv", "logdet"])

    return moments.mapInPandas(run, PARAMS)


def _starts(rows: DataFrame, rules: Rules) -> DataFrame:
    """PARAMS of the three starts of every group."""
    floors = [float(x) ** 2 for x in rules.floor_sd]
    long = rows.select("g", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x")) for k in range(DIMS)))).alias("e")).select("g", "e.k", "e.x")
    counts = materialize(long.groupBy("g", "k", "x").agg(F.count("*").alias("n")), "quality-counts")
    med = _nth(counts, ["g", "k"], "x", 0.5, "med")
    spread = counts.join(med, ["g", "k"]).withColumn("a", F.abs(F.col("x") - F.col("med"))).groupBy("g", "k", "a").agg(F.sum("n").alias("n"))
    sd = F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + F.element_at(F.array(*(F.lit(x) for x in floors)), F.col("k") + 1))
    center = med.join(_nth(spread, ["g", "k"], "a", 0.5, "mad"), ["g", "k"]).select("g", "k", "med", sd.alias("sd"))
    center = center.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "med", "sd"))).alias("e"))
    center = materialize(center.select("g", F.col("e.med").alias("med"), F.col("e.sd").alias("sd")), "quality-center")
    discard(counts)
    z = [(F.col(f"x{k}") - F.col("med")[k]) / F.col("sd")[k] for k in range(DIMS)]
    norm = F.sqrt(sum((c * c for c in z), F.lit(0.0)))
    fixed = lambda c: F.round(c * 10_000).cast("long")
    scores = F.array(
        F.struct(F.lit(1).alias("start"), *(fixed(F.tanh(c)).alias(f"x{k}") for k, c in enumerate(z))),
        F.struct(F.lit(2).alias("start"), *(fixed(F.when(norm > 0, c / norm).otherwise(0.0)).alias(f"x{k}") for k, c in enumerate(z))),
    )
    scored = rows.join(center, "g").select("g", F.explode(scores).alias("v")).select("g", "v.*")
    with_center = _moments(scored).join(center, "g")

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                med, sd = np.array(r.med, float), np.array(r.sd, float)
                cov = _scatter(r)[1]
                one = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                corr = cov / np.outer(one, one)
                np.fill_diagonal(corr, 1.0)
                # half of the floor stays on the diagonal alone, so that no start is singular
                out.append(_row(r.g, r.start, med, np.outer(sd, sd) * corr + np.diag(floors) / 2))
                if r.start == 1:
                    out.append(_row(r.g, 0, med, np.diag(sd**2)))
            yield pd.DataFrame(out, columns=["g", "start", "mean", "inv", "logdet"])

    return materialize(with_center.mapInPandas(run, PARAMS), "quality-starts")


def _scale(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with ``scale``, which makes the median squared distance that of a normal sample."""
    near = rows.join(params, "g").withColumn("d2", _distance()).withColumn("b", _bin())
    middle = _nth(near.groupBy("g", "b").agg(F.count("*").alias("n")), ["g"], "b", 0.5, "b")
    chi_median = chi_square_point(0.5)
    return params.join(middle, "g").select("g", "mean", "inv", F.greatest(F.lit(1.0), (F.pow(2.0, (F.col("b") + 1) / 64) - 1) / 16 / chi_median).alias("scale"))


def mcd(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows``: g, x0..x4. Returns g, mean, inv (of the reweighted scatter) and scale."""
    # each start of each group goes on until it has settled, whatever the others do
    params, settled = _starts(rows, rules).withColumn("logdet", F.lit(1e300)), []
    for _ in range(rules.max_steps):
        near = rows.join(params, "g").withColumn("d2", _distance()).withColumn("b", _bin())
        limit = _nth(near.groupBy("g", "start", "b").agg(F.count("*").alias("n")), ["g", "start"], "b", rules.subset, "limit")
        new = _solve(_moments(near.join(limit, ["g", "start"]).where("b <= limit")), rules)
        before = params.select("g", "start", F.col("logdet").alias("before"))
        new = new.join(before, ["g", "start"]).withColumn("done", F.col("logdet") >= F.col("before") - rules.tolerance).drop("before")
        new = materialize(new, "quality-step")
        settled.append(new.where("done").drop("done"))
        params = new.where("not done").drop("done")
        if params.isEmpty():
            break
    for more in settled:
        params = params.unionByName(more)
    best = params.groupBy("g").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    best = materialize(best, "quality-best")
    raw = materialize(_scale(rows, best), "quality-raw")
    inside = rows.join(raw, "g").where(_distance() <= F.col("scale") * chi_square_point(0.025)).withColumn("start", F.lit(0))
    final = materialize(_solve(_moments(inside), rules).select("g", "mean", "inv"), "quality-final")
    return _scale(rows, final)


def estimates(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """From the counts of all documents, per language and source (l, s): mean, inv and scale."""
    fit = stats.where(_fits(rules)).select(*(c.alias(n) for n, c in _keys().items()), *_vector())
    fit = materialize(fit, "quality-vectors")
    uses, members = _groups(fit, rules)
    known = materialize(fit.join(members, ["l", "s"]).select("g", *(f"x{k}" for k in range(DIMS))), "quality-members")
    out = materialize(uses.join(mcd(known, rules), "g").drop("g"), "quality-estimates")
    discard(fit, known)
    return out


def judge(stats: DataFrame, est: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc, the base counts, base_failed, distance (null without an estimate) and kept."""
    rows = stats.select("*", *(c.alias(n) for n, c in _keys().items()), *_vector(), _fits(rules).alias("fits"))
    scored = rows.join(est, ["l", "s"], "left").withColumn("distance", F.when(F.col("fits"), _distance() / F.col("scale")))
    return scored.select(
        "doc",
        *STATS,
        (~F.col("fits")).alias("base_failed"),
        "distance",
        (F.col("fits") & F.coalesce(F.col("distance") <= rules.cutoff, F.lit(True))).alias("kept"),
    )


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, distance and kept."""
    counted = with_stats(docs.select("doc_id", "lang", "source", "text"))
    slim = counted.select(F.struct("doc.doc_id", "doc.lang", "doc.source").alias("doc"), *STATS)
    stats = materialize(slim, "quality-stats")
    return judge(stats, estimates(stats, rules), rules).select("doc.doc_id", *STATS, "base_failed", "distance", "kept")


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns. Only the estimates, one row per
    language and source, are joined to the texts; counting them a second time is cheaper than
    moving them."""
    counted = with_stats(docs.select("lang", "source", "text")).select(F.struct("doc.lang", "doc.source").alias("doc"), *STATS)
    est = estimates(materialize(counted, "quality-stats"), rules)
    return judge(with_stats(docs), est, rules).where("kept").select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
