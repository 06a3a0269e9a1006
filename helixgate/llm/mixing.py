"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sizes are word counts. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
the words of all documents; a target stops at ``cap`` times its source's size and the excess is
reshared by weight, which has a closed form over the sources sorted by cap per weight. Every
document of a source is due target / size copies on average: the whole part it gets, the
fraction is rounded by the pivotal method. A source's documents are dealt to leaves of about ``fan``
documents by size (their place follows from counts per size class and a hash); in a leaf, from large to
small, neighbours transfer words, not copies, to one another at random until the fraction of one of
them is 0 or 1; the leaf's one residual goes up a reduction tree whose nodes join ``fan`` children, and
the last residual of a source is drawn with its own probability. Every transfer keeps each document's
expectation and the sum of fraction times size, so a source takes its target's words but for what the
last residual is rounded by: less than one document.

Nothing is gathered but leaves, and their count follows the count of documents. Random numbers
are hashes of the documents' identities, so reruns agree.

Defined results: null text has size 0; very long texts are counted whole; ties in size are ordered by a
hash; size-0 documents take nothing; a source without words has
target 0; rows with equal doc_id, source and size (and text, in ``mix_documents``) form one unit
that is rounded as a whole and shared out evenly; an empty table gives an empty result; other
columns are ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import digest, materialize, read, take_rows, word_count

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """source, source_size -> the same with ``target``; one small row per source.

    With sources by cap per weight, the first k that are full leave (total - their caps) to the
    others' weights; the right k is the first at which the next source is not full."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth + 1).cast("int")))
    full = cap * F.col("source_size").cast("double")
    order = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / F.sum("weight").over(after)).withColumn("fits", F.col("weight") * F.col("level") <= full)
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    share = F.col("weight") * level
    return rows.select("source", "source_size", F.coalesce(F.least(share, full), full).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _pivot(items: Column, seed: int, level: int) -> Column:
    """Fold an array of (order, tie, p, unit) into the residual (item, p) and the rounded (unit, up)."""

    def step(s, x):
        a, p, q = s["item"], s["p"], x["p"]
        m, n = a["unit"]["size"].cast("double"), x["unit"]["size"].cast("double")
        # words that one can give the other before a fraction reaches 0 or 1
        up, down = F.least((1.0 - p) * m, q * n), F.least(p * m, (1.0 - q) * n)
        rises = F.coalesce(_uniform(F.lit(seed), F.lit(level), a["tie"], x["tie"]) * (up + down) < down, F.lit(False))
        first_done = F.when(rises, (1.0 - p) * m <= q * n).otherwise(p * m <= (1.0 - q) * n)
        within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        left = F.when(first_done, within(F.when(rises, q - up / n).otherwise(q + down / n))).otherwise(within(F.when(rises, p + up / m).otherwise(p - down / m)))
        # the first is done at 1 where it has risen, the second where the first has fallen
        done = F.struct(F.when(first_done, a["unit"]).otherwise(x["unit"]).alias("unit"), (first_done == rises).alias("up"))
        return F.struct(F.when(first_done, x).otherwise(a).alias("item"), left.alias("p"), F.concat(s["done"], F.array(done)).alias("done"))

    ordered = F.array_sort(items)
    head = ordered[0]
    none = F.slice(F.array(F.struct(head["unit"].alias("unit"), F.lit(False).alias("up"))), 1, 0)
    start = F.struct(head.alias("item"), head["p"].alias("p"), none.alias("done"))
    return F.aggregate(F.slice(ordered, 2, 1 << 30), start, step)


def _rounded(units: DataFrame, fan: int, seed: int) -> DataFrame:
    """unit, up from units (source_key, bucket, top, p, size, unit): bucket 0..top of the source."""
    span = units.agg(F.max("top").alias("t")).first()["t"]
    if span is None:
        return units.select("unit", F.lit(False).alias("up"))
    tie = F.xxhash64(F.lit(seed), "unit.doc_id", "unit.size", "unit.digest")
    rows = units.select("source_key", "bucket", F.struct((-F.col("unit.size")).alias("order"), tie.alias("tie"), "p", "unit").alias("item"))
    done, level = None, 0
    while True:
        folded = rows.groupBy("source_key", "bucket").agg(_pivot(F.collect_list("item"), seed, level).alias("s"))
        folded = materialize(folded, "mixing-level")
        part = folded.select(F.explode("s.done").alias("d")).select("d.unit", "d.up")
        done = part if done is None else done.unionByName(part)
        rest = folded.select("source_key", "bucket", F.col("s.item").alias("item"), F.col("s.p").alias("p"))
        if span == 0:
            last = rest.select("item.unit", (_uniform(F.lit(seed), F.lit(-1), F.col("item.tie")) < F.col("p")).alias("up"))
            return done.unionByName(last)
        rows = rest.select("source_key", F.floor(F.col("bucket") / fan).alias("bucket"), F.struct("item.order", "item.tie", "p", "item.unit").alias("item"))
        span, level = span // fan, level + 1


def _decide(rows: DataFrame, weights: tuple[int, ...], cap: int, fan: int, seed: int) -> DataFrame:
    """Per unit: doc_id, source, size, digest, m (its rows), source_size, target, copies."""
    units = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("m"))
    key = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    units = materialize(units.select("*", key.alias("source_key"), F.floor(F.log2(F.col("size") + 1) * 16).alias("class")), "mixing-units")
    per = units.groupBy("source", "source_key", "class").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.count("*").alias("n"))
    per = materialize(per, "mixing-classes")
    sums = per.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = materialize(targets(sums, weights, cap), "mixing-targets")
    w = W.partitionBy("source", "source_key")
    before = F.coalesce(F.sum("n").over(w.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = per.select("source", "source_key", "class", "n", before.alias("before"), F.sum("n").over(w).alias("all"))
    known = materialize(
        classes.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source"),
        "mixing-known",
    )
    due = F.when(F.col("size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + _uniform(F.lit(seed), F.lit("leaf"), F.col("doc_id"), F.col("size"), F.col("digest")) * F.col("n")
    placed = units.join(known, ["source_key", "class"]).select(
        F.struct("doc_id", "source", "size", "digest", "m", "source_size", "target", F.floor(due).alias("base")).alias("unit"),
        "size",
        (due - F.floor(due)).alias("p"),
        "source_key",
        F.floor((F.col("all") - 1) / fan).alias("top"),
        F.floor(at / fan).alias("bucket"),
    )
    placed = materialize(placed, "mixing-placed")
    rounded = _rounded(placed.where("p > 0"), fan, seed).unionByName(placed.where("not p > 0").select("unit", F.lit(False).alias("up")))
    return rounded.select("unit.*", (F.col("unit.base") + F.col("up").cast("long")).alias("copies")).drop("base")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, fan: int = 100, seed: int = 42, run: int = 10_000) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's) and taken words."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit("").alias("digest"))
    decided = materialize(_decide(rows, weights, cap, fan, seed), "mixing-decided")
    # a row repeated very often is dealt out in runs, so that no task unfolds it alone
    one = F.lit(1).cast("long")
    few = decided.where(F.col("m") <= run).withColumn("r", F.explode(F.sequence(one, F.col("m"))))
    runs = decided.where(F.col("m") > run).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / run))))
    many = runs.repartition("doc_id", "k").withColumn("r", F.explode(F.sequence(F.col("k") * run + 1, F.least((F.col("k") + 1) * run, F.col("m"))))).drop("k")
    each = few.unionByName(many)
    copies = F.floor(F.col("copies") / F.col("m")) + (F.col("r") <= F.col("copies") % F.col("m")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, fan: int = 100, seed: int = 42) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"))
    picked = _decide(rows, weights, cap, fan, seed).where("copies > 0")
    # rows of one doc_id and text in several sources are told apart by the source
    return take_rows(docs, picked.select("doc_id", "source", "digest", "m", "copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
