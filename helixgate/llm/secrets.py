"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every file (here: every row of a table of texts) is content-addressed: its blob
is the SHA-256 of its text. The ledger lists which (blob, rule, rule version) have been scanned and
what was found. A run scans only pairs that the ledger doesn't list: texts of unseen blobs, one
text for each, and for changed rules again all blobs; findings are then joined back to all paths.
Only short rows are shuffled but for the texts to scan, which move once to meet their claim.

Rules are regular expressions with a least length for one of their groups. Matches are leftmost
and do not overlap within a rule; too short ones are dropped after matching. Positions are code
points: a text split at a rule's matches gives the pieces between them, and running sums of the
lengths of pieces and matches give every start.

Defined results: null text is the empty blob and has no findings; very long texts are scanned whole;
of equal texts the least path (a null one last) is scanned for all; spans that begin together stand in
the order of their rules; repeated rows and paths are reported each; an empty table gives an empty
result and leaves the ledger as it is; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import digest, fresh_path, materialize, read


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: the group whose length counts, and its least length in characters
    group: int = 0
    least: int = 1
    version: int = 1


#: Base rules first, in the order of their kinds; then those that the scan adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of one class is matched whole, so its least length may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("prefixed_token", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<start:long,kind:int,end:long>"
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule in a text that holds a match."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(whole), F.lit(1))).alias("gap"), whole.alias("whole"), part.alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(s, x):
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["whole"])
        span = F.struct(a.cast("long").alias("start"), F.lit(number).alias("kind"), b.cast("long").alias("end"))
        more = F.when(F.length(x["part"]) >= rule.least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct(b.cast("long").alias("at"), more.alias("spans"))

    return F.aggregate(steps, start, step)["spans"]


def _found(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule; texts without a match are seen by one search."""
    return F.when(text.rlike(rule.pattern), _spans(text, rule, number)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): paths has doc_id, blob and all spans of every row, entries are the ledger
    rows that this run adds. ``ledger`` has the columns of LEDGER; none: nothing has been seen."""
    paths = materialize(docs.select("doc_id", digest(F.col("text")).alias("blob")), "secrets-paths")
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("path"))
    wanted = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    claim = blobs.select("blob", "path", F.array(*wanted).alias("todo"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        claim = claim.join(seen, "blob", "left").select("blob", "path", F.array_except("todo", F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))).alias("todo"))
    claim = materialize(claim.where(F.size("todo") > 0), "secrets-claim")
    mark = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    # one text of each claimed blob: the one at the claim's path; texts stream past the claims
    texts = docs.select(mark(F.col("doc_id")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(claim.select(mark(F.col("path")).alias("k"), F.col("blob").alias("own"), "todo"), "k").where(digest(F.col("text")) == F.col("own"))
    per_rule = []
    for n, r in enumerate(rules):
        due = F.array_contains("todo", wanted[n])
        per_rule.append(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(due, _found(F.col("text"), r, n)).alias("spans")))
    scanned = met.select(F.col("own").alias("blob"), F.filter(F.array(*per_rule), lambda x: x["spans"].isNotNull()).alias("found"))
    entries = materialize(scanned.dropDuplicates(["blob"]).select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.version", "f.spans"), "secrets-entries")
    current = entries if ledger is None else entries.unionByName(ledger.select("blob", "rule", "version", "spans"))
    live = F.array(*wanted)
    hits = current.where(F.array_contains(live, F.struct("rule", "version")) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule", "version"])
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")), entries


def scan_with_ledger(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan`` with the ledger kept as Parquet at ``ledger_path``, to which new entries are added."""
    spark = docs.sparkSession
    path = ledger_path or fresh_path(spark, "secrets-ledger")
    ledger = None
    if ledger_path and spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        ledger = spark.read.schema(LEDGER).parquet(path)
    found, entries = scan(docs, ledger, rules)
    entries.write.mode("append").parquet(path)
    return found


def _joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as a string."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan_with_ledger(read(spark, sf_dir, "documents", "doc_id", "text")))
