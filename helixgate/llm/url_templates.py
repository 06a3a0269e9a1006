"""URL filters: fixed rules, then a path-template tree per host judged by labelled purity.

Rules are strings of host and path; one fits its host and all subdomains where the url's path
starts with the rule's, and the longest fitting rule decides. The urls that rules decide are the
labelled ones (callers may give labels of their own).

The tree: path segments that are numbers, dates, long hexadecimal or mixed identifiers become
wildcards of their kind at once. Then, level by level from the host down, as deep as paths still
share a branch, the literal branches of a node that are statistically like their siblings are
generalised - same share of urls that end there, that go on to a wildcard, and that are labelled
block, by Hoeffding bounds. A branch is compared with the pool of the siblings that mostly go on as it
does and have labels if it has, never pair by pair. Templates are the paths of the finished tree.

A template's purity is the share of block among its labelled urls, smoothed towards that of the branch
above it, this one's towards the next, up to the host, the registered domain, all labelled urls and the
Beta prior: each level counts ``backoff`` labels of the level above. A template is rejected when its
purity is at least ``purity``.

Everything after the first aggregation works on (host, masked path) counts. A host that holds
most urls is combined map-side, and joins of its rows to decisions are ordinary joins that
adaptive execution may split.

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and is
judged like any other (a host of its own); empty segments are left out; very long urls are split whole,
at any depth; of equally long rules the one with the longer host decides; repeated rows are judged each
and count each; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, read


@dataclass(frozen=True)
class Rule:
    prefix: str  # host/path
    verdict: str

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


@dataclass(frozen=True)
class Tree:
    #: confidence of the Hoeffding bounds is 1 - alpha
    alpha: float = 0.05
    #: Beta prior of all labelled urls, as block and allow labels
    prior: tuple[float, float] = (1.0, 1.0)
    #: labels of the level above that smooth a level's own
    backoff: float = 2.0
    purity: float = 0.8


#: Fixed values of the production rules.
RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null; of two as long the one with
    the longer host."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.prefix), -len(r.host), r.prefix)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.prefix).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _mask(segment: Column) -> Column:
    """A segment's kind with its extension, for segments that vary by nature."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    name = F.substring(segment, F.lit(1), F.length(segment) - F.length(ext))
    kind = (
        F.when(name.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("<date>"))
        .when(name.rlike("^[0-9]+$"), F.lit("<number>"))
        .when(name.rlike("^[0-9a-fA-F-]{8,}$") & name.rlike("[0-9]"), F.lit("<hex>"))
        .when(name.rlike("[0-9]") & name.rlike("[A-Za-z]") & (F.length(name) >= 8), F.lit("<id>"))
    )
    return F.when(kind.isNotNull(), F.concat(kind, ext)).otherwise(segment)


def _like(a: Column, n: Column, b: Column, m: Column, alpha: float) -> Column:
    """Hoeffding: the shares a / n and b / m may be the same."""
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / F.sqrt(n) + 1 / F.sqrt(m))
    return (n == 0) | (m == 0) | (F.abs(a / n - b / m) < bound)


def templates(paths: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """From (host, segments, n, block, allow) per distinct masked path: the same rows with their
    ``template``."""
    live = paths.select("*", F.lit("").alias("node"))
    counts = ["n", "block", "allow", "ends", "wild"]
    seg = lambda i: F.get(F.col("segments"), F.lit(i))
    done, k = [], 0
    while True:
        # a path that shares its node with no other, or ends there, has no siblings further down
        w = live.groupBy("host", "node").agg(F.count("*").alias("paths"))
        met = materialize(live.join(w, ["host", "node"]).withColumn("open", (F.col("paths") > 1) & (F.size("segments") > k)).drop("paths"), "url-level")
        done.append(met.where("not open").drop("open").withColumn("node", F.concat("node", F.array_join(F.transform(F.slice("segments", k + 1, F.greatest(F.size("segments"), F.lit(1))), lambda x: F.concat(F.lit("/"), x)), ""))))
        live = met.where("open").drop("open")
        if live.isEmpty():
            break
        step = live.select(
            "host", "node", seg(k).alias("s"), "n", "block", "allow",
            F.when(F.size("segments") == k + 1, F.col("n")).otherwise(0).alias("ends"),
            F.when(seg(k + 1).startswith("<"), F.col("n")).otherwise(0).alias("wild"),
        )
        kids = step.groupBy("host", "node", "s").agg(*(F.sum(c).alias(c) for c in counts))
        labels = F.col("block") + F.col("allow")
        on = F.col("n") - F.col("ends") - F.col("wild")
        kind = F.concat(F.when(labels > 0, "labelled ").otherwise("bare "), F.when(F.col("wild") >= F.greatest("ends", on), "wild").when(F.col("ends") >= on, "end").otherwise("literal"))
        literal = kids.where(~F.col("s").startswith("<")).withColumn("kind", kind)
        pools = literal.groupBy("host", "node", "kind").agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in counts))
        rest = {c: F.col(f"all_{c}") - F.col(c) for c in counts}
        alike = (
            (F.col("kids") > 1)
            & _like(F.col("ends"), F.col("n"), rest["ends"], rest["n"], tree.alpha)
            & _like(F.col("wild"), F.col("n"), rest["wild"], rest["n"], tree.alpha)
            & _like(F.col("block"), labels, rest["block"], rest["block"] + rest["allow"], tree.alpha)
        )
        wild = literal.join(pools, ["host", "node", "kind"]).where(alike).select("host", "node", "s", F.lit(True).alias("any"))
        named = live.withColumn("s", seg(k)).join(wild, ["host", "node", "s"], "left")
        live = named.withColumn("node", F.concat("node", F.lit("/"), F.when(F.col("any"), F.lit("<any>")).otherwise(F.col("s")))).drop("s", "any")
        k += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("node", "template")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three where the last two are of the kind co.uk."""
    return F.regexp_extract(host, r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))$", 1)


def purities(named: DataFrame, tree: Tree) -> DataFrame:
    """host, template and smoothed purity from (host, template, block, allow)."""
    labelled = named.groupBy("host", "template").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    parts = F.filter(F.split("template", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.concat(F.lit("path "), F.col("host"), F.lit(" "), F.array_join(F.slice("parts", 1, n), "/")))
    levels = F.concat(
        F.array(F.lit("all"), F.concat(F.lit("domain "), registered_domain(F.col("host"))), F.concat(F.lit("host "), F.col("host"))),
        F.when(F.size("parts") > 0, above).otherwise(F.array().cast("array<string>")),
    )
    rows = labelled.withColumn("parts", parts).select("host", "template", "block", "allow", F.posexplode(levels).alias("level", "node"))
    sums = rows.groupBy("node").agg(F.sum("block").alias("b"), F.sum(F.col("block") + F.col("allow")).alias("m"))
    chain = rows.select("host", "template", "level", "node").join(sums, "node").groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "b", "m"))).alias("chain"))
    a, b = tree.prior
    smooth = lambda p, x: (x["b"] + tree.backoff * p) / (x["m"] + tree.backoff)
    return chain.select("host", "template", F.aggregate("chain", F.lit(a / (a + b)), smooth).alias("purity"))


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, tree: Tree = Tree(), label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and the template's purity of every row of ``urls``
    (page_id, url). ``label`` names a boolean column that is true for block and null without a label;
    by default the urls that rules decide are the labelled ones."""
    host, path = split_url(F.col("url"))
    given = F.lit(None).cast("boolean") if label is None else F.col(label).cast("boolean")
    cut = urls.select("page_id", host.alias("host"), path.alias("path"), given.alias("label"))
    cut = cut.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if label is None:
        cut = cut.withColumn("label", F.col("r.verdict") == "block")
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _mask)
    cut = cut.select("page_id", "host", "path", "r", "label", segments.alias("segments"), F.to_json(F.struct(segments.alias("s"))).alias("masked"))
    paths = cut.groupBy("host", "masked").agg(
        F.first("segments").alias("segments"), F.count("*").alias("n"), F.count_if("label").alias("block"), F.count_if(~F.col("label")).alias("allow")
    )
    named = materialize(templates(paths, tree), "url-templates")
    pure = materialize(purities(named, tree), "url-purities")
    verdicts = named.select("host", "masked", "template").join(pure, ["host", "template"])
    out = cut.join(verdicts, ["host", "masked"])
    own = F.when(F.col("purity") >= tree.purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "template", "purity")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url"))
