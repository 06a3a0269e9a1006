"""The parts of operators that SQL can express, as queries of their own with their SQL.

Each takes its rows from the operator itself and leaves out the columns that only the operator's
method gives: templates and learnt verdicts, added spans, distances, rounded copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality, secrets, url_templates
from .shared import read


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_templates.judge(read(spark, sf_dir, "pages", "page_id", "url"))
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(secrets.scan_with_ledger(read(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {"url_rules": url_rules, "secret_base": secret_base, "quality_base": quality_base, "mixing_targets": mixing_targets}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_HITS = r"""SELECT row_id, doc_id, '{kind}' AS kind, {place} AS place,
    list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'k': length(g[i])}}), lambda h: h.k >= {least}) AS hits
    FROM (SELECT row_id, doc_id, string_split_regex(body, {pattern}) AS gap, regexp_extract_all(body, {pattern}) AS m, regexp_extract_all(body, {pattern}, {group}) AS g FROM d)"""
_ASSIGN = r"""'(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_KINDS = " UNION ALL ".join(
    _HITS.format(kind=kind, place=n, pattern=pattern, group=group, least=least)
    for n, (kind, pattern, group, least) in enumerate((("assign", _ASSIGN, 1, 6), ("access", "'AKIA[A-Z0-9]+'", 0, 20), ("hex", "'[0-9a-f]+'", 0, 24)))
)

ORACLES = {
    "url_rules": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS rule_verdict FROM p JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule, rule_verdict FROM p LEFT JOIN fit USING (page_id)""",
    "secret_base": f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents),
kinds AS ({_KINDS}),
spans AS (SELECT row_id, kind, place, unnest(hits) AS h FROM kinds)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(kind || ':' || h.a::BIGINT || ':' || (h.a + h.n)::BIGINT, ',' ORDER BY h.a, place) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN spans USING (row_id) GROUP BY row_id, doc_id""",
    "quality_base": rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT row_id, i, array_to_string(ws[i:i + 4], ' ') AS five FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT row_id, i FROM win QUALIFY count(*) OVER (PARTITION BY row_id, five) > 1),
rep AS (SELECT row_id, count(DISTINCT k) AS n FROM (SELECT row_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed
FROM d LEFT JOIN rep USING (row_id)""",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
best AS (SELECT min_by(level, place) AS level FROM l WHERE weight * level <= 3 * source_size),
t AS (SELECT source, source_size, round(CASE WHEN best.level IS NULL THEN 3e0 * source_size ELSE least(weight * best.level, 3e0 * source_size) END, 4) AS target FROM w CROSS JOIN best)
SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
