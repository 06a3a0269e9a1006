"""Language-model scores: stupid backoff over count tables partitioned by hash.

The model is that of the whole corpus. A word whose n-gram of order k has been counted ``min_count``
times or more scores count(n-gram) / count(context); rarer n-grams of orders above 1 are cut off, as
large models do, and each order given up costs a factor ``ALPHA``; a single word scores its share of
the corpus's words. ``leave_one_out`` takes a document's own counts off first, for which nothing is cut
off by default. A document's ``score`` is the mean of log10 over its words, ``log10_sum`` their sum.

The relational plan, with n-grams as 64-bit hashes:

1. Documents are dealt to batches by hash; a batch explodes its n-grams of all orders and adds up
   equal ones, so a frequent n-gram leaves a batch once, however many documents hold it.
2. The count tables are partitioned by ranges of the hash: a range sums what all batches have
   counted, and is joined to them: each gets the corpus totals of just its own n-grams.
3. A batch joins the totals to its exploded n-grams and sums the logarithms per document.

Batches and ranges grow in number with the characters of the corpus, not in size, so each fits a
task: about ``batch_chars`` of text, or the n-grams of as much. Hash columns travel as compressed
byte planes of their differences. Two n-grams with one 64-bit hash would share their count.

Defined results: words are split at ASCII white space and lower-cased (A-Z); null and word-less
texts have a sum of 0 and a null score; very long texts count whole, in one batch; copies count as
other documents; repeated rows are scored each, alike, in one batch; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _give_back, read

ALPHA = 0.4
ORDER = 3
MIN_COUNT = 2
BATCH_CHARS = 12_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: stands for "any word": its count is the number of words
_TOTAL = np.uint64(0)


def _pack(values: np.ndarray) -> bytes:
    kind = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, kind).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    kind = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(kind, -1).T).view(dtype).ravel()


class Grams:
    """The n-grams of a batch of texts: per order the hash of each word's n-gram and its validity."""

    def __init__(self, texts: list[bytes], order: int):
        digest = xxhash.xxh3_64_intdigest
        # text by text, so that a batch's words are never held as objects all at once
        parts = [np.fromiter(map(digest, t.lower().split()), np.uint64) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        word = np.concatenate([np.zeros(0, np.uint64), *parts])
        del parts
        n = len(word)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        place = (np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        self.order = order
        self.place = place
        self.hashes, self.valid = [word | np.uint64(1)], [np.ones(n, bool)]
        for k in range(1, order):
            longer = np.zeros(n, np.uint64)
            longer[k:] = self.hashes[-1][k - 1 : n - 1] * _A ^ (word[k:] + np.uint64(k)) * _B
            longer ^= longer >> np.uint64(31)
            self.hashes.append(longer * _A | np.uint64(1))
            self.valid.append(place >= k)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in ascending order with their counts in the batch; the total stands first."""
        found = [np.unique(h[v], return_counts=True) for h, v in zip(self.hashes, self.valid)]
        u = np.concatenate([[_TOTAL], *(f[0] for f in found)]).astype(np.uint64)
        c = np.concatenate([[len(self.doc)], *(f[1] for f in found)]).astype(np.int64)
        at = np.argsort(u, kind="stable")
        u, c = u[at], c[at]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        return u[first], np.add.reduceat(c, first)

    def scores(self, distinct: np.ndarray, totals: np.ndarray, min_count: int, leave_one_out: bool) -> np.ndarray:
        """Sum of log10 scores of each text."""
        n = len(self.doc)
        counts = []  # per order
        for h, v in zip(self.hashes, self.valid):
            at = np.searchsorted(distinct, h[v])
            out = np.zeros(n, np.int64)
            out[v] = totals[at]
            if leave_one_out:
                _, back, own = np.unique(at * len(self.sizes) + self.doc[v], return_inverse=True, return_counts=True)
                out[v] -= own[back]
                del back
            del at
            counts.append(out)
        words = (totals[0] - self.sizes * leave_one_out)[self.doc].astype(float)
        score = -np.log10(words + 1)  # the word alone, unseen
        score[:] += np.log10(ALPHA) * np.minimum(self.place, self.order - 1)
        done = np.zeros(n, bool)
        for k in reversed(range(self.order)):
            seen = (counts[k] >= (min_count if k else 1)) & ~done
            if k:
                prefix = np.zeros(n, np.int64)
                prefix[1:] = counts[k - 1][:-1]
            else:
                prefix = words
            up = np.minimum(self.place, self.order - 1) - k
            score[seen] = np.log10(counts[k][seen] / prefix[seen]) + np.log10(ALPHA) * up[seen]
            done |= seen
        return np.bincount(self.doc, score, len(self.sizes)) if n else np.zeros(len(self.sizes))


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def stupid_backoff(docs: DataFrame, order: int = ORDER, batch_chars: int = BATCH_CHARS, min_count: int | None = None, leave_one_out: bool = False) -> DataFrame:
    """doc_id, n_words, log10_sum and score (the mean over the words) of every document."""
    cut = min_count or (1 if leave_one_out else MIN_COUNT)
    chars = docs.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    parts = max(1, -(-chars // batch_chars))
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("batch"))

    def request(key, table):
        distinct, counts = Grams(_texts(table), order).counted()
        # all of range p lie between two cuts; the total is asked of every range, and counted by one
        cut = np.searchsorted(distinct, np.array([(p << 64) // parts for p in range(parts)], np.uint64))
        cut[0] = 1
        cut = np.append(cut, len(distinct))
        out = {"range": list(range(parts)), "hashes": [], "counts": []}
        for p in range(parts):
            h = np.concatenate([distinct[:1], distinct[cut[p] : cut[p + 1]]])
            c = np.concatenate([counts[:1], counts[cut[p] : cut[p + 1]]]).astype(np.uint32)
            out["hashes"].append(_pack(np.diff(h, prepend=np.uint64(0))))
            out["counts"].append(_pack(c))
        batch = pa.array([key[0].as_py()] * parts, pa.int32())
        return pa.table({"batch": batch, "range": pa.array(out["range"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def respond(key, table):
        hashes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        counts = [_unpack(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
        everything = np.concatenate(hashes)
        at = np.argsort(everything, kind="stable")
        u = everything[at]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        sums = np.add.reduceat(np.concatenate(counts)[at], first)
        u = u[first]
        # what the other batches have: nothing for most n-grams, which packs well
        totals = [_pack((sums[np.searchsorted(u, h)] - c).astype(np.uint64)) for h, c in zip(hashes, counts)]
        return pa.table({"batch": table.column("batch"), "range": table.column("range"), "totals": pa.array(totals, pa.binary())})

    def score(key, table, answers):
        grams = Grams(_texts(table), order)
        distinct, counts = grams.counted()
        by_range = sorted(zip(answers.column("range").to_pylist(), answers.column("totals").to_pylist()))
        got = [_unpack(x, np.uint64).astype(np.int64) for _, x in by_range]
        totals = counts + np.concatenate([got[0][:1], *(x[1:] for x in got)])
        sums = grams.scores(distinct, totals, cut, leave_one_out)
        n = grams.sizes
        mean = pa.array(np.where(n > 0, sums / np.maximum(n, 1), 0.0), mask=n == 0)
        _give_back()
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n), "log10_sum": pa.array(sums), "score": mean})

    asked = rows.groupBy("batch").applyInArrow(request, "batch int, range int, hashes binary, counts binary")
    answered = asked.groupBy("range").applyInArrow(respond, "batch int, range int, totals binary")
    return rows.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, log10_sum double, score double")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stupid_backoff(read(spark, sf_dir, "documents", "doc_id", "text"))
    return scores.select("doc_id", "n_words", F.round("log10_sum", 5).alias("log10_sum"), F.round("score", 6).alias("score"))


#: The same by tables of n-grams, their counts, joins and sums.
ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, row_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
p AS (SELECT row_id, i, ws[i] AS a, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS c FROM g),
c1 AS (SELECT a, count(*) AS n FROM p GROUP BY 1), c2 AS (SELECT b, a, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT c, b, a, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY 1, 2, 3), total AS (SELECT count(*) AS n FROM p),
s AS (SELECT p.row_id, CASE
    WHEN c3.n >= 2 THEN log10(c3.n / cc.n)
    WHEN c2.n >= 2 THEN log10(c2.n / cb.n) + CASE WHEN p.c IS NULL THEN 0 ELSE log10(0.4e0) END
    ELSE log10(c1.n / total.n) + CASE WHEN p.b IS NULL THEN 0 WHEN p.c IS NULL THEN log10(0.4e0) ELSE 2 * log10(0.4e0) END END AS x
    FROM p CROSS JOIN total JOIN c1 ON c1.a = p.a LEFT JOIN c2 ON c2.b = p.b AND c2.a = p.a LEFT JOIN c1 cb ON cb.a = p.b
    LEFT JOIN c3 ON c3.c = p.c AND c3.b = p.b AND c3.a = p.a LEFT JOIN c2 cc ON cc.b = p.c AND cc.a = p.b)
SELECT w.doc_id, len(w.ws) AS n_words, round(coalesce(sum(s.x), 0), 5) AS log10_sum, round(sum(s.x) / len(w.ws), 6) AS score
FROM w LEFT JOIN s USING (row_id) GROUP BY w.row_id, w.doc_id, w.ws
"""
