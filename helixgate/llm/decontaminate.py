"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case (A-Z) with white space collapsed. An item of L
characters may differ from a passage of a document by k = L // ``chars_per_edit`` edits. Cut into
k + 1 pieces, at least one piece of such a passage is untouched, so exact piece hits (one
Aho-Corasick automaton over all pieces) propose places and Myers' bit-parallel distance over the
window around them decides. No pair of document and item is compared without a hit, and no
passage within the budget is missed.

Documents never move: the test items, a stated query set, go to the tasks in blocks of at most
``block_chars`` characters, one pass over the documents for each block.

Items of every length are looked for. One of under ``edit_words`` words has no error budget and counts
where it stands by itself, between white space or punctuation: within a word it is no evidence.

Defined results: null or blank documents match nothing, and null or blank items nothing either; very
long documents and items are compared whole; of several equally good matches of an item the first is
given; items that repeat a text are reported with each of their ids, ids of any type; repeated documents
are reported each; extra columns, whatever their names, are ignored by ``matches`` and kept by
``clean_documents``; without items, or with an empty table, every document is clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import read, slices, tidied

CHARS_PER_EDIT = 16
EDIT_WORDS = 5
BLOCK_CHARS = 1_000_000


def normalize(data: bytes) -> str:
    return b" ".join(data.lower().split()).decode("utf-8", "replace")


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(least distance of ``pattern`` to any substring of ``text``, end of the first such), within limit."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (limit + 1, 0)
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= limit else None


class Matcher:
    """A block of items: texts by number, and the automaton over their pieces."""

    def __init__(self, items: list[str], chars_per_edit: int, edit_words: int = EDIT_WORDS):
        import ahocorasick

        self.items = items
        self.alone = [x.count(" ") + 1 < edit_words for x in items]
        self.budget = [0 if short else len(x) // chars_per_edit for x, short in zip(items, self.alone)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, x in enumerate(items):
            parts = self.budget[n] + 1
            cuts = [len(x) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(x[a:b], []).append((n, a))
        self.auto = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.auto.add_word(piece, (len(piece), places))
        if pieces:
            self.auto.make_automaton()

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item, distance, end in the text) of the best match of each item that the text holds."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.auto.iter(text):
            for n, a in places:
                starts.setdefault(n, set()).add(end + 1 - size - a)
        found = []
        for n in sorted(starts):
            item, k = self.items[n], self.budget[n]
            best = None
            exact = sorted(s for s in starts[n] if s >= 0 and text.startswith(item, s))
            if self.alone[n]:
                exact = [s for s in exact if not text[s - 1 : s].isalnum() and not text[s + len(item) : s + len(item) + 1].isalnum()]
            if exact:
                best = (0, exact[0] + len(item))
            elif not self.alone[n]:
                # windows around the proposed starts, joined where they touch
                reach = 0
                spans: list[list[int]] = []
                for s in sorted(starts[n]):
                    a, b = max(0, s - k), min(len(text), s + len(item) + k)
                    if spans and a <= reach:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                    reach = spans[-1][1]
                for a, b in spans:
                    if b - a >= len(item) - k and (got := myers(item, text[a:b], k)) and (best is None or got[0] < best[0]):
                        best = (got[0], a + got[1])
            if best:
                found.append((n, *best))
                if first_only:
                    break
        return found


_built: dict[str, Matcher] = {}


def _matcher(key: str, items: list[str], chars_per_edit: int, edit_words: int) -> Matcher:
    """The block's matcher, built once in each Python worker; one is held at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, chars_per_edit, edit_words)
    return _built[key]


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[str], list[list]]]:
    """Distinct item texts with their ids, in blocks of bounded size."""
    texts: list[str] = []
    ids: list[list] = []
    size = 0
    rows = benchmark.where("text is not null").groupBy("text").agg(F.collect_list("item_id").alias("ids"))
    by: dict[str, int] = {}
    for row in rows.toLocalIterator():
        item = normalize(row["text"].encode())
        if not item:
            continue
        if item in by:
            ids[by[item]] += row["ids"]
            continue
        if texts and size + len(item) > block_chars:
            yield texts, ids
            texts, ids, size, by = [], [], 0, {}
        by[item] = len(texts)
        texts.append(item)
        ids.append(list(row["ids"]))
        size += len(item)
    if texts:
        yield texts, ids


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, edit_words: int = EDIT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, and start-free
    ``end_char``, where the best match ends in the normalised text."""
    slim = docs.select("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, distance long, end_char long"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for texts, ids in blocks(benchmark, block_chars):
        key = uuid.uuid4().hex

        def run(batches, key=key, texts=texts, ids=ids):
            for batch in slices(batches):
                rows = []
                matcher = _matcher(key, texts, chars_per_edit, edit_words)
                for at, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    for n, distance, end in matcher.find(normalize(data or b"")):
                        rows += [(at, item, distance, end) for item in ids[n]]
                at, item, distance, end = list(zip(*rows)) or [()] * 4
                cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind), pa.array(distance, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "end_char"])

        part = slim.mapInArrow(tidied(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, edit_words: int = EDIT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, with all their columns, decided where they lie."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = packed.schema
    for texts, _ in blocks(benchmark, block_chars):
        key = uuid.uuid4().hex

        def run(batches, key=key, texts=texts):
            for batch in slices(batches):
                matcher = _matcher(key, texts, chars_per_edit, edit_words)
                data = batch.column(0).field("text").cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not matcher.find(normalize(x or b""), first_only=True) for x in data], pa.bool_()))

        packed = packed.mapInArrow(tidied(run), schema)
    return packed.select("doc.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))
