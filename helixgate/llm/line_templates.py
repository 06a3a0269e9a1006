"""Line dedup with a log-template tree.

A line's words with a digit become the field mark, unless most would; lines then fall through a tree of fixed depth,
by word count and leading words, to a leaf. In a leaf that several documents reach, a word that
fewer than ``min_docs`` documents have at its place is a variable field and becomes the mark too.
The result is the line's template, unless fewer than ``min_constant`` of its words are constant:
then the line is its own template, so that unlike lines of prose don't fall together. Lines whose
template comes from at least ``min_docs`` documents are dropped from all of them.

All passes but two carry digests of lines: leaves, lines and templates are counted by 64-bit
hashes, combined map-side. Texts move once, past short lists of line numbers, to be rebuilt. To
fetch one copy of each distinct line of the recurring leaves they stay where they are: a Bloom filter
goes to them, and an exact join drops what it lets through besides. (Leaves in which every line recurs
as it is need none.) Beyond some millions of such lines
(``filter_bits``) the filter lets more through, which costs time and changes no result.

Support is counted in documents: several lines of one document that fall together, in a vote or in a
template, count once for it. A line of fewer than ``min_docs`` documents is counted with their names;
one of more settles by itself what it votes for.

Defined results: null text has no lines and stays null; very long texts and lines are taken whole; blank
lines are never dropped and count in n_lines; a line that repeats within one document counts once for
it; a tie at ``min_docs`` is enough; repeated rows count as documents of their own and get equal results;
other columns, whatever their names, are ignored; an empty table gives an empty result. Lines, words and
documents are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, read, slices, tidied

FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")
_DIGIT_WORD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")


@dataclass(frozen=True)
class Tree:
    #: leading words that the tree branches on, below the word count
    depth: int = 3
    #: documents that a constant word, and a template, must come from
    min_docs: int = 3
    #: share of constant words that a generalised template needs
    min_constant: float = 0.7
    #: size of the filter of lines to fetch, a power of two; 16 MB
    filter_bits: int = 1 << 27


def words_of(line: bytes) -> list[bytes]:
    """The words of a line with marks for fields, unless these would be most of it."""
    if not _DIGIT.search(line):
        return line.split()
    words = _DIGIT_WORD.sub(FIELD, line).split()
    return words if 2 * words.count(FIELD) <= len(words) else line.split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leaf_of(words: list[bytes], depth: int) -> int:
    return _signed(xxhash.xxh64_intdigest(b"%d " % len(words) + b" ".join(words[:depth])))


def _key(docs: DataFrame):
    """A document is known by its id and the hash of its text."""
    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("th"), "text")


def _lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, th, no, leaf, line, and whether leaf and line are new in this document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches):
            doc, no, leaf, line, new_leaf, new_line = [], [], [], [], [], []
            for n, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                leaves, lines = set(), set()
                for k, x in enumerate((data or b"").split(b"\n")):
                    words = words_of(x)
                    if not words:
                        continue
                    a, b = leaf_of(words, tree.depth), _signed(xxhash.xxh64_intdigest(b" ".join(words)))
                    doc.append(n)
                    no.append(k)
                    leaf.append(a)
                    line.append(b)
                    new_leaf.append(a not in leaves)
                    new_line.append(b not in lines)
                    leaves.add(a)
                    lines.add(b)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(no, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(new_leaf, pa.bool_()), pa.array(new_line, pa.bool_())],
                names=["doc_id", "th", "no", "leaf", "line", "new_leaf", "new_line"],
            )

    return _key(docs).mapInArrow(tidied(run), f"doc_id {kind}, th long, no int, leaf long, line long, new_leaf boolean, new_line boolean")


def _mark(*cols: str):
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols))


def _places(doc: np.ndarray, no: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a document's line in a Bloom filter of ``bits`` bits, a power of two."""
    x = doc.astype(np.uint64) + (no.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)


def _sieve(wanted: DataFrame, most: int) -> np.ndarray:
    """Bloom filter of lines (doc, no): 16 to 32 bits for each, ``most`` in all, as 64-bit words."""
    bits = max(64, min(most, 1 << (16 * wanted.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(_places(batch.column("doc").to_numpy(), batch.column("no").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    got = wanted.select("doc", "no").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _line_votes(docs: DataFrame, wanted: DataFrame, tree: Tree) -> DataFrame:
    """line and votes (hashes of leaf, place and word) of each wanted line. Texts stay where they are: a filter
    goes to them, and the few other lines that it lets through are for the caller to drop."""
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted, tree.filter_bits))

    def run(batches):
        bits = sieve.value
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([x.count(b"\n") + 1 for x in texts])
            begins = np.cumsum(sizes) - sizes
            no = np.arange(sizes.sum()) - np.repeat(begins, sizes)
            of = np.repeat(np.arange(len(texts)), sizes)
            hit = np.ones(len(no), bool)
            for at in _places(batch.column("doc").to_numpy()[of], no, 64 * len(bits)):
                hit &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            line, votes, last, parts = [], [], -1, []
            for n, k in zip(of[hit].tolist(), no[hit].tolist()):
                if n != last:
                    last, parts = n, texts[n].split(b"\n")
                if words := words_of(parts[k]):
                    leaf = leaf_of(words, tree.depth)
                    line.append(_signed(xxhash.xxh64_intdigest(b" ".join(words))))
                    votes.append([_signed(xxhash.xxh64_intdigest(w, (leaf + place) % (1 << 64))) for place, w in enumerate(words)])
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(votes, pa.list_(pa.int64()))], names=["line", "votes"])

    return _key(docs).select(F.xxhash64("doc_id", "th").alias("doc"), "text").mapInArrow(tidied(run), "line long, votes array<long>")


def _supported(groups: DataFrame, key: str, least: int) -> DataFrame:
    """Values of ``key`` that ``least`` different documents have; a null document stands for so many."""
    pairs = groups.select(key, F.explode("docs").alias("doc")).distinct()
    voices = F.sum(F.when(F.col("doc").isNull(), least).otherwise(1))
    return pairs.groupBy(key).agg(voices.alias("n")).where(F.col("n") >= least).select(key)


def _known_lines(lines: DataFrame, tree: Tree) -> DataFrame:
    """leaf, line, docs, doc and no (of one occurrence). docs: its documents, copies of rows numbered;
    one null where they are ``min_docs`` or more."""
    seen = lines.where("new_line").select("leaf", "line", F.xxhash64("doc_id", "th").alias("doc"), "no")
    nth = F.row_number().over(Window.partitionBy("leaf", "line").orderBy("doc", "no"))
    first = seen.withColumn("nth", nth).where(F.col("nth") <= tree.min_docs)
    known = first.groupBy("leaf", "line").agg(F.sort_array(F.collect_list("doc")).alias("ids"), F.min(F.struct("doc", "no")).alias("at"))
    numbered = F.transform("ids", lambda x, k: F.xxhash64(x, k + 1 - F.array_position("ids", x)))
    alone = F.size("ids") >= tree.min_docs
    return known.select("leaf", "line", F.when(alone, F.array(F.lit(None).cast("long"))).otherwise(numbered).alias("docs"), "at.doc", "at.no")


def recurring_lines(docs: DataFrame, tree: Tree = Tree()) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): the lines of all recurring leaves by hash, and the hashes ``line`` to drop."""
    every = materialize(_lines(docs, tree), "lines")
    # written, as joins of tables that are only dealt out can split a hot leaf or template
    leaves = materialize(every.where("new_leaf").groupBy("leaf").count().where(F.col("count") >= tree.min_docs).select("leaf"), "leaves")
    lines = materialize(every.join(leaves, "leaf", "left_semi").drop("new_leaf"), "lines-of-leaves")
    discard(every, leaves)
    known = materialize(_known_lines(lines, tree), "lines-known")
    # a line that recurs as it is needs no template, but takes part in the counts of a leaf where others do
    alone = F.col("docs")[0].isNull()
    unsettled = materialize(known.where(~alone).select("leaf").distinct(), "leaves-unsettled")
    wanted = materialize(known.join(unsettled, "leaf", "left_semi"), "lines-wanted")
    # rows that repeat a document give its lines again
    votes = _line_votes(docs, wanted.select("doc", "no"), tree).dropDuplicates(["line"]).join(wanted.select("leaf", "line", "docs"), "line")
    votes = materialize(votes, "line-votes")
    each = votes.select("line", "docs", F.explode("votes").alias("vote"))
    constant = materialize(_supported(each, "vote", tree.min_docs), "votes-constant")
    # a template's name: its leaf and its constant words with their places
    shape = each.select("line", "vote").join(constant, "vote").groupBy("line").agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("vote")).alias("words"))
    named = votes.select("line", "leaf", "docs", F.size("votes").alias("size")).join(shape, "line", "left")
    general = F.sha2(F.concat_ws("/", "leaf", "fixed", "words"), 256)
    template = F.when(F.col("fixed") >= tree.min_constant * F.col("size"), general).otherwise(F.col("line").cast("string"))
    by_line = materialize(named.select("line", "docs", template.alias("template")), "line-templates")
    often = materialize(_supported(by_line, "template", tree.min_docs), "templates")
    others = by_line.where(~alone).join(often, "template", "left_semi").select("line")
    dropped = materialize(known.where(alone).select("line").unionByName(others), "lines-dropped")
    discard(known, unsettled, wanted, votes, constant, by_line, often)
    return lines, dropped


def drop_recurring(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its recurring lines."""
    lines, dropped = recurring_lines(docs, tree)
    nos = lines.join(dropped, "line", "left_semi").groupBy(_mark("doc_id", "th").alias("k")).agg(F.collect_set("no").alias("nos"))
    kind = dict(docs.dtypes)["doc_id"]
    met = _key(docs).select("doc_id", "text", _mark("doc_id", "th").alias("k")).join(nos, "k", "left").select("doc_id", "text", "nos")

    def run(batches):
        for batch in slices(batches):
            size, gone, text = [], [], []
            for data, nos in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("nos").to_pylist()):
                parts = [] if data is None else data.split(b"\n")
                out = set(nos or ())
                size.append(len(parts))
                gone.append(len(out))
                text.append(None if data is None else b"\n".join(x for k, x in enumerate(parts) if k not in out) if out else data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return met.mapInArrow(tidied(run), f"doc_id {kind}, n_lines long, n_dropped long, text string")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(read(spark, sf_dir, "documents", "doc_id", "text"))
