"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fasta import spread
from ..store import discard, fresh_path, store

__all__ = ["WORD", "digest", "discard", "fresh_path", "materialize", "read", "row_mark", "slices", "spread", "take_rows", "tidied", "word_count"]


#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: One table written to the shared folder and read again.
materialize = store


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table, or some of its columns, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols or "*"))


def slices(batches, rows: int = 256):
    """The same rows in short batches, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc: nothing to give back


def tidied(run):
    """A task's function that gives freed memory back to the machine when it ends: Python workers
    are kept for other tasks, and would keep what the largest of them had needed."""

    @functools.wraps(run)
    def inner(*args):
        try:
            yield from run(*args)
        finally:
            _give_back()

    return inner


def word_count(text: Column) -> Column:
    """Number of words of a whole text, JVM-side; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def digest(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def row_mark(cols: dict[str, Column]) -> Column:
    """One string key of several columns, null apart from any text."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in cols.values()))


def take_rows(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``picked`` (doc_id, digest, m, copies, and source if need be)
    says: m rows share these keys and text, and give ``copies`` rows together.

    Texts move once, to meet the short list of picks; the few keys that rows repeat are handled
    apart. The join is left to adaptive execution, which splits hot keys and may spill."""
    keys = [c for c in ("doc_id", "source", "digest") if c in picked.columns]
    plain = {"doc_id": F.col("doc_id").cast("string"), "source": F.col("source"), "digest": F.col("digest")}
    picked = materialize(picked.select(row_mark({c: plain[c] for c in keys}).alias("__key"), "m", "copies"), "picked")
    own = plain | {"digest": digest(F.col("text"))}
    packed = docs.select(F.struct(*docs.columns).alias("doc"), row_mark({c: own[c] for c in keys}).alias("__key"))
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    out = packed.join(picked.where("m = 1"), "__key").withColumn("__r", times).select("doc.*")
    many = materialize(picked.where("m > 1"), "picked-repeats")
    if not many.isEmpty():
        firsts = packed.join(many, "__key").dropDuplicates(["__key"])
        out = out.unionByName(firsts.withColumn("__r", times).select("doc.*"))
    return out
