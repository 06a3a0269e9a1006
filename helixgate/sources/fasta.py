"""Records from FASTA files and from tables.

Files are read as text cut at ``\\n>``, which Spark splits, so a plain file of any size is read in
parallel; a gzip file (by extension, several members allowed) is one task. A chunk is a record:
its first line the header, the rest the body. A chunk's number in its file is its number in its
split plus the chunks of the splits before, so nothing sorts a file and no sequence is shuffled:
the driver sees one row per split and one per file.

``read_fasta`` gives (records, problems): problems holds the first structural error of each
file, in file order as a line reader would meet it, and ``records`` only files without one.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.naming import sample_id

RECORDS = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("record_idx", T.LongType()),
        T.StructField("header_line", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("sequence", T.StringType()),
    ]
)

_TRIM = r"(?U)^\s+|\s+$"


def spread(df: DataFrame) -> DataFrame:
    """A plain scan dealt to all cores where it has fewer tasks than there are, as a file of one row
    group has. Scans of many files or row groups stay as they are: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _lines(spark: SparkSession, paths: list[str], line_sep: str | None = None) -> DataFrame:
    """One scan of all files: file, start of the split, number of the row in its task, text."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    rows = reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("nth", F.monotonically_increasing_id())


def _plain(path: str) -> str:
    """A path as Spark names the file, without scheme and escapes."""
    return unquote(re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", path)) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else os.path.abspath(path)


def _tails(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Files whose last bytes are ``\\n>`` or that are ``>``: the empty header that splitting loses."""
    # only the file's last line counts, and text readers drop the final newline
    last = _lines(spark, paths).groupBy("file").agg(F.max_by("value", F.struct("block", "nth")).alias("v"))
    return {r["file"]: r["bare"] for r in last.select("file", (F.regexp_replace("v", r"\r+$", "") == ">").alias("bare")).collect()}


def _head(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"^[^\n]*", 0), _TRIM, "")


def _body(text: Column) -> Column:
    rest = F.substring(text, F.length(F.regexp_extract(text, r"^[^\n]*", 0)) + 2, F.length(text))
    return F.regexp_replace(rest, r"\r*\n|\r+$", "")


def _ident(header: Column) -> Column:
    return F.regexp_extract(header, r"(?U)^(\S+)", 1)


def read_fasta(spark: SparkSession, paths: list[str] | str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of FASTA files; problems: path, sample_id, line, message. ``lines`` fills
    header_line, which takes a window over the line counts of each split."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input files")
    raw = _lines(spark, paths, "\n>").withColumnRenamed("value", "chunk")
    newlines = F.length("chunk") - F.length(F.translate("chunk", "\n", "")) + 1
    given = {_plain(p): p for p in paths}
    splits: dict[str, list] = {}
    for r in raw.groupBy("file", "block").agg(F.min("nth").alias("base"), F.count("*").alias("n"), F.sum(newlines).alias("lines")).collect():
        splits.setdefault(r["file"], []).append(r)
    path_of = {file: given[_plain(file)] for file in splits}
    known = []
    for file, rows in splits.items():
        chunks = line = 0
        for r in sorted(rows, key=lambda r: r["block"]):
            known.append((file, path_of[file], r["block"], r["base"], chunks, line))
            chunks, line = chunks + r["n"], line + r["lines"]
    # a local table of a row per split: broadcast where it is small enough
    offsets = spark.createDataFrame(known, "file string, path string, block long, base long, chunks_before long, lines_before long")
    cut = (
        raw.join(offsets, ["file", "block"])
        .withColumn("k", F.col("chunks_before") + F.col("nth") - F.col("base"))
        .withColumn("is_record", (F.col("k") > 0) | F.col("chunk").startswith(">"))
        .withColumn("text", F.when((F.col("k") == 0) & F.col("is_record"), F.substring("chunk", F.lit(2), F.length("chunk"))).otherwise(F.col("chunk")))
    )
    # where a reader would stop: an empty record shows at the next header, before that is judged
    stray = ~F.col("is_record") & (F.regexp_replace("chunk", r"[\r\n]+", "") != "")
    at = lambda k, rank, kind: F.struct(k.alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "block", "nth", _ident(_head(F.col("text"))).alias("id"), F.regexp_extract("chunk", r"^(?:\r*\n)*", 0).alias("blank"))
    problem = (
        F.when(stray, at(F.col("k"), 1, "stray"))
        .when(F.col("is_record") & (_head(F.col("text")) == ""), at(F.col("k"), 1, "header"))
        .when(F.col("is_record") & (_body(F.col("text")) == ""), at(F.col("k") + 1, 0, "body"))
    )
    worst = {r["file"]: r for r in cut.groupBy("file").agg(F.min(problem).alias("p"), F.count_if("is_record").alias("records"), F.count_if(~F.col("is_record")).alias("preamble")).collect()}
    bare = _tails(spark, paths)
    stops = [(file, r["p"]["block"], r["p"]["nth"]) for file, r in worst.items() if r["p"]]
    before: dict[str, int] = {}
    if stops:
        stop = spark.createDataFrame(stops, "file string, at_block long, at_nth long")  # at most a row per input
        earlier = raw.join(stop, "file").where((F.col("block") < F.col("at_block")) | ((F.col("block") == F.col("at_block")) & (F.col("nth") < F.col("at_nth"))))
        before = {r["file"]: r["n"] for r in earlier.groupBy("file").agg(F.sum(newlines).alias("n")).collect()}
    file_of = {path: file for file, path in path_of.items()}
    bare = {path_of.get(file, given[_plain(file)]): b for file, b in bare.items()}
    found = []
    for path in paths:
        file = file_of.get(path)
        r = worst.get(file)
        p = r["p"] if r else None
        line = before.get(file, 0) + 1
        if p and p["kind"] == "stray":
            line += p["blank"].count("\n")
            found.append((path, line, f"sequence data before the first header, line {line}"))
        elif p:
            found.append((path, line, f"empty header, line {line}" if p["kind"] == "header" else f"record without sequence: {p['id']}, line {line}"))
        elif bare.get(path) and r and r["records"]:
            line = 1 + sum(x["lines"] for x in splits[file])
            found.append((path, line, f"empty header, line {line}"))
        elif not r or not r["records"]:
            found.append((path, 0, "no records"))
    problems = spark.createDataFrame(found, "path string, line long, message string").select("path", sample_id(F.col("path")).alias("sample_id"), "line", "message")
    bad = {f[0] for f in found}
    preamble = [file for file, r in worst.items() if r["preamble"]]
    good = cut.where(F.col("is_record") & ~F.col("path").isin(*bad)) if bad else cut.where("is_record")
    header_line = F.lit(None)
    if lines:
        run = W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
        counted = raw.select("file", "block", "nth", newlines.alias("n")).withColumn("sum", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n")
        good = good.join(counted, ["file", "block", "nth"])
        header_line = F.col("lines_before") + F.col("sum") + 1
    records = good.withColumn("header", _head(F.col("text"))).select(
        sample_id(F.col("path")).alias("sample_id"),
        (F.col("k") - F.when(F.col("file").isin(*preamble), 1).otherwise(0) if preamble else F.col("k")).cast("long").alias("record_idx"),
        header_line.cast("long").alias("header_line"),
        _ident(F.col("header")).alias("id"),
        "header",
        _body(F.col("text")).alias("sequence"),
    )
    return records, problems


def from_table(df: DataFrame, sample: Column, order: Column, id_: Column, header: Column, sequence: Column) -> DataFrame:
    """Records from any table. ``order`` must be a distinct number per record of a sample; its
    order is the record order, so no window numbers the rows again."""
    return df.select(
        sample.cast("string").alias("sample_id"),
        order.cast("long").alias("record_idx"),
        F.lit(None).cast("long").alias("header_line"),
        id_.cast("string").alias("id"),
        header.cast("string").alias("header"),
        sequence.cast("string").alias("sequence"),
    )


def from_records(spark: SparkSession, rows: list[tuple[str, str, str]], sample: str = "sample") -> DataFrame:
    """Records from (id, header, sequence) tuples in memory."""
    return spark.createDataFrame([(sample, n, None, i, h, s) for n, (i, h, s) in enumerate(rows)], RECORDS)


def file_fingerprints(spark: SparkSession, paths: list[str], whole: int = 1 << 30) -> DataFrame:
    """path, bytes and SHA-256 of the raw (compressed) bytes of each file. Files above ``whole`` bytes
    don't fit a binary value and are read as a stream by the driver's JVM, in constant memory."""
    files = spark.read.format("binaryFile").load(paths)
    large = [(r["path"], r["length"]) for r in files.where(F.col("length") > whole).select("path", "length").collect()]
    out = files.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if large:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        rows = []
        for path, size in large:
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if ":" in path else path)
            stream = where.getFileSystem(conf).open(where)
            try:
                rows.append((path, size, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
            finally:
                stream.close()
        out = out.unionByName(spark.createDataFrame(rows, "path string, bytes long, sha256 string"))
    return out


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file on any file system that Spark reaches; returns its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def read_multiqc(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Artifacts for MultiQC: those with an id, a plot type and data; one row per file."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    pick = lambda k: F.get_json_object("json", f"$.{k}")
    rows = raw.select("path", pick("id").alias("id"), pick("plot_type").alias("plot_type"), pick("section_name").alias("section_name"), F.from_json(pick("data"), "map<string,map<string,string>>").alias("data"))
    return rows.where("id is not null and plot_type is not null and data is not null")
