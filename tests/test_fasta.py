import gzip

import pytest

from helixgate.functions.naming import parse_expected_size, table_sample_name, utc_seconds
from helixgate.sources.fasta import file_fingerprints, read_fasta


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def rows(spark, path):
    records, problems = read_fasta(spark, path, lines=True)
    return [tuple(r) for r in records.orderBy("record_idx").collect()], [(r["line"], r["message"]) for r in problems.collect()]


def test_lines_blanks_and_spaces(spark, tmp_path):
    got, bad = rows(spark, write(tmp_path, "x.fasta", "\n\r\n>a one  \r\nAC\r\r\n\nG T\n>b\n a>c\n"))
    assert bad == []
    assert got == [("x", 0, 3, "a", "a one", "ACG T"), ("x", 1, 7, "b", "b", " a>c")]


@pytest.mark.parametrize(
    "data,line,message",
    [
        ("ACGT\n>a\nAC\n", 1, "before the first header"),
        ("\n\nACGT\n>a\nAC\n", 3, "before the first header"),
        (">a\nAC\n>  \nGG\n", 3, "empty header"),
        (">a\n>b\nAC\n", 2, "without sequence: a, line 1"),
        (">a\nAC\n>b\n", 4, "without sequence: b, line 3"),
        (">a\n>\n", 2, "without sequence: a"),
        (">a\nAC\n>", 2, "empty header"),
        (">a\nAC\n>\n", 2, "empty header"),
        ("", 0, "no records"),
        ("\n\n", 0, "no records"),
    ],
)
def test_structural_errors(spark, tmp_path, data, line, message):
    got, bad = rows(spark, write(tmp_path, "x.fa", data))
    assert got == [] and len(bad) == 1
    assert message in bad[0][1]
    assert f"line {bad[0][0]}" in bad[0][1] or bad[0][0] == 0


def test_gzip_of_several_members_equals_plain(spark, tmp_path):
    plain = rows(spark, write(tmp_path, "x.fa", ">a\nAC\nGT\n>b\nNN\n"))
    packed = rows(spark, write(tmp_path, "x.fa.gz", gzip.compress(b">a\nAC\n") + gzip.compress(b"GT\n>b\nNN\n")))
    assert plain == packed


def test_order_over_many_splits(spark, tmp_path):
    n = 3000
    path = write(tmp_path, "big.fa", "".join(f">r{k}\n{'ACGT' * (k % 9 + 1)}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got, bad = rows(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert bad == [] and [r[3] for r in got] == [f"r{k}" for k in range(n)]
    assert [r[2] for r in got] == [2 * k + 1 for k in range(n)]


def test_fingerprints(spark, tmp_path):
    r = file_fingerprints(spark, [write(tmp_path, "x.fa", ">a\nA\n")]).first()
    assert r["bytes"] == 5 and len(r["sha256"]) == 64


def test_names_sizes_and_times():
    assert [table_sample_name(p) for p in ("a/b.fa.gz", "b.fna", "b", ".gz")] == ["b", "b", "b", "sample"]
    assert [parse_expected_size(x) for x in ("5", "3k", "2MB", "1 g")] == [5, 3000, 2_000_000, 1_000_000_000]
    for bad in ("", "1.5m", "-3", "9" * 25):
        with pytest.raises(ValueError):
            parse_expected_size(bad)
    assert utc_seconds("2024-05-01T12:00:00+02:00") == "2024-05-01T10:00:00Z"
