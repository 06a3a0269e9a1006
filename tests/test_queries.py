import os
from collections import Counter

import duckdb
import pytest

from helixgate import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["assembly_summary", "raw_record_features", "header_flags", "duplicate_ids", "length_histogram", "gc_length_topk", "findings", "evidence_top20", "readiness", "recommended_tools", "cohort_summary", "cohort_samples", "tsv_long", "structure_problems", "fasta_gzip_features", "fasta_problems", "fasta_records", "fasta_flags", "fasta_findings", "cohort_outliers_fixed"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = Counter(tuple(plain(r[k]) for k in place) for r in found.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*cols).collect()) == want


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
