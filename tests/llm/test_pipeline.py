import corpus_pipeline
import pytest
from common import documents, empty, hard, row, text


def test_stages_take_effect(spark, tmp_path):
    passage = "A very particular question about rivers and their sources that no other text ever asks of us"
    rows = [row(n, text(120, n), source="ab"[n % 2]) for n in range(300)]
    rows += [row(400 + n, text(120, 5), source="a") for n in range(4)]
    rows += [row(500, text(60, 500) + "\n" + passage + "\n" + text(60, 501)), row(501, "too short"), row(502, None)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.mode("overwrite").parquet(str(tmp_path / f"s{len(sizes)}"))
        kept = spark.read.parquet(str(tmp_path / f"s{len(sizes)}"))
        sizes.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert {501, 502} & sizes[0] == set() and len(sizes[0]) == 305
    assert sizes[1] == sizes[0] - {400, 401, 402, 403}
    assert sizes[2] == sizes[1] - {500}
    words = {s: sum(len(r["text"].split()) for r in kept.where(f"source = '{s}'").collect()) for s in "ab"}
    assert words["a"] / (5 / 7) == pytest.approx(words["b"] / (2 / 7), rel=0.05)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())


def test_hard_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, long and empty texts, repeated rows, columns named as the operators' own."""
    docs = hard(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, text(12, 777, line=99))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / f"s{n}"))
        kept = spark.read.parquet(str(tmp_path / f"s{n}"))
    ids = [r["doc_id"] for r in kept.collect()]
    # 41, 42 and 43 have no words; 46 is there with one of its two texts twice
    assert sorted(ids, key=str) == sorted([None, *range(41), *range(44, 48), 46], key=str) or 45 in ids and 47 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(ids) and sum(r["n_tokens"] for r in out) > 0


def test_empty_table(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
