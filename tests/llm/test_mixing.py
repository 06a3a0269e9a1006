from collections import defaultdict

import pytest
from common import documents, empty, hard, row, text

from helixgate.llm import mixing


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if w[s] * left / total > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * left / total for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_equal_resharing(spark):
    import random

    for seed in range(6):
        r = random.Random(seed)
        sizes = {f"s{k}": r.choice([0, 1, 5, 100, 3000]) * r.randrange(1, 9) for k in range(9)} | {None: 50}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(rows).collect()}
        assert got == pytest.approx(water(sizes))


def test_words_come_near_targets_and_reruns_agree(spark):
    rows = [row(n, text(20 + (n * 37) % 200, n), source=f"s{n % 3}") for n in range(3000)]
    docs = documents(spark, rows)
    out = mixing.mix(docs, fan=50).collect()
    source = {r[0]: r[3] for r in rows}
    taken, target = defaultdict(int), {}
    for r in out:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    assert len(out) == 3000
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.01 * t
    assert sorted(mixing.mix(docs.repartition(5), fan=50).collect()) == sorted(out)


def test_words_of_the_small_table_are_within_two_percent(spark):
    """Words taken of each source of sf0.01; a source may miss by its largest document at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in mixing.mix(docs).collect():
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) < largest[s] + 1
        assert largest[s] > 0.02 * t or abs(taken[s] - t) < 0.02 * t


def test_a_row_repeated_very_often(spark):
    docs = documents(spark, [row(5, text(10, 1), source="a")] * 95 + [row(6, text(10, 2), source="b")] * 5)
    out = mixing.mix(docs, run=10).collect()
    assert len(out) == 100 and sum(r["taken"] for r in out if r["doc_id"] == 6) == 150
    assert abs(sum(r["taken"] for r in out if r["doc_id"] == 5) - 850) <= 10


def test_expectations_are_kept(spark):
    docs = documents(spark, [row(n, text(10, n), source="ab"[n % 2]) for n in range(40)])
    sums = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed, fan=7).collect():
            sums[r["doc_id"]] += r["taken"] // r["size"]
    due = {d: 12 * (5 if d % 2 == 0 else 2) * 2 / 7 for d in sums}
    assert all(abs(sums[d] - due[d]) <= 12 for d in sums)
    assert sum(sums.values()) == pytest.approx(sum(due.values()), abs=12)


def test_hard_rows(spark):
    docs = hard(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    assert sum(r["taken"] for r in out if r["size"] == 0) == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) > 0


def test_empty_table(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0
