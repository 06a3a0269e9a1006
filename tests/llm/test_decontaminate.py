import random

from common import documents, empty, hard, row, text
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgate.llm import decontaminate as dc


def brute(pattern, body):
    """Least edit distance of pattern to any substring of body."""
    last = [0] * (len(body) + 1)
    for i, p in enumerate(pattern):
        now = [i + 1]
        for j, c in enumerate(body):
            now.append(min(last[j] + (p != c), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=80), st.text("ab", max_size=80))
def test_myers_equals_dynamic_programming(pattern, body):
    want = brute(pattern, body)
    got = dc.myers(pattern, body, len(pattern))
    assert got[0] == want if got else want == len(pattern)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_no_match_within_budget_is_missed(seed):
    r = random.Random(seed)
    item = " ".join("".join(r.choices("abc", k=r.randrange(1, 5))) for _ in range(20))
    body = list(" x ".join(r.choices(["ab", "c", item], k=4)))
    for _ in range(r.randrange(8)):
        body[r.randrange(len(body))] = r.choice("abc ")
    body = dc.normalize("".join(body).encode())
    item = dc.normalize(item.encode())
    found = dc.Matcher([item], 16).find(body)
    want = brute(item, body)
    assert ([found[0][1]] if found else []) == ([want] if want <= len(item) // 16 else [])


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_planted_items(spark):
    item = "The quick  brown fox jumps over the lazy dog near the old stone bridge at dawn"
    edited = item.replace("brown", "brawn").replace("stone", "ston").lower()
    rows = [row(1, text(50, 1) + "\n" + item + "\n" + text(20, 2)), row(2, text(70, 3)), row(3, "x " + edited), row(4, item[:40]), row(5, None)]
    bench = items(spark, [(7, item), (8, item), (9, None), (10, ""), (11, "too short")])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.matches(documents(spark, rows), bench).collect()}
    assert got == {(1, 7): 0, (1, 8): 0, (3, 7): 2, (3, 8): 2}
    clean = dc.clean_documents(documents(spark, rows), bench, block_chars=1)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 5]


def test_short_items_count_where_they_stand_alone(spark):
    bench = items(spark, [(1, "Paris"), (2, "too  short here"), (3, "comparison of fire")])
    rows = [row(1, "I saw paris, twice"), row(2, "a comparison"), row(3, "it is TOO short\nhere."), row(4, "comparisons of fires")]
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(documents(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2)}
    assert {r["doc_id"] for r in dc.clean_documents(documents(spark, rows), bench).collect()} == {2, 4}


def test_ids_of_any_type_and_many_blocks(spark):
    passages = [text(12, 50 + n, line=99) for n in range(6)]
    docs = spark.createDataFrame([(f"d{n}", text(30, n) + " " + passages[n % 6]) for n in range(12)], "doc_id string, text string")
    bench = spark.createDataFrame([(f"i{n}", x) for n, x in enumerate(passages)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, bench, block_chars=100).collect()}
    assert got == {(f"d{n}", f"i{n % 6}") for n in range(12)}


def test_hard_and_empty(spark):
    docs = hard(spark)
    bench = items(spark, [(1, text(30, 45, line=999)), (2, text(25, 777))])
    assert dc.matches(docs, bench).count() >= 1
    assert dc.clean_documents(docs, items(spark, [])).count() == docs.count()
    assert dc.matches(docs, items(spark, [])).count() == 0
    assert dc.matches(empty(spark), bench).count() == 0
