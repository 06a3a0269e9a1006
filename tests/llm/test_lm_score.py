import math
from collections import Counter

import pytest
from common import documents, empty, hard, row, text

from helixgate.llm import lm_score


def brute(rows, least, leave_one_out):
    def grams(w):
        return Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))

    split = [(d, (t or "").encode().lower().split()) for d, t in rows]
    total, n = Counter(), sum(len(w) for _, w in split)
    for _, w in split:
        total.update(grams(w))
    out = []
    for d, w in split:
        own, s = grams(w) if leave_one_out else Counter(), 0.0
        rest = n - len(w) * leave_one_out
        for i in range(len(w)):
            top = min(3, i + 1)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if total[g] - own[g] >= (least if k > 1 else 1):
                    context = rest if k == 1 else total[g[:-1]] - own[g[:-1]]
                    s += math.log10((total[g] - own[g]) / context) + (top - k) * math.log10(0.4)
                    break
            else:
                s += (top - 1) * math.log10(0.4) - math.log10(rest + 1)
        out.append((d, len(w), s))
    return out


@pytest.mark.parametrize("batch_chars,leave_one_out", [(500, False), (16_000_000, False), (500, True)])
def test_scores_equal_brute_force(spark, batch_chars, leave_one_out):
    docs = hard(spark).unionByName(documents(spark, [row(100 + n, text(30, n % 3, size=20)) for n in range(30)]))
    found = lm_score.stupid_backoff(docs, batch_chars=batch_chars, leave_one_out=leave_one_out).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["log10_sum"]) for r in found)
    want = sorted((str(d), n, s) for d, n, s in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 1 if leave_one_out else 2, leave_one_out))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9, abs=1e-9)
    assert all(r["score"] == pytest.approx(r["log10_sum"] / r["n_words"]) for r in found if r["n_words"])


def test_empty_and_blank(spark):
    assert lm_score.stupid_backoff(empty(spark)).count() == 0
    r = lm_score.stupid_backoff(documents(spark, [row(1, None)])).first()
    assert (r["n_words"], r["log10_sum"], r["score"]) == (0, 0.0, None)
