import re
from collections import Counter

import numpy as np
import pytest
from common import documents, empty, hard, row, text
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgate.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(body):
    body = body or ""
    found = WORD.findall(body)
    windows = Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
    covered = {k + j for k in range(len(found) - 4) if windows[tuple(found[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in body.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", body)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x0c\r|é ", max_size=120))
def test_counts_equal_brute_force(body):
    assert quality.text_stats(body.encode())[:5] == brute(body)


def test_junk_is_rejected_and_clean_text_kept(spark):
    rows = [row(n, text(120, n), source="ab"[n % 2]) for n in range(600)]
    rows += [row(1000 + n, " ".join(w + "###$$$%%%" for w in text(120, 5000 + n).split()), source="ab"[n % 2]) for n in range(60)]
    out = {r["doc_id"]: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert all(out[n]["kept"] for n in range(600))
    assert not any(out[1000 + n]["kept"] or out[1000 + n]["base_failed"] for n in range(60))


def numpy_mcd(x, rules=quality.Rules()):
    """The same estimate of one group in numpy: x has a row of whole numbers for each document."""
    floors = np.array(rules.floor_sd, float) ** 2
    nth = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]
    med = np.array([nth(c, 0.5) for c in x.T], float)
    sd = np.sqrt([(1.4826 * nth(np.abs(c - m), 0.5)) ** 2 + f for c, m, f in zip(x.T, med, floors)])
    z = (x - med) / sd
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    starts = [np.diag(sd**2)]
    for y in (np.tanh(z), np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)):
        cov = np.cov(np.round(y * 10_000).T, bias=True)
        one = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / np.outer(one, one)
        np.fill_diagonal(corr, 1)
        starts.append(np.outer(sd, sd) * corr + np.diag(floors) / 2)

    def bins(mean, inv):
        d = x - mean
        return np.floor(np.log2(1 + np.einsum("ni,ij,nj->n", d, inv, d) * 16) * 64).astype(int)

    def fit(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) + np.diag(floors)

    found = []
    for cov in starts:
        mean, det = med, np.inf
        for _ in range(rules.max_steps):
            b = bins(mean, np.linalg.inv(cov))
            mean, cov = fit(x[b <= nth(b, rules.subset)])
            new = np.linalg.slogdet(cov)[1]
            if new >= det - rules.tolerance:
                break
            det = new
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])

    def scale(mean, inv):
        return max(1.0, (2 ** ((nth(bins(mean, inv), 0.5) + 1) / 64) - 1) / 16 / quality.chi_square_point(0.5))

    inv = np.linalg.inv(cov)
    d = x - mean
    inside = np.einsum("ni,ij,nj->n", d, inv, d) <= scale(mean, inv) * quality.chi_square_point(0.025)
    mean, cov = fit(x[inside])
    inv = np.linalg.inv(cov)
    return mean, inv, scale(mean, inv)


def test_estimates_equal_numpy(spark):
    r = np.random.default_rng(2)
    groups = {}
    for k in range(3):
        mix = r.normal(size=(5, 5)) * 80
        body = r.normal(size=(400, 5)) @ mix + 1000 * k
        body[:40] += r.normal(size=(40, 5)) * 900 + 2500  # outliers
        groups[f"g{k}"] = np.round(body).astype(int)
    rows = spark.createDataFrame([(g, *map(int, v)) for g, x in groups.items() for v in x], "g string, " + ", ".join(f"x{k} long" for k in range(5)))
    for e in quality.mcd(rows, quality.Rules()).collect():
        mean, inv, scale = numpy_mcd(groups[e["g"]])
        assert np.allclose(e["mean"], mean, rtol=1e-9)
        assert np.allclose(np.reshape(e["inv"], (5, 5)), inv, rtol=1e-6, atol=1e-12)
        assert e["scale"] == pytest.approx(scale)
        d = groups[e["g"]] - mean
        far = np.einsum("ni,ij,nj->n", d, inv, d) / scale > quality.Rules().cutoff
        assert far[:40].mean() > 0.8 and not far[40:].any()


def test_chi_square_points():
    for tail, value in ((0.5, 4.35146), (0.025, 12.83250), (1e-4, 25.74483)):
        assert quality.chi_square_point(tail) == pytest.approx(value, abs=1e-4)


def test_small_groups_use_wider_ones(spark):
    """A rare language, and a small source of a language whose others are large, are judged too."""
    bad = lambda n: " ".join(w + "###$$$%%%" for w in text(120, n).split())
    rows = [row(n, text(120, n), source="ab"[n % 2]) for n in range(500)] + [row(600 + n, text(120, 600 + n), source="c") for n in range(20)]
    rows += [row(700, bad(700), source="c"), row(701, bad(701), lang="xx"), row(702, text(120, 702), lang="xx")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert not kept[700] and not kept[701] and kept[702] and all(kept[n] for n in range(500))


def test_hard_rows_and_reruns(spark):
    docs = hard(spark)
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for got, want in ((r, brute(d["text"])) for d in docs.collect() for r in rows if r["doc_id"] == d["doc_id"] and d["doc_id"] not in (46,)):
        assert tuple(got[1:6]) == want
    assert sorted(map(str, quality.quality_rules(docs.repartition(7)).collect())) == sorted(map(str, rows))
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)


def test_empty_table(spark):
    assert quality.quality_rules(empty(spark)).count() == 0
    assert quality.filter_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("body,failed", [("a b c", True), ("a b c d e f g h i j", False), ("a b c d e " * 4, True)])
def test_fixed_limits(spark, body, failed):
    assert quality.quality_rules(documents(spark, [row(1, body)])).first()["base_failed"] is failed
