import random
from collections import defaultdict

import numpy as np
import xxhash
from common import documents, empty, hard, row, text

from helixgate.llm import simhash


def brute_fingerprint(body):
    w = (body or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """least doc_id by component from (doc_id, fingerprint)."""
    parent = {fp: fp for _, fp in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, fp in pairs:
        least[find(fp)] += [d] if d is not None else []
    return sorted(str((d, f"{fp:016x}", min(least[find(fp)], default=None))) for d, fp in pairs)


def test_search_equals_brute_force_in_both_ways(spark):
    r = random.Random(1)
    fps = [0, (1 << 64) - 1, 3, 7]
    for _ in range(60):
        center = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            fps.append(center ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))))
    hub = r.getrandbits(64)
    fps += [hub ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    want = simhash.roots(len(fps), *np.nonzero(np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 2))
    for most in (512, 4):
        comp = {e["id"]: e["root"] for e in simhash.components(simhash.links(df, most)).collect()}
        root = [comp.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in fps]
        groups = lambda labels: sorted(sorted(i for i in range(len(fps)) if labels[i] == k) for k in set(labels))
        assert groups(root) == groups(list(want))


def test_bit_sliced_links_with_large_groups():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 16, 300).astype(np.uint64)
    starts = np.array([0, 130, 131, 300])
    a, b = simhash.bit_sliced_links(values, starts)
    want = {(i, j) for s, e in zip(starts, starts[1:]) for i in range(s, e) for j in range(s, i) if np.bitwise_count(values[i] ^ values[j]) <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_hard_rows(spark):
    docs = hard(spark)
    rows = simhash.near_duplicates(docs).collect()
    want = brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs.collect()])
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in rows) == want


def test_one_document_of_each_group_stays(spark):
    base = text(300, 7)
    rows = [row(n, base) for n in range(5)] + [row(0, base)] + [row(10, base.upper()), row(11, text(300, 8)), row(12, None), row(13, "")]
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 11, 12]


def test_near_copies_go_and_unlike_texts_stay(spark):
    r = random.Random(5)

    def edited(words, n):
        words = list(words)
        for k in r.sample(range(len(words)), n):
            words[k] = f"new{r.randrange(10**6)}"
        return words

    rows, near = [], 0
    for n in range(150):
        base = [f"w{r.randrange(10**5)}" for _ in range(300)]
        rows.append(row(10 * n, " ".join(base)))
        rows.append(row(10 * n + 1, " ".join(edited(base, 3))))  # shingles alike to 0.9
        rows.append(row(10 * n + 2, " ".join(edited(base, 40))))  # to about 0.35
    kept = {x["doc_id"] for x in simhash.keep_one(documents(spark, rows)).collect()}
    assert kept == {10 * n + k for n in range(150) for k in (0, 2)}


def shingle_set(body):
    w = body.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def test_links_are_those_of_the_real_similarity(spark):
    """Pairs on both sides of 0.8, where SimHash bits can't tell them apart; all sizes of text."""
    r = random.Random(11)
    rows, above, below = [], 0, 0
    for n in range(300):
        size = r.choice([8, 9, 14, 30, 60, 120, 300])
        base = [f"p{n}w{k}" for k in range(size)]
        cut = round((size - 4) * r.uniform(0.1, 0.28))
        other = base[: size - cut] + ([f"q{n}w{k}" for k in range(r.choice([0, 0, cut // 4]))])
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        alike = len(a & b) / len(a | b)
        above += 0.8 <= alike < 0.85
        below += 0.7 <= alike < 0.8
        rows.append(row(2 * n, " ".join(base)))
        rows.append(row(2 * n + 1, " ".join(other)))
    assert above > 20 and below > 20
    texts = {x[0]: shingle_set(x[1]) for x in rows}
    want = {2 * n for n in range(300)} | {2 * n + 1 for n in range(300) if len(texts[2 * n] & texts[2 * n + 1]) * 5 < 4 * len(texts[2 * n] | texts[2 * n + 1])}
    got = {x["doc_id"] for x in simhash.keep_one(documents(spark, rows)).collect()}
    assert got == want


def groups_of(rows, key, member):
    by = defaultdict(set)
    for x in rows:
        by[x[key]].add(x[member])
    return sorted(sorted(g) for g in by.values() if len(g) > 1)


def alike(sets):
    """Components of all pairs alike to 0.8, brute force over pairs that share a shingle."""
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[max(a, b), min(a, b)] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}


def test_large_buckets_and_clusters_lose_no_link(spark):
    """Windows sliding over a text are alike to their neighbours only: long chains in common buckets,
    compared whole and in pairs of small blocks."""
    r = random.Random(2)
    rows = []
    for n in range(4):
        words = [f"t{n}w{k}" for k in range(200)]
        at = 0
        while at + 60 <= 200:
            rows.append(row(len(rows), " ".join(words[at : at + 60])))
            at += r.choice([3, 5, 6, 6, 7])
    pairs = [k for k, j in alike({x[0]: shingle_set(x[1]) for x in rows}).items() if j >= 0.8]
    root = simhash.roots(len(rows), *np.array(pairs).T)
    want = groups_of([(int(k), n) for n, k in enumerate(root)], 0, 1)
    assert len(want) > 8
    for bucket, block in ((2048, 1_000_000), (3, 200)):
        got = simhash.shingle_classes(documents(spark, rows), max_bucket=bucket, block_shingles=block).collect()
        assert groups_of(got, "root", "doc_id") == want


def test_every_link_of_the_small_table_is_found(spark):
    """Recall over all distinct texts of sf0.01, held against brute force; 0.8 to 0.85 by itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {x["doc_id"]: shingle_set(x["text"] or "") for x in docs.collect()}
    links = {k: j for k, j in alike(sets).items() if j >= 0.8}
    found = {x["doc_id"]: x["root"] for x in simhash.shingle_classes(docs).collect()}
    assert all(found[a] == found[b] for a, b in links)
    assert sum(0.8 <= j < 0.85 for j in links.values()) >= 5
    ids = list(sets)
    nth = {d: n for n, d in enumerate(ids)}
    root = simhash.roots(len(ids), np.array([nth[a] for a, _ in links]), np.array([nth[b] for _, b in links]))
    assert groups_of(found.items(), 1, 0) == groups_of([(int(k), ids[n]) for n, k in enumerate(root)], 0, 1)


def test_any_alike_pair_shares_a_rare_key():
    """Pairs at the least overlap that 0.8 allows, of all sizes, under any frequencies."""
    r = np.random.default_rng(1)
    levels = r.integers(0, 40, 1 << 10).astype(np.uint8)
    tried = 0
    for n in (1, 4, 5, 8, 11, 20, 30, 50, 100, 300, 1000):
        for _ in range(200 if n < 300 else 20):
            m = int(r.integers(n, n * 5 // 4 + 1))
            common = -(-4 * (n + m) // 9)
            if common > n:
                continue
            h = r.integers(0, 1 << 63, n + m - common).astype(np.uint64)
            a, b = (simhash.prefix_keys(x, levels, 0.8) for x in (h[:n], h[n - common :]))
            assert len(np.intersect1d(a, b)), (n, m)
            tried += 1
    assert tried > 1000


def test_wide_fingerprints_of_alike_sets_are_within_the_radius():
    r = np.random.default_rng(4)
    far = []
    for n in (9, 18, 45, 90, 450):
        for _ in range(400):
            common = -(-8 * n // 9)
            h = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            far.append(int(np.bitwise_count(simhash.wide_fingerprint(h[:n]) ^ simhash.wide_fingerprint(h[n - common :])).sum()))
    assert max(far) <= simhash.WIDE_RADIUS and 35 < np.mean(far) < 43


def test_set_links_equal_brute_force():
    r = random.Random(8)
    sets = []
    for _ in range(40):
        base = r.sample(range(10**6), r.choice([3, 9, 40, 90]))
        for _ in range(r.randrange(1, 6)):
            kept = r.sample(base, max(1, round(len(base) * r.uniform(0.8, 1))))
            sets.append(np.unique(np.array(kept, np.uint64)))
    pairs = [k for k, j in alike({n: set(h.tolist()) for n, h in enumerate(sets)}).items() if j >= 0.8]
    assert simhash.set_links(sets, 0.8).tolist() == simhash.roots(len(sets), *np.array(pairs).T).tolist()


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0
