import random
from collections import defaultdict

import pytest
from common import documents, empty, hard, row, text

from helixgate.llm import line_templates as lt


def brute(rows, tree=lt.Tree()):
    """(doc_id, text) rows -> rows with the recurring lines dropped, without any hashing."""
    docs = [(d, None if t is None else t.split("\n")) for d, t in rows]
    leaf_docs, line_docs, words = defaultdict(set), defaultdict(set), {}
    for n, (_, lines) in enumerate(docs):
        for x in lines or []:
            w = tuple(lt.words_of(x.encode()))
            if w:
                leaf_docs[len(w), w[: tree.depth]].add(n)
                line_docs[w].add(n)
    votes = defaultdict(set)
    for w, n in line_docs.items():
        for k, x in enumerate(w):
            votes[len(w), w[: tree.depth], k, x] |= n
    template, support = {}, defaultdict(set)
    for w, n in line_docs.items():
        leaf = (len(w), w[: tree.depth])
        if len(leaf_docs[leaf]) < tree.min_docs:
            continue
        fixed = tuple(x if len(votes[*leaf, k, x]) >= tree.min_docs else None for k, x in enumerate(w))
        template[w] = (leaf, fixed) if sum(x is not None for x in fixed) >= tree.min_constant * len(w) else w
        support[template[w]] |= n
    out = []
    for d, lines in docs:
        kept = [x for x in lines or [] if not (w := tuple(lt.words_of(x.encode()))) or len(support.get(template.get(w), ())) < tree.min_docs]
        out.append((d, len(lines or []), len(lines or []) - len(kept), None if lines is None else "\n".join(kept)))
    return sorted(map(str, out))


def bodies():
    rows = []
    for n in range(30):
        log = f"User u{n} logged in from host{n % 7} at 10:{n:02d} with session s{n * 17}"
        notice = f"Copyright by the {['red', 'green', 'blue', 'grey', 'pink', 'gold'][n % 6]} company of the town, all rights reserved here"
        rows.append((n, "\n".join([text(40, n), log if n % 3 == 0 else "", notice if n % 2 else text(8, 1000 + n), "The end."])))
    return rows


def test_equals_brute_force(spark):
    rows = bodies()
    docs = documents(spark, [row(*r) for r in rows])
    got = lt.drop_recurring(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    by = {r["doc_id"]: r["text"] for r in got}
    assert not any("logged in" in t or "Copyright" in t or "The end." in t for t in by.values())
    assert all(text(40, n).split("\n")[0] in by[n] for n in by)


def test_lines_of_one_document_are_one_voice(spark):
    """Three lines of one template in one document; two others reach its leaf with other lines."""
    body = "\n".join(f"we all went down to the {x} side today" for x in ("river", "lake", "sea"))
    rows = [(1, body), (2, "we all went up and over some old hill"), (3, "we all went out with them one cold night")]
    got = lt.drop_recurring(documents(spark, [row(*r) for r in rows])).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert sum(r["n_dropped"] for r in got) == 0
    more = rows + [(4, "we all went down to the lake side today"), (5, "we all went down to the pond side today")]
    got = lt.drop_recurring(documents(spark, [row(*r) for r in more])).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(more)
    assert sum(r["n_dropped"] for r in got) == 5


def test_hard_and_empty(spark):
    docs = hard(spark)
    got = lt.drop_recurring(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lt.drop_recurring(empty(spark)).count() == 0


@pytest.mark.parametrize("copies", [2, 3])
def test_copies(spark, copies):
    rows = [(7, text(30, 3))] * copies + [(8, text(30, 4))]
    got = lt.drop_recurring(documents(spark, [row(*r) for r in rows])).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def stages(spark):
    """Bytes that shuffles wrote, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}


def test_texts_move_once(spark):
    """Where no join is a broadcast, as in large tables, all shuffles together write little more than the texts."""
    r = random.Random(5)
    prose = lambda: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40))
    rows = [(n, "\n".join([*(prose() for _ in range(8)), f"Page of the {'old' if n % 2 else 'new'} book, all rights reserved"])) for n in range(400)]
    docs, before = documents(spark, [row(*x) for x in rows]), stages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lt.drop_recurring(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wrote = sum(n for k, n in stages(spark).items() if k not in before)
    assert sorted(str(tuple(x)) for x in got) == brute(rows)
    assert sum(x["n_dropped"] for x in got) == 400
    assert wrote < 1.6 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("bits", [64, 1 << 27])
@pytest.mark.parametrize("least", [2, 3, 5])
def test_any_filter_and_support(spark, bits, least):
    """A filter that lets every line through gives the same; so do repeated rows, with any least support."""
    rows = bodies()
    rows += [(40, text(30, 3))] * 2 + [(41, text(30, 3))] * 2 + [(42, text(30, 3).replace("x", "y")), (None, rows[1][1])]
    tree = lt.Tree(min_docs=least, filter_bits=bits)
    got = lt.drop_recurring(documents(spark, [row(*x) for x in rows]), tree).collect()
    assert sorted(str(tuple(x)) for x in got) == brute(rows, tree)


def test_leaves_that_recur_whole_need_no_words(spark, monkeypatch):
    """Where every line recurs as it is, no line is fetched; all are dropped."""
    wanted = []
    fetch = lt._line_votes
    monkeypatch.setattr(lt, "_line_votes", lambda docs, w, tree: wanted.append(w.count()) or fetch(docs, w, tree))
    rows = [(n, text(60, n % 5)) for n in range(15)]
    got = lt.drop_recurring(documents(spark, [row(*x) for x in rows])).collect()
    assert sorted(str(tuple(x)) for x in got) == brute(rows)
    assert wanted == [0] and sum(x["n_dropped"] for x in got) == 75
