import datetime
import hashlib
import random
import re

import pytest
from common import documents, empty, hard, row

from helixgate.llm import pseudonyms as pn


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def cards(n, seed=1):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        d = "".join(r.choices("0123456789", k=r.choice([13, 15, 16, 19])))
        if luhn(d):
            out.append(d)
    return out


def rewritten(spark, bodies, key="k"):
    docs = documents(spark, [row(n, b) for n, b in enumerate(bodies)])
    out = pn.pseudonymize(docs, key)
    back = {r["doc_id"]: r["text"] for r in pn.restore(out.select("doc.*"), key).collect()}
    assert [back[n] for n in range(len(bodies))] == bodies
    got = {r["doc"]["doc_id"]: (r["doc"]["text"], r["kinds"]) for r in out.collect()}
    return [got[n] for n in range(len(bodies))]


def test_cards_keep_their_format_and_check_digit(spark):
    some = cards(40)
    got = rewritten(spark, [f"pay {c}, then" for c in some] + ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112", "x4111111111111111"])
    for c, (t, kinds) in zip(some, got):
        new = re.fullmatch(r"pay (\d+), then", t).group(1)
        assert kinds == ["card"] and len(new) == len(c) and luhn(new)
    assert len({t for t, _ in got[:40]}) == 40
    digits = [re.sub(r"\D", "", t) for t, _ in got[40:43]]
    assert digits[0] == digits[1] == digits[2] != "4111111111111111"
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", got[40][0]) and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", got[41][0])
    assert got[43] == ("4111111111111112", []) and got[44][1] == []


def test_dates_are_permuted_among_valid_days(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(0, 73049, 997)]
    got = rewritten(spark, [d.isoformat() for d in days] + ["1987-02-29", "29/02/2000", "2000-02-29", "1899-12-31", "2024-13-01"])
    new = [datetime.date.fromisoformat(t) for t, k in got[: len(days)] if k == ["date"]]
    assert len(set(new)) == len(days) and all(1900 <= d.year <= 2099 for d in new)
    odd = got[len(days) :]
    assert odd[0] == ("1987-02-29", []) and odd[3][1] == [] and odd[4][1] == []
    assert datetime.datetime.strptime(odd[1][0], "%d/%m/%Y").date().isoformat() == odd[2][0]


def test_other_kinds(spark):
    bodies = ["call +1 (017) 555-7713 now", "017-555-7713", "at 10.0.255.1.", "10.0.256.1", "ssn 123-45-6789", "000-45-6789", "Mail jane.Doe99@mail.example.com!", "jane.Doe99@other.org", "v1.2.3.4.5"]
    got = rewritten(spark, bodies)
    assert [k for _, k in got] == [["phone"], ["phone"], ["ip"], [], ["ssn"], [], ["email"], ["email"], []]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", got[0][0]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", got[1][0])
    assert re.sub(r"\D", "", got[0][0])[1:] == re.sub(r"\D", "", got[1][0])
    assert all(int(x) < 256 for x in got[2][0][3:-1].split("."))
    area, group, serial = map(int, got[4][0][4:].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial
    assert re.fullmatch(r"Mail [a-z]{4}\.[A-Z][a-z]{2}\d\d@mail\.example\.com!", got[6][0])
    assert got[6][0][5:15] == got[7][0][:10]
    assert all(t != b for (t, k), b in zip(got, bodies) if k)


def test_another_key_gives_other_values(spark):
    assert rewritten(spark, ["2001-05-06"], "a") != rewritten(spark, ["2001-05-06"], "b")


def test_hard_and_empty(spark):
    docs = hard(spark)
    out = pn.pseudonymize(docs, "k")
    assert out.select("doc.*").columns == docs.columns
    assert sorted(map(str, out.select("doc.*").collect())) == sorted(map(str, docs.collect()))
    assert pn.pseudonymize(empty(spark), "k").count() == 0


@pytest.mark.parametrize("body", ["a" * 50_000, "1" * 50_000, "1-" * 20_000, "a.b@" * 5_000, "é" * 9_999])
def test_long_runs_stay_fast(spark, body):
    assert len(rewritten(spark, [body])[0][0]) == len(body)


def feistel(digits, key, kind):
    """The network over the halves of a string of digits, written anew."""
    n = len(digits) // 2
    a, b, sizes = int(digits[:n]), int(digits[n:]), (10**n, 10 ** (len(digits) - n))
    for i in range(10):
        f = int(hashlib.sha256(f"{key}|{kind}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + f) % sizes[0]
        else:
            b = (b + f) % sizes[1]
    return f"{a:0{n}d}{b:0{len(digits) - n}d}"


def iban_rest(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_equal_an_independent_network(spark):
    got = rewritten(spark, ["017-555-7713", "4111111111111111", "DE89 3704 0044 0532 0130 00"])
    assert got[0][0].replace("-", "") == feistel("0175557713", "k", "phone")
    assert got[1][0][:-1] == feistel("411111111111111", "k", "card") and luhn(got[1][0])
    assert got[2][0].replace(" ", "")[4:] == feistel("370400440532013000", "k", "iban")


def test_ibans_phones_abroad_and_dotted_dates(spark):
    bodies = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432.", "GB83 WEST 1234 5698 7654 32", "call +44 20 7946 0958", "+442079460958", "+12 34 56", "25.12.1980", "25.13.1980", "1.25.12.1980", "25/12/1980"]
    got = rewritten(spark, bodies)
    assert [k for _, k in got] == [["iban"], ["iban"], ["iban"], [], ["phone"], ["phone"], [], ["date"], [], [], ["date"]]
    assert iban_rest(got[1][0]) == iban_rest(got[2][0][:-1]) == 1
    assert got[0][0].replace(" ", "") == got[1][0] != bodies[1] and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[0][0])
    assert re.fullmatch(r"GB\d\dWEST\d{14}\.", got[2][0])
    assert re.fullmatch(r"call \+44 \d\d \d{4} \d{4}", got[4][0]) and re.fullmatch(r"\+442\d{9}", got[5][0])
    assert got[7][0].replace(".", "/") == got[10][0] != bodies[10]
