"""Format-preserving Feistel pseudonyms, in DataFrame operations only.

One expression finds candidates in whole texts; each is validated as what it looks like and then
replaced by a value of the same kind and format under a keyed permutation:

    card    13 to 19 digits with a valid Luhn digit: all but the last permuted, that one renewed
    ssn     valid area, group and serial: permuted among the valid ones
    phone   ten national digits in groups, or a plus, a country code and up to 15 digits in all:
            permuted, country code and punctuation kept
    iban    valid check digits (mod 97): digits of the account permuted, check digits renewed
    ip      IPv4 with octets to 255: permuted among all addresses
    date    valid days of 1900 to 2099, year-month-day, day/month/year or day.month.year: permuted
            among these days
    email   letters and digits of the local part: each shifted within its class, domain kept

The permutation is an alternating Feistel network over Z_A x Z_B with A * B the number of valid
values, so it needs no cycle walking, maps no two values to one, and is undone by the same
network backwards (``restore``). Round functions are the first 60 bits of a keyed SHA-256. The
value alone decides the pseudonym, so equal values stay linked across documents and runs. Texts
do not move: there is no shuffle.

Not taken for personal data, as nothing validates them: ten digits in a row, month/day/year, IPv6.

Defined results: null text stays null and counts nothing; very long texts are rewritten whole; invalid
candidates stay as they are; where two kinds fit at one place the first in the order of the pattern
wins; repeated rows are treated alike; all other columns, whatever their names, are kept by
``pseudonymize``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

ROUNDS = 10
KINDS = ("card", "ssn", "phone", "iban", "ip", "date", "email")

# Lookarounds keep candidates apart from longer runs; possessive repeats keep the search linear.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_ISO = r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
_DMY = r"(?<![0-9A-Za-z./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])"
_DOTTED = r"(?<![0-9A-Za-z./-])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
_SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_PHONE = r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
_ABROAD = r"(?<![0-9A-Za-z.+-])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,5}\)|[ .-]?[0-9]{2,5}){2,5}+(?![0-9A-Za-z-])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
_CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z-])"
CANDIDATE = "|".join((_EMAIL, _ISO, _DMY, _DOTTED, _SSN, _PHONE, _ABROAD, _IBAN, _IP, _CARD))


def _round(key: str, kind: str, i: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str, back: bool) -> Column:
    """struct(a, b): the network over Z_size_a x Z_size_b, forwards or backwards."""
    turn = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s, i):
        f = _round(key, kind, i, F.when(i % 2 == 0, s["b"]).otherwise(s["a"]))
        moved = lambda x, size: F.pmod(x - f % size if back else x + f % size, size)
        return F.struct(
            F.when(i % 2 == 0, moved(s["a"], size_a)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, moved(s["b"], size_b)).otherwise(s["b"]).alias("b"),
        )

    return F.aggregate(turn, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _digits(digits: Column, key: str, kind: str, back: bool) -> Column:
    """Permute a string of digits among those of its length (up to 18)."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = _feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n - left).cast("long"), size(left), size(n - left), key, kind, back)
    return _let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), n - left, F.lit("0"))))


def _luhn(body: Column) -> Column:
    """Sum of the digits of ``body`` as they stand before a check digit."""
    n = F.length(body)

    def add(s, i):
        d = F.substring(body, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _check(body: Column) -> Column:
    return F.pmod(F.lit(10) - F.pmod(_luhn(body), F.lit(10)), F.lit(10)).cast("string")


def _refill(form: Column, digits: Column) -> Column:
    """``digits`` at the places of the digits of ``form``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s, c):
        d = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(d, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + d.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, put)["out"]


def _card(m: Column, key: str, back: bool) -> Column:
    def of(d):
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = F.length(d).between(13, 19) & (F.substring(d, F.length(d), F.lit(1)) == _check(body))
        new = _let(_digits(body, key, "card", back), lambda b: F.concat(b, _check(b)))
        return F.when(valid, _refill(m, new))

    return _let(F.regexp_replace(m, "[^0-9]", ""), of)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, k, n).cast("long") for k, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    nth = area - F.when(area > 666, 2).otherwise(1)  # among the 898 areas
    out = _feistel(nth * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", back)

    def text(s):
        n = F.floor(s["a"] / 99)
        return F.format_string("%03d-%02d-%04d", n + F.when(n >= 665, 2).otherwise(1), s["a"] % 99 + 1, s["b"] + 1)

    return F.when(valid, _let(out, text))


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, which stand for 10 to 35."""

    def add(s, c):
        n = F.ascii(c)
        return F.when(n < 58, (s * 10 + n - 48) % 97).otherwise((s * 100 + n - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(m: Column, key: str, back: bool) -> Column:
    def of(d):
        head, body = F.substring(d, F.lit(1), F.lit(2)), F.substring(d, F.lit(5), F.length(d))
        digits = F.regexp_replace(body, "[^0-9]", "")
        valid = F.length(d).between(15, 34) & (F.length(digits) > 1) & (_mod97(F.concat(body, F.substring(d, F.lit(1), F.lit(4)))) == 1)

        def renewed(new):
            check = F.lpad((F.lit(98) - _mod97(F.concat(new, head, F.lit("00")))).cast("string"), 2, F.lit("0"))
            # letters and spaces of the account stay; its digits and the check digits take their places
            return _refill(m, F.concat(check, F.regexp_replace(new, "[^0-9]", "")))

        return F.when(valid, _let(_refill(body, _digits(digits, key, "iban", back)), renewed))

    return _let(F.regexp_replace(m, " ", ""), of)


def _phone(m: Column, key: str, back: bool) -> Column:
    national = F.regexp_replace(F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]?", ""), "[^0-9]", "")
    code = F.regexp_extract(m, r"^(?:\+[0-9]{1,3}[ .-]?)?", 0)
    valid = ~m.startswith("+") | F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.when(valid, F.concat(code, _refill(F.substring(m, F.length(code) + 1, F.length(m)), _digits(national, key, "phone", back))))


def _ip(m: Column, key: str, back: bool) -> Column:
    o = [F.split(m, r"\.")[k].cast("long") for k in range(4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256) & ~m.rlike(r"(?:^|\.)0[0-9]")
    half = F.lit(1 << 16).cast("long")
    out = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, "ip", back)
    return F.when(valid, _let(out, lambda s: F.format_string("%d.%d.%d.%d", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)))


def _date(m: Column, key: str, back: bool) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    dots = m.contains(".")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).when(dots, F.try_to_date(m, "dd.MM.yyyy")).otherwise(F.try_to_date(m, "dd/MM/yyyy"))

    def moved(d):
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))
        # 1900 to 2099 has 73,049 = 17 * 4297 days
        out = _feistel(F.floor(n / 4297), n % 4297, F.lit(17).cast("long"), F.lit(4297).cast("long"), key, "date", back)
        new = _let(out, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * 4297 + s["b"]).cast("int")))
        return F.when((n >= 0) & (n < 73049), _let(new, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).when(dots, F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "dd/MM/yyyy"))))

    return _let(day, moved)


def _email(m: Column, key: str, back: bool) -> Column:
    """Feistel over the halves of the local part: each character is shifted within its class."""
    local = F.substring_index(m, "@", 1)
    n = F.length(local)
    left = (n / 2).cast("int")
    turn = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def shifted(half, other, i):
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

        def one(c, k):
            f = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, k.cast("string")), 256), 1, 7), 16, 10).cast("int")
            f = -f if back else f
            turned = lambda base, size: F.char(F.pmod(F.ascii(c) - base + f, F.lit(size)) + base)
            return F.when(c.rlike("[0-9]"), turned(48, 10)).when(c.rlike("[a-z]"), turned(97, 26)).when(c.rlike("[A-Z]"), turned(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(s, i):
        return F.struct(
            F.when((i % 2 == 0) & (F.length(s["a"]) > 0), shifted(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, shifted(s["b"], s["a"], i)).otherwise(s["b"]).alias("b"),
        )

    start = F.struct(F.substring(local, F.lit(1), left).alias("a"), F.substring(local, left + 1, n - left).alias("b"))
    return _let(F.aggregate(turn, start, step), lambda s: F.concat(s["a"], s["b"], F.substring(m, n + 1, F.length(m))))


def _replaced(m: Column, key: str, back: bool) -> Column:
    """struct(kind, out) of a candidate; kind is null where it is not valid."""
    made = lambda kind, out: F.struct(F.when(out.isNotNull(), kind).alias("kind"), F.coalesce(out, m).alias("out"))
    one = lambda kind, of: _let(of(m, key, back), lambda out: made(F.lit(kind), out))
    return (
        F.when(m.contains("@"), one("email", _email))
        .when(m.rlike(f"^(?:{_ISO}|{_DMY}|{_DOTTED})$"), one("date", _date))
        .when(m.rlike(f"^(?:{_SSN})$"), one("ssn", _ssn))
        .when(m.rlike(f"^(?:{_PHONE}|{_ABROAD})$"), one("phone", _phone))
        .when(m.rlike("^[A-Z]"), one("iban", _iban))
        .when(m.rlike(f"^(?:{_IP})$"), one("ip", _ip))
        .otherwise(one("card", _card))
    )


def _rewritten(text: Column, key: str, back: bool) -> Column:
    """struct(text, kinds): the text with its candidates replaced, and the kinds of the valid ones."""
    gaps = F.split(text, CANDIDATE, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: _replaced(m, key, back))

    def build(found):
        outs = F.concat(F.transform(found, lambda x: x["out"]), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(gaps, outs, lambda g, o: F.concat(g, o)), "")
        return F.struct(joined.alias("text"), F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9]{2}|@") & text.rlike(CANDIDATE), _let(new, build)).otherwise(none)


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with text rewritten under ``key``, in a struct beside what was found: columns doc
    (all columns of docs) and kinds."""
    doc = F.struct(*(F.col("__r.text").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), _rewritten(F.col("text"), key, back).alias("__r"))
    return packed.select(doc.alias("doc"), F.col("__r.kinds").alias("kinds"))


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The texts that ``pseudonymize`` has rewritten, as they were."""
    return pseudonymize(docs, key, back=True).select("doc.*")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind and the rewritten text. A production run takes its key from a vault."""
    out = pseudonymize(read(spark, sf_dir, "documents", "doc_id", "text"), "not-a-secret")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc.doc_id", *(count(k) for k in KINDS), "doc.text")
