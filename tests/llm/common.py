"""Small tables with the cases that every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, doc string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size):03d}x" for _ in range(n)]


def text(n, seed, size=400, line=12):
    w = words(n, seed, size)
    return "\n".join(" ".join(w[k : k + line]) for k in range(0, n, line))


def row(doc_id, body, lang="en", source="a"):
    return (doc_id, body, lang, source, len(body or ""), "clash", "clash", "clash")


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def hard(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [row(n, text(60 + n, n)) for n in range(40)]
    rows += [row(None, text(50, 901)), row(41, None), row(42, ""), row(43, " \n\t ")]
    rows += [(44, text(80, 44), None, None, None, None, None, None)]
    rows += [row(45, text(9000, 45)), row(46, text(70, 46)), row(46, text(70, 46)), row(46, text(71, 47))]
    rows += [row(47, "žluťoučký kůň 🐎 " * 9)]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])
