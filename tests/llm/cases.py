"""Small tables with the awkward rows that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, bucket int, doc_group string, keys string, kept string, node long, lang string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def awkward_texts(seed=1):
    """(doc_id, text): prose with shared passages, copies, null, empty, blank, long and odd texts."""
    draw = random.Random(seed)
    passage = prose(draw, 40, 10_000)
    rows = []
    for i in range(60):
        text = prose(draw, draw.randrange(1, 120), 10_000)
        if i % 4 == 0:
            text = f"{text} {passage}\nShared LINE\t\n{prose(draw, 9, 10_000)}"
        rows.append((i, text))
    rows += [(100 + i, rows[3][1]) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "Ünïcode wörds stay whole É é"), (205, "\n\nshared line\n")]
    rows += [(206, "again " * 3000), (207, "x" * 20_000), (None, rows[0][1]), (None, None), (203, "one"), (5, rows[6][1])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", "k", "x", 2, "en") for i, t in rows], COLUMNS).repartition(5)
