"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sa", "to", "vé") for b in ("x", "ld", "ma", "rin", "st", "q", "pol", "7")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=3, families=6):
    """(doc_id, text) rows: random texts, families of near and exact copies, and the awkward ones."""
    rng = random.Random(seed)
    rows = [(k, sentence(rng, rng.randint(1, 60))) for k in range(40)]
    at = 100
    for _ in range(families):
        base = sentence(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "one two"), (505, "One  TWO\n"), (506, "one two three")]
    rows += [(507, sentence(rng, 30_000)), (508, "x" * 100_000), (509, "日本 語 " * 40), (509, "日本 語 " * 40), (None, "no id here at all"), (None, None)]
    rows.append((510, rows[0][1]))
    return rows


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    """A frame with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return df.selectExpr("*", "'de' AS lang", "'src0' AS source", "length(text) AS n_chars", "1 AS fp", "'k' AS key", "2 AS _score", "3 AS _found", "4 AS h")


def empty(spark, schema="doc_id long, text string"):
    return frame(spark, [], schema)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))
