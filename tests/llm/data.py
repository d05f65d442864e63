"""Small inputs with the odd cases every operator and stage must take."""

import random

SF = "/root/testdata/sf0.001"
LONG = 60_000

# extra columns named like columns the operators use inside
CLASH = ["fp", "size", "rank", "kept", "lang_pred", "_row", "_key", "words", "x", "key", "start", "root"]


def documents():
    """(doc_id, text, lang, source, n_chars) rows: nulls in every column, empty,
    blank and very long texts, repeated rows and ids, no letters, ties."""
    r = random.Random(4)
    en = ["the", "and", "of", "with", "house", "river", "green", "stone", "walked", "over", "under", "bright"]
    de = ["der", "und", "von", "mit", "haus", "fluss", "grün", "stein", "über", "unter", "nicht", "schön"]

    def text(words, n):
        return " ".join(r.choice(words) for _ in range(n)) + "."

    rows = [(i, text(en if i % 2 else de, 60 + i % 7), "en" if i % 2 else "de", f"s{i % 4}") for i in range(60)]
    base = rows[10][1]
    rows += [
        (100, base, "de", "s0"), (101, base, "de", None), (101, base, "de", None),      # copies, an equal row
        (102, base + " extra", "de", "s1"), (102, rows[11][1], "en", "s2"),             # one id, two texts
        (103, None, "en", "s0"), (104, "", "en", "s0"), (105, " \n\t ", None, "s1"),
        (106, "123 456 !!", "en", "s1"), (107, text(en, LONG), "en", "s3"), (108, "a" * LONG, "en", "s3"),
        (None, text(en, 55), "en", "s1"), (None, None, None, None), (109, rows[3][1], None, None),
        (110, "mail bob.smith@example.com or +1 (234) 555-0199 from 10.0.0.255 card 4111 1111 1111 1111", "en", "s0"),
    ]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=False):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASH:
            df = df.withColumn(c, F.lit("extra"))
    return df
