"""Small frames of awkward documents."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators also use inside.
EXTRA = ", size long, fp string, row string, id string, bucket int, kind string, start int, rank int, found string"


def awkward():
    """Nulls in every column, empty and blank texts, a very long text, ties,
    repeated rows and ids."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta", "eta", "\U0001f600", "theta#", "IOTA"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80))) + rng.choice(["", ".\n", "\t"]),
             rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 5) for i in range(60)]
    rows += [(100, None, "en", "s1", 0), (101, "", None, None, None), (102, " \n\t ", "en", "s2", 4),
             (None, "token = abcdefghijklmnop for a null id", None, "s1", 1), (None, None, None, None, None),
             (103, " ".join(rng.choices(words, k=20_000)), "en", "s1", 1), (104, "x" * 50_000, "de", "s2", 1),
             (105, "same words here " * 30, "en", "s1", 1), (105, "same words here " * 30, "en", "s1", 1),
             (106, "same words here " * 30, "en", "s2", 1), (105, "other text of the same id", "en", "s1", 1)]
    return rows


def frame(spark, rows=None, extra=True):
    rows = awkward() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, 1, "f", "r", "i", 2, "k", 3, 4, "x") for r in rows], DOCS + EXTRA)


def empty(spark):
    return frame(spark, [])


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
