import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit("mine"))
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with shared passages, near and exact copies, repeated lines and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(60), prose(12)
    rows = []
    for i in range(60):
        text = prose(rng.randint(0, 120))
        if i % 4 == 0:
            text += " " + passage[rng.randint(0, 80) :] + " " + prose(5)
        if i % 5 == 0:
            text += "\n" + line + "\n" + prose(8)
        if i % 7 == 0 and rows:
            text = rows[-1][1]
        if i % 11 == 0 and rows:
            text = (rows[-1][1] or "").replace("a", "e", 1)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "x " * 45), (105, "x " * 45), (106, "A,B;c\n\n\nd"), (107, "▁   \U0001f600 é"), (108, "w" * 5000)]
    return rows
