import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank and long texts, copies, near copies, shared passages, repeated rows."""
    rnd = random.Random(5)
    base = sentence(rnd, 120)
    words = base.split()
    passage = sentence(rnd, 70)
    rows = [(1, base), (2, base), (3, base.upper())]
    for i in range(4, 24):
        near = list(words)
        for _ in range(rnd.randint(0, 8)):
            near[rnd.randrange(len(near))] = sentence(rnd, 1)
        rows.append((i, " ".join(near)))
    rows += [(i, sentence(rnd, 40) + "\n" + passage + "\n" + sentence(rnd, 30)) for i in range(24, 32)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "one"), (45, "One two three"), (46, "x" * 700), (47, "é" * 400 + "ü")]
    rows += [(48, sentence(rnd, 20_000)), (49, passage), (49, passage), (49, passage), (50, "ab" * 300), (51, "日本語 " * 90)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with one more without id, and columns whose names the operators use themselves."""
    frame = spark.createDataFrame([*odd_rows, (None, "no id here but some words " * 12)], "doc_id long, text string").repartition(5)
    for name in ("row", "key", "open", "unique", "first", "last", "label", "score", "id", "component", "words"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
