import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, n int, _doc string, first string"


def documents(spark, rows):
    """rows (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, s, None, 0.5, 7, 1, "x", "y") for i, t, g, s in rows], SCHEMA)


def sample_rows():
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(80) for _ in range(6)]
    rows = [(k, text(r.randint(0, 120)), r.choice(["en", "de"]), f"s{k % 4}") for k in range(40)]
    for k, b in enumerate(base):
        rows += [(100 + 10 * k + j, b if j < 2 else b + f" tail{j} x y z" if j < 4 else "lead " + b, "en", "hot") for j in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \n\t ", "en", None), (203, "one", "en", "s1"), (204, "one two", None, "s1"), (205, "one  two\n", "en", "s1")]
    rows += [(None, text(60), "en", "s2"), (300, base[0], "en", "s2"), (300, base[0], "en", "s2"), (301, "a" * 3000, "en", "s3"), (302, "ab " * 4000, "en", "s3")]
    rows += [(303, "line one here\nline one here\nother\n\nother\n" * 3, "fr", "s3"), (304, "Ünïcödé 😀 " * 30, "fr", "s3"), (305, " ".join(text(3000).split()), "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, []).repartition(2)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (5, None, None), (5, 1, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
