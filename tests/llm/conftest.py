import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n int, start int, item_id long, label string, h1 long, row long, key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(120), text(30_000)
    lines = "\n".join([" A common line of the table \t", "short", "A COMMON line of the table", "other " + base[:40]])
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO", base, base, base.upper(), base + " tail", base.replace(" ", "  "), long, long + " x", lines, lines + "\nmore", lines, "é À ß 漢字 かな", "###\n###\n###", base + "\n" + base]
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], i, 1, 1, "x", 5, 6, "k") for i, t in enumerate(texts)] + [(7, base, "en", "a", 0, 0, 0, "x", 0, 0, "k"), (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
