import pytest

#: Null ids and texts, empty, blank, repeated rows, ties, no white space, odd white space, other scripts, long lines.
ODD = [
    (1, "the cat sat on the mat and the dog ran off to the big red barn", "en", "a"),
    (1, "the cat sat on the mat and the dog ran off to the big red barn", "en", "a"),
    (2, None, None, None),
    (None, "no id here but the words are fine and they are long enough to count", "en", "b"),
    (None, None, None, "b"),
    (3, "", "en", "a"),
    (4, " \t\n\r ", "de", None),
    (5, "x" * 3000, "en", "b"),
    (6, "word " * 4000, "en", "c"),
    (7, "Straße und ÜBER \U0001f600 é   ſecret=abcdefgh12 \x1c tail", "de", "c"),
    (8, "The cat sat on the mat and the dog ran off to the big red barn", "en", "c"),
    (9, "SHOUT!! LOUD!! WORDS!! ### $$$ %%% &&& MORE!! THINGS!! HERE!! NOW!!", "en", "d"),
    (10, "one\ntwo\n\none\n  \none\r\nthis is a longer line of some words that counts\nThis  is a longer line of some words that counts", "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = {"size": F.lit(7), "kept": F.lit("x"), "fp": F.lit(1.5), "key": F.lit("k"), "row": F.lit(0), "n_lines": F.lit(-1), "_t": F.lit("t"), "sigs": F.lit(3), "n_words": F.lit(-2), "n_capitals": F.lit("c"), "_w": F.lit(0), "host": F.lit("h"), "times": F.lit("t")}
    clash |= {c: F.lit(f"own {c}") for c in ("_d", "_k", "_t", "_m", "_times", "_rows", "_cut", "_r", "_row", "_n", "cell", "id", "id2", "d", "k", "nil", "drop", "cut", "stratum", "rows", "each", "judged", "page", "key 2", "a.b")}
    return rows.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
