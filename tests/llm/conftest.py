import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, keep_id string, _salt string, words string, digest string, n_words string, label string"


def row(doc_id, text):
    return (doc_id, text, None, "src0", None, None, "x", None, "s", None, "d", "n", None)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with null columns and columns whose names clash with those of the operators."""
    return lambda pairs, parts=3: spark.createDataFrame([row(*p) for p in pairs], SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"w{i % 977} the Apache License cc by" if i % 50 == 0 else f"tok{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "Plain words here, twice."), (5, "plain WORDS here, twice."), (5, "plain WORDS here, twice."),
        (6, "ÉCOLE École école Ünïcode \U0001F600 text 中文"), (7, long), (None, "no id"), (None, None), (8, "Plain words here, twice."),
        (9, "one"), (10, "!!! ??? ***"), (11, "a" * 50_000),
    ]
