import pytest

EXTRA = {"_id": "a", "_text": "b", "key": "c", "node": "d", "size": "e", "target": "f", "shard": "g", "_row": "h", "copies": "i", "ids": "j", "x": "k"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

PARAGRAPH = " ".join(f"word{i % 97} other{i % 89}" for i in range(120))


def rows_of(texts, source=lambda i: None if i is None else f"s{i % 2}"):
    """Rows of documents with columns that clash with the operators' own names."""
    return [(i, t, None, source(i), len(t or ""), *EXTRA.values()) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **more: spark.createDataFrame(rows_of(texts, **more), SCHEMA)


@pytest.fixture(scope="session")
def edge(make):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i}" for i in range(60_000))
    return make([
        (1, PARAGRAPH), (2, PARAGRAPH), (3, PARAGRAPH + " end"), (4, None), (5, ""), (6, " \t\n "), (7, long), (8, "one two"), (9, "One\ntwo"),
        (None, "one  two"), (None, PARAGRAPH), (10, "ÀÉ strąße 漢字 😀\nline\n\nline"), (11, PARAGRAPH), (11, PARAGRAPH), (12, "a\x1cb \x85   c"),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
