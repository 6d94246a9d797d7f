
import pytest



@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as the table documents, with columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, size int, shard string")

    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return documents([
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, "", "en", None), (3, None, None, "a"),
        (None, "one two three four five six", "en", None), (4, long, "en", "b"), (5, long + " end", "en", "b"), (6, " \t\n", "en", "b"), (7, "123 456", None, "a"),
        (8, "One two  three\nfour five six", "en", "a"), (9, "eins zwei drei vier fünf", "de", "c"), (10, "日本語 テキスト 😀", "ja", "c"),
    ])
