"""Tables that hold the awkward cases every operator must survive."""

import pytest

ODD_TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", "x" * 5000, "word " * 30_000,
    "é ß 漢字   😀 it's we'll", "line one\nline two\n\nline one", "<|endoftext|> end", "\x00 nul \x1f",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, h long, score double, bucket int, id long"


def odd_rows():
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, 1, 2, 0.5, 3, 4) for i, t in enumerate(ODD_TEXTS)]
    return [*rows, rows[4], rows[4], (None, "null key", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with names that operators use."""
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
