import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, label int, score string"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang]) rows, with columns whose names clash."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 9, "k", 5, "x") for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


#: Nulls, empty and long texts, ties and repeated rows.
ODD = [
    (1, None),
    (2, ""),
    (3, "Short."),
    (4, "one two three four five six seven eight nine ten " * 2500),
    (5, "same words in two rows of one table here"),
    (5, "same words in two rows of one table here"),
    (6, "same words in two rows of one table here"),
    (7, "\n \t  "),
    (8, "x" * 60_000),
    (9, "日本語 é 😀 ́ <|endoftext|> a@b.co +1 (234) 555-7890"),
    (10, "a b"),
]


@pytest.fixture
def odd():
    return list(ODD)
