import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as a documents table, with columns whose names an operator might use itself."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS id", "1 AS doc", "2 AS anchor", "3 AS score", "4 AS start").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one long text, repeated rows, a repeated id, many-byte characters."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdeéñ漢") for _ in range(draw.randint(1, 7))) for _ in range(50)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = text(120)
    return [
        (1, None), (2, ""), (3, "   \n"), (4, "word"), (5, base), (5, base), (6, base), (7, base + " more words here"), (8, text(90)), (9, "a" * 700),
        (10, "It's 42 <|im_end|> x y z  two\n\n three\r\n"), (11, text(4000)), (12, "😀 " * 60), (None, "no id at all"), (13, text(3) + "\n" + base[:300]),
    ]
