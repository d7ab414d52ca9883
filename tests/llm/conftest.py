import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from (id, text) pairs, with columns that operators use as names of their own."""

    def make(pairs, extra=True):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("text_key", "key", "score", "block", "node", "_id", "part", "words", "item"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


#: Null ids and texts, empty and blank texts, rows repeated, one text under two ids, a long text.
ODD = [
    (None, None),
    (None, "one two three four"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four"),
    (4, "one two three four"),
    (5, "one two three four"),
    (6, "A " + "lorem ipsum dolor sit amet " * 20_000),
    (7, "é 漢字 🎉 \u0000 Σ"),
]
