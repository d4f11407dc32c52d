import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white texts, equal rows, ties of ids, a long text, other alphabets.
AWKWARD = [
    (0, "The cat sat. It was a mat! Why?\nOne more line", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "b"),
    (3, " \t\n ", "en", None),
    (4, "The cat sat. It was a mat! Why?\nOne more line", "en", "a"),
    (4, "The cat sat. It was a mat! Why?\nOne more line", "en", "a"),
    (None, "no id here, but a few words of text anyway", "en", None),
    (None, None, None, None),
    (7, "日本語 텍스트 ́x İstanbul ½ <|endoftext|> it's end", "ja", "b"),
    (8, "word " * 30_000, "en", "long"),
    (9, "x", "en", "b"),
]


@pytest.fixture
def documents(spark):
    def make(rows, **extra):
        data = [(*row, None if row[1] is None else len(row[1]), *extra.values()) for row in rows]
        columns = "".join(f", {name} string" for name in extra)
        return spark.createDataFrame(data, DOCUMENT + columns)

    return make


@pytest.fixture
def awkward(documents):
    """Rows that are hard to handle, with further columns whose names operators use themselves."""
    return documents(AWKWARD, row="r", key="k", fp="f", size="s", score="c", shard="d", spans="e")
