import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts (ids 0, 1, ...) or (id, text) pairs, with columns that clash with results."""

    def made(rows, clash=()):
        pairs = [(i, r) if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(clash)) for i, t in pairs]
        return spark.createDataFrame(full, DOCUMENT + "".join(f", {c} string" for c in clash))

    return made


EDGE = [None, "", " ", "a", "\n\n", "one two", "é́ ñ 日本語 \U0001f600", "x" * 5000, "same text here", "same text here", "token = \"0123456789abcdef\"", "<|endoftext|> a  b\t\tc\xa0 d"]
