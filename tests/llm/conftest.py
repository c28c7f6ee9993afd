import pytest

DOC_FIELDS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, doc string, found int"


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def make(rows):
        full = [(i, t, "en", None, None if t is None else len(t), "r", 7, "d", 1) for i, t in rows]
        return spark.createDataFrame(full, DOC_FIELDS)
    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and blank texts, repeated rows and ids, one very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return frame([(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (None, None), (4, "one"), (5, "same text twice over"),
                  (5, "same text twice over"), (5, "another text"), (6, long), (7, "ärger über größe  x"), (8, "a\u0000b c\rd")])
