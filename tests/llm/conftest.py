import pytest

HARD = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string, _t int, kept int"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, odd white space, clashing names."""
    long_text = " ".join(f"word{i % 977} tail{i % 31}" for i in range(12_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (3, "the QUICK brown fox jumps over the lazy dog", "en", None),
        (4, "", None, "b"),
        (5, None, "en", None),
        (6, " \t\n\x0b\x0c\r ", None, "b"),
        (7, long_text, "en", "c"),
        (8, long_text + " end", "en", "c"),
        (9, "one", "de", "b"),
        (10, "non breaking spaces and \x1cseparators", "fr", "é"),
        (None, "a row without a name", None, None),
        (None, None, None, None),
        (11, "日本語 のテキスト 一二三", None, "日"),
        (12, "!!! 123 ### $$$", "en", ""),
        (13, "a  b   c\n\n\nd \n e", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "x", 1, 0) for r in rows], HARD).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], HARD)
