import pytest


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, node long, row string"):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", 1, "x") for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: frame(spark, rows)


#: null and empty texts, white space, ties, repeated rows, a null id, one very long text
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two"), (7, "long " * 30000), (8, "z" * 30000), (9, "ÄÖ 日本 é\x1c x"), (10, "line\n\nline\nline")]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
