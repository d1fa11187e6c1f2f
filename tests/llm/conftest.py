import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, n int, node int, sha string, mark long, keep_id long, kept_id long, a long, b long, cid long, c string, id long, times int, tokens long, list long, hashes string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like inner ones."""
    rest = (1, 2, "x", 3, 4, 5, 6, 7, 8, "y", 9, 10, 11, 12, "z")
    prose = " ".join(WORDS)
    texts = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t"), (None, prose), (None, None), (6, "one two"), (7, "one  two"), (8, "one two " * 30_000), (9, "\U0001f600 <|endoftext|> é\n\nA\n" * 3), (1, "other text under the same id")]
    rows = [(i, t, "en" if i else None, "s" if i != 3 else None, None, *rest) for i, t in texts]
    return spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], CLASH)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (8, 0, 0), (9, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
