import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, odd characters, one very long text.
ODD = [
    (1, "The the quick  brown\tfox.\n\nIt's we'LL, 12345 3.14!", "en", "a", 5),
    (1, "The the quick  brown\tfox.\n\nIt's we'LL, 12345 3.14!", "en", "a", 5),
    (2, None, None, None, None),
    (None, "a row without an id", "en", "a", 1),
    (None, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   ", "en", "b", 3),
    (5, "\n \n", "fr", "b", 3),
    (6, "éà ÇA ß 中文 🙂 \x1c\x85​ é Σς <|endoftext|> x<|startoftext|> <|ENDOFTEXT|>", "fr", "c", 9),
    (7, "a" * 5000 + " " + "word " * 9000 + "end", "en", "hot", 9),
    (8, "The the quick  brown\tfox.\n\nIt's we'LL, 12345 3.14!", "de", "hot", 5),
    (9, "tail, tail. Tail, 'tail' (tail) tail,, tail..", "en", "hot", 4),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
