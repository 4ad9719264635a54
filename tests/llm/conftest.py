import pytest

#: Documents with nulls, empty, short, long, equal and nearly equal texts, repeated rows, and columns with names the operators use themselves.
LONG = " ".join(f"w{k % 977}" for k in range(6000))
BASE = "the cat sat on the mat and looked at the moon over the old town while rain fell on the roof and the street below was empty and dark again"
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("again", "now"), "en", "b"), (4, None, "en", "a"), (5, "", None, None),
    (None, "one two three", "de", "c"), (6, "  \n\t ", "fr", "c"), (7, LONG, "en", "b"), (8, "A <|endoftext|> b\u00a0c  d\ne é 日本 \U0001f600", "xx", "a"),
    (9, "dup line here\ndup line here\nand\n\ndup line here", "en", ""), (10, "!!! ??? 123", "en", "c"), (11, LONG + " tail", "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*t, k, "x", 1.5, k, True, None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, taken double, shard long, kept boolean, key string").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tokenizer():
    from pagemill.llm._store import tokenizer_path

    return tokenizer_path()
