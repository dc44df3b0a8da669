import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "kept string, score string, lang_pred string, node string, hash string, block int, row string, `a.b` string"
)
WORDS = [
    "the river runs past seven quiet mills before it meets the sea and turns north again",
    "le train part de la gare vers midi et arrive avant la nuit dans une autre ville",
]


def rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows, rows that share an id."""
    long = " ".join(f"word{i % 7919} of{i % 31}" for i in range(60_000))
    texts = [
        (1, WORDS[0], "en", "a"), (2, WORDS[0], "en", "a"), (2, WORDS[0], "en", "a"),
        (3, None, None, None), (4, "", "fr", "b"), (5, " \n\t ", None, "b"), (None, WORDS[1], "fr", "b"),
        (6, WORDS[1], "fr", None), (7, WORDS[1].upper(), None, "b"), (8, long, "en", "a"),
        (9, "x" * 300_000, "en", "a"), (6, WORDS[0] + " but not here", "en", "a"), (10, "12 34 ### !!", "en", "a"),
        (11, "word", "en", "b"), (12, "two words", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), None, "x", "x", "x", "x", 1, "x", "x")
            for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and other columns with names that the operators use."""
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
