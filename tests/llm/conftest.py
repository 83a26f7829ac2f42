import pytest

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
#: id, text: nulls, empty and blank texts, ties, repeated rows, a very long text, odd white space.
AWKWARD = [
    (1, SENTENCE),
    (2, SENTENCE + " sixteen"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "Single"),
    (7, SENTENCE.upper()),
    (7, SENTENCE.upper()),
    (None, SENTENCE),
    (None, None),
    (8, LONG),
    (9, LONG + " end"),
    (10, "the the the " * 40),
    (11, "été à Noël — naïve café ici " * 12),
    (12, "  " + SENTENCE.replace(" ", " \n ") + "  "),
    (13, "12 34 !? ..."),
]


@pytest.fixture
def awkward(spark):
    """The rows above with further columns whose names operators might use themselves."""
    rows = [(i, t, "en", None if i == 3 else "s1", n, "x", "y", 0.5, 1) for n, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, chunk int, bucket string, id string, score double, copy int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, chunk int, bucket string, id string, score double, copy int")
