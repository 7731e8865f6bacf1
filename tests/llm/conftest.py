import pytest

LONG = "word " * 60_000 + "x" * 200_000
ROWS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a"),
    (2, "The  cat sat\ton the mat and looked at the dog", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", None),
    (6, LONG, "en", "a"),
    (7, "café naïve 你好 <|endoftext|> \U0001f600 x", "fr", "b"),
    (8, "mail bob@example.com or +1 (556) 555-4807, ip 10.0.0.1", "en", "c"),
    (8, "mail bob@example.com or +1 (556) 555-4807, ip 10.0.0.1", "en", "c"),
    (None, "no id here", "en", "a"),
    (10, "one", "de", "c"),
    (11, "one two three four five six seven\nbye now\none two three four five six seven\neight nine", "en", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, blanks, a very long text, copies, a repeated row, and columns whose names
    operators might use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = {c: "1" for c in ("digest", "size", "row_id", "n", "kept", "_salt", "_order", "fp", "component_id", "score", "line", "doc", "repeats", "target", "_digest", "_kept_id")}
    return df.selectExpr("*", *[f"'{v}' AS {c}" for c, v in clash.items()]).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")


@pytest.fixture(scope="session")
def rows():
    return ROWS
