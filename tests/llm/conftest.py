import pytest

#: Texts that every operator has to bear: nulls, blanks, ties, repeated rows, odd characters, a long one.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "one two three four five six seven eight nine ten."), (5, "one two three four five six seven eight nine ten."),
    (6, "ONE two three four five six seven eight nine ten."), (None, "no id here"), (None, None), (8, "a b " * 3000), (9, "日本語 テスト Ünïcode ǅ ẞ  x y ́z 😀😀"), (10, "<|endoftext|>x<|startoftext|>"), (11, "\x00\x01 \x1c a\x85b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows, with columns whose names clash with those that operators make."""
    rows = [(i, t, "x", 1, 2.0, "k") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, rank int, score double, key string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
