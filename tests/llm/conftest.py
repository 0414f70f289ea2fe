import pytest

#: Texts that are easy to get wrong: null, empty, white space only, one word, repeats, long, other scripts, control strings.
AWKWARD = [
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (9, None),
    (8, ""),
    (7, " \n\t  "),
    (11, "word"),
    (12, "WORD"),
    (13, "be " * 40),
    (14, "be " * 60 + "end"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, None),
    (15, "ñandú 漢字 🙂 é̈ \x1c \x85 x y z  two  spaces\r\nline"),
    (16, "x" * 5000 + " " + "é" * 3000),
    (17, "prefix words here one two three four five six seven eight nine ten eleven twelve thirteen fourteen and more"),
    (18, "a\n\n\na\n \nb\nb\n"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (20, " ".join(f"w{i % 997}" for i in range(20000))),
    (21, " ".join(f"w{i % 997}" for i in range(500, 3000))),
]
CLASH = "score double, id long, block int, row string, kept boolean, copies int, _id long, _s string, x int, predicted int"


@pytest.fixture(scope="session")
def awkward(spark):
    """AWKWARD as documents, with null languages and sources and extra columns whose names clash with inner ones."""
    rows = [(i, t, None if k % 3 else "en", [None, "s0", "s1"][k % 3], None if t is None else len(t), 0.5, 1, 2, "r", True, 3, 4, "s", 5, 6) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.limit(0)
