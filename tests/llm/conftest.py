import pytest

from lumatlas.llm.common import ship

#: Extra columns named like those that the operators use inside.
CLASH = ["id", "text", "block", "rep", "root", "key", "bucket", "size", "run", "n", "of", "cell", "score", "word", "in_0"]

TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "one two",
    "Über die Brücke, naïve café — 日本語のテキスト <|endoftext|> don't\x1c stop  now\r\n\r\n  end  ",
    "tab\t and  double  spaces\n\nnew\n line " * 3,
    "the quick brown fox jumps over the lazy dog near the old stone bridge at noon " * 5,
    "the quick brown fox jumps over the lazy dog near the old stone bridge at noon " * 5,
    "x" * 3000,
    "añb" * 900,
    " ".join(f"w{i % 977}q{i}" for i in range(20_000)),
]


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def nasty(shipped):
    """Null and repeated ids, null, empty, odd and long texts, repeated rows, clashing extra columns."""
    ids = [None, 3, 5, 5, 8, 13, 14, 21, 22, 30, 31, 40]
    rows = [(i, t, *["clash"] * len(CLASH)) for i, t in zip(ids, TEXTS, strict=True)]
    rows += [rows[7], (None, "one two", *["clash"] * len(CLASH))]
    schema = "photo_id bigint, summary string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return shipped.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.limit(0)


def pairs(df):
    """The fixture's (id, text) rows."""
    return [(r.photo_id, r.summary or "") for r in df.select("photo_id", "summary").collect()]
