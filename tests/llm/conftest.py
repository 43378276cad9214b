import duckdb
import pytest

HARD_TEXTS = [
    (0, "The cat sat on the mat. " * 30),
    (1, "The cat sat on the mat. " * 30),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b\x0c\r "),
    (5, "été ▁ 漢字   x y \x1cz <|endoftext|> 😀 don't\n\n\tend"),
    (6, "x" * 30000 + " tail"),
    (7, " ".join(f"w{i}" for i in range(6000))),
    (7, " ".join(f"w{i}" for i in range(6000))),
    (None, "a document without an id, with a few words"),
    (8, "one"),
    (9, "a\x1f b 　 c"),
]


@pytest.fixture
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators make."""
    rows = [(i, t, "en", None if i == 3 else "s", 1, "own", 5) for i, t in HARD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, start int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def duck(sf):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con
