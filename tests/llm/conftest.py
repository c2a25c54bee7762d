import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def prose(seed, n):
    """n invented words."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and a repeated doc_id."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    long = prose(3, 4000)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 4),
        (7, "one", "en", "c", 3),
        (8, "One two", "en", "c", 7),
        (9, f"{prose(4, 30)}\n{passage}\n{prose(5, 30)}", "fr", None, 9),
        (10, f"{prose(6, 30)}\n{passage}\n{prose(7, 30)}", "fr", "d", 9),
        (11, f"{prose(8, 30)}\n  {passage.upper()}  \n{prose(9, 30)}", "fr", "d", 9),
        (12, long, "en", "d", len(long)),
        (12, prose(10, 40), "en", "d", 5),
        (13, "Ab " * 400, "en", "e", 1200),
        (14, "Ñandú été Übergröße " * 20, "es", "é", 400),
        (15, prose(11, 80), "en", "e", 5),
        (15, prose(11, 80), "en", "e", 5),
        (None, prose(12, 50), "en", "e", 5),
        (None, prose(12, 50), "en", "e", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(1).alias(c) for c in ("row", "h1", "pos", "n", "node", "label", "k1", "kept", "size", "w", "media", "spans", "score")])


def folder(df, path, **tables):
    """A folder of tables, as queries read them."""
    df.write.parquet(f"{path}/documents.parquet")
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}.parquet")
    return str(path)
