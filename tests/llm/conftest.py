import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def corpus() -> list[tuple]:
    """Documents with copies, edited copies, a shared passage and odd rows."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, rows = text(120), []
    for i in range(40):
        body = text(draw.randint(60, 200))
        rows.append((i, body, "en" if i % 3 else "fr", f"s{i % 4}"))
    base = rows[0][1].split()
    for i in range(40, 60):  # a group of edited copies
        edited = list(base)
        edited[draw.randrange(len(edited))] = f"new{i}"
        rows.append((i, " ".join(edited), "en", "s0"))
    rows += [(i, rows[1][1], "en", "s1") for i in range(60, 66)]
    rows += [(i, f"{text(30)} {passage} {text(30)}", "en", "s2") for i in range(66, 72)]
    rows += [(72, None, None, None), (73, "", "en", "s3"), (74, "   \n\t ", "en", None), (75, "one", None, "s1")]
    rows += [(76, "ünïcödé été " * 60 + text(80), "fr", "s1"), (None, text(90), "en", "s0"), (77, text(6000), "en", "s0")]
    rows += [(78, text(70), "en", "s2")] * 2
    return [(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    found = [(r[0], 0 if r[0] % 5 == 4 else 1, 0) for r in rows if r[0] is not None and r[0] < 72]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")
