import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def words():
    return prose


def rows() -> list[tuple]:
    long = prose(5, 6000) + " " + "x" * 5000
    return [
        (1, "plain words of a small text", "en", "src0", 27),
        (None, prose(1, 70), "en", "src0", 400),
        (2, None, "en", "src1", 0),
        (3, "", None, None, None),
        (4, " \n\t ", "de", "src1", 4),
        (5, long, "fr", None, len(long)),
        (6, prose(2, 80), "en", "src2", 500),
        (6, prose(2, 80), "en", "src2", 500),  # a repeated row
        (6, "another text under one id", "en", "src2", 25),
        (7, prose(2, 80), "en", "src2", 500),  # a copy
        (8, "Ünïcödé 中文 😀 don't stop\n\n  now", "es", "src1", 30),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators might want."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({"TOKENS": F.lit("mine"), "toxic": F.lit(None).cast("int"), "key": F.lit(1), "text_key": F.lit(2), "node": F.lit("n"), "source_rank": F.lit(0.5), "a.b": F.lit("dot"), "simhash_key": F.lit(3), "mix_source": F.lit("m"), "suffix_id": F.lit(9)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
