"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, _hit string, gone string, kept string, rate string, id string, line string"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve " * 6
    texts = [(1, base), (2, base.upper()), (2, base.upper()), (3, None), (4, ""), (5, " \t\n "), (6, long), (7, long + " tail"), (None, base), (8, "a"), (9, "été ÉTÉ ß\n中文 words"), (None, None), (10, "x\n\n\ny")]
    rows = [(d, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 0.5, 7, "h", "g", "k", "r", "i", "l") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
