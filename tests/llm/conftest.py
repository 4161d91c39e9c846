import pytest

SF = "/root/testdata/sf0.001"
CLASHING = {"n": 1, "seq": 2, "bucket": 3, "score": 4, "_row": 5, "label": 6, "node": 7}


def documents(spark, rows, clashing=False):
    """A documents table; with ``clashing``, extra columns named like the operators' own."""
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return df


ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "same words here and there " * 30),
    (4, "same words here and there " * 30),
    (5, "x" * 5000),
    (None, "a row without an id " * 5),
    (6, "Ünïcödé wörds — 漢字 and 😀 marks"),
    (7, " ".join(f"w{k}" for k in range(30_000))),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD, clashing=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}
