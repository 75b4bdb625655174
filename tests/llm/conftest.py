import pytest

ODD = [
    (1, "Hello  world,\n\tit's 'quoted' and naïve: 日本語 🙂 12345", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "Hello  world,\n\tit's 'quoted' and naïve: 日本語 🙂 12345", None, "b", 10),
    (5, "!!! 123 --- ...", "fr", "b", 5),
    (6, "word " * 30_000 + "end", "en", "hot", 150_003),
    (7, "x" * 5000, "en", "hot", 5000),
    (8, " \t\n ", "de", None, 4),
    (9, "\x1c\x85\xa0a<|endoftext|>b <|startoftext|>", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    clash = {c: F.lit("clash") for c in ("ids", "score", "node", "fp", "label", "block", "piece", "spans", "base", "term", "payload", "row", "path2", "weight", "probability", "token", "tokens", "sig")}
    return df.withColumns(clash).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
