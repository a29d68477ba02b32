import pytest

#: Columns whose names operators use inside; they must neither clash nor change.
CLASHING = ["size", "key", "h", "n", "k", "label", "place", "norm", "text_sha256", "toxic_score",
            "lang_pred", "root", "copies", "rate", "count", "value", "row", "pointer", "parts", "uid", "spans",
            "__h", "__s", "__copies", "__own", "__keep", "__key", "__place", "__group", "__bin", "__poor", "__text",
            "a.b"]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Small tables: two shuffle partitions instead of the session's eight."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def long_text(n: int = 30_000) -> str:
    return " ".join(f"w{i % 9973}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and
    ids, and columns with the operators' own names."""
    a = "one two three four five six seven eight nine ten"
    rows = [
        (10, a, "en", "s1", 1), (11, a.replace(" ", "\n\t "), "en", "s2", 2),
        (12, a + " eleven", "en", "s2", 3), (13, a.upper(), None, None, 4),
        (14, None, "en", "s1", 5), (15, "", "de", "", 6), (16, " \n\t ", "de", "s1", 7),
        (17, "one two", "de", "s3", 8), (18, "one two", "de", "s3", 8), (19, "one two", None, "s3", 9),
        (20, "repeated row of words", "fr", "s4", 10), (20, "repeated row of words", "fr", "s4", 10),
        (None, a, "en", "s1", 11), (None, "alone without an id", None, None, None),
        (21, long_text(), "en", "s1", 12), (22, long_text() + " tail", "en", "s5", 13),
        (23, "é ü ñ — … 日本語", "fr", "s5", 14),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
