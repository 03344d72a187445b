import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A folder for stored steps, as the tests' session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    long_ = " ".join(f"word{i % 977} of{i % 31}." for i in range(30_000))
    rows = [(1, "The first text. It has words.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "No id here.", "fr", "b"), (None, None, None, None)]
    rows += [(4, long_, "en", "a"), (5, long_, "en", "b"), (6, "x", "de", "b"), (6, "x", "de", "b"), (7, "  \n\t ", "es", "b"), (8, "é ß 文字 🙂", "fr", "a")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("id", "t", "n", "key", "slot", "shard", "score", "keys", "u", "v", "block", "at", "_domain", "n_removed", "label"):
        made = made.withColumn(name, F.lit("clash"))
    return made
