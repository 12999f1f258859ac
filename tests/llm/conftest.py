import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, names that clash with inner ones."""
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (3, "a b c d e f g\nA B", 3, None), (3, "a b c d e f g\nA B", 3, None), (None, "no id", None, "y"), (5, "long " * 30000 + "é" * 20000 + "z" * 50000, 5, "y"), (6, " \t\n", 6, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, _id long, kept string")
