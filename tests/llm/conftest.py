import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: doc_id, text, lang, source, n_chars and columns that clash with results: nulls, ties, repeated rows, empty and long texts.
ODD = [
    (1, None, "en", "a", None), (1, None, "en", "a", None), (None, "only words here", None, None, 3), (2, "", "en", "a", 0), (3, " \n\t\n ", "en", None, 5),
    (4, "word " * 9000, "fr", "b", 45000), (5, "x" * 70000, "fr", "b", 70000), (6, "café déjà\nvu ünï 漢字 <|endoftext|> 🎉", "fr", "b", 9), (7, "same text\nsame text", "en", "a", 19), (8, "same text\nsame text", "en", "a", 19),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
