import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


ODD = [
    (1, "  Only the same line that many other documents repeat in full here \n\nshort\nx"),
    (2, "Only the same line that many other documents repeat in full here\r\nother  tail. "),
    (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (5, ""), (6, " \n\t "),
    (7, "only the same line that MANY other documents repeat in full here"),
    (8, "Only the same line that many other documents repeat in full here\nOnly the same line that many other documents repeat in full here"),
    (9, "Only the same line that many other documents repeat in full here"), (None, "Only the same line that many other documents repeat in full here"),
    (10, "é ß ñandú 漢字 words of many kinds, 12 3.5 it's <|endoftext|>   \x85 end"), (11, "w " * 3000), (12, "x" * 700), (13, "x" * 199),
    (14, " ".join(f"t{i}" for i in range(400))), (15, " ".join(f"t{i}" for i in range(390)) + " z"), (16, " ".join(f"t{i}" for i in range(5, 400))),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(d, t, ("en", "fr", None)[i % 3], None, i, "mine", i) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string, _d int").repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_table(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
