import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def vocabulary_of(spark):
    """A vocabulary from tokens in id order."""
    from glyphmill import Vocabulary

    def make(tokens):
        rows = list(enumerate(tokens))
        return Vocabulary.from_entries(spark.createDataFrame(rows, "token_id int, token string"))

    return make


@pytest.fixture(scope="session")
def table_of(spark):
    """Texts as a table: position is the key."""

    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "text_id bigint, text string")

    return make
