import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rinse-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    from __spark_entry__ import _ready

    yield _ready(session)
    session.stop()


@pytest.fixture
def write_csv(tmp_path):
    def write(content: str, name: str = "source.csv") -> str:
        path = tmp_path / name
        path.write_text(content, encoding="utf-8")
        return str(path)

    return write


@pytest.fixture
def table(spark):
    """A frame of string columns from rows of values."""

    def build(names: list[str], *rows):
        schema = ", ".join(f"`{name}` string" for name in names)
        return spark.createDataFrame(list(rows), schema)

    return build


def values(df):
    return [tuple(row) for row in df.collect()]
