import pytest
from pyspark.sql import SparkSession

from textloom.session import SETTINGS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    conf = SETTINGS | {
        "spark.master": "local[4]",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.local.dir": str(base / "local"),
        "spark.sql.warehouse.dir": str(base / "warehouse"),
        "spark.checkpoint.dir": f"file://{base}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
