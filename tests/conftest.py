import pytest
from pyspark.sql import SparkSession

from tessera.session import configure


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
