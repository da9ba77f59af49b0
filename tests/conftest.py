import pytest
from pyspark.sql import SparkSession

from faultline.session import RECOMMENDED


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column builder on one row of string values."""
    from pyspark.sql import functions as F

    def run(build, *values):
        names = [f"c{n}" for n in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
        return df.select(build(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return run
