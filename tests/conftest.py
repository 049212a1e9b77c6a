import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from jobpanel.session import get_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression on a single string."""
    from pyspark.sql import functions as F

    def run(function, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(function(*[F.col(n) for n in names]).alias("x")).first()[0]

    return run
