import pytest


@pytest.fixture(scope="session", autouse=True)
def small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
