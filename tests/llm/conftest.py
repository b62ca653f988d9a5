import pytest


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    """The tables here are tiny: two partitions after each shuffle are enough."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
