from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zonetide.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not there")
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate an expression on a single row of named values."""
    from pyspark.sql import functions as F

    def run(expr, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
        return row.select(expr.alias("r")).first()["r"]

    return run


def hours(spark, series: dict[int, list], start: str = "2024-03-01 00:00:00", value: str = "taxi_count"):
    """Zone-hour rows from per-zone lists; None leaves a gap."""
    from pyspark.sql import functions as F

    rows = [(z, i, v) for z, vs in series.items() for i, v in enumerate(vs) if v is not None]
    df = spark.createDataFrame(rows, f"zone_id long, i int, {value} double" if any(isinstance(r[2], float) for r in rows)
                               else f"zone_id long, i int, {value} long")
    return df.withColumn("timestamp", F.lit(start).cast("timestamp") + F.make_interval(hours=F.col("i"))).drop("i")
