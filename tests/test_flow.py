"""Plant flow on values that its queries' tables are too small for."""

import statistics

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import flow


def test_noise_floor_of_sums_beyond_a_long(spark):
    """n times the sum of squares is 1.6e19 here, as with some million rows of ordinary values."""
    df = spark.range(4000).select((F.col("id") % 2).alias("state"), (2_000_000 + F.col("id") * 7919 % 1000).alias("cents"))
    df = df.union(spark.createDataFrame([(2, -4_000_000_000), (2, 4_000_000_000), (3, None)], "state long, cents long"))
    got = {r.state: r.noise for r in flow.noise_floor(df, ("state",)).collect()}
    want = {s: statistics.pstdev(r.cents for r in df.filter(F.col("state") == s).collect()) / 100 for s in (0, 1, 2)}
    assert got == {s: pytest.approx(x, rel=1e-12) for s, x in want.items()} | {3: None}
