"""Printed decimals against C's."""

import random

import pytest
from pyspark.sql import functions as F
from runledger.functions import formats


@pytest.mark.parametrize("places", [0, 1, 2])
def test_decimals_print_as_in_c(spark, places):
    rng = random.Random(places)
    numbers = [rng.randrange(10**6) / 10**places + 5 / 10 ** (places + 1) for _ in range(2000)]  # halves, exact or nearly
    numbers += [rng.uniform(-1e6, 1e6) for _ in range(500)] + [0.0, -0.04, 0.05, 1.005, 6.25, 322.25, 2.5, 1e14 + 0.25]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", F.format_string(f"%.{places}f", formats.printed("x", places)).alias("t")).collect()}
    assert got == {i: f"{x:.{places}f}" for i, x in enumerate(numbers)}
