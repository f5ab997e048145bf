"""Order statistics over values that sit where bands meet."""

import math
import random

from pyspark.sql import functions as F

from quotary.operators.scale import order_statistics


def test_against_sorting(spark):
    rng = random.Random(1)
    near = [x for e in range(-3, 5) for x in (math.nextafter(10.0**e, 0), 10.0**e, math.nextafter(10.0**e, 1e9), 9.95 * 10.0**(e - 1))]
    values = near + [-v for v in near] + [0.0, -0.0, 0.3 - 0.2, 0.0995, 99.95, float("inf"), float("-inf")] + [
        rng.uniform(-1, 1) * 10 ** rng.randint(-6, 6) for _ in range(500)]
    rows = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    picks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(1, len(values) + 1, 7)}
    got = order_statistics(rows, ["k"], "v", picks | {"n": None, "top": lambda n: n}).collect()[0]
    ordered = sorted(values)
    assert got["n"] == len(values) and got["top"] == ordered[-1]
    assert [got[name] for name in picks] == [ordered[int(name[1:]) - 1] for name in picks]


def test_values_just_below_a_power_of_ten(spark):
    for values in ([0.0995, 0.3 - 0.2], [99.95, math.nextafter(100.0, 0)]):
        rows = spark.createDataFrame([("k", v) for v in values], "k string, v double")
        assert order_statistics(rows, ["k"], "v", {"top": lambda n: n}).collect()[0]["top"] == max(values)
