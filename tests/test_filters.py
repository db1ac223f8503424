import numpy as np
from pyspark.sql import functions as F

from folivane.plans.filters import Passing, key_filter, may_hold


def test_what_is_put_in_passes(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), 1 << 63, 2000)
    df = spark.createDataFrame([(int(k),) for k in [*keys, 0, -1, (1 << 63) - 1]], "k long")
    f = key_filter(df, df.k)
    assert may_hold(f, keys.view("u8")).all() and may_hold(f, np.array([0, (1 << 64) - 1, (1 << 63) - 1], "u8")).all()
    assert may_hold(f, rng.integers(0, 1 << 63, 100_000).astype("u8")).mean() < 0.001
    words = ["pump", "größe", "", "насос", "x" * 5000]
    passing = Passing(key_filter(spark.createDataFrame([(w,) for w in words], "w string"), F.xxhash64("w")), 3)
    assert all(passing[w] for w in words) and sum(passing[f"other{n}"] for n in range(1000)) < 3 and len(passing) <= 3
    assert not may_hold(key_filter(df.where("false"), df.k), keys.view("u8")).any()
