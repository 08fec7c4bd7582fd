import random

import pytest

from veritab.operators import joins


@pytest.mark.parametrize(("bins", "most"), [(256, 1_000_000), (4, 10), (1, 3)])
@pytest.mark.parametrize("on", [["k"], []])
def test_bands(spark, bins, most, on):
    """Overlapping, empty, reversed and open bands, one hot value, nulls, values outside of all bands."""
    rng = random.Random(bins)
    rows = [(rng.choice(["a", "b", None]), rng.choice([5.0, 5.0, 5.0, None, rng.uniform(-50, 50)]), i) for i in range(300)]
    bands = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.uniform(-60, 60), 5.0]), rng.choice([None, 5.0, rng.uniform(-60, 60)]), i) for i in range(40)]
    l, r = spark.createDataFrame(rows, "k string, bin_ double, i int"), spark.createDataFrame(bands, "k string, low double, high double, b int")
    if not on:
        r = r.withColumnRenamed("k", "k2")
    want = [(i, b) for k, v, i in rows for k2, low, high, b in bands if None not in (v, low, high) and low <= v <= high and (not on or (k is not None and k == k2))]
    got = joins.band_join(l, "bin_", r, "low", "high", on, bins, most)
    assert sorted((x.i, x.b) for x in got.collect()) == sorted(want)
    lone = {i for *_, i in rows} - {i for i, _ in want}
    outer = joins.band_join(l, "bin_", r, "low", "high", on, bins, most, left=True)
    assert sorted((x.i, -1 if x.b is None else x.b) for x in outer.collect()) == sorted(want + [(i, -1) for i in lone])
    assert joins.band_join(l.where("false"), "bin_", r, "low", "high", on).count() == 0
