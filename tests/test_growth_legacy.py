"""What a task holds, and how often a table is read, must not grow with the rows: windows of the older method."""

import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators import legacy
from sitefold.operators.islands import BIN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def values(spark):
    """Dense values, over the edges of bins and below zero."""
    rng = random.Random(4)
    rows = {(g, "p", edge + rng.randrange(-60, 60)): rng.randrange(1, 9) for g in "ab" for edge in (0, BIN, -BIN) for _ in range(60)}
    return rows, spark.createDataFrame([(*k, f) for k, f in rows.items()], "g string, p string, v long, f long")


def _brute(rows, window):
    out = {}
    for (g, p, v), f in rows.items():
        near = [(max(f, e), -(min(v, w) if f == e else v if f > e else w)) for (h, q, w), e in rows.items() if (g, p) == (h, q) and v != w and abs(v - w) <= window]
        out[g, p, v] = -max(near)[1] if near else v
    return out


@pytest.mark.parametrize("by_quartile", [False, True])
def test_values_are_snapped_without_pairs(values, by_quartile):
    rows, df = values
    found = legacy.cluster_values(df, "p", "v", "g", "f", by_quartile=by_quartile)
    got = {(r.grouping, r.posID, r.value): r.clusteredValue for r in found.collect()}
    want = {}
    if by_quartile:
        limits = {g: df.filter(F.col("g") == g).agg(F.percentile("f", F.lit(0.7))).first()[0] for g in "ab"}
        high, low = ({k: f for k, f in rows.items() if (f >= limits[k[0]]) is side} for side in (True, False))
        near = {k: max(((f, -abs(k[2] - w), w) for (g, _, w), f in high.items() if g == k[0] and abs(k[2] - w) <= 5), default=None) for k in low}
        lone = _brute({k: f for k, f in low.items() if near[k] is None}, 5)
        want = {**{k: k[2] for k in high}, **{k: n[2] for k, n in near.items() if n}, **lone}
    else:
        want = _brute(rows, 5)
        assert "Join" not in plan(found)
    assert got == want
