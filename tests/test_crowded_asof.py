"""As-of joins when one instant holds more rows than a block."""

import datetime as dt
import random

import pytest

from barline.operators.asof import asof
from barline.plans.series import Series

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.mark.parametrize("direction, strict, tolerance", [("backward", False, None), ("backward", True, None), ("forward", False, None), ("backward", False, 3_000_000)])
def test_crowded_instant_is_found_and_joined(spark, small_blocks, direction, strict, tolerance):
    rng = random.Random(1)
    left = [("a", at(50), i) for i in range(300)] + [("a", at(rng.randrange(100)), 300 + i) for i in range(80)] + [("b", at(9), 900), ("c", at(9), 901)]
    right = [("a", at(s), float(s)) for s in range(0, 100, 7)] + [("a", at(50), 50.0)] * 90 + [("b", at(9), 9.0)]
    schema = "k string, ts timestamp, id long", "k string, available_at timestamp, v double"
    l, r = spark.createDataFrame(left, schema[0]), spark.createDataFrame(right, schema[1])
    both = l.selectExpr("k", "ts AS t", "1 AS side").unionAll(r.selectExpr("k", "available_at", "0"))
    assert Series(both, "k", ["t", "side"]).crowded()
    out = asof(l, r, "k", direction=direction, strict=strict, tolerance_us=tolerance, keep_right_ts="seen")
    assert out.columns == ["k", "ts", "id", "v", "seen"]
    got = {x.id: x.v for x in out.collect()}
    for k, ts, i in left:
        known = sorted((t, v) for key, t, v in right if key == k)
        if direction == "backward":
            known = [(t, v) for t, v in known if (t < ts if strict else t <= ts)][-1:]
        else:
            known = [(t, v) for t, v in known if t >= ts][:1]
        known = [(t, v) for t, v in known if tolerance is None or abs((t - ts).total_seconds()) * 1e6 <= tolerance]
        assert got[i] == (known[0][1] if known else None), (k, ts)
    assert len(got) == len(left)
