"""Keyed bijections: permutations of any size, alike in SQL, different by key."""

import duckdb
import pytest
from pyspark.sql import functions as F

from barline.plans.bijection import permuted, permuted_sql

SIZES = [1, 2, 3, 5, 7, 10, 48, 49, 50, 101, 997, 1025]


def test_every_key_permutes_every_size(spark):
    sizes = spark.createDataFrame([(m,) for m in SIZES], "m long")
    slots = sizes.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("v")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep"))
    out = slots.withColumn("to", permuted(F.col("v"), F.col("m"), F.lit(7), F.col("rep"), F.lit("g")))
    seen = {}
    for r in out.collect():
        seen.setdefault((r.m, r.rep), {})[r.v] = r.to
    for (m, _), to in seen.items():
        assert sorted(to.values()) == list(range(m))
    assert all(seen[m, 0] != seen[m, 1] for m in SIZES if m > 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT m, unnest(range(m)) AS v, 0 AS rep FROM (VALUES (7), (50), (101)) s(m)")
    for m, v, _, target in con.execute(f"SELECT m, slot, rep, target FROM {permuted_sql('(SELECT m, v AS slot, rep FROM u)', 'slot', 'm', chr(40) + repr('7|') + ' || rep || ' + repr('|g') + chr(41), 12, 'target')}").fetchall():
        assert seen[m, 0][v] == target


def test_slots_are_spread(spark):
    """Where a slot goes over many keys is even: chi-square below a far quantile."""
    out = spark.range(4000).select(permuted(F.lit(3), F.lit(20), F.lit(1), F.col("id")).alias("to"), permuted(F.lit(4), F.lit(20), F.lit(1), F.col("id")).alias("next"))
    for c in ("to", "next"):
        counts = [r["count"] for r in out.groupBy(c).count().collect()]
        assert len(counts) == 20 and sum((n - 200) ** 2 / 200 for n in counts) < 60
    assert out.stat.corr("to", "next") == pytest.approx(-1 / 19, abs=0.08)
