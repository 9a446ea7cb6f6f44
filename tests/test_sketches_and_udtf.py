"""Sketch roll-ups against exact answers; the box table function against the batch kernel."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from barline.operators import eventbars as EB
from barline.operators import sketches as S
from barline.operators import table_functions


def test_merged_sketches_are_as_good_as_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=60_000)
    rows = [(f"g{i % 3}", i % 40, float(v), int(i % 5000)) for i, v in enumerate(x)] + [("g0", 1, None, None), ("empty", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, day int, x double, who int")
    S.build(df, ["g", "day"], ["x"], ["who"]).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    got = S.read(S.roll_up(stored), {"p50": ("x", 0.5), "p99": ("x", 0.99)}, {"users": "who"}).collect()
    assert len(got) == 1 and got[0].n == 60_002 and set(got[0].asDict()) == {"n", "p50", "p99", "users"}
    assert abs((x <= got[0].p50).mean() - 0.5) < 0.02 and abs((x <= got[0].p99).mean() - 0.99) < 0.02
    assert got[0].users == pytest.approx(5000, rel=0.05)
    per = {r.g: r for r in S.read(S.roll_up(stored, "g"), distinct={"users": "who"}).collect()}
    assert per["g1"].n == 20_000 and per["empty"].users == 0


def test_boxes_of_the_table_function(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, i, float(p)) for k in range(4) for i, (t, p) in enumerate(zip(range(200), 50 + rng.normal(0, 4, 200).cumsum(), strict=True))] + [(9, 0, 0, None)]
    df = spark.createDataFrame(rows, "series_id long, ts long, tie long, price double").repartition(4)
    table_functions.register(spark)
    df.withColumn("note", F.lit("kept")).createOrReplaceTempView("some_ticks")
    got = spark.sql("SELECT * FROM price_boxes(TABLE(some_ticks) PARTITION BY series_id ORDER BY (ts, tie), 2.0D, 3)")
    assert got.columns == ["series_id", "ts", "tie", "price", "note", "box_id", "column_id", "direction", "level"]
    want = EB.box_columns(df.filter("price IS NOT NULL"), "series_id", 2.0, 3)
    cols = ["series_id", "ts", "tie", "box_id", "column_id", "direction", "level"]
    key = lambda r: (r[0], r[3])
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(map(tuple, want.select(*cols).collect()), key=key)
    for bad in ("TABLE(some_ticks) PARTITION BY series_id, 0.0D, 3", "TABLE(SELECT 1 AS a), 1.0D, 3"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM price_boxes({bad})").collect()
