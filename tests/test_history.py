"""A history with an index: few files read, the same rows."""

import datetime as dt

import pytest

from barline.sources.history import History

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, tie long, x double"


def rows(day, keys=("a", "b")):
    return [(k, T0 + dt.timedelta(days=day, minutes=m), 0, float(day * 100 + m)) for k in keys for m in range(20)]


@pytest.fixture
def history(spark, tmp_path):
    h = History(spark, f"{tmp_path}/h", "k", "ts", ["tie"])
    for day in range(30):
        h.append(spark.createDataFrame(rows(day, ("a", "b", "old") if day == 0 else ("a", "b")), SCHEMA).coalesce(1))
    return h


def test_tail_reads_the_newest_files_only(spark, history):
    got = {k: sorted(r.x for r in history.tail(5).collect() if r.k == k) for k in ("a", "b", "old")}
    newest = [2900.0 + m for m in range(15, 20)]
    assert got == {"a": newest, "b": newest, "old": [float(m) for m in range(15, 20)]}
    total = history.index().select("file").distinct().count()
    assert len(history.files_read) <= 4 < total  # the last batch, and the first one for ``old``
    assert history.tail(25).count() == 25 + 25 + 20


def test_known_rows_are_dropped_by_overlapping_files(spark, history):
    before = history.all().count()
    again = spark.createDataFrame(rows(29) + rows(29) + rows(30), SCHEMA)
    history.append_new(again)
    assert len(history.files_read) <= 3
    assert history.all().count() == before + len(rows(30))
    history.append_new(spark.createDataFrame([("new", T0, 1, 1.0)] * 3, SCHEMA))
    assert history.files_read == [] and history.all().count() == before + len(rows(30)) + 1


def test_before_the_first_batch(spark, tmp_path):
    h = History(spark, f"{tmp_path}/none", "k", "ts")
    assert h.index() is None and h.tail(3) is None and h.all() is None
    h.append_new(spark.createDataFrame(rows(1), SCHEMA))
    assert h.all().count() == len(rows(1))


def test_a_batch_without_index_is_not_seen(spark, history):
    before = history.all().count()
    spark.createDataFrame(rows(50), SCHEMA).write.parquet(f"{history.path}/rows-half")
    assert history.all().count() == before
