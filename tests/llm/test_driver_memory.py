"""What the driver holds follows the keys at hand, not the largest filter or expression."""

import pytest
from pyspark.sql import functions as F

from barline.llm import line_dedup, ngram_join


@pytest.mark.parametrize("module", [line_dedup, ngram_join])
def test_filters_are_as_large_as_their_keys_ask_for(spark, monkeypatch, module):
    made = []

    def noted(*args):
        made.append(module_filter(*args))
        rows.append(made[-1].count())
        return made[-1]

    module_filter, rows = module.filter_of, []
    monkeypatch.setattr(module, "filter_of", noted)
    words = [f"{w}{i}" for i in range(100) for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta")]
    docs = [(k, " ".join(words[k : k + 60]) + f" end{k % 3}") for k in range(0, 600, 2)]
    docs += [(1000 + k, text + "!" * (k % 4 == 0)) for k, text in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if module is line_dedup:
        assert line_dedup.removed_lines(df).count()
    else:
        assert ngram_join.similar_groups(df).filter("component_id <> doc_id").count()
    assert rows and max(rows) <= 2, rows


def test_segments_are_not_written_out(spark):
    said = line_dedup.may_be_near(F.col("a"), F.col("b"), 1)
    plan = spark.createDataFrame([("x", "y")], "a string, b string").select(said.alias("may"))
    assert plan._jdf.queryExecution().optimizedPlan().expressions().head().toString().count("substr") <= 4


def test_wanted_segments_of_short_and_shifted_lines(spark):
    rows = [("abcdefgh", "abcdefgh"), ("abcdefgh", "xabcdefgh"), ("abcdefghijklmnop", "abcdefghijklmno"), ("é😀abcdefghij", "é😀abXdefghij"), ("abc", "abd"), ("abcdefghijklmnopqrst", "tsrqponmlkjihgfedcba")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(line_dedup.may_be_near(F.col("a"), F.col("b"), 1)).collect()] == [True, True, True, True, True, False]
