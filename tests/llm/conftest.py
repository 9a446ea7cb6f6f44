import duckdb
import pytest


@pytest.fixture
def frame(spark):
    """A small documents table with extra columns of names that operators use inside."""

    def make(rows, schema="doc_id long, text string, source string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("score", "n", "rep", "component", "at", "block", "size", "id_", "copies", "removed"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture
def sql():
    def run(query, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for name, df in tables.items():
            arrow = df.toArrow()
            con.register(name, arrow)
        return sorted(con.execute(query).fetchall(), key=repr)

    return run


NASTY = [
    (1, "same text here and more of it to be long", "a"),
    (2, "same  text\there and more of it to be long", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, " \n\t ", "é"),
    (6, "word " * 3000 + "end", "a"),
    (7, "x" * 20000, None),
    (8, "same text here and more of it to be long", "a"),
    (9, "ünïcödé ▁ 😀 text\nwith lines\nthat are long enough to count as lines", "b"),
]


@pytest.fixture
def nasty():
    return list(NASTY)
