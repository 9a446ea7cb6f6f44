"""Query registry: a Spark callable, a column spec and (where possible) DuckDB SQL.

A column spec is a string of ``name:type`` items with types ``s`` string,
``i`` integer, ``f`` float (rounded to 6 decimals), ``t`` timestamp, ``b`` boolean.
The same spec shapes the Spark result and wraps the SQL, so names, types and
rounding always agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import use_utc

DIGITS = 6
# moves exact half-way values off the rounding boundary, alike on both sides
TIE_BREAK = 3e-10


@dataclass
class Entry:
    name: str
    spec: list[tuple[str, str]]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return shape(self.build(spark, sf_dir), self.spec)

    def oracle(self) -> str | None:
        return None if self.sql is None else wrap_sql(self.sql, self.spec)


REGISTRY: dict[str, Entry] = {}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def shape(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "f":
            c = F.round(c.cast("double") + F.lit(TIE_BREAK), DIGITS) + F.lit(0.0)
        elif kind == "t":
            c = c.cast("timestamp_ntz")
        elif kind == "b":
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def wrap_sql(sql: str, spec: list[tuple[str, str]]) -> str:
    kinds = {
        's': 'CAST("{0}" AS VARCHAR) AS "{0}"',
        'i': 'CAST("{0}" AS BIGINT) AS "{0}"',
        'f': 'round(CAST("{0}" AS DOUBLE) + 3e-10, 6) + 0.0 AS "{0}"',
        't': 'CAST("{0}" AS TIMESTAMP) AS "{0}"',
        'b': 'CAST("{0}" AS BOOLEAN) AS "{0}"',
    }
    cols = ", ".join(kinds[k].format(n) for n, k in spec)
    return f"SELECT {cols} FROM (\n{sql.strip()}\n) AS q"


def query(name: str, spec: str, sql: str | None = None):
    """Decorator registering ``fn(spark, sf_dir)`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, parse_spec(spec), fn, sql)
        return fn

    return deco
