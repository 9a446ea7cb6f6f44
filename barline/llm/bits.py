"""A membership filter of bounded size as a table of bitmaps, tested on the map side.

The filter is built and tested with Spark's own functions. It is a table of at most
``n_bits / 32768`` rows of 4 KB, so its broadcast is bounded by ``n_bits`` alone; when more
keys are put in than it can tell apart it only lets more rows through. Bits of few keys
spread over all rows, so a filter of a counted table takes its size from ``bits_for``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of the filter: what Spark's bitmap aggregate holds.
BLOCK_BITS = 32768
MOST_BITS = 1 << 26


def bits_for(n_keys: int, most: int = MOST_BITS) -> int:
    """Bits of a filter of ``n_keys`` keys: 64 for each, one row at least, ``most`` at most."""
    return min(most, max(BLOCK_BITS, 1 << (64 * n_keys - 1).bit_length()))


def positions(key: list[Column], n_bits: int, n_hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)]


def as_bitmaps(bits: DataFrame) -> DataFrame:
    """(block, bitmap) of the positions in column ``bit``."""
    return bits.groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).agg(
        F.bitmap_construct_agg(F.expr(f"bit % {BLOCK_BITS}")).alias("bitmap")
    )


def filter_of(df: DataFrame, key: list[str], n_bits: int = MOST_BITS, n_hashes: int = 2, at_least: int = 1) -> DataFrame:
    """Filter of the keys of ``df``; with ``at_least`` 2, of the bits that two rows hit."""
    bits = df.select(F.explode(F.array(*positions([F.col(c) for c in key], n_bits, n_hashes))).alias("bit"))
    counts = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("hits"))
    return as_bitmaps(counts.filter(F.col("hits") >= at_least).select("bit"))


def with_test(df: DataFrame, key: list[str], bitmaps: DataFrame, name: str, n_bits: int = MOST_BITS, n_hashes: int = 2) -> DataFrame:
    """Adds ``name``: false if the key is certainly not in the filter."""
    columns, tests = df.columns, []
    for i, at in enumerate(positions([F.col(c) for c in key], n_bits, n_hashes)):
        bit, block, bitmap = f"__bit{i}", f"__block{i}", f"__bitmap{i}"
        side = F.broadcast(bitmaps.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
        df = df.withColumn(bit, at).withColumn(block, F.expr(f"{bit} div {BLOCK_BITS}")).join(side, block, "left")
        byte = F.conv(F.hex(F.expr(f"substring({bitmap}, int({bit} % {BLOCK_BITS}) div 8 + 1, 1)")), 16, 10).cast("int")
        tests.append(F.coalesce(F.expr(f"shiftleft(1, int({bit} % 8))").bitwiseAND(byte) != 0, F.lit(False)))
    return df.select(*columns, reduce(Column.__and__, tests).alias(name))
