"""Keyed bijections of slot numbers: a permutation without a sort.

``permuted`` sends slot v of 0..m-1 to another slot so that every key gives one permutation.
Slots are written with two digits, v = left * b + right, for a square-like a * b just above
m; a Feistel network adds to one digit a mix of the other one, in turn, which can be undone
and is therefore a bijection of a * b. What falls behind m walks on through the network
until it is inside (at most a * b - m times), which makes it a bijection of m.

Round keys are slices of an MD5 of the key, and rounds mix by arithmetic on longs, so
another engine can repeat the draw: ``permuted_sql`` is the same in SQL. In Spark a batch of
slots goes through the network at once in numpy; keys are digested once per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 6
PRIME = (1 << 31) - 1
STRIDE = 1_103_515_245


def _mix(key: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A cubic of the digit modulo a prime, offset by the key."""
    t = (v * STRIDE + key) % PRIME
    return (t * t % PRIME * t + key) % PRIME


def round_keys(key: str) -> list[int]:
    digests = [hashlib.md5(f"{key}|{half}".encode()).hexdigest() for half in range(2)]
    return [int(digests[i // 3][10 * (i % 3) : 10 * (i % 3) + 7], 16) for i in range(ROUNDS)]


def network(v: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    left, right = v // b, v % b
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + _mix(keys[:, i], right)) % a
        else:
            right = (right + _mix(keys[:, i], left)) % b
    return left * b + right


@F.pandas_udf(T.LongType())
def _permuted(slot: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    v, m = slot.to_numpy(np.int64), size.to_numpy(np.int64)
    codes, texts = pd.factorize(key)
    keys = np.array([round_keys(t) for t in texts], np.int64).reshape(-1, ROUNDS)[codes]
    a = np.maximum(np.ceil(np.sqrt(m.astype(float))).astype(np.int64), 1)
    b = (m + a - 1) // a
    v = network(v, a, b, keys)
    while len(out := np.flatnonzero(v >= m)):
        v[out] = network(v[out], a[out], b[out], keys[out])
    return pd.Series(v)


def permuted(slot: Column, size: Column, *key: Column) -> Column:
    """The slot (from 0) that ``slot`` of ``size`` is sent to under a key of columns."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return _permuted(slot.cast("long"), size.cast("long"), text)


def permuted_sql(table: str, slot: str, size: str, key: str, steps: int, out: str = "partner") -> str:
    """SQL of the same: ``table`` with one more column. ``steps`` bounds how often a slot may
    walk on; ``key`` is an SQL expression of the key's text."""
    keys = ", ".join(f"CAST('0x' || substr(md5({key} || '|{i // 3}'), {1 + 10 * (i % 3)}, 7) AS BIGINT) AS k{i}" for i in range(ROUNDS))
    mix = lambda k, v: f"((((({v} * {STRIDE} + {k}) % {PRIME}) * (({v} * {STRIDE} + {k}) % {PRIME})) % {PRIME}) * (({v} * {STRIDE} + {k}) % {PRIME}) + {k}) % {PRIME}"
    at = f"(SELECT *, {slot} AS v, greatest(CAST(ceil(sqrt({size})) AS BIGINT), 1) AS a, {keys} FROM {table})"
    at = f"(SELECT *, CAST(({size} + a - 1) // a AS BIGINT) AS b, false AS done FROM {at})"
    for _ in range(steps + 1):
        at = f"(SELECT * EXCLUDE (v), CAST(v // b AS BIGINT) AS l, CAST(v % b AS BIGINT) AS r, v FROM {at})"
        for i in range(ROUNDS):
            moved = f"(l + {mix(f'k{i}', 'r')}) % a AS l" if i % 2 == 0 else f"(r + {mix(f'k{i}', 'l')}) % b AS r"
            at = f"(SELECT * REPLACE (CASE WHEN done THEN {'l' if i % 2 == 0 else 'r'} ELSE {moved[:-5]} END AS {moved[-1]}) FROM {at})"
        at = f"(SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN done THEN v ELSE l * b + r END AS v, done OR l * b + r < {size} AS done) FROM {at})"
    return f"(SELECT * EXCLUDE (v, a, b, done, {', '.join(f'k{i}' for i in range(ROUNDS))}), v AS {out} FROM {at})"
