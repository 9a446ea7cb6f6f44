"""Hard negatives by exact integer scores: residue-number-system products, then windows.

Components become integers. A block of anchors is multiplied with a block of rows modulo
several small primes: residues are centred, so the float32 products of ``WIDTH`` components
add up below 2 ** 24 and every partial sum is exact whatever the order of addition. As many
primes are taken as the largest possible score of the two blocks needs, and the signed
score comes back by Chinese remaindering with balanced digits.

Anchors are the stated query set (ids divisible by ``every``) against all rows, in blocks
of bounded size on both sides; a key is (vector length, anchor block, row block), or with
the label for the positives. A block keeps the best few per anchor, or per anchor and
positive within the window of scores, and the best of all blocks follow by rank, of which
Spark keeps the top before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import drop_tables, keep_table

#: The largest primes p with WIDTH * ((p - 1) / 2) ** 2 < 2 ** 24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
WIDTH = 64
ANCHORS_PER_BLOCK, ROWS_PER_BLOCK, TILE = 2048, 8192, 128
EVERY, SCALE, POSITIVES, NEGATIVES = 50, 256.0, 5, 3
LOW, HIGH = 50, 95


def residues(x: np.ndarray, prime: int) -> np.ndarray:
    """Centred residues of whole doubles, as float32; ``fmod`` is exact at every size."""
    r = np.fmod(x, prime)
    half = prime // 2
    r[r > half] -= prime
    r[r < -half] += prime
    return r.astype(np.float32)


def _centred(x: np.ndarray, prime: int) -> np.ndarray:
    half = prime // 2
    return (x + half) % prime - half


def product_mod(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a @ b.T modulo the prime, centred, as int64; blocks of WIDTH components at a time."""
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], WIDTH):
        total += np.rint(a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.int64)
        total = _centred(total, prime)
    return total


def largest_score(a: np.ndarray, b: np.ndarray) -> float:
    """A bound of |a_i . b_j| by lengths of vectors, with room for rounding."""
    if not a.size or not b.size:
        return 0.0
    return float(np.sqrt((a * a).sum(axis=1).max()) * np.sqrt((b * b).sum(axis=1).max())) * (1 + 1e-9) + 1


class Scorer:
    """Exact scores of one block of rows; residues are made once per prime."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.residues: dict[int, np.ndarray] = {}

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        bound = largest_score(anchors, self.rows)
        if not bound < 2**62:
            raise OverflowError("scores do not fit a long")
        primes, room = [], 1
        for p in PRIMES:
            primes.append(p)
            room *= p
            if room > 2 * bound + 1:
                break
        digits: list[np.ndarray] = []
        for k, p in enumerate(primes):
            if p not in self.residues:
                self.residues[p] = residues(self.rows, p)
            d = product_mod(residues(anchors, p), self.residues[p], p)
            for j, q in enumerate(primes[:k]):  # mixed radix, digit by digit
                d = _centred((d - digits[j]) * pow(q, -1, p), p)
            digits.append(d)
        score, weight = np.zeros_like(digits[0]), 1
        for d, p in zip(digits, primes, strict=True):
            score += d * np.int64(weight)
            weight *= p
        return score


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _top(key: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in order; equal keys do not occur."""
    k = min(k, key.shape[1])
    best = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < key.shape[1] else np.tile(np.arange(key.shape[1]), (len(key), 1))
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, axis=1), axis=1, kind="stable"), axis=1)


def _tiles(left: pa.Table, right: pa.Table, scale: float):
    """(anchor rows, ids of rows in order, labels, scores) of one pair of blocks, in tiles."""
    order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
    ids, labels = right["vec_id"].to_numpy()[order], right["label"].to_numpy()[order]
    rows = np.floor(scale * _matrix(right["vector"], len(right)))[order]
    anchors = np.floor(scale * _matrix(left["vector"], len(left)))
    score = Scorer(rows)
    for at in range(0, len(anchors), TILE):
        yield slice(at, at + TILE), ids, labels, score(anchors[at : at + TILE])


def _ranked(score: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """One key per cell: higher scores first, then earlier columns; -1 where not allowed.

    Scores are replaced by their ranks in the row, so a key always fits a long."""
    n = score.shape[1]
    low = score.min(initial=0)
    spread = int(score.max(initial=0)) - int(low)
    if spread < (1 << 62) // max(n, 1):
        key = (score - low) * n + np.arange(n - 1, -1, -1)
    else:
        key = np.empty_like(score)
        order = np.lexsort((np.broadcast_to(-np.arange(n), score.shape), score), axis=1)
        np.put_along_axis(key, order, np.broadcast_to(np.arange(n), score.shape), axis=1)
    return np.where(allowed, key, -1)


def _positives(left: pa.Table, right: pa.Table, scale: float, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    anchor_ids = left["vec_id"].to_numpy() if len(left) else np.empty(0, np.int64)
    if len(left) and len(right):
        for part, ids, _, score in _tiles(left, right, scale):
            mine = anchor_ids[part]
            key = _ranked(score, ids[None, :] != mine[:, None])
            top = _top(key, k)
            found = np.take_along_axis(key, top, axis=1) >= 0
            at, _ = np.nonzero(found)
            out.append((mine[at], ids[top[found]], score[at, top[found]]))
    return _table(out, ["anchor_id", "positive_id", "positive_score"])


def _negatives(left: pa.Table, right: pa.Table, scale: float, k: int, low: int, high: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    if len(left) and len(right):
        anchor_ids, own = left["vec_id"].to_numpy(), left["label"].to_numpy()
        windows = left["positives"].to_pylist()
        for part, ids, labels, score in _tiles(left, right, scale):
            key = _ranked(score, labels[None, :] != own[part][:, None])
            mine, wins = anchor_ids[part], windows[part]
            for p in range(max(map(len, wins), default=0)):
                has = np.array([i for i, w in enumerate(wins) if len(w) > p])
                win = [wins[i][p] for i in has]
                # 100 * score between low and high hundredths of the positive's score, in whole numbers
                least = np.array([-((-low * w["positive_score"]) // 100) for w in win], np.int64)[:, None]
                most = np.array([(high * w["positive_score"]) // 100 for w in win], np.int64)[:, None]
                s = score[has]
                inside = np.where((s >= least) & (s <= most), key[has], -1)
                top = _top(inside, k)
                found = np.take_along_axis(inside, top, axis=1) >= 0
                at, _ = np.nonzero(found)
                positive = np.array([w["positive_id"] for w in win], np.int64)
                gained = np.array([w["positive_score"] for w in win], np.int64)
                out.append((mine[has][at], positive[at], gained[at], ids[top[found]], s[at, top[found]]))
    return _table(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _blocks(df: DataFrame, sizes: DataFrame, keys: list[str], anchors: bool) -> DataFrame:
    """Copies of rows for every block of the other side, so that each pair of blocks meets once."""
    own, other = ("na", "nr") if anchors else ("nr", "na")
    limit = {"na": ANCHORS_PER_BLOCK, "nr": ROWS_PER_BLOCK}
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(limit[c]))).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), count(own).cast("long")).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), count(other) - 1))
    names = ("anchor_block", "row_block") if anchors else ("row_block", "anchor_block")
    return df.join(sizes, keys).withColumn(names[0], mine).withColumn(names[1], theirs).drop("na", "nr")


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], sizes: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    at = [*keys, "anchor_block", "row_block"]
    a, r = _blocks(anchors, sizes, keys, True), _blocks(rows, sizes, keys, False)
    a = a.select(*[F.col(c).alias(c) for c in a.columns])  # columns of its own: both sides read one table
    return a.groupBy(*at).cogroup(r.groupBy(*at)).applyInArrow(lambda left, right: fn(left, right), schema)


def _best(df: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vector, dim) of the rows that take part, one per id."""
    v = rows[vector_col]
    x = v.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    taking = rows.select(rows[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("vector"), F.size(v).alias("dim"), bad.alias("bad"))
    taking = taking.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT bad").drop("bad")
    once = taking.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vector")).alias("row"))
    return once.select("vec_id", "row.label", "row.vector", "row.dim")


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    every: int = EVERY, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; their positives the first
    ``positives`` other rows of the same label by score (ties: smaller id); for each, the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths
    of the positive's. Scores are inner products of floor(``scale`` * component).

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part. Rows that repeat an id count once, with the smallest label and vector. Vectors
    are compared with those of their own length. Scores of 2 ** 62 or more raise an error.
    Other columns are ignored; an empty table gives an empty table.
    """
    label = F.col(label) if isinstance(label, str) else label
    vectors = keep_table(usable(rows, id_col, vector_col, label), "mining")
    is_anchor = F.col("vec_id") % every == 0
    anchors = vectors.filter(is_anchor)
    sizes = vectors.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("nr"), F.count(F.when(is_anchor, 1)).alias("na")).filter("na > 0")
    schema = "anchor_id long, positive_id long, positive_score long"
    near = _meet(anchors, vectors, ["dim", "label"], sizes, lambda a, r: _positives(a, r, scale, positives), schema)
    near = keep_table(_best(near, ["anchor_id"], "positive_score", "positive_id", positives, "place"), "positives")
    wins = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most ``positives``
    total = sizes.groupBy("dim").agg(F.sum("na").alias("na")).join(vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("nr")), "dim")
    schema = f"{schema}, negative_id long, negative_score long"
    hard = _meet(anchors.join(wins, "vec_id"), vectors, ["dim"], total, lambda a, r: _negatives(a, r, scale, negatives, low, high), schema)
    out = keep_table(_best(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank"), "hard-negatives")
    drop_tables(vectors, near)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE own <> label AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
