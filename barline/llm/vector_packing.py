"""Best-fit packing of documents into sequences under several capacities.

1. ``cut`` encodes each document, ends it with ``END`` and cuts what is longer than a
   sequence into whole sequences; the first piece keeps the remainder. A task numbers its
   pieces of each length while it writes them.
2. A piece takes tokens, one document slot and attention cost (the square of its length),
   all of which follow from its length. So the packing is solved for the counts per
   length, a table of at most ``tokens`` rows whatever the input: ``solve`` goes through
   lengths from long to short and puts pieces into the open bin that fits under every
   constraint and leaves the smallest weighted residual norm (or has the smallest weighted
   dot-product of residual and piece). Bins of equal content are one class with a count;
   there are at most four classes per length.
3. ``pack`` numbers the pieces of a length over all tasks (counts per task and length,
   running sums) and reads each piece's sequence and offset off the solved slots. Ids and
   texts are not shuffled.
4. ``sequences`` gathers the pieces of each sequence with their spans.

Weights are the shares of demand to capacity, so a constraint that could bind weighs more;
the rule and weights that need the fewest sequences are kept.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm import units
from barline.llm.common import keep_table, whole

TOKENS = 1024
END = 2
RULES = ("norm", "dot")


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and the sum of squared piece lengths."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@lru_cache(1)
def _coders(vocabulary: str) -> tuple[units.Remembered, units.Remembered]:
    """Ids of first units and of those behind a space, as bytes; kept by the worker."""
    coder = units.byte_bpe(vocabulary)
    return units.Remembered(units.UnitIds(coder, "")), units.Remembered(units.UnitIds(coder), 800_000)


def _documents(texts: pa.Array, vocabulary: str, end: int) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the end as bytes) of each text."""
    first, later = _coders(vocabulary)
    last = array("I", [end]).tobytes()
    row, coded = 0, []
    for group in units.batches(texts):
        all_ids = later(group.units)
        heads = iter(first([group.units[i] for i in group.bounds[:-1][group.begins].tolist()]))
        for here, begins, low, high in zip(group.rows, group.begins, group.bounds[:-1].tolist(), group.bounds[1:].tolist(), strict=True):
            if here != row:
                yield row, b"".join([*coded, last])
                row, coded = here, []
            if begins:
                coded.append(next(heads))
            coded.append(b"".join(all_ids[low + begins : high]))
    if len(texts):
        yield row, b"".join([*coded, last])


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, tokens: int, end: int, digests: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    seen = np.zeros(tokens + 1, np.int64)
    for batch in batches:
        rows: list[tuple[int, int, int, bytes]] = []
        held = 0
        for at, data in _documents(batch["text"], vocabulary, end):
            total = len(data) // 4
            head = total % tokens or tokens
            for piece, start in enumerate([0, *range(head, total, tokens)]):
                stop = head if piece == 0 else start + tokens
                ids = data[4 * start : 4 * stop]
                rows.append((at, piece, start, stop - start, zlib.crc32(ids) if digests else ids))
            held += len(data)
            if held > 1 << 22:
                yield _pieces(batch["id"], rows, task, seen, digests)
                rows, held = [], 0
        if rows:
            yield _pieces(batch["id"], rows, task, seen, digests)


def _pieces(ids: pa.Array, rows: list[tuple], task: int, seen: np.ndarray, digests: bool) -> pa.RecordBatch:
    length = np.array([r[3] for r in rows], np.int64)
    order = np.argsort(length, kind="stable")
    run = length[order]
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows)) - np.searchsorted(run, run) + seen[run]
    np.add.at(seen, length, 1)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array([r[0] for r in rows])),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array(length),
            pa.array([r[4] for r in rows], pa.int64() if digests else pa.binary()),
            pa.array(np.full(len(rows), task), pa.int32()),
            pa.array(place),
        ],
        ["id", "piece", "start", "length", "ids_crc32" if digests else "ids", "task", "place"],
    )


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end: int = END, digests: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` (unsigned 32-bit,
    little-endian), and the ``task`` and ``place`` that number the pieces of a length.
    With ``digests`` the task that encodes a piece takes the CRC of its ids, and
    ``ids_crc32`` stands in place of ``ids``.

    ``vocabulary`` is the path of a tokenizer's JSON, read on the driver. A null text counts
    as empty: its document is ``end`` alone. Strings of special tokens count as such.
    Written to the shared folder, so the numbers stay as they are.
    """
    with open(vocabulary, encoding="utf-8") as f:
        json = f.read()
    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    content = "ids_crc32 long" if digests else "ids binary"
    schema = f"id {kind}, piece int, start long, length long, {content}, task int, place long"
    return keep_table(rows.mapInArrow(lambda b: _cut(b, json, tokens, end, digests), schema), "pieces")


def _best(residual: np.ndarray, need: np.ndarray, weight: np.ndarray, cap: np.ndarray, rule: str) -> int:
    """The bin class to take ``need``: the one it fills best under every constraint, or -1."""
    fits = np.flatnonzero((residual >= need).all(axis=1))
    if not len(fits):
        return -1
    left, share = (residual[fits] - need) / cap, need / cap
    score = (left * left) @ weight if rule == "norm" else ((residual[fits] / cap) * share) @ weight
    return int(fits[np.argmin(score)])


def _fill(lengths: np.ndarray, counts: np.ndarray, cap: np.ndarray, weight: np.ndarray, rule: str) -> tuple[list[list], list[int]]:
    """(content, number) of the bin classes; content lists (length, pieces of it in a bin)."""
    residual = np.empty((0, 3), np.int64)
    content: list[list] = []
    number: list[int] = []

    def add(rest: np.ndarray, items: list, n: int) -> None:
        nonlocal residual
        if n:
            residual = np.vstack((residual, rest))
            content.append(items)
            number.append(n)

    for length, todo in zip(lengths.tolist(), counts.tolist(), strict=True):
        need = np.array([length, 1, length * length], np.int64)
        while todo:
            at = _best(residual, need, weight, cap.astype(float), rule)
            rest, items, bins = (cap, [], None) if at < 0 else (residual[at].copy(), content[at], number[at])
            per = int((rest // need).min())  # a bin takes as many as fit before the next one is opened
            full = todo // per if bins is None else min(bins, todo // per)
            todo -= full * per
            whole_class = bins is not None and full == bins
            if at >= 0 and not whole_class:
                number[at] -= full
            if whole_class:
                residual[at], content[at] = rest - per * need, [*items, (length, per)]
            else:
                add(rest - per * need, [*items, (length, per)], full)
                if todo:  # fewer than one bin takes
                    if at >= 0:
                        number[at] -= 1
                    add(rest - todo * need, [*items, (length, todo)], 1)
                    todo = 0
                if at >= 0 and not number[at]:
                    residual = np.delete(residual, at, axis=0)
                    del content[at], number[at]
    return content, number


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity = Capacity()) -> tuple[dict[int, np.ndarray], int]:
    """Slots by length, and the number of sequences.

    The slots of a length are rows (first, sequence, per_bin, offset): pieces numbered from
    ``first`` on lie ``per_bin`` to a sequence from ``sequence`` on, in it from ``offset``.
    A piece that fits in no empty sequence raises an error.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, counts, cap = lengths[order].astype(np.int64), counts[order].astype(np.int64), capacity.vector()
    needs = np.stack((lengths, np.ones_like(lengths), lengths * lengths), axis=1)
    if (needs > cap).any():
        raise ValueError("a piece is larger than a sequence")
    demand = (needs * counts[:, None]).sum(axis=0) / cap
    mixes = [demand / max(demand.max(), 1e-9), np.array([1.0, 0.0, 0.0])]
    tried = [_fill(lengths, counts, cap, w, rule) for rule in RULES for w in mixes]
    content, number = min(tried, key=lambda x: sum(x[1]))
    slots: dict[int, list] = {}
    seen: dict[int, int] = {}
    base = 0
    for items, n in zip(content, number, strict=True):
        offset = 0
        for length, per in items:
            slots.setdefault(length, []).append((seen.get(length, 0), base, per, offset))
            seen[length] = seen.get(length, 0) + n * per
            offset += length * per
        base += n
    return {k: np.array(v, np.int64) for k, v in slots.items()}, base


def _placed(batches: Iterator[pa.RecordBatch], slots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["__rank"].to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            table = slots[int(n)]
            slot = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
            step = rank[rows] - slot[:, 0]
            sequence[rows] = slot[:, 1] + step // slot[:, 2]
            offset[rows] = slot[:, 3] + step % slot[:, 2] * n
        keep = batch.drop_columns(["__rank"])
        yield keep.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The rows of ``cut`` (any of its columns, or more) with ``sequence_id`` and ``offset``
    in place of ``task`` and ``place``.

    Offsets of a sequence start at 0 and leave no gap. Repeated rows are pieces of their
    own; an empty table gives an empty one. Columns called ``sequence_id``, ``offset`` or
    ``__rank`` raise an error.
    """
    if clash := {"sequence_id", "offset", "__rank"} & set(pieces.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    counts = keep_table(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most one row for each length a sequence can hold
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    slots, _ = solve(by_length["length"].to_numpy(), by_length["n"].to_numpy(), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("length").alias("__l"), F.col("task").alias("__t"), F.coalesce(before, F.lit(0)).alias("__before"))
    names = [c for c in pieces.columns if c not in ("task", "place")]
    ranked = pieces.join(starts, (F.col("length") == F.col("__l")) & (F.col("task") == F.col("__t"))).select(
        *names, (F.col("__before") + F.col("place")).alias("__rank")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema.fields)
    return ranked.mapInArrow(lambda b: _placed(b, slots), f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per sequence: ``sequence_id``, ``length``, its pieces (id, piece, start,
    length, offset) in order, and their ``ids`` joined: what a trainer reads. A sequence is
    bounded by its capacity, so gathering its pieces is too."""
    member = F.struct("offset", F.col(id_col).alias("id"), "piece", "start", "length", "ids")
    out = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    ids = F.aggregate("m", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    spans = F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset")))
    return out.select("sequence_id", F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), spans.alias("pieces"), ids.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), end: int = END) -> DataFrame:
    """``cut`` and ``pack`` with the digest of each piece instead of its ids: one row per
    piece with id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = cut(docs, vocabulary, id_col, text_col, capacity.tokens, end, digests=True)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
