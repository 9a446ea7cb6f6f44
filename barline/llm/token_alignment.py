"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

A text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Byte offsets at
which tokens of both end cut it into groups; every A and B token of a group are linked. An
id pair's count is the number of documents that hold it linked.

Counting is external and by runs:

1. ``_align`` takes documents in blocks. Each distinct pair of a document is one record.
   When a block is full its records are sorted A-side major and cut by the radix of the A
   id into zstd runs: a head (pairs and how many documents of the block have each) and a
   body (those documents and how often each has the pair).
2. ``_merge`` counts: a k-way heap merge over the heads of a radix, one A id at a time,
   at most ``FAN_IN`` runs to a task and as many levels as it takes. A head holds a
   block's counts, so a pair that every document has costs one record per block. All pairs
   of an A id come together, which gives its highest count at once.
3. ``_contribute`` streams back: the runs of a radix, again at most ``FAN_IN`` to a task,
   look up their pairs and add count and highest to the documents of their block; one row
   of sums per block and radix.
4. The sums of a block meet its documents.

No group grows with the data: runs are bounded by the block size, merged counts by the
two vocabularies, and a hot pair or A id is spread over its blocks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import units
from barline.llm.common import drop_tables, keep_table, whole

RADIXES = 32
FAN_IN = 64
#: A block is full at so many records or documents.
BLOCK_RECORDS, BLOCK_DOCS = 1_000_000, 50_000
#: Units learnt at a time, and cells of a group's outer product made at a time.
LEARNT, CELLS = 8192, 1 << 20
_BITS = 24  # of an id inside a key
_LOW = (1 << _BITS) - 1


def radix_of(a: np.ndarray) -> np.ndarray:
    """Spreads neighbouring ids; all pairs of an A id share a radix."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) % RADIXES


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def byte_level(token: str) -> bytes:
    """The bytes that the characters of a byte-level token stand for: printable ones for
    themselves, the others, in order, for the code points from 256 on."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_table() -> dict[str, int]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTE_OF = _byte_table()


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def group_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of every A and B token, and the number of groups; both ends reach the same byte."""
    shared = np.intersect1d(ends_a, ends_b)
    return np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), len(shared)


def linked_pairs(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, unit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked id pairs of each unit (A id above B id in one key), how many links
    each has, and its unit; ``unit`` is the unit of each group.

    A group's repeated ids are counted before they are paired, and large groups are paired
    in slices, so memory follows the distinct pairs."""
    na, nb = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    small = na * nb <= 64
    keep = small[group_a]
    rows, times = np.flatnonzero(keep), nb[group_a[keep]]
    start_b = np.cumsum(nb) - nb
    shift = np.repeat(start_b[group_a[rows]] - (np.cumsum(times) - times), times)
    key = np.repeat(a[rows] << _BITS, times) | b[shift + np.arange(len(shift))]
    of = np.repeat(unit[group_a[rows]], times)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.empty(0, np.int64)
    keys, of, counts = key[first], of[first], np.diff(np.r_[first, len(key)])
    start_a = np.cumsum(na) - na
    for g in np.flatnonzero(~small):
        mine = of == unit[g]
        some, n = keys[mine], counts[mine]
        ua, ca = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        step = max(1, CELLS // len(ub))
        for at in range(0, len(ua), step):
            more = ((ua[at : at + step] << _BITS)[:, None] | ub).ravel()
            some, n = summed(np.r_[some, more], np.r_[n, (ca[at : at + step][:, None] * cb).ravel()])
        low = int(np.searchsorted(of, unit[g]))
        high = low + int(mine.sum())
        keys, counts = np.r_[keys[:low], some, keys[high:]], np.r_[counts[:low], n, counts[high:]]
        of = np.r_[of[:low], np.full(len(some), unit[g]), of[high:]]
    return keys, counts, of


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values added up by key, in order of keys."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def one_by_one(whole: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The stretches of an array between bounds."""
    return (whole[low:high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


class Aligner:
    """Aligned units, remembered: numbers, the group string and the linked pairs of each."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece

        self.a = units.byte_bpe(vocabulary, specials_are_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.a.get_vocab_size()
        self.bytes_a = [byte_level(t) if set(t) <= _BYTE_OF.keys() else t.encode() for t in map(self.a.id_to_token, range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model cross white space, so texts cannot be cut into units")
        self.bytes_b = [piece_bytes(p) for p in pieces]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # names of ids with what follows them: A inside, A last, B inside, B last
        self.names = [f"{i}{end}" for end, n in ((",", size), ("|", size), (",", len(pieces)), (";", len(pieces))) for i in range(n)]
        self.spaced = units.UnitIds(self.a)
        self.learn = units.Remembered(self._learn)

    def __call__(self, parts: list[str]) -> list:
        """(numbers, group string, pairs, links) of units, each of which stands behind a
        space; False where the tokens of a unit are not its bytes."""
        return self.learn(parts)

    def _learn(self, new: list[str]) -> list:
        return [x for at in range(0, len(new), LEARNT) for x in self._learn_some(new[at : at + LEARNT])]

    def _learn_some(self, new: list[str]) -> list:
        coded_a = [np.frombuffer(x, "<u4").tolist() for x in self.spaced(new)]
        coded_b = self.b.encode(new, num_threads=1)
        raw = [b" " + u.encode() for u in new]
        spelt = [[b"".join(map(table.__getitem__, x)) for x in coded] for table, coded in ((self.bytes_a, coded_a), (self.bytes_b, coded_b))]
        if spelt[0] == raw == spelt[1]:
            return self._align(coded_a, coded_b)
        kept = [i for i, x in enumerate(zip(raw, *spelt, strict=True)) if x[0] == x[1] == x[2]]
        out: list = [False] * len(new)
        for i, x in zip(kept, self._align([coded_a[i] for i in kept], [coded_b[i] for i in kept]), strict=True):
            out[i] = x
        return out

    def _align(self, coded_a: list[list[int]], coded_b: list[list[int]]) -> list[tuple]:
        """All units at once, as if they were one text: units begin and end with groups."""
        n = len(coded_a)
        if not n:
            return []
        na, nb = (np.fromiter(map(len, x), np.int64, n) for x in (coded_a, coded_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (coded_a, coded_b))
        ga, gb, n_groups = group_cuts(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        last_a, last_b = np.r_[ga[1:] != ga[:-1], True], np.r_[gb[1:] != gb[:-1], True]
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        words = np.r_[a + size_a * last_a, 2 * size_a + b + size_b * last_b]
        order = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable")
        text = list(map(self.names.__getitem__, words[order].tolist()))
        ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
        bounds = np.r_[0, ends_a + ends_b].tolist()
        first_group = np.r_[0, ga[ends_a - 1] + 1]
        unit = np.repeat(np.arange(n), np.diff(first_group))
        keys, counts, of = linked_pairs(a, b, ga, gb, n_groups, unit)
        at = np.searchsorted(of, np.arange(n + 1))
        numbers = np.stack((na, nb, np.diff(first_group), np.add.reduceat(np.r_[counts, 0], at[:-1])), axis=1)
        names = ["".join(text[low:high])[:-1].encode() for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
        return list(zip((x.tobytes() for x in numbers), names, (x.tobytes() for x in one_by_one(keys, at)), (x.tobytes() for x in one_by_one(counts, at)), strict=True))


@lru_cache(1)
def _aligner(vocabulary: str, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


class _Block:
    """Documents and records until they are written as runs."""

    def __init__(self):
        self.ids: list = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.digests: list = []  # hashes, at first
        self.bad: set[int] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.records = 0

    def add(self, group: units.Group, place: np.ndarray, known: list, ids: pa.Array) -> None:
        """Takes the stretches of a group, of which the first may go on with the last document.
        A unit whose tokens are not its bytes takes the tokens of its document away."""
        failed = np.fromiter((x is False for x in known), bool, len(known))
        known = [(bytes(32), b"", b"", b"") if x is False else x for x in known]
        owner = len(self.ids) - 1 + np.cumsum(group.begins)
        self.ids += ids.take(pa.array(np.array(group.rows)[group.begins])).to_pylist()
        low = group.bounds[:-1]
        totals = np.add.reduceat(np.frombuffer(b"".join([x[0] for x in known]), np.int64).reshape(-1, 4)[place], low)
        self.numbers = np.r_[self.numbers, np.zeros((len(self.ids) - len(self.numbers), 4), np.int64)]
        np.add.at(self.numbers, owner, totals)
        self.bad.update(owner[np.add.reduceat(failed[place].astype(np.int64), low) > 0].tolist())
        texts = list(map([x[1] for x in known].__getitem__, place.tolist()))
        for begins, start, stop in zip(group.begins, low.tolist(), group.bounds[1:].tolist(), strict=True):
            text = b";".join(texts[start:stop])
            if begins:
                self.digests.append(hashlib.sha256(text))
            else:
                self.digests[-1].update(b";" + text)
        # each distinct unit of a document once, with its number there
        own = np.repeat(owner, np.diff(group.bounds)) * len(known) + place
        own, times = np.unique(own, return_counts=True)
        doc, at = own // len(known), own % len(known)
        keys, links = (np.frombuffer(b"".join([x[k] for x in known]), np.int64) for k in (2, 3))
        sizes = np.fromiter((len(x[2]) // 8 for x in known), np.int64, len(known))
        n = sizes[at]
        shift = np.repeat(np.cumsum(sizes)[at] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if len(shift):
            self.parts.append((np.repeat(doc, n), keys[shift], links[shift] * np.repeat(times, n)))
            self.records += len(shift)

    def full(self) -> bool:
        return self.records >= BLOCK_RECORDS or len(self.ids) >= BLOCK_DOCS

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Radix, pair, document and links of the distinct (pair, document), side-major."""
        doc, key, links = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64),) * 3
        if self.bad:
            good = ~np.isin(doc, list(self.bad))
            doc, key, links = doc[good], key[good], links[good]
        radix = radix_of(key >> _BITS)
        order = np.lexsort((doc, key, radix))
        radix, doc, key, links = radix[order], doc[order], key[order], links[order]
        if len(key):
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            radix, key, doc, links = radix[first], key[first], doc[first], np.add.reduceat(links, first)
        self.parts = [(doc, key, links)] if len(key) else []
        self.records = len(key)
        return radix, key, doc, links


_SCHEMA = (
    "block long, at int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "radix int, head binary, body binary"
)


def _align(batches: Iterator[pa.RecordBatch], vocabulary: str, model: bytes) -> Iterator[pa.RecordBatch]:
    aligner, block = _aligner(vocabulary, model), _Block()
    next_block = TaskContext.get().partitionId() << 32
    id_kind = None
    for batch in batches:
        id_kind = batch["id"].type
        for group in units.batches(batch["text"]):
            if group.begins[0] and block.full():
                block.compact()
                if block.full():
                    yield from _runs(block, next_block, id_kind)
                    block, next_block = _Block(), next_block + 1
            distinct, at = group.coded()
            block.add(group, at, aligner(distinct), batch["id"])
    if block.ids:
        yield from _runs(block, next_block, id_kind)


def _runs(block: _Block, name: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    n = len(block.ids)
    radix, key, doc, links = block.compact()
    bad = list(block.bad)
    block.numbers[bad] = 0
    digests = [x.hexdigest() for x in block.digests]
    for i in bad:
        digests[i] = ""
    no = lambda kind, size: pa.nulls(size, kind)
    names = ["block", "at", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "head", "body"]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, name)), pa.array(np.arange(n), pa.int32()), pa.array(block.ids, id_kind),
            *[pa.array(block.numbers[:, k].copy()) for k in range(4)], pa.array(digests, pa.string()),
            no(pa.int32(), n), no(pa.binary(), n), no(pa.binary(), n),
        ],
        names,
    )
    for r in np.unique(radix):
        part = slice(*np.searchsorted(radix, [r, r + 1]))
        pairs, counts = np.unique(key[part], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.int64()), no(pa.int32(), 1), no(id_kind, 1), *[no(pa.int64(), 1)] * 4, no(pa.string(), 1),
                pa.array([r], pa.int32()),
                pa.array([packed(np.r_[np.diff(pairs, prepend=0), counts])], pa.binary()),
                pa.array([packed(np.r_[doc[part], links[part]])], pa.binary()),
            ],
            names,
        )


def read_head(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order and the documents that have each."""
    step, counts = np.split(unpacked(data, np.int64), 2)
    return np.cumsum(step), counts


def merge_runs(heads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of each A id, in order: a heap of runs by the A id they stand at."""
    runs = []
    for data in heads:
        pairs, counts = read_head(data)
        side = pairs >> _BITS
        first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(side) else np.empty(0, np.int64)
        runs.append((pairs, counts, side[first].tolist(), np.r_[first, len(side)].tolist()))
    heap = [(run[2][0], k, 0) for k, run in enumerate(runs) if run[2]]
    heapq.heapify(heap)
    while heap:
        side, found = heap[0][0], []
        while heap and heap[0][0] == side:
            _, k, at = heap[0]
            pairs, counts, sides, first = runs[k]
            found.append((pairs[first[at] : first[at + 1]], counts[first[at] : first[at + 1]]))
            if at + 1 < len(sides):
                heapq.heapreplace(heap, (sides[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        yield found[0] if len(found) == 1 else summed(np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]))


def _merge(table: pa.Table) -> pa.Table:
    merged = list(merge_runs(table["head"].to_pylist()))
    pairs, counts = np.concatenate([p for p, _ in merged]), np.concatenate([c for _, c in merged])
    highest = np.concatenate([np.full(len(c), c.max()) for _, c in merged])
    return pa.table(
        {
            "radix": pa.array([table["radix"][0].as_py()], pa.int32()),
            "part": pa.array([table["part"][0].as_py()], pa.int64()),
            "head": pa.array([packed(np.r_[np.diff(pairs, prepend=0), counts])], pa.binary()),
            "highest": pa.array([packed(highest)], pa.binary()),
        }
    )


def _contribute(runs: pa.Table, counted: pa.Table) -> pa.Table:
    blocks, sums = [], []
    if len(runs):
        known, counts = read_head(counted["head"][0].as_py())
        highest = unpacked(counted["highest"][0].as_py(), np.int64)
        for k in range(len(runs)):
            pairs, holders = read_head(runs["head"][k].as_py())
            doc, links = np.split(unpacked(runs["body"][k].as_py(), np.int64), 2)
            at = np.searchsorted(known, pairs)
            count, best = np.repeat(counts[at], holders), np.repeat(counts[at] == highest[at], holders)
            docs, back = np.unique(doc, return_inverse=True)
            n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(n_best, back, links * best)
            np.add.at(count_sum, back, links * count)
            blocks.append(runs["block"][k].as_py())
            sums.append(packed(np.r_[docs, n_best, count_sum]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(sums, pa.binary())})


def _finish(docs: pa.Table, sums: pa.Table) -> pa.Table:
    if not len(docs):
        return docs.drop_columns(["block", "at"]).append_column("n_best", pa.array([], pa.int64())).append_column("count_sum", pa.array([], pa.int64()))
    at = docs["at"].to_numpy()
    total = np.zeros((2, int(at.max()) + 1), np.int64)
    for data in sums["sums"].to_pylist():
        rows, n_best, count_sum = np.split(unpacked(data, np.int64), 3)
        total[0, rows] += n_best
        total[1, rows] += count_sum
    out = docs.drop_columns(["block", "at"])
    return out.append_column("n_best", pa.array(total[0, at])).append_column("count_sum", pa.array(total[1, at]))


def count_pairs(runs: DataFrame, n_blocks: int) -> DataFrame:
    """One row per radix: its pairs and counts (``head``) and their A id's highest count."""
    merged, parts = runs, n_blocks
    while True:
        parts = max(1, -(-parts // FAN_IN))
        by = F.pmod(F.xxhash64(F.col("block") if merged is runs else F.col("part")), F.lit(parts))
        merged = merged.select("radix", by.alias("part"), "head").groupBy("radix", "part").applyInArrow(_merge, "radix int, part long, head binary, highest binary")
        if parts <= 1:
            return merged.drop("part")


def align(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pair counts by radix).

    Documents: one row per row with id, ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links``, ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``), ``n_best`` (links whose count
    is the highest of their A id, ties included) and ``count_sum``. ``pair_counts`` reads
    the second as rows.

    Texts that are null, empty or not what their tokens spell (behind a space) have no
    tokens: zeros and an empty digest. Repeated rows are documents of their own, an empty
    table gives empty ones, other columns are ignored. Vocabulary and model are paths that
    the driver reads.
    """
    with open(vocabulary, encoding="utf-8") as f:
        json = f.read()
    with open(model, "rb") as f:
        proto = f.read()
    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    schema = _SCHEMA.format(kind=rows.schema["id"].dataType.simpleString())
    kept = keep_table(rows.mapInArrow(lambda b: _align(b, json, proto), schema), "aligned")
    runs = kept.filter("radix IS NOT NULL").select("block", "radix", "head", "body")
    n_blocks = runs.agg(F.count_distinct("block")).collect()[0][0]
    counted = keep_table(count_pairs(runs.drop("body"), n_blocks), "pair-counts")
    salts = max(1, -(-n_blocks // FAN_IN))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    copies = counted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    sums = salted.groupBy("radix", "salt").cogroup(copies.groupBy("radix", "salt")).applyInArrow(_contribute, "block long, sums binary")
    facts = kept.filter("radix IS NULL").select("block", "at", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema.fields[2:])
    out = facts.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_finish, f"{schema}, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col), counted


def pair_counts(counted: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, is_best) rows of the counts that ``align`` returns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, high in zip(batch["head"].to_pylist(), batch["highest"].to_pylist(), strict=True):
                pairs, counts = read_head(head)
                best = counts == unpacked(high, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs >> _BITS), pa.array(pairs & _LOW), pa.array(counts), pa.array(best)], ["a_id", "b_id", "n_docs", "is_best"]
                )

    return counted.select("head", "highest").mapInArrow(rows, "a_id long, b_id long, n_docs long, is_best boolean")
