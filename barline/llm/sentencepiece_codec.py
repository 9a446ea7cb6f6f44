"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives the pieces; its vocabulary is never trained here. A unigram model
brings log scores. A merge (BPE) model brings only the order of its pieces; they get the
log scores of Zipf's law over that order, which is what frequencies of ranked pieces
follow. Characters without a piece cost ten less than the worst piece and come out as
bytes (``<0xNN>``). The space is written as the marker U+2581 and one is put before the
text; decoding takes them back. A literal U+2581 in a text therefore decodes as a space.

When no piece has the marker behind another character, the best path never crosses a cut
before a run of markers, so a text is a sequence of units (markers and what follows up to
the next marker) that are solved alone. A task solves each distinct unit once, all new
units of a slice of texts together: the trie is walked from every character in step, then
one numpy step per end offset takes the best predecessor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.common import whole

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Units that a task remembers before it starts anew, and texts that are solved together.
REMEMBERED, SLICE = 400_000, 200
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class DoubleArray:
    """Trie over bytes: the child of node s by byte c is ``base[s] + c`` if its ``check`` is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        self._free, self._open = 257, 1
        level = [(0, 0, 0, len(order))]  # node, depth, range of keys below it
        while level:
            below = []
            for node, depth, lo, hi in level:
                if lo < hi and len(keys[order[lo]]) == depth:
                    self.value[node] = values[order[lo]]
                    lo += 1
                kids: dict[int, list[int]] = {}
                for i in range(lo, hi):
                    kids.setdefault(keys[order[i]][depth], [i, i])[1] = i + 1
                if not kids:
                    continue
                at = self._place(np.array(sorted(kids)))
                self.base[node] = at
                for c, (i, j) in kids.items():
                    self.check[at + c] = node
                    below.append((at + c, depth + 1, i, j))
            level = below

    def _place(self, labels: np.ndarray) -> int:
        """A base at which all children's slots are free. An only child takes the first free
        slot; more children are tried near the end and then behind all that is taken."""
        if self._open + 600 > len(self.check):
            grow = len(self.check)
            self.base = np.concatenate((self.base, np.zeros(grow, np.int32)))
            self.check = np.concatenate((self.check, np.full(grow, -1, np.int32)))
            self.value = np.concatenate((self.value, np.full(grow, -1, np.int32)))
        while self.check[self._free] >= 0:
            self._free += 1
        low, high = int(labels[0]), int(labels[-1])
        at = max(1, self._free - low)
        if len(labels) > 1:
            tries = np.arange(max(1, self._open - 8192), self._open + 1)
            fits = (self.check[tries[:, None] + labels] < 0).all(axis=1)
            at = int(tries[fits.argmax()]) if fits.any() else self._open
        elif self.check[at + low] >= 0:
            at = self._open
        self._open = max(self._open, at + high + 1)
        return at

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into starts, length, value) of every key found at a start before its end."""
        who, node, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(who):
            inside = starts[who] + depth < ends[who]
            who, node = who[inside], node[inside]
            child = self.base[node] + data[starts[who] + depth].astype(np.int64)
            ok = (self.check[child] == node) & (child != 0)
            who, node, depth = who[ok], child[ok], depth + 1
            value = self.value[node]
            hit = value >= 0
            found.append((who[hit], np.full(int(hit.sum()), depth), value[hit].astype(np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b, c


@dataclass
class Codec:
    """Pieces by id, their log scores and kinds, and the trie of the normal ones."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    add_prefix: bool = True
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        normal = np.flatnonzero(self.kinds == NORMAL)
        self.trie = DoubleArray([self.pieces[i].encode() for i in normal], normal.tolist())
        self.unknown = float(self.scores[normal].min(initial=0.0)) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.unk_id = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else 0
        self.fallback = bool((self.byte_ids >= 0).all())
        self.cuts = not any(MARK in self.pieces[i].lstrip(MARK) for i in normal)
        plain = {i: self.pieces[i].replace(MARK, " ").encode() for i in normal}
        plain |= {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        self.surface = [plain.get(i, b"") for i in range(len(self.pieces))]
        if not self.fallback:
            self.surface[self.unk_id] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        """Read a model file (on the driver; tasks get the codec by broadcast)."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        scores = np.array([p.score for p in model.pieces], np.float64)
        kinds = np.array([p.type for p in model.pieces])
        if model.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            scores = zipf_scores(scores, kinds)
        return cls([p.piece for p in model.pieces], scores, kinds, model.normalizer_spec.add_dummy_prefix)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        text = " " + text if self.add_prefix else text
        return re.findall(r" +[^ ]*|[^ ]+", text) if self.cuts else [text]

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all units, number per unit): the best path of each."""
        raw = [u.replace(" ", MARK).encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        first = ends - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        unit = np.searchsorted(ends, starts, side="right")
        width = np.diff(np.r_[starts, len(data)])
        who, length, piece = self.trie.matches(data, starts, ends[unit])
        single = np.zeros(len(starts), bool)
        single[who[length == width[who]]] = True
        bare = np.flatnonzero(~single)  # characters without a piece of their own
        who, length = np.r_[who, bare], np.r_[length, width[bare]]
        piece, score = np.r_[piece, np.full(len(bare), -1)], np.r_[self.scores[piece], np.full(len(bare), self.unknown)]
        start, stop = starts[who], starts[who] + length
        offset = stop - first[unit[who]]
        order = np.lexsort((start, stop, offset))  # of equal paths, the longest last piece
        start, stop, piece, score, offset = start[order], stop[order], piece[order], score[order], offset[order]
        # best score of a path up to each byte; a unit's own start is its first byte's place
        best = np.full(len(data) + 1, -np.inf)
        best_in = np.zeros(len(data), np.int64)  # by last byte: the edge that the best path ends with
        lead = np.zeros(len(data) + 1, bool)
        lead[first] = True
        edges = np.searchsorted(offset, np.unique(offset))
        for lo, hi in zip(edges, np.r_[edges[1:], len(offset)], strict=True):
            s, e = start[lo:hi], stop[lo:hi]
            total = np.where(lead[s], 0.0, best[s]) + score[lo:hi]
            heads = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            top = np.maximum.reduceat(total, heads)
            run = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, hi - lo]))
            hit = np.flatnonzero(total == top[run])
            pick = hit[np.r_[True, run[hit][1:] != run[hit][:-1]]]
            at = e[heads]
            best_in[at - 1] = lo + pick
            # a unit's end is the next one's start and is only read through lead there
            best[at] = top
        return self._paths(units, data, first, ends, best_in, start, stop, piece)

    def _paths(self, units, data, first, ends, best_in, start, stop, piece) -> tuple[np.ndarray, np.ndarray]:
        who, at = np.arange(len(units)), ends.copy()
        steps = []  # (unit, edge), from the end of each unit backwards
        while len(who):
            edge = best_in[at - 1]
            steps.append((who, edge))
            at = start[edge]
            going = at > first[who]
            who, at = who[going], at[going]
        if not steps:
            return np.empty(0, np.int64), np.zeros(len(units), np.int64)
        unit = np.concatenate([w for w, _ in steps])
        edge = np.concatenate([e for _, e in steps])
        order = np.lexsort((start[edge], unit))
        unit, edge = unit[order], edge[order]
        ids, counts = piece[edge], np.ones(len(edge), np.int64)
        lost = ids < 0
        if lost.any():
            if self.fallback:
                counts[lost] = (stop - start)[edge[lost]]
                where = np.repeat(np.arange(len(edge)), counts)
                within = np.arange(len(where)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids = np.where(lost[where], self.byte_ids[data[start[edge[where]] + within]], ids[where])
            else:
                ids = np.where(lost, self.unk_id, ids)
        return ids, np.bincount(unit, counts, len(units)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


def zipf_scores(order: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Log frequencies by Zipf's law of the normal pieces, ranked by falling ``order``."""
    out = np.zeros(len(order))
    normal = np.flatnonzero(kinds == NORMAL)
    ranked = normal[np.argsort(-order[normal], kind="stable")]
    share = 1 / np.arange(1, len(ranked) + 1)
    out[ranked] = np.log(share / share.sum())
    return out


class Encoder:
    """Encodes texts with one codec, remembering the units it has solved."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.codec.units(t or "") for t in texts]
        seen = set().union(*split)
        new = sorted(seen - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = sorted(seen)
        if new:
            ids, counts = self.codec.solve(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        out = []
        for units in split:
            at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            counts = self.counts[at]
            shift = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
            out.append(self.ids[shift + np.arange(len(shift))])
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, ``n_pieces``, ``n_byte_pieces``, ``pieces`` (ids in order), ``round_trip`` (the
    decoded pieces are the text) of each row.

    Null and empty texts have no pieces; a null counts as empty. Rows are independent, so
    repeated rows agree and an empty table stays empty. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        encoder, is_byte = Encoder(codec), codec.kinds == BYTE
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part["text"].to_pylist()
                coded = encoder(texts)
                counts = np.fromiter(map(len, coded), np.int64, len(coded))
                flat = np.concatenate(coded)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array(counts),
                        pa.array([int(is_byte[x].sum()) for x in coded], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32())),
                        pa.array([codec.decode(x.tolist()) == t for x, t in zip(coded, texts, strict=True)], pa.bool_()),
                    ],
                    ["id", "n_pieces", "n_byte_pieces", "pieces", "round_trip"],
                )

    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_pieces long, n_byte_pieces long, pieces array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """id and ``text`` of each row of piece ids; null pieces give a null text. Ids outside
    the vocabulary raise an error."""
    shared = coded.sparkSession.sparkContext.broadcast(Codec.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])

    rows = coded.select(coded[id_col].alias("id"), coded[pieces_col].alias("pieces"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
