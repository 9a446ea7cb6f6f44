"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent.

A word's features are the word and the byte n-grams of ``<word>``; a document also has
those of its pairs of neighbouring words, where all pairs of equal words are one feature.
Each is hashed to a row of one embedding table. A document is the mean of the rows of all
its features, and a softmax over two classes follows. Training runs in numpy on a bounded sample of labelled rows (at
most ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters, the first by hash of
their id). Scoring reads every whole text: since the output is linear in the mean, each
feature's row is reduced to one number beforehand and a word and a pair cost one look-up each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barline.llm.common import hash60, whole

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (3, 4, 5)
SAMPLE, SAMPLE_CHARS = 2000, 50_000
EPOCHS, RATE = 5, 0.5
THRESHOLD = 0.3
#: Words whose sums a task remembers before it starts anew.
REMEMBERED = 400_000
U = np.uint64


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, number of the word that each belongs to)."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(U)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes to the end of the word
    hashes = [word_hashes(words)]
    owners = [np.arange(len(words))]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, U)
        for j in range(n):
            h = (h ^ data[at + j]) * U(0x100000001B3)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        hashes.append(h ^ (h >> U(32)))
        owners.append(owner[at])
    return (np.concatenate(hashes) % U(BUCKETS)).astype(np.int64), np.concatenate(owners)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), U, len(words))


def pair_rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of the pairs of neighbouring words, given their hashes; row 0 if both are equal."""
    a, b = hashes[:-1], hashes[1:]
    h = (a * U(0x9E3779B97F4A7C15)) ^ (b + U(0x7F4A7C15))
    return np.where(a == b, U(0), (h ^ (h >> U(31))) % U(BUCKETS)).astype(np.int64)


def all_features(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.concatenate((features(words)[0], pair_rows(word_hashes(words))))


@dataclass
class Model:
    """``per_row``: how much each feature adds to the log odds of class 1, before the mean."""

    per_row: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Plain SGD, one document a step, with a linearly falling rate. Without labels every
    score is 0.5."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for text in texts:
        rows, counts = np.unique(all_features(text), return_counts=True)
        docs.append((rows, (counts / max(1, counts.sum())).astype(np.float32)))
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, share = docs[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ table[rows] if len(rows) else np.zeros(DIM, np.float32)
            score = mean @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the loss by the scores
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            if len(rows):
                # the mean's gradient is spread evenly over its features, not by their share
                table[rows] -= now * np.outer(share * min(len(rows), 200), back)
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Scores of texts; remembers the sums of words, which depend on nothing else."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.sums, self.counts, self.hashes = np.empty(0), np.empty(0, np.int64), np.empty(0, U)

    def _learn(self, words: list[bytes]) -> None:
        rows, owner = features(words)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.sums = np.concatenate((self.sums, np.bincount(owner, self.model.per_row[rows], len(words))))
        self.counts = np.concatenate((self.counts, np.bincount(owner, minlength=len(words))))
        self.hashes = np.concatenate((self.hashes, word_hashes(words)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").encode().split() for t in texts]
        new = sorted(set().union(*split) - self.at.keys())
        if len(self.at) + len(new) > REMEMBERED:
            self.__init__(self.model)
            new = sorted(set().union(*split))
        self._learn(new)
        odds = np.full(len(texts), self.model.bias)
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                pairs = self.model.per_row[pair_rows(self.hashes[at])]
                odds[i] += (self.sums[at].sum() + pairs.sum()) / (self.counts[at].sum() + len(pairs))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model of ``labels`` (doc_id, quality); rows held out, or with a null label, are not
    used, and of several labels of a document the highest counts."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.select(docs[id_col].alias("doc_id"), whole(docs[text_col]).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    # twice the sample, as some labelled documents are absent or too long; at most 2 * sample short rows
    few = known.orderBy(hash60("quality", F.col("doc_id")), "doc_id").limit(2 * sample)
    rows = texts.join(F.broadcast(few), "doc_id").orderBy(hash60("quality", F.col("doc_id")), "doc_id").limit(sample).collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added (replacing a column of that name).

    Null and empty texts have the score of the bias alone. Rows are scored one by one, so
    repeated rows agree and an empty table stays empty."""
    keep = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = scorer(part.column(keep.index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*keep, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = rows.withColumn(name, F.lit(0.0).cast("double")).schema
    for field in schema.fields:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted`` of each row; a null id is not held out."""
    model = fit(docs, labels, id_col, text_col)
    rows = with_scores(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), model)
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, all columns as they were."""
    score = "__quality_score"
    return with_scores(docs, fit(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) >= THRESHOLD).drop(score)
