"""Personal data: patterns, and a skip-chain conditional random field over their tokens.

The patterns give the base spans (email, ip, card, phone), exactly as documented in
``base_spans``. The field then labels every token of a text that has a digit or an at sign
(all other tokens are fixed as outside) and adds what the patterns miss:

* unary potentials: a softmax over hashed features of the token and its neighbours;
* chain edges between such tokens that only white space parts;
* skip edges between tokens of a document that are equal or have the same last digits,
  however far apart; m similar tokens are joined in order by m - 1 edges, which carry a
  label from any of them to all others.

Weights are learned on a bounded sample of documents (at most ``SAMPLE``, of at most
``SAMPLE_CHARS`` characters, by hash of their id) whose labels are the base spans: the
softmax by stochastic gradient descent, edge potentials as smoothed log ratios of label
pairs. Loopy sum-product messages run over all tokens of a slice of documents at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from barline.llm.common import hash60, whole

KINDS = ("email", "ip", "card", "phone")
N = len(KINDS) + 1  # label 0 is outside
SAMPLE, SAMPLE_CHARS = 2000, 50_000
BUCKETS = 1 << 14
ROUNDS, DAMPING = 8, 0.3
#: Belief from which a token outside all base spans is added.
SURE = 0.9
BASE_WEIGHT = 6.0
MIN_SHARED_DIGITS = 4
#: An added span other than an email has so many digits at least, so no lone prefix is one.
MIN_ADDED_DIGITS = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_EDGES = ".,;:!?#$%&*|\"'[]{}<>=/\\"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (p := text.find("@", at)) >= 0:
        at, start = p + 1, p
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            yield start, m.end()
            done = at = m.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans by start, then kind: leftmost non-overlapping matches per kind in linear time;
    ip parts are at most 255, cards have 14 to 19 digits and pass Luhn, phones have 10 to
    15 digits; a match that fails is dropped and the search goes on behind it."""
    out: list[Span] = []
    if not _MARKED.search(text):
        return out
    out += [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the white-space tokens with a digit or at sign, without the marks
    around them; linear in the text."""
    out, done = [], 0
    hit = _MARKED.search(text)
    while hit:
        start = max(done, *(text.rfind(c, done, hit.start()) + 1 for c in " \n\t\r\x0b\x0c"))
        gap = _SPACE.search(text, hit.end())
        end = done = gap.start() if gap else len(text)
        word = text[start:end]
        left = len(word) - len(word.lstrip(_EDGES))
        out.append((start + left, start + len(word.rstrip(_EDGES))))
        hit = _MARKED.search(text, end)
    return out


def _shape(word: str) -> str:
    return _RUN.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0][0] in "0123456789" else "a", word)[:40]


def token_features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows of hashed feature numbers, one row per token."""
    words = [text[s:e] for s, e in spans]
    shapes = [_shape(w[:200]) for w in words]
    rows = []
    for i, ((s, e), word) in enumerate(zip(spans, words, strict=True)):
        digits = re.sub(r"[^0-9]", "", word)
        before, after = text[max(0, s - 24) : s].split(), text[e : e + 24].split()
        near = lambda j, gap: shapes[j] if 0 <= j < len(shapes) and not gap.strip() else ""
        parts = word.split(".")
        values = (
            shapes[i],
            str(min(len(digits), 25)),
            f"{min(len(word), 40) // 2}{'@' in word}",
            f"{min(word.count('.'), 6)}{'@' in word}{word[:1].isalpha()}",
            f"{word[:1] if not word[:1].isalnum() else ''}~{word[-1:] if not word[-1:].isalnum() else ''}",
            _RUN.sub(lambda m: m[0].lower(), before[-1])[:20] if before else "",
            after[0][:20].lower() if after else "",
            near(i - 1, text[spans[i - 1][1] : s]) if i else "",
            near(i + 1, text[e : spans[i + 1][0]]) if i + 1 < len(spans) else "",
            str(14 <= len(digits) <= 19 and len(digits) == len(word) and luhn(digits)),
            str(len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)),
            "",
        )
        rows.append([xxh32_intdigest(f"{k}={v}".encode("utf-8", "replace")) % BUCKETS for k, v in enumerate(values)])
    return np.array(rows, np.int64).reshape(len(spans), -1)


def edges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, token, 0 for a chain edge or 1 for a skip edge)."""
    out = [(i, i + 1, 0) for i in range(len(spans) - 1) if not text[spans[i][1] : spans[i + 1][0]].strip()]
    last: dict[str, int] = {}
    for i, (s, e) in enumerate(spans):
        word = text[s:e].lower()
        digits = re.sub(r"[^0-9]", "", word)
        similar = word if "@" in word or len(digits) < MIN_SHARED_DIGITS else digits[-max(MIN_SHARED_DIGITS, 7) :]
        if similar in last:
            out.append((last[similar], i, 1))
        last[similar] = i
    return out


def weak_labels(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """Label of the first base span that a token overlaps, else 0."""
    out = np.zeros(len(spans), np.int64)
    for start, kind, end in reversed(base):
        for i, (s, e) in enumerate(spans):
            if s < end and start < e:
                out[i] = kind + 1
    return out


@dataclass
class Field:
    """``unary``: weights by feature and label; ``pair``: chain and skip log potentials."""

    unary: np.ndarray
    pair: np.ndarray


def train(texts: list[str], epochs: int = 5, rate: float = 0.3, seed: int = 1) -> Field:
    rng = np.random.default_rng(seed)
    rows, labels, counts = [], [], np.ones((2, N, N))  # one of each: smoothing
    for text in texts:
        spans = tokens(text)
        if not spans:
            continue
        own = weak_labels(spans, base_spans(text))
        rows.append(token_features(text, spans))
        labels.append(own)
        for a, b, kind in edges(text, spans):
            counts[kind, own[a], own[b]] += 1
            counts[kind, own[b], own[a]] += kind  # skip edges have no direction
    unary = np.zeros((BUCKETS, N))
    if rows:
        x, y = np.concatenate(rows), np.concatenate(labels)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 64):
                pick = order[lo : lo + 64]
                score = unary[x[pick]].sum(axis=1)
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                step = rate / (1 + epoch)
                np.add.at(unary, x[pick].ravel(), -step * np.repeat(p, x.shape[1], axis=0) / x.shape[1])
    share = counts / counts.sum(axis=(1, 2), keepdims=True)
    return Field(unary, np.log(share) - np.log(share.sum(2, keepdims=True)) - np.log(share.sum(1, keepdims=True)))


def beliefs(unary: np.ndarray, links: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product; ``links`` has rows (token, token, kind)."""
    if len(links):
        a, b, psi = links[:, 0], links[:, 1], pair[links[:, 2]]
        to_b, to_a = np.zeros((len(links), N)), np.zeros((len(links), N))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
            new_b = np.logaddexp.reduce((total[a] - to_a)[:, :, None] + psi, axis=1)
            new_a = np.logaddexp.reduce((total[b] - to_b)[:, None, :] + psi, axis=2)
            for old, new in ((to_b, new_b), (to_a, new_a)):
                new -= np.logaddexp.reduce(new, axis=1)[:, None]
                old *= DAMPING
                old += (1 - DAMPING) * new
        unary = unary.copy()
        np.add.at(unary, b, to_b)
        np.add.at(unary, a, to_a)
    return np.exp(unary - np.logaddexp.reduce(unary, axis=1)[:, None])


def find_all(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Texts do not influence one another."""
    base = [base_spans(t) for t in texts]
    spans = [tokens(t) for t in texts]
    first = np.cumsum([0, *map(len, spans)])
    if not first[-1]:
        return [(b, list(b)) for b in base]
    unary, links = [], []
    for i, text in enumerate(texts):
        if not spans[i]:
            continue
        scores = field.unary[token_features(text, spans[i])].sum(axis=1)
        fixed = weak_labels(spans[i], base[i])
        scores[np.flatnonzero(fixed), fixed[fixed > 0]] += BASE_WEIGHT
        unary.append(scores)
        links += [(a + first[i], b + first[i], k) for a, b, k in edges(text, spans[i])]
    p = beliefs(np.concatenate(unary), np.array(links, np.int64).reshape(-1, 3), field.pair)
    best = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    out = []
    for i, text in enumerate(texts):
        added: list[Span] = []
        for (s, e), label in zip(spans[i], best[first[i] : first[i + 1]], strict=True):
            if label and not any(bs < e and s < be for bs, _, be in base[i]):
                if added and added[-1][1] == label - 1 and not text[added[-1][2] : s].strip():
                    added[-1] = (added[-1][0], label - 1, e)
                else:
                    added.append((s, int(label) - 1, e))
        added = [x for x in added if x[1] == 0 or sum(c in "0123456789" for c in text[x[0] : x[2]]) >= MIN_ADDED_DIGITS]
        out.append((base[i], sorted(base[i] + added)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    rows = rows.filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    rows = rows.select(hash60("pii", F.col("id"), F.xxhash64("text")).alias("draw"), "text")
    # the draws alone are ordered, and only the texts up to the last one leave their tasks
    last = rows.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    few = rows.filter(F.col("draw") <= F.lit(-1 if last is None else last)).orderBy("draw", "text").limit(sample).collect()
    return train([r["text"] for r in few])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts per kind, ``base_sha256``, ``spans`` (all, written kind:start:end in
    code points, end exclusive) of each row.

    Null texts count as empty and have no spans. Rows are independent, so repeated rows
    agree; an empty table gives an empty table. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = find_all(part["text"].to_pylist(), shared.value)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([written(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays([part["id"], *counts, digest, spans], names)

    names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
