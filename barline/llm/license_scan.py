"""License scans by patience alignment of texts with license templates.

Words are runs of ASCII letters and digits in lower case. A template and a stretch of text
are aligned by the words that are unique in both: the longest increasing subsequence of
their positions gives anchors, and the gaps between anchors are aligned in the same way,
after equal words at both ends of a gap are matched. Coverage is the share of the
template's words that are aligned; a license is found from ``COVERAGE`` on.

Where to align follows from coverage: if enough words are to be aligned, at least one of
any ``seeds`` template words is, where seeds number the words that may be missing plus one.
So the rarest seeds in the text are taken and a stretch around each of their places is
aligned; a text that lacks too many words of a template is not aligned at all. A stretch
reaches ``STRETCH`` template lengths to each side, so words put in between may be many.

A name or a version is a small share of a wording, so coverage alone cannot tell similar
licenses apart. Templates have deciding runs of words: a short notice must show them unbroken,
a longer template at least half of each, with no foreign word in it. A longer template that
lacks some of them gives way to one that has all of its own at the same place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.common import whole
from barline.llm.license_texts import DECIDING, TEMPLATES

COVERAGE = 0.8
STRETCH = 2
#: Templates of at most so many words must show their deciding words unbroken.
NOTICE = 20
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else _lower(text))


def _lower(text: str) -> str:
    """ASCII letters only, so that every character keeps its place."""
    return text.translate({i: i + 32 for i in range(65, 91)})


def _unique(words: list[str], lo: int, hi: int) -> dict[str, int]:
    counts = Counter(words[lo:hi])
    return {words[i]: i for i in range(lo, hi) if counts[words[i]] == 1}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first part, whose second part rises."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[k], ends[k] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], a_lo: int = 0, a_hi: int | None = None, b_lo: int = 0, b_hi: int | None = None) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, in order; gaps wait on a stack, not in calls."""
    out = []
    todo = [(a_lo, len(a) if a_hi is None else a_hi, b_lo, len(b) if b_hi is None else b_hi)]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo == a_hi or b_lo == b_hi:
            continue
        here, there = _unique(a, a_lo, a_hi), _unique(b, b_lo, b_hi)
        anchors = _rising(sorted((i, there[w]) for w, i in here.items() if w in there))
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a_lo - 1, b_lo - 1), *anchors], [*anchors, (a_hi, b_hi)], strict=True):
            if p + 1 < r and q + 1 < s:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def _run_of(words: list[str], run: list[str]) -> tuple[int, int]:
    """First and last place of a run of words."""
    at = next(i for i in range(len(words)) if words[i : i + len(run)] == run)
    return at, at + len(run) - 1


def _decided(template: list[str], words: list[str], pairs: list[tuple[int, int]], runs: list[tuple[int, int]]) -> float:
    """Share of the deciding words that the aligned stretch has; 0 if they rule the template out."""
    place, seen = dict(pairs), 0
    for first, last in runs:
        here = [place[i] for i in range(first, last + 1) if i in place]
        seen += len(here)
        if len(template) <= NOTICE:
            if len(here) <= last - first or here[-1] - here[0] != last - first:
                return 0.0
            continue
        if 2 * len(here) < last - first + 1:
            return 0.0
        # the aligned words next to the run, or its ends
        lo = max((i for i in place if i <= first), default=min(place))
        hi = min((i for i in place if i >= last), default=max(place))
        if not set(template[lo : hi + 1]).issuperset(words[place[lo] : place[hi] + 1]):
            return 0.0
    return seen / sum(last - first + 1 for first, last in runs) if runs else 1.0


@dataclass(frozen=True)
class Found:
    name: str
    coverage: float
    first: int  # words of the text
    last: int
    decided: float = 1.0


class Scanner:
    """Looks for templates, given as texts by name, in lists of words."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, deciding: dict[str, list[str]] | None = None):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.vocabulary = {w for words in self.templates.values() for w in words}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.deciding = {name: [_run_of(self.templates[name], words_of(run)) for run in runs] for name, runs in (deciding or {}).items()}

    def _possible(self, have: set[str], name: str) -> bool:
        words = self.templates[name]
        return bool(words) and sum(n for w, n in self.counts[name].items() if w in have) >= self.coverage * len(words)

    def __call__(self, text: str) -> list[Found]:
        words = words_of(text)
        have = self.vocabulary.intersection(words)
        names = [n for n in self.templates if self._possible(have, n)]
        if not names:
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in have:
                places.setdefault(w, []).append(i)
        out = []
        for name in names:
            out += self._found(name, words, places)
        sure = [f for f in out if f.decided == 1 and self.deciding.get(f.name) and len(self.templates[f.name]) > NOTICE]
        out = [f for f in out if f.decided == 1 or not any(f.first <= g.last and g.first <= f.last for g in sure)]
        return sorted(out, key=lambda f: (f.first, f.last, f.name))

    def _found(self, name: str, words: list[str], places: dict[str, list[int]]) -> list[Found]:
        template = self.templates[name]
        size = len(template)
        missing = int((1 - self.coverage) * size + 1e-9)
        seeds = sorted(range(size), key=lambda i: (len(places.get(template[i], ())), i))[: missing + 1]
        around = sorted({
            (max(0, p - i - STRETCH * size), min(len(words), p - i + (1 + STRETCH) * size)) for i in seeds for p in places.get(template[i], ())
        })
        # the stretch is also aligned without slack: repeated notices leave no unique words in a wide one
        around += sorted({(max(0, p - i), min(len(words), p - i + size)) for i in seeds for p in places.get(template[i], ())})
        hits: list[Found] = []
        for lo, hi in around:
            pairs = align(template, words, 0, size, lo, hi)
            if pairs and len(pairs) >= self.coverage * size:
                if decided := _decided(template, words, pairs, self.deciding.get(name, [])):
                    hits.append(Found(name, len(pairs) / size, pairs[0][1], pairs[-1][1], decided))
        # of overlapping hits the densest, so that two copies are not taken for one; then the first
        hits.sort(key=lambda f: (-f.coverage * size / max(size, f.last - f.first + 1), f.first, f.last))
        out: list[Found] = []
        for f in hits:
            if not any(f.first <= g.last and g.first <= f.last for g in out):
                out.append(f)
        return out


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """id, ``n_licenses``, ``best`` (name of the highest coverage, first by place),
    ``coverage`` of it and ``licenses`` (name:coverage:start:end by start, in code points,
    end exclusive) of each row.

    Null and empty texts have none (``best`` is null, ``coverage`` 0). Rows are independent:
    repeated rows agree and an empty table stays empty. Other columns are ignored.
    """
    deciding = DECIDING if templates is None else None
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, deciding)
        for batch in batches:
            rows = [_row(scanner, t.as_py()) for t in batch["text"]]
            n, best, share, written = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(written, pa.string())],
                ["id", "n_licenses", "best", "coverage", "licenses"],
            )

    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_licenses long, best string, coverage double, licenses string")
    return out.withColumnRenamed("id", id_col)


def _row(scanner: Scanner, text: str) -> tuple[int, str | None, float, str]:
    found = scanner(text)
    if not found:
        return 0, None, 0.0, ""
    spans = [m.span() for m in _WORD.finditer(_lower(text))]
    best = max(found, key=lambda f: (f.coverage, -f.first))
    written = ",".join(f"{f.name}:{f.coverage:.4f}:{spans[f.first][0]}:{spans[f.last][1]}" for f in found)
    return len(found), best.name, best.coverage, written
