"""Stretches of a text that word tokenizers encode independently of one another.

Both public tokenizers end a token before a single space that stands between two
characters other than white space: the byte-level splitter has no class that holds a
letter and a space behind it, and no piece of the piece model has its space marker behind
another character. A text is therefore cut at such spaces into units. Units repeat, so
their ids are kept in a table; what is long, or cannot be cut, is encoded all the same.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers, and characters from which a unit is not worth it.
REMEMBERED, LONG_UNIT = 200_000, 80
#: Characters of a text that are cut into units at a time.
SLICE_CHARS = 1 << 20
#: Characters of texts whose units are looked up together.
GROUP_CHARS = 1 << 21

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_IRREGULAR = f"{_SPACE} | {_SPACE}|^ | $"


@lru_cache(2)
def byte_bpe(vocabulary: str, specials_are_text: bool = False):
    """The tokenizer of a vocabulary's JSON, once for each worker; it encodes in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(vocabulary)
    out.encode_special_tokens = specials_are_text
    return out


#: Fixed ranges of Latin letters, the same in every version of the character tables.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+"
_PLAIN = re.compile(f"({_LETTERS})([.,;:!?]*)(?:\n({_LETTERS})([.,;:!?]*))?")
_HIDDEN = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b)]
_SHOWN = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))


class UnitIds:
    """Ids of units behind ``lead`` (a space, or nothing), as unsigned 32-bit bytes.

    What the byte-level splitter makes of Latin words with marks behind them is plain: the
    words, the marks and a line break are tokens' limits. Such words go straight to the
    merges and are remembered; all other units go through the whole tokenizer."""

    def __init__(self, coder, lead: str = " "):
        self.coder, self.lead = coder, lead
        self.merge = coder.model.tokenize
        self.word = Remembered(self._merge)

    def _merge(self, words: list[str]) -> list[bytes]:
        # all words at once: their bytes as the characters of byte-level tokens, between zeros
        shown = codecs.charmap_decode("\0".join(words).encode(), "strict", _SHOWN)[0].split(_SHOWN[0])
        return [array("I", [t.id for t in x]).tobytes() for x in map(self.merge, shown)] if words else []

    def __call__(self, found: list[str]) -> list[bytes]:
        out: list = [None] * len(found)
        alone, words, where, rest = [], [], [], []
        match, lead = _PLAIN.fullmatch, self.lead
        for i, u in enumerate(found):
            if u.isascii():
                word = u.rstrip(".,;:!?")
                if word.isalpha():
                    if len(word) == len(u):
                        alone.append(i)
                    else:
                        words += (lead + word, u[len(word) :])
                        where.append((i, len(words)))
                    continue
            plain = match(u)
            if plain is None:
                rest.append(i)
                continue
            word, marks, second, more = plain.groups()
            if second is None and not marks:
                alone.append(i)
                continue
            words += (lead + word, marks) if second is None else (lead + word, marks, "\n", second, more)
            where.append((i, len(words)))
        if alone:  # seldom known with marks behind, so not looked up, but remembered
            spaced = [lead + found[i] for i in alone]
            coded = self._merge(spaced)
            self.word.put(dict(zip(spaced, coded, strict=True)))
            for i, x in zip(alone, coded, strict=True):
                out[i] = x
        coded, at = self.word(words), 0
        for i, end in where:
            out[i] = b"".join(coded[at:end])
            at = end
        if rest:
            for i, e in zip(rest, self.coder.encode_batch_fast([lead + found[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out


def irregular(texts: pa.Array) -> list[bool]:
    """Whether a text has a space beside white space or at an end, where it is not cut."""
    return pc.match_substring_regex(texts, _IRREGULAR).to_pylist()


def cut(text: str, irregular: bool = True) -> list[str]:
    """Units without the space in front of all but the first; joined by spaces they are the text."""
    return _CUT.split(text) if irregular else text.split(" ")


def slices(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """The text in stretches of about ``chars`` characters, cut like units."""
    at = 0
    while len(text) - at > chars:
        end = _CUT.search(text, at + chars)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


@dataclass
class Group:
    """Stretches of texts as units: stretch i has the units ``bounds[i]`` to
    ``bounds[i + 1]`` of ``units``, belongs to row ``rows[i]`` and begins its text where
    ``begins[i]``."""

    rows: list[int]
    begins: list[bool]
    bounds: np.ndarray
    units: list[str]

    def coded(self) -> tuple[list[str], np.ndarray]:
        """The distinct units, and the place in them of each."""
        place = {u: i for i, u in enumerate(dict.fromkeys(self.units))}
        return list(place), np.fromiter(map(place.__getitem__, self.units), np.int64, len(self.units))


def batches(texts: pa.Array, chars: int = GROUP_CHARS) -> Iterator[Group]:
    """Groups of about ``chars`` characters; texts and their stretches follow in order."""
    odd = irregular(texts)
    rows, begins, counts, units, held = [], [], [], [], 0
    for row, text in enumerate(texts):
        for k, stretch in enumerate(slices(text.as_py())):
            parts = cut(stretch, odd[row])
            rows.append(row)
            begins.append(k == 0)
            counts.append(len(parts))
            units += parts
            held += len(stretch)
            if held >= chars:
                yield Group(rows, begins, np.cumsum([0, *counts]), units)
                rows, begins, counts, units, held = [], [], [], [], 0
    if rows:
        yield Group(rows, begins, np.cumsum([0, *counts]), units)


class Remembered:
    """What ``encode`` gives for units, with a table of known ones in two generations: when
    the young one is full, the old one goes. Units over ``LONG_UNIT`` characters stay out."""

    def __init__(self, encode: Callable[[list[str]], list], size: int = REMEMBERED):
        self.encode, self.size = encode, size
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def put(self, found: dict[str, object]) -> None:
        if len(self.young) + len(found) > self.size // 2:
            self.young, self.old = {}, self.young
        self.young.update(found if max(map(len, found)) <= LONG_UNIT else {u: x for u, x in found.items() if len(u) <= LONG_UNIT})

    def __call__(self, parts: list[str]) -> list:
        out = list(map(self.young.get, parts))
        missed = [i for i, x in enumerate(out) if x is None]
        if not missed:
            return out
        asked = parts if len(missed) == len(parts) else [parts[i] for i in missed]
        found = dict.fromkeys(asked)
        new = list(found)
        if self.old:
            found = dict(zip(new, map(self.old.get, new), strict=True))
            new = [u for u, x in found.items() if x is None]
        if new:
            found.update(zip(new, self.encode(new), strict=True))
        for i, x in zip(missed, map(found.__getitem__, asked), strict=True):
            out[i] = x
        self.put(found)
        return out
