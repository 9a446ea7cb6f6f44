import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barline.llm import hard_negatives, token_alignment, units, vector_packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    return plain, Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)


STRANGE = ["a", "b c", " ", "  ", "\n", "\t", "é", "▁", "😀", "中文", "1234", "'s", "<|endoftext|>", "<s>", "\x1c", " ", "　", "x" * 90, ".", "-", "\0"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(STRANGE), max_size=14).map("".join)), st.integers(1, 9))
def test_units_encode_like_the_whole(text, chars):
    plain, special, pieces = (coder for coder in _coders())
    parts = units.cut(text, units.irregular(pa.array([text]))[0])
    assert " ".join(parts) == text and " ".join(units.slices(text, chars)) == text
    for coder in (plain, special):
        one_by_one = [i for k, u in enumerate(parts) for i in coder.encode((" " if k else "") + u, add_special_tokens=False).ids]
        assert one_by_one == coder.encode(text, add_special_tokens=False).ids
    spelt = lambda ids: b"".join(token_alignment.piece_bytes(pieces.id_to_piece(i)) for i in ids)
    if spelt(pieces.encode(text)) == (" " + text).encode():
        assert [i for u in parts for i in pieces.encode(u)] == pieces.encode(text) or not text


def test_plain_words_are_merged_without_a_look_up():
    """Latin words with no marks behind them, ASCII or not, go to the merges at once."""
    coder = _coders()[0]
    words = ["plain", "naïve", "Ærøskøbing", "straße", "x", "ʯ"]
    for lead in (" ", ""):
        ids = units.UnitIds(coder, lead)
        ids.word.encode = None  # what the table would call
        got = ids(words)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [coder.encode(lead + w, add_special_tokens=False).ids for w in words]
    marked = ["naïve,", "one.\nÆon!", "Über\nunter"]
    got = units.UnitIds(coder)(marked)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [coder.encode(" " + w, add_special_tokens=False).ids for w in marked]


_CODERS = []


def _coders():
    if not _CODERS:
        plain = Tokenizer.from_file(VOCABULARY)
        plain.encode_special_tokens = True
        _CODERS.extend([plain, Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)])
    return _CODERS


# ---- alignment -----------------------------------------------------------------------

def brute_alignment(docs, plain, pieces):
    rows, holders = [], defaultdict(set)
    for n, (i, text) in enumerate(docs):
        raw = (" " + (text or "")).encode()
        a = plain.encode(" " + (text or ""), add_special_tokens=False)
        b = pieces.encode(text or "")
        name_a = [plain.id_to_token(x) for x in a.ids]
        bytes_a = [bytes(token_alignment._BYTE_OF[c] for c in t) for t in name_a]
        bytes_b = [token_alignment.piece_bytes(pieces.id_to_piece(x)) for x in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append([i, 0, 0, [], "", n])
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        shared = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for high in shared:
            groups.append(([x for x, e in zip(a.ids, ends_a) if low < e <= high], [x for x, e in zip(b, ends_b) if low < e <= high]))
            low = high
        for x, y in {(x, y) for ga, gb in groups for x in ga for y in gb}:
            holders[x, y].add(n)
        text_form = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        rows.append([i, len(a.ids), len(b), groups, hashlib.sha256(text_form.encode()).hexdigest(), n])
    count = {p: len(h) for p, h in holders.items()}
    highest = Counter()
    for (x, _), c in count.items():
        highest[x] = max(highest[x], c)
    out = []
    for i, na, nb, groups, digest, _ in rows:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        out.append((i, na, nb, len(groups), len(links), digest, sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links)))
    return sorted(out, key=repr), count


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "cat", "Größe", "naïve", "中文字", "😀", "a1b2", "http://x.y/z?q=1", "\n", "  ", "end.\n\nNew", "<|endoftext|>", "<unk>", "é" * 5, "x" * 200, "0x1F", "▁"]
    return [" ".join(rng.choice(words[: rng.choice([4, 12, 17])]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_alignment_matches_brute_force(frame, coders, nasty, monkeypatch):
    plain, _, pieces = coders
    docs = [(i, t) for i, t, _ in nasty if not t or len(t) < 30000] + [(100 + k, t) for k, t in enumerate(some_texts(3, 60))] + [(100, "the cat"), (None, "the cat"), (7, None)]
    want, count = brute_alignment(docs, plain, pieces)
    for records, fan_in in ((2_000_000, 64), (40, 2)):  # the second: many runs, several levels
        monkeypatch.setattr(token_alignment, "BLOCK_RECORDS", records)
        monkeypatch.setattr(token_alignment, "FAN_IN", fan_in)
        out, counted = token_alignment.align(frame([(a, b, "s") for a, b in docs]).repartition(3), VOCABULARY, MODEL)
        got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in out.collect()]
        assert sorted(got, key=repr) == want
        assert {(r.a_id, r.b_id): r.n_docs for r in token_alignment.pair_counts(counted).collect()} == count


def test_large_groups_are_paired_without_all_cells():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 3000), rng.integers(0, 7, 2000)
    # a large group between small ones of the same unit, and other units around them
    group_a, group_b = np.r_[0, 0, 1, np.full(2996, 2), 3], np.r_[0, 1, 1, np.full(1996, 2), 3]
    keys, counts, of = token_alignment.linked_pairs(a, b, group_a, group_b, 4, np.array([0, 1, 1, 2]))
    want = Counter()
    for g, unit in enumerate([0, 1, 1, 2]):
        ca, cb = Counter(a[group_a == g].tolist()), Counter(b[group_b == g].tolist())
        want.update({(unit, x << 24 | y): ca[x] * cb[y] for x in ca for y in cb})
    assert dict(zip(zip(of.tolist(), keys.tolist()), counts.tolist())) == want
    assert sorted(zip(of.tolist(), keys.tolist())) == list(zip(of.tolist(), keys.tolist()))


def test_alignment_of_nothing(frame):
    out, counted = token_alignment.align(frame([]), VOCABULARY, MODEL)
    assert out.count() == 0 and token_alignment.pair_counts(counted).count() == 0


# ---- packing -------------------------------------------------------------------------

def packed_rows(frame, docs, **kw):
    return vector_packing.pack_documents(frame([(a, b, "s") for a, b in docs]).repartition(3), VOCABULARY, **kw).collect()


def check_layout(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity.tokens and len(members) <= capacity.documents
        assert sum(r.length**2 for r in members) <= capacity.attention
    return len(by_sequence)


def test_pieces_are_the_documents(frame, coders, nasty):
    _, special, _ = coders
    docs = [(i, t) for i, t, _ in nasty] + [(50 + k, t * 9) for k, t in enumerate(some_texts(5, 40))] + [(50, "again"), (None, "no id")]
    rows = packed_rows(frame, docs)
    check_layout(rows, vector_packing.Capacity())
    want = []
    for i, text in docs:
        ids = special.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[start : head if k == 0 else start + 1024]
            want.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert packed_rows(frame, []) == []


def test_sequences_hold_the_ids(frame, coders):
    _, special, _ = coders
    docs = [(k, t) for k, t in enumerate(some_texts(8, 30))]
    pieces = vector_packing.cut(frame([(a, b, "s") for a, b in docs]), VOCABULARY, tokens=64)
    capacity = vector_packing.Capacity(64, 5, 3000 + 64 * 64)
    packed = vector_packing.pack(pieces, capacity)
    check_layout(packed.collect(), capacity)
    ids = defaultdict(dict)
    for r in vector_packing.sequences(packed).collect():
        assert r.length * 4 == len(r.ids)
        for p in r.pieces:
            ids[p.id][p.start] = np.frombuffer(r.ids, "<u4")[p.offset : p.offset + p.length].tolist()
    for i, text in docs:
        assert sum((ids[i][k] for k in sorted(ids[i])), []) == special.encode(text, add_special_tokens=False).ids + [2]


def first_fit(lengths, counts, capacity):
    rest, n = np.tile(capacity.vector(), (counts.sum(), 1)), 0
    for length in np.repeat(lengths, counts)[::-1].tolist():
        need = np.array([length, 1, length**2])
        at = int((rest[: n + 1] >= need).all(axis=1).argmax())
        rest[at] -= need
        n = max(n, at + 1)
    return n


@pytest.mark.parametrize("seed", range(3))
def test_few_sequences_under_every_constraint(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(rng.integers(1, [1025, 400, 60][seed % 3], 4000), return_counts=True)
    for capacity in (vector_packing.Capacity(), vector_packing.Capacity(1024, 6, 1024**2 if seed % 3 == 0 else 250_000)):
        slots, n = vector_packing.solve(lengths, counts, capacity)
        seen = Counter()
        assert n <= 1.01 * first_fit(lengths, counts, capacity) + 1
        if capacity == vector_packing.Capacity():
            assert n <= np.ceil((lengths * counts).sum() / capacity.tokens) * 1.02 + 1
        for length, table in slots.items():
            first = np.r_[table[:, 0], counts[lengths == length]]
            assert first[0] == 0 and (np.diff(first) > 0).all()
            for (at, base, per, offset), stop in zip(table.tolist(), first[1:].tolist()):
                for k in range(stop - at):
                    seen[base + k // per, "n"] += 1
                    seen[base + k // per, "t"] += length
                    seen[base + k // per, "c"] += length**2
        assert max(v for (_, k), v in seen.items() if k == "n") <= capacity.documents
        assert max(v for (_, k), v in seen.items() if k == "t") <= capacity.tokens
        assert max(v for (_, k), v in seen.items() if k == "c") <= capacity.attention
    with pytest.raises(ValueError):
        vector_packing.solve(np.array([2000]), np.array([1]))


# ---- hard negatives ------------------------------------------------------------------

def brute_negatives(rows, every=50):
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        use[i] = (label, [int(np.floor(256 * x)) for x in v])
    out = []
    for i, (label, v) in use.items():
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, lab) for j, (lab, w) in use.items() if j != i and len(w) == len(v)]
        scores.sort()
        for s, j, _ in [x for x in scores if x[2] == label][:5]:
            found = [(t, k) for t, k, lab in scores if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.2, 900.0])
def test_negatives_match_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", 90)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 70))
    rows = [(k, (scale * (base[k % 12] + 0.8 * rng.normal(size=70))).tolist(), int(rng.integers(0, 3))) for k in range(400)]
    rows += [(1000 + k, rows[k][1], 1) for k in range(60)]  # ties
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 70, 1), (2150, [1.0] * 70, None), (None, [1.0] * 70, 1), (2200, [1.0, 2.0], 1), (2201, [1.0, 2.0], 1), (2202, [0.5, 1.2], 2), (2250, [], 2), (2251, [], 2), (2253, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("mine")).withColumn("na", F.lit(1))
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, label=label).collect())
    assert got == brute_negatives(rows) and len(got) > 50
    assert hard_negatives.mine(df.limit(0), label=label).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.9], 2), (3, [0.9, 0.9], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == [(0, 1, 1, 3, 131072, 117760), (0, 1, 2, 2, 131072, 91648)]


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for top in (3, 300, 10**5, 10**8):
        a, b = rng.integers(-top, top + 1, (40, 333)), rng.integers(-top, top + 1, (50, 333))
        assert (hard_negatives.Scorer(b.astype(float))(a.astype(float)) == a @ b.T).all()
    with pytest.raises(OverflowError):
        hard_negatives.Scorer(np.full((1, 4), 1e18))(np.full((1, 4), 1e18))
