import random

import pytest
from pyspark.sql import functions as F

from barline.llm import exact_dedup, line_dedup


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 6, 1 << 20])
def test_exact_matches_sql_whatever_the_filter_holds(frame, sql, nasty, bits):
    docs = frame(nasty)
    got = rows_of(exact_dedup.mark_copies(docs, filter_bits=bits))
    assert got == sql(exact_dedup.SQL, documents=docs)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [1, 3, 5, 6, 7, 9]


def test_exact_keeps_nulls_and_empty_tables(frame):
    docs = frame([(None, "a", "s"), (None, "b", "s"), (2, "a", "s"), (2, "a", "s")])
    got = rows_of(exact_dedup.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == sorted([(None, 2, 3, False), (None, None, 1, True), (2, 2, 3, True), (2, 2, 3, True)], key=repr)
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_is_levenshtein(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = [rng.choice("abé😀") for _ in range(rng.randint(8, 60))]
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").filter(F.length("b") >= 4)
    got = df.select(
        line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("got"),
        F.least(F.levenshtein("a", "b"), F.lit(edits + 1)).alias("want"),
        line_dedup.may_be_near(F.col("a"), F.col("b"), edits).alias("may"),
        (F.length("a") >= edits + 7).alias("long"),
    ).collect()
    assert all(r.got == r.want for r in got)
    assert all(r.may for r in got if r.want <= edits)


def brute_lines(docs, edits, least):
    from functools import cache

    @cache
    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] <= edits

    seen, out = [], {}
    for doc, text in sorted(docs):
        out[doc] = [[], 0, 0]
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(line) < least:
                continue
            close = any(s != line and abs(len(s) - len(line)) <= edits and near(s, line) for s in seen)
            if close or line in seen:
                out[doc][0].append(pos)
                # a near line counts as near in every place, also where it is repeated
                out[doc][1 + near_first(seen, line, edits, near)] += 1
            seen.append(line)
    return out


def near_first(seen, line, edits, near):
    first = seen.index(line) if line in seen else len(seen)
    return int(any(s != line and abs(len(s) - len(line)) <= edits and near(s, line) for s in seen[:first]))


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_match_brute_force(frame, edits):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(18, 40))) for _ in range(12)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(line))
                line[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            lines.append("".join(line))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "short\nshort")]
    df = frame([(a, b, "s") for a, b in docs])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, max_edits=edits).collect()}
    want = brute_lines(docs, edits, line_dedup.MIN_CHARS)
    assert {k: list(r["removed"]) for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: (r["n_exact"], r["n_near"]) for k, r in got.items()} == {k: (v[1], v[2]) for k, v in want.items()}
    assert got[100].text is None and got[101].text == "" and got[102].text == "short\nshort"
    for d, text in docs[:40]:
        left = [x for i, x in enumerate(text.split("\n")) if i not in want[d][0]]
        assert got[d].text == "\n".join(left)


def test_lines_edge_tables(frame):
    line = "a line that is long enough to count"
    docs = frame([(None, line, "s"), (5, line, "s"), (5, line, "s"), (7, line + "\n" + line, "s")])
    got = sorted((str(r.doc_id), r.n_exact, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [("5", 1, ""), ("5", 1, ""), ("7", 2, ""), ("None", 0, line)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("max_edits", [1, 2])
def test_large_groups_that_share_a_segment_fall_apart(spark, monkeypatch, max_edits):
    """Many lines with one half, three quarters or all but a number in common."""
    monkeypatch.setattr(line_dedup, "GROUP_LINES", 3)
    rng = random.Random(max_edits)
    half, most = "the same first half of a line, ", "nearly all of this line is always as it was: "
    lines = [half + "".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(40)]
    lines += [most + f"{rng.randrange(10**5):05d}" for _ in range(40)] + [f"{rng.randrange(100)} " + most for _ in range(20)]
    for line in rng.sample(lines, 50):
        at = rng.randrange(len(line))
        lines.append(line[:at] + rng.choice(["", "xy", "x", "x" + line[at]]) + line[at + 1 :])
    lines = list(dict.fromkeys(x.strip() for x in lines))
    rng.shuffle(lines)
    docs = [(i, x) for i, x in enumerate(lines)]
    want = {i for i, x in docs if any(abs(len(x) - len(y)) <= max_edits and edit_distance(x, y) <= max_edits for y in lines[:i])}
    got = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_edits=max_edits)
    assert {r["at"] for r in got.collect()} == want and len(want) > 30
