"""Line dedup by a segment-partition edit join.

An occurrence of a line goes if an equal line, or one within ``max_edits`` edits, occurs
earlier in the corpus (by document id, then line number). Lines are compared without
surrounding white space; those of fewer than ``min_chars`` code points always stay.

1. Equal lines collapse by a 128-bit hash to their first occurrence.
2. Each distinct line is cut into ``max_edits + 1`` segments. Two lines within
   ``max_edits`` edits share one segment unchanged, at a place that the lengths bound. A
   line is filed under each of its segments (with its own length) and looks under the
   substrings that could be a segment of a line up to ``max_edits`` shorter
   (multi-match-aware selection).
3. Under each signature all lines are first checked against the earliest one there, which
   settles a large group of near copies with one pair each. Lines still unsettled are paired
   with the other earlier ones while a group is small. What lines of a large group have
   besides the shared segment is again within ``max_edits`` edits for a near pair, so it is
   cut into segments in its turn and the group falls apart into groups that share more,
   again and again until nearly all is shared.
4. Pairs are verified by a banded bit-parallel edit distance, as a fold over the
   characters with bit operations on longs, after a cheap count of segments in place.

Everything is DataFrame functions. Texts are read where they lie: only lines in candidate
pairs, found by a bounded bitmap filter, and the documents that lose lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.bits import bits_for, filter_of, with_test
from barline.llm.common import drop_tables, keep_table, whole

MAX_EDITS = 1
MIN_CHARS = 20
IDENT = ["at", "pos", "k1"]
#: Groups of up to so many lines are paired; larger ones are cut by what else they share.
GROUP_LINES, LEVELS = 64, 4
#: Segments added to a signature from one level to the next.
CUTS = 2


def _segment(length: Column, i: int, n: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``n`` nearly equal ones, the longer last."""
    short = F.lit(n) - length % n
    base = F.floor(length / n).cast("int")
    return base * i + F.greatest(F.lit(0), F.lit(i) - short), base + (F.lit(i) >= short).cast("int")


def _shared_at(line: Column, length: Column, gap: int, max_edits: int) -> list[tuple[int, Column]]:
    """(shift, signature) for each place at which a line may have a segment of a line
    ``gap`` characters shorter; a signature tells also where the segment lies here."""
    n = max_edits + 1
    out = []
    for i in range(n):
        start, size = _segment(length - gap, i, n)
        low, high = max(-i, gap - (max_edits - i)), min(i, gap + (max_edits - i))
        for shift in range(low, high + 1):
            at = start + shift
            sig = F.struct(F.xxhash64(length - gap, F.lit(i), line.substr(at + 1, size)).alias("sig"), at.cast("int").alias("start"), size.cast("int").alias("size"))
            out.append((shift, F.when((at >= 0) & (at + size <= length), sig)))
    return out


def signatures(line: Column, length: Column, max_edits: int) -> tuple[list[Column], list[tuple[int, Column]]]:
    """Signatures to file a line under, and (gap, signature) of further ones to look under;
    null where out of range.

    Filing at the line's own length is also its look-up among lines of that length at
    shift 0, so that one is not repeated."""
    own = _shared_at(line, length, 0, max_edits)
    looked = [(0, sig) for shift, sig in own if shift]
    looked += [(gap, sig) for gap in range(1, max_edits + 1) for _, sig in _shared_at(line, length, gap, max_edits)]
    return [sig for shift, sig in own if not shift], looked


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two strings if at most ``max_edits`` (up to 31), else ``max_edits + 1``.

    Bit-vectors of the 2k+1 diagonals around the main one (Hyyrö 2003): bit d of a vector at
    column j stands for row j - k + d. Both strings have at least ``max_edits`` characters."""
    k = max_edits
    band = (1 << (2 * k + 1)) - 1
    # transform over an array of one names an intermediate result, so it is computed once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    codes = lambda x: F.transform(F.split(x, ""), F.ascii)  # noqa: E731  code points

    def of(env: Column) -> Column:
        return _banded(env["rows"], env["cols"], env["m"], env["n"], k, band, once)

    m, n = F.length(a), F.length(b)
    dist = once(F.struct(codes(a).alias("rows"), codes(b).alias("cols"), m.alias("m"), n.alias("n")), of)
    return F.when(F.abs(m - n) > k, F.lit(k + 1).cast("long")).otherwise(F.least(dist, F.lit(k + 1).cast("long")))


def _banded(rows: Column, cols: Column, m: Column, n: Column, k: int, band: int, once) -> Column:
    def step(s: Column, j: Column) -> Column:
        here = F.get(cols, j - 1)
        match = F.lit(0).cast("long")
        for d in range(2 * k + 1):
            row = j - k + d - 1
            same = (row >= 0) & (F.get(rows, row) == here)
            match = match.bitwiseOR(F.when(same, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), match.alias("match"), j.alias("j"))

    def diagonal(s: Column) -> Column:
        carry = (s["match"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
        return F.struct(s["vp"], s["vn"], s["dist"], s["j"], carry.bitwiseOR(s["match"]).bitwiseOR(s["vn"]).bitwiseAND(F.lit(band)).alias("d0"))

    def advance(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(F.lit(band))
        hn = s["d0"].bitwiseAND(s["vp"])
        return F.struct(s["d0"], s["dist"], s["j"], hp.alias("hp"), hn.alias("hn"))

    def finish(s: Column) -> Column:
        bit = lambda v, at: F.call_function("shiftright", v, at).bitwiseAND(F.lit(1))
        low = F.call_function("shiftright", s["d0"], F.lit(1))
        on_row = (m - s["j"] + k).cast("int")
        change = F.when(s["j"] + k <= m, F.lit(1) - bit(s["d0"], F.lit(2 * k))).otherwise(bit(s["hp"], on_row) - bit(s["hn"], on_row))
        return F.struct(
            s["hn"].bitwiseOR(F.bitwise_not(low.bitwiseOR(s["hp"]))).bitwiseAND(F.lit(band)).alias("vp"),
            low.bitwiseAND(s["hp"]).alias("vn"),
            (s["dist"] + change).alias("dist"),
        )

    start = F.struct(
        F.lit(band & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("dist")
    )
    fold = lambda s, j: once(once(once(step(s, j), diagonal), advance), finish)
    return F.aggregate(F.sequence(F.lit(1), n), start, fold, lambda s: s["dist"])


def may_be_near(a: Column, b: Column, max_edits: int) -> Column:
    """True for all pairs within ``max_edits`` edits: of ``max_edits + 7`` segments of ``a``,
    each edit spoils one at most, and the others stand in ``b`` shifted by at most the edits."""
    parts = max_edits + 7
    m = F.length(a)
    base = F.floor(m / parts).cast("int")
    longer = F.lit(parts) - m % parts  # segments from this one on have one character more

    def stays(i: Column) -> Column:
        start = base * i + F.greatest(F.lit(0), i - longer)
        size = base + (i >= longer).cast("int")
        shifts = F.sequence(F.greatest(start - max_edits, F.lit(0)), start + max_edits)
        return F.exists(shifts, lambda at: b.substr(at + 1, size) == a.substr(start + 1, size))

    # segments and shifts are walked, not written out: the expression is planned anew in every job
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), stays)) >= parts - max_edits


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(at, pos, line, length, k1, k2) of each line that may go; a null id is below all ids."""
    at = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(at.alias("at"), F.posexplode(F.split(whole(docs[text_col]), "\n")).alias("pos", "raw"))
    rows = rows.select("at", "pos", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
    rows = rows.withColumn("length", F.length("line")).filter(F.col("length") >= min_chars)
    return rows.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _verified(pairs: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Identities of the later lines of pairs that are within ``max_edits`` edits."""
    first = texts.select(*[F.col(c).alias(f"x_{c}") for c in IDENT], F.col("line").alias("x_line"))
    rows = pairs.join(first, [f"x_{c}" for c in IDENT])
    rows = rows.join(texts.select(*IDENT, "line"), IDENT)
    x, y = F.col("x_line"), F.col("line")
    near = F.when(may_be_near(x, y, max_edits), banded_distance(x, y, max_edits) <= max_edits)
    return rows.filter(near).select(*IDENT).distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows whose signature others share and somebody is filed under, with the earliest line
    (``leader``) and the size of the group."""
    shared = rows.groupBy("sig").agg(
        F.min(F.struct(*IDENT)).alias("leader"), F.count(F.lit(1)).alias("group_size"), F.bool_or("filed").alias("any_filed")
    ).filter("group_size > 1 AND any_filed")
    return rows.join(shared.select("sig", "leader", "group_size"), "sig")


def _cut_further(members: DataFrame, max_edits: int) -> DataFrame:
    """Members of large groups, grouped by the segments shared so far and ``CUTS`` of the rest."""
    rows = members.select(*IDENT, "sig", "start", "size", "gap", "filed", "line")
    for _ in range(CUTS):
        rows = _cut_once(rows, max_edits)
    return _grouped(rows)


def _cut_once(rows: DataFrame, max_edits: int) -> DataFrame:
    rest = F.concat(F.substring("line", F.lit(1), F.col("start")), F.col("line").substr(F.col("start") + F.col("size") + 1, F.length("line")))
    rows = rows.withColumn("line", rest)
    rows = rows.withColumn("length", F.length("line"))
    found = []
    for gap in range(max_edits + 1):
        for shift, sig in _shared_at(F.col("line"), F.col("length"), gap, max_edits):
            found.append(F.when(F.col("gap") == gap, F.struct(sig.alias("s"), (F.col("filed") & F.lit(gap == 0 and shift == 0)).alias("filed"))))
    rows = rows.select(*IDENT, F.col("sig").alias("above"), "gap", "line", F.explode(F.array(*found)).alias("e"))
    return rows.filter("e.s IS NOT NULL").select(
        *IDENT, F.xxhash64("above", "e.s.sig").alias("sig"), "e.s.start", "e.s.size", "gap", "e.filed", "line")


def _later_lines(members: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Identities of the lines near to an earlier one; drops both tables."""
    me = F.struct(*IDENT)
    settled, kept, level = None, [members, texts], 1
    while True:
        to_leader = members.filter(me > F.col("leader"))
        to_leader = to_leader if level == 1 else to_leader.join(settled, IDENT, "left_anti")
        to_leader = to_leader.select(*[F.col(f"leader.{c}").alias(f"x_{c}") for c in IDENT], *IDENT).distinct()
        if level == 1:
            settled = keep_table(_verified(to_leader, texts, max_edits), "settled")
            kept.append(settled)

        paired = members if level == LEVELS else members.filter(F.col("group_size") <= GROUP_LINES)
        open_ = paired.join(settled, IDENT, "left_anti").filter(me > F.col("leader"))
        others = paired.filter(me > F.col("leader")).select("sig", F.col("filed").alias("x_filed"), *[F.col(c).alias(f"x_{c}") for c in IDENT])
        earlier = F.struct(*[f"x_{c}" for c in IDENT]) < me
        rest = open_.join(others, "sig").filter(earlier & (F.col("filed") | F.col("x_filed")))
        rest = rest.select(*[f"x_{c}" for c in IDENT], *IDENT)
        # further groups are few, so leaders and others are verified in one job
        rest = (rest if level == 1 else rest.unionByName(to_leader)).distinct()
        settled = keep_table(settled.unionByName(_verified(rest, texts, max_edits)).distinct(), "settled")
        kept.append(settled)

        large = members.filter(F.col("group_size") > GROUP_LINES)
        if level == LEVELS or not large.join(settled, IDENT, "left_anti").take(1):
            drop_tables(*kept[:-1])
            return settled
        if level == 1:
            large = large.join(texts, IDENT)
        members = keep_table(_cut_further(large, max_edits), "members")
        kept.append(members)
        level += 1


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(at, positions, n_exact, n_near) per document that loses lines; ``at`` is its id."""
    if min_chars <= max_edits + 1:
        raise ValueError("lines must be longer than the number of segments")
    occ = _occurrences(docs, id_col, text_col, min_chars)
    filed, looked = signatures(F.col("line"), F.col("length"), max_edits)
    first = F.struct("at", "pos", *[s.alias(f"f{i}") for i, s in enumerate(filed)], *[s.alias(f"l{i}") for i, (_, s) in enumerate(looked)])
    lines = occ.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    lines = keep_table(lines.select("k1", "k2", "n", "first.*"), "lines")

    entry = lambda c, gap, is_filed: F.struct(F.col(c).alias("s"), F.lit(gap).alias("gap"), F.lit(is_filed).alias("filed"))
    entries = [entry(f"f{i}", 0, True) for i in range(len(filed))] + [entry(f"l{i}", gap, False) for i, (gap, _) in enumerate(looked)]
    rows = lines.select(*IDENT, F.explode(F.array(*entries)).alias("e")).select(*IDENT, "e.s.*", "e.gap", "e.filed")
    members = keep_table(_grouped(rows.filter("sig IS NOT NULL")), "members")

    # texts of the lines that share a signature, found where they lie
    wanted = keep_table(members.select(*IDENT).distinct(), "wanted")
    n_bits = bits_for(wanted.count())
    near = with_test(occ.select(*IDENT, "line"), IDENT, filter_of(wanted, IDENT, n_bits), "hit", n_bits).filter("hit")
    texts = keep_table(near.join(wanted, IDENT, "left_semi").dropDuplicates(IDENT).select(*IDENT, "line"), "texts")
    drop_tables(wanted)
    later = _later_lines(members, texts, max_edits)

    gone = later.select(*IDENT, F.lit(True).alias("near"))
    affected = lines.join(gone, IDENT, "left").filter("near OR n > 1").select(
        "k1", "k2", F.col("at").alias("first_at"), F.col("pos").alias("first_pos"), F.coalesce("near", F.lit(False)).alias("near")
    )
    is_first = (F.col("at") == F.col("first_at")) & (F.col("pos") == F.col("first_pos"))
    out = occ.select("at", "pos", "k1", "k2").join(affected, ["k1", "k2"]).filter(F.col("near") | ~is_first)
    by_doc = out.groupBy("at").agg(
        F.sort_array(F.collect_set("pos")).alias("positions"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("pos")))).cast("long").alias("n_near"),
    )
    return by_doc.select("at", "positions", (F.size("positions") - F.col("n_near")).alias("n_exact"), "n_near")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Columns of ``docs`` with the remaining text, and ``n_lines``, ``n_exact``, ``n_near``,
    ``removed`` (line numbers from 0).

    Null texts stay null, empty ones empty: they have no line that may go. A text that loses
    all its lines is empty. Rows that repeat an id and a text are one occurrence and keep or
    lose lines alike; a null id counts as the smallest. Empty tables give empty tables.
    """
    cut = removed_lines(docs, id_col, text_col, max_edits, min_chars)
    cut = cut.select(F.col("at").alias("__at"), F.col("positions").alias("__cut"), "n_exact", "n_near")
    at = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near", "removed")]
    rows = docs.select(*keep).join(cut, at == cut["__at"], "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    # lines are joined one by one; those at removed positions are left out
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("__cut"), i)), "\n")
    text = F.when(F.col("__cut").isNull(), F.col(f"`{text_col}`")).otherwise(left)
    none = F.array().cast("array<int>")
    return rows.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("__cut", none).alias("removed"),
    )


SQL = rf"""
WITH o AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, trim(unnest(ls), e' \t\r\x0b\x0c') AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
occ AS (SELECT *, length(line) AS n FROM o WHERE length(line) >= {MIN_CHARS}),
f AS (SELECT line, n, min((doc_id, pos)) AS first FROM occ GROUP BY line, n),
c AS (SELECT a.line AS x, b.line AS y FROM f a JOIN f b ON a.n = b.n AND a.first < b.first AND levenshtein(a.line, b.line) <= 8
  UNION ALL SELECT a.line, b.line FROM f a JOIN f b ON a.n = b.n - 1 AND levenshtein(a.line, b.line) <= 8),
near AS (SELECT DISTINCT CASE WHEN fa.first < fb.first THEN y ELSE x END AS line FROM c JOIN f fa ON fa.line = x JOIN f fb ON fb.line = y
  WHERE CASE WHEN length(x) = length(y)
    THEN len(list_filter(generate_series(1, length(x)), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
    ELSE len(list_filter(generate_series(1, length(y)), lambda i: x = left(y, i - 1) || substr(y, i + 1))) > 0 END),
r AS (SELECT occ.doc_id, occ.pos, near.line IS NOT NULL AS is_near FROM occ JOIN f USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (doc_id, pos) <> first),
g AS (SELECT doc_id, list(pos ORDER BY pos) AS removed, count(*) FILTER (NOT is_near) AS n_exact, count(*) FILTER (is_near) AS n_near FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  coalesce(array_to_string(removed, ','), '') AS removed,
  sha256(coalesce((SELECT string_agg(l, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(d.text, chr(10))) AS l, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS i)
    WHERE removed IS NULL OR NOT list_contains(removed, i)), '')) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)"""
