"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles (64-bit hashes of the words, ASCII
lower case). Two sets of sizes a and b with Jaccard >= 4/5 differ in at most (a + b) / 9
elements and their sizes lie in the same or neighbouring bands (a band ends at 5/4 of its
start). For each band the domain is cut by hash into ``n1`` partitions, each into three
cells; with 2 * n1 > k some partition differs in at most one element, hence two of its
three cells agree. The signatures of a set are therefore the hashes of every two of three
cells of every partition: for its own band, and as a guest of the band above.

A signature of no elements would be shared by unrelated sets. It is not needed by a set
that has enough other partitions: when fewer than half of what k demands are weak (some
two cells empty), the pigeonhole argument holds with the others alone, and the partner has
the same non-empty signature. Only sets with too many weak partitions emit the empty ones.

Steps: equal sets collapse by fingerprint; signatures are packed per reducer (six bytes
each), shuffled once and sorted there with numpy, and only those seen twice come back as
rows. Links are then looked for in three rounds, each followed by connected components:
each set with the bucket leader it shares most with; with all leaders outside its
component; with all partners outside its component. Only pairs that could still join two
components are ever verified, so a group of near copies costs about one pair per member.
A parity sketch bounds the difference of two sets from below: a short one inside the last
join, a long one before the sets themselves are intersected. Nothing is capped; the rounds change the order of work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barline.llm.bits import bits_for, filter_of, with_test
from barline.llm.common import drop_tables, keep_table, whole
from barline.llm.components import components

WORDS_PER_SHINGLE = 5
#: Link when NUM * union <= DEN * intersection.
NUM, DEN = 4, 5
NULL_ID = -(1 << 63)
#: Signatures that one reducer sorts, and that a mapper gathers before it writes them out.
PER_REDUCER = 1_000_000
#: Longs of the sketch that travels with signatures.
SHORT = 8
SHORT_NAMES = [f"w{i}" for i in range(SHORT)]
U = np.uint64
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(1, WORDS_PER_SHINGLE + 1)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than five words are one shingle, none are none."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII space only
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxh64_intdigest, words), U, n)
    if n < WORDS_PER_SHINGLE:
        return mix(np.sum(h * _ODD[:n], dtype=U, keepdims=True) + U(n))
    end = n - WORDS_PER_SHINGLE + 1
    acc = h[:end] * _ODD[0]
    for i in range(1, WORDS_PER_SHINGLE):
        acc = acc + h[i : end + i] * _ODD[i]
    return np.unique(mix(acc))


def _bands(limit: int = 1 << 31) -> np.ndarray:
    ends, start = [], 1
    while start < limit:
        ends.append(start * DEN // NUM)
        start = ends[-1] + 1
    return np.array(ends)


BAND_ENDS = _bands()


def _instance(s: np.ndarray, band: int) -> np.ndarray:
    """Signatures of a sorted set in the enumeration of one band."""
    k = int(2 * BAND_ENDS[band] * (DEN - NUM) // (DEN + NUM))
    if k < 1:
        return np.empty(0, U)  # only equal sets are similar enough
    base = k // 2 + 1
    n1 = base + base * 12 // 100
    part = ((s >> U(32)) * U(n1)) >> U(32)  # rises with s, so partitions are runs
    edge = np.searchsorted(part, np.arange(n1 + 1, dtype=U))
    value, third = mix(s + U(0x632BE59BD9B4E019)), (s & U(0xFFFFFFFF)) % U(3)
    sums, counts = np.empty((3, n1), U), np.empty((3, n1), np.int64)
    for c in range(3):
        here = third == U(c)
        run = np.concatenate((np.zeros(1, U), np.cumsum(np.where(here, value, U(0)), dtype=U)))
        sums[c] = run[edge[1:]] - run[edge[:-1]]
        run = np.concatenate((np.zeros(1, np.int64), np.cumsum(here)))
        counts[c] = run[edge[1:]] - run[edge[:-1]]
    two, has = sums.sum(axis=0, dtype=U) - sums, counts.sum(axis=0) - counts
    place = np.arange(3 * n1, dtype=U).reshape(3, n1) + (U(band) << U(40))
    out = mix(two ^ mix(place + U(1)))
    weak = int((has == 0).any(axis=0).sum())
    return out[has > 0] if 2 * (n1 - weak) > k else out.ravel()


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures in the set's own band, as a guest of the band above)."""
    n = len(s)
    band = int(np.searchsorted(BAND_ENDS, n))
    home = _instance(s, band)
    if DEN * n < NUM * (int(BAND_ENDS[band]) + 1):
        return home, np.empty(0, U)  # no set of the band above is small enough
    return home, _instance(s, band + 1)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements by hash, at least four bits per element. Bits that
    differ between two sketches are never more than elements that differ."""
    bits = 1 << max(8, int(4 * len(s) - 1).bit_length())
    at = (mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the number of elements in which two sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a longer sketch folds to a shorter one
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def short_sketch(s: np.ndarray) -> np.ndarray:
    """Parities in ``SHORT`` longs, small enough to travel with every signature."""
    at = (mix(s ^ U(0x2545F4914F6CDD1D)) & U(64 * SHORT - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SHORT) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _pack(sigs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, reducers: int) -> pa.RecordBatch:
    part = ((sigs >> U(48)) % U(reducers)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    sigs, ids, sizes, part = sigs[order], ids[order], sizes[order], part[order]
    six = np.ascontiguousarray(sigs).view(np.uint8).reshape(-1, 8)[:, :6]
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows = []
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True):
        own = ids[lo:hi]
        heads = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
        counts = np.diff(np.r_[heads, hi - lo]).astype(np.uint32)
        rows.append((int(part[lo]), six[lo:hi].tobytes(), own[heads].tobytes(), sizes[lo:hi][heads].astype(np.uint32).tobytes(), counts.tobytes()))
    part, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], ["part", "sigs", "ids", "sizes", "counts"]
    )


def _shared_in(table: pa.Table) -> pa.Table:
    """Rows of the signatures that two sets of one reducer have, at least one at home."""
    col = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    raw = col("sigs", np.uint8).reshape(-1, 6)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :6] = raw
    sig = sig.view(U).ravel()
    counts = col("counts", np.uint32)
    ids, sizes = np.repeat(col("ids", np.int64), counts), np.repeat(col("sizes", np.uint32), counts)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    home, key = (sig & U(1)).astype(bool), sig >> U(1)
    first = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(key)])
    use = np.repeat((length > 1) & np.logical_or.reduceat(home, start), length)
    part = int(table["part"][0].as_py())
    return pa.table({
        "sig": pa.array((key[use] | (U(part) << U(47))).view(np.int64)),
        "id": pa.array(ids[order][use]),
        "n": pa.array(sizes[order][use].astype(np.int64)),
        "home": pa.array(home[use]),
    })


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two = [], [], []
        for text in batch["text"]:
            s = shingle_set(text.as_py())
            n.append(len(s))
            one.append(int(np.sum(s, dtype=U).view(np.int64)))
            two.append(int(np.sum(mix(s + U(7)), dtype=U).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["id"], *map(lambda x: pa.array(x, pa.int64()), (n, one, two))], ["id", "n", "fp1", "fp2"])


def _content_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(t.as_py()) for t in part["text"]]
            short = np.array([short_sketch(s) for s in sets], np.int64).reshape(-1, SHORT)
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"], pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                    *[pa.array(np.ascontiguousarray(short[:, i])) for i in range(SHORT)],
                ],
                ["id", "sketch", "elements", *SHORT_NAMES],
            )


def _close_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist()
        n = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        low = np.fromiter(map(least_difference, a, b), np.int64, len(a))
        keep = pa.array(low * (DEN + NUM) <= n * (DEN - NUM))
        yield batch.select(["a", "b"]).filter(keep)


def _linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["elements_a"], batch["elements_b"], strict=True):
            p, q = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(NUM * (len(p) + len(q) - both) <= DEN * both)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose sets are similar enough."""
    side = lambda what, x: content.select(F.col("id").alias(x), F.col(what).alias(f"{what}_{x}"))
    near = pairs.join(side("sketch", "a"), "a").join(side("sketch", "b"), "b").mapInArrow(_close_rows, "a long, b long")
    both = near.join(side("elements", "a"), "a").join(side("elements", "b"), "b")
    return both.mapInArrow(_linked_rows, "a long, b long")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links between the components so far."""
    links = keep_table(links, "found")
    if labels is None:
        out = components(links)
        drop_tables(links)
        return out
    name = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    lifted = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")
    )
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    top = components(lifted)
    nodes = labels.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("below"))
    up = top.select(F.col("node").alias("below"), "component")
    out = keep_table(nodes.join(up, "below", "left").select("node", F.coalesce("component", "below").alias("component")), "merged")
    drop_tables(labels, links, top)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``.

    The component is the smallest id reachable by links (itself included). Null and empty
    texts, and texts without words, have the empty set and no links. Rows that repeat an id
    are one node. A null id is a node below all others and shows as null. An empty table
    gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), whole(docs[text_col]).alias("text"))
    sets = keep_table(texts.mapInArrow(_set_rows, "id long, n long, fp1 long, fp2 long"), "sets")
    prints = ["n", "fp1", "fp2"]
    equal = sets.filter("n > 0").groupBy(*prints).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    classes = keep_table(sets.join(equal, prints).select("id", "rep"), "classes")
    copies = keep_table(classes.filter("id <> rep").select("id").distinct(), "copies")

    def with_text(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
        """Rows whose id is (not) wanted; only what the filter cannot tell is shuffled."""
        n_bits = bits_for(wanted.count())
        tested = with_test(rows, ["id"], filter_of(wanted, ["id"], n_bits), "hit", n_bits)
        sure = tested.filter("hit").join(wanted, "id", how)
        return sure.drop("hit") if how == "left_semi" else sure.unionByName(tested.filter("NOT hit")).drop("hit")

    total = sets.agg(F.sum("n")).first()[0] or 0
    reducers = min(60_000, int(total / PER_REDUCER) + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch["id"], batch["text"], strict=True):
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                home, guest = signatures(s)
                # bit 0 tells the set's own band; bits 1-47 and the reducer tell the signature
                own = np.concatenate((home | U(1), guest & ~U(1)))
                if len(own):
                    held.append((own, i.as_py(), len(s)))
                    size += len(own)
                if size >= PER_REDUCER // 2:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        counts = [len(x[0]) for x in held]
        ids, sizes = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)
        return _pack(np.concatenate([x[0] for x in held]), np.repeat(ids, counts), np.repeat(sizes, counts), reducers)

    packed = with_text(texts, copies, "left_anti").mapInArrow(emit, "part int, sigs binary, ids binary, sizes binary, counts binary")
    members = keep_table(packed.groupBy("part").applyInArrow(_shared_in, "sig long, id long, n long, home boolean").distinct(), "members")
    wanted = keep_table(members.select("id").distinct(), "wanted")
    content = keep_table(
        with_text(texts, wanted, "left_semi").mapInArrow(
            _content_rows, "id long, sketch binary, elements binary, " + ", ".join(f"{w} long" for w in SHORT_NAMES)
        ), "content"
    )
    drop_tables(copies, wanted)

    fits = F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM
    pair = ["a", "b", "n_a", "n_b"]
    leaders = members.groupBy("sig").agg(F.min(F.struct("id", "n", "home")).alias("lead"))
    led = members.join(leaders, "sig").select(
        F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"),
        (F.col("home") | F.col("lead.home")).alias("met"),
    ).filter("a <> b AND met").filter(fits)
    led = keep_table(led.groupBy(*pair).agg(F.count(F.lit(1)).alias("shared")), "led")

    best = led.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"), "a", "n_a", "n_b")).alias("m")).select("m.a", "b", "m.n_a", "m.n_b")
    labels = _merged(None, _links(best, content))

    def apart(pairs: DataFrame) -> DataFrame:
        name = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        rows = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left")
        return rows.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pair)

    labels = _merged(labels, _links(apart(led.join(best.select("a", "b"), ["a", "b"], "left_anti")), content))

    # all partners outside the component: signatures that more than one component has
    placed = members.join(labels, members["id"] == labels["node"], "left").select(
        "sig", "id", "n", "home", F.coalesce("component", "id").alias("c")
    )
    mixed = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("sig")
    placed = keep_table(placed.join(mixed, "sig").join(content.select("id", *SHORT_NAMES).dropDuplicates(["id"]), "id"), "placed")
    as_ = lambda x: placed.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "home", "c", *SHORT_NAMES)])
    apart_bits = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in SHORT_NAMES), F.lit(0))
    may_fit = fits & (apart_bits * (DEN + NUM) <= (F.col("n_a") + F.col("n_b")) * (DEN - NUM))
    rest = as_("a").join(as_("b"), "sig").filter("id_a < id_b AND c_a <> c_b AND (home_a OR home_b)").filter(may_fit)
    rest = rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b").distinct()
    rest = rest.join(led.select("a", "b"), ["a", "b"], "left_anti")
    labels = _merged(labels, _links(rest, content))
    drop_tables(members, content, led, placed)

    of_rep = labels.select(F.col("node").alias("rep"), "component")
    rep = sets.join(classes.distinct(), "id", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = rep.join(of_rep, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(shown("id").alias(id_col), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are the smallest id of their group; ids are taken to be unique."""
    groups = similar_groups(docs, id_col, text_col)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE q AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, q.root FROM q JOIN u ON u.a = q.node) SELECT node, min(root) AS root FROM q GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, r.root AS component_id FROM n JOIN r ON r.node = n.doc_id"""
