"""Mixing sources to target weights by a splitting tree over source blocks.

1. Each source gets a share of all words by weight, at most ``max_repeats`` times its own
   size; what is above goes to the others by weight (solved in closed form over the small
   table of sources, one row per source).
2. Documents fall by hash into ``BLOCKS`` blocks per source. A source takes every block
   ``floor(target / size)`` times and, for the rest, blocks in a random order while they
   fit and then the largest others that still do. The block at the border is split the same way by ``BLOCKS`` finer blocks, and the
   finer one at its border by documents, shortest first. No step orders a whole source.
3. Splitting tree: the taken block copies of all sources are split in two again and again
   until each output shard has its part. At every node they are put in a random order and
   the left child gets exactly the first half, so the number it gets of each source is a
   multivariate hypergeometric draw from the node's quotas, and the shards' blocks are
   disjoint. A node orders at most ``(max_repeats + 1) * BLOCKS`` block rows per source,
   whatever the input.
4. ``deal`` writes each document once per copy with its shard and a random key by which
   the shard is sorted locally.

All draws are hashes of ids and ``seed``, so a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import WORDS, hash60, hash60_sql, keep_table, whole

BLOCKS = 1024
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS = 4
FILLS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): the weights repeat over the sources in code point
    order, null last. Sources without words get 0."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(n, F.lit(len(weights)))])
    room = (F.lit(float(max_repeats)) * F.col("source_size") / F.col("weight")).alias("room")
    s = s.select("*", room)
    before = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # what a unit of weight gets when all sources with less room are full
    unit = (total - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.select("*", unit.alias("unit"))
    # full sources come first in this order; behind them the unit only falls
    level = F.max(F.when(F.col("room") > F.col("unit"), F.col("unit"))).over(Window.partitionBy())
    target = F.when(F.col("room") > F.col("unit"), F.col("weight") * level).otherwise(
        F.lit(float(max_repeats)) * F.col("source_size")
    )
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def _border(groups: DataFrame, keys: list[str], block: str, order: str, room: str) -> DataFrame:
    """Marks blocks in random order: ``inside`` those that fit in ``room``; the first that
    does not is the ``border`` and keeps what is left in ``left_over``."""
    w = Window.partitionBy(*keys).orderBy(order, block).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("words").over(w)
    out = groups.withColumn("end", end)
    return out.select(
        *[c for c in out.columns if c != "end"],
        (F.col("end") <= F.col(room)).alias("inside"),
        ((F.col("end") > F.col(room)) & (F.col("end") - F.col("words") < F.col(room))).alias("border"),
        (F.col(room) - (F.col("end") - F.col("words"))).alias("left_over"),
    )


def _fill(blocks: DataFrame, times: int = FILLS) -> DataFrame:
    """Gives what is left at a source's border to the largest other block that fits, again
    and again, so that little is left to split the border block for."""
    source = Window.partitionBy("source")
    for _ in range(times):
        blocks = blocks.withColumn("room", F.max(F.when(F.col("border"), F.col("left_over"))).over(source))
        fits = F.coalesce(~F.col("inside") & ~F.col("border") & (F.col("words") > 0) & (F.col("words") <= F.col("room")), F.lit(False))
        place = F.row_number().over(source.orderBy(F.col("fits").desc(), F.col("words").desc(), "order", "block"))
        blocks = blocks.withColumn("fits", fits).withColumn("fits", F.col("fits") & (place == 1))
        used = F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))).over(source), F.lit(0))
        blocks = blocks.withColumn("left_over", F.col("left_over") - used).withColumn("inside", F.col("inside") | F.col("fits"))
    return blocks.drop("room", "fits")


def choose(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """(documents with target, copies and block; taken copies of blocks)."""
    sizes = keep_table(
        docs.select(
            docs[id_col].alias("id"),
            docs[source_col].cast("string").alias("source"),
            F.regexp_count(whole(docs[text_col]), F.lit(WORDS)).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(sizes).select(
        "source", "source_size", "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("full"),
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    targets = keep_table(targets, "targets")
    placed = (
        sizes.withColumn("draw", hash60(seed, F.col("id")))
        .withColumn("block", F.pmod("draw", F.lit(BLOCKS)))
        .withColumn("fine", F.pmod(F.expr(f"draw div {BLOCKS}"), F.lit(BLOCKS)))
    )

    coarse = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    t = targets.withColumnRenamed("source", "s")
    coarse = coarse.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    coarse = coarse.withColumn("order", hash60(seed, "block", F.coalesce("source", F.lit("\u0000")), F.col("block")))
    coarse = keep_table(_fill(_border(coarse, ["source"], "block", "order", "rest")), "blocks")

    edge = coarse.filter("border").select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.col("left_over").alias("room")
    )
    at_edge = placed.join(edge, placed["source"].eqNullSafe(edge["s"]) & (placed["block"] == edge["b"])).drop("s", "b")
    fine = at_edge.groupBy("source", "block", "fine").agg(F.sum("size").alias("words"), F.max("room").alias("room"))
    fine = fine.withColumn("order", hash60(seed, "fine", F.coalesce("source", F.lit("\u0000")), F.col("fine")))
    fine = _border(fine, ["source", "block"], "fine", "order", "room")
    fine = fine.select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.col("fine").alias("f"),
        F.col("inside").alias("fine_inside"), F.col("border").alias("fine_border"), F.col("left_over").alias("last"),
    )
    at_fine = at_edge.join(
        fine, at_edge["source"].eqNullSafe(fine["s"]) & (at_edge["block"] == fine["b"]) & (at_edge["fine"] == fine["f"])
    ).drop("s", "b", "f")
    w = Window.partitionBy("source", "block", "fine").orderBy("size", "draw", "id").rowsBetween(Window.unboundedPreceding, 0)
    one_by_one = F.col("fine_border") & (F.sum("size").over(w) - F.col("size") / 2 <= F.col("last"))
    picked = at_fine.withColumn("extra_at_edge", (F.col("fine_inside") | one_by_one).cast("int"))
    picked = picked.select(F.col("id").alias("picked_id"), F.col("extra_at_edge")).filter("extra_at_edge = 1").distinct()

    blocks = coarse.select(
        F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "full", "inside", "border"
    )
    rows = placed.join(blocks, placed["source"].eqNullSafe(blocks["s"]) & (placed["block"] == blocks["b"])).drop("s", "b")
    rows = rows.join(picked, rows["id"] == picked["picked_id"], "left").drop("picked_id")
    extra = F.when(F.col("size") == 0, 0).when(F.col("inside"), 1).otherwise(F.coalesce("extra_at_edge", F.lit(0)))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("full") + extra).cast("long")
    rows = rows.select(
        "id", "source", "block", "size", "source_size", "target", copies.alias("n_copies"),
    )
    units = coarse.filter("full > 0 OR inside OR border").select(
        "source", "block", F.explode(F.expr("sequence(1, int(full + if(inside OR border, 1, 0)))")).alias("copy")
    )
    return rows, units


def splitting_tree(units: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """(source, block, copy, shard): each level halves every node's block copies in a
    random order, the left child taking the first half (rounded up)."""
    out = units.withColumn("shard", F.lit(0).cast("long"))
    for level in range(levels):
        draw = hash60(seed, "tree", F.lit(level), F.coalesce("source", F.lit("\u0000")), F.col("block"), F.col("copy"))
        out = out.withColumn("draw", draw)
        order = Window.partitionBy("shard").orderBy("draw", F.col("source").asc_nulls_last(), "block", "copy")
        place = F.row_number().over(order)
        half = F.expr("ceil(node_size / 2)")
        out = (
            out.withColumn("place", place)
            .withColumn("node_size", F.count(F.lit(1)).over(Window.partitionBy("shard")))
            .withColumn("shard", F.col("shard") * 2 + F.when(F.col("place") <= half, 0).otherwise(1))
            .drop("draw", "place", "node_size")
        )
    return out


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    levels: int = LEVELS, seed: str = SEED,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``,
    ``n_copies`` and ``shards`` (one per copy, in the order of copies).

    A null text has size 0 and is never taken. A null source is a source of its own, last
    in the order of weights. Repeated ids are drawn alike. With an empty table, or without
    any words, nothing is taken. The words taken of a source differ from its target by
    at most half the size of one document, mostly by far less.
    """
    rows, units = choose(docs, id_col, text_col, source_col, seed)
    dealt = splitting_tree(units, levels, seed)
    by_block = dealt.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("all_shards")
    )  # at most max_repeats + 1 copies
    out = rows.join(by_block, rows["source"].eqNullSafe(by_block["s"]) & (rows["block"] == by_block["b"]), "left")
    shards = F.when(F.col("n_copies") > 0, F.slice("all_shards", F.lit(1), F.greatest(F.col("n_copies"), F.lit(1)).cast("int")))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies",
        F.coalesce(shards, F.array().cast("array<bigint>")).alias("shards"),
    )


def deal(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    levels: int = LEVELS, seed: str = SEED,
) -> DataFrame:
    """Rows of ``docs`` once per copy, with ``mix_shard`` and ``mix_order`` added. Sorted by
    ``mix_order`` inside a shard they are shuffled locally. Ids are taken to be unique."""
    plan = mix(docs, id_col, text_col, source_col, levels, seed).filter("n_copies > 0")
    plan = plan.select(F.col(id_col).alias("__id"), F.posexplode("shards").alias("__copy", "mix_shard"))
    plan = plan.withColumn("mix_order", hash60(seed, "order", F.col("__id"), F.col("__copy")))
    return docs.join(plan, docs[id_col] == plan["__id"]).drop("__id", "__copy")


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Parquet folders ``mix_shard=k``, shuffled inside each file."""
    out = deal(docs, **kw)
    out.repartition("mix_shard", F.pmod("mix_order", F.lit(64))).sortWithinPartitions("mix_shard", "mix_order").write.partitionBy(
        "mix_shard"
    ).mode("overwrite").parquet(path)


def _tree_sql(levels: int) -> str:
    ctes, at = [], "units0"
    for k in range(levels):
        draw = hash60_sql(f"'{SEED}'", "'tree'", f"'{k}'", "coalesce(source, chr(0))", "block", "copy")
        ctes.append(f"""units{k + 1} AS (SELECT source, block, copy, shard * 2 + CASE WHEN place <= ceil(n / 2.0) THEN 0 ELSE 1 END AS shard FROM (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY draw, source NULLS LAST, block, copy) AS place,
    count(*) OVER (PARTITION BY shard) AS n FROM (SELECT *, {draw} AS draw FROM {at})))""")
        at = f"units{k + 1}"
    return ",\n".join(ctes)


def _fill_sql(times: int) -> str:
    ctes, at = [], "c2"
    for k in range(times):
        ctes.append(f"""fill{k + 1} AS (SELECT * EXCLUDE (left_room, fits, place, chosen) REPLACE (inside OR chosen AS inside,
  room - coalesce(sum(CASE WHEN chosen THEN words END) OVER (PARTITION BY source), 0) AS room) FROM (
  SELECT *, fits AND place = 1 AS chosen FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY fits DESC, words DESC, ord, block) AS place FROM (
  SELECT *, coalesce(NOT inside AND NOT border AND words > 0 AND words <= left_room, false) AS fits FROM (
  SELECT *, max(CASE WHEN border THEN room END) OVER (PARTITION BY source) AS left_room FROM {at})))))""")
        at = f"fill{k + 1}"
    return ",\n".join(ctes)


SQL = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, 3.0::DOUBLE * source_size / weight AS room FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM s2),
s4 AS (SELECT source, source_size, round(CASE WHEN room > unit THEN weight * max(CASE WHEN room > unit THEN unit END) OVER () ELSE 3.0::DOUBLE * source_size END, 6) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS fully FROM s4),
t AS (SELECT *, target - fully * source_size AS rest FROM s5),
p AS (SELECT *, draw % {BLOCKS} AS block, (draw // {BLOCKS}) % {BLOCKS} AS fine FROM (SELECT *, {hash60_sql(f"'{SEED}'", 'doc_id')} AS draw FROM z)),
c0 AS (SELECT source, block, sum(size) AS words FROM p GROUP BY source, block),
c1 AS (SELECT c0.*, t.source_size, target, fully, rest, sum(words) OVER (PARTITION BY c0.source
  ORDER BY {hash60_sql(f"'{SEED}'", "'block'", "coalesce(c0.source, chr(0))", 'block')}, block ROWS UNBOUNDED PRECEDING) AS fin
  FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, fin <= rest AS inside, fin > rest AND fin - words < rest AS border, rest - (fin - words) AS room,
  {hash60_sql(f"'{SEED}'", "'block'", "coalesce(source, chr(0))", 'block')} AS ord FROM c1),
{_fill_sql(FILLS)},
c AS (SELECT * FROM fill{FILLS}),
e AS (SELECT p.*, c.room FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.block = c.block WHERE c.border),
f0 AS (SELECT source, block, fine, sum(size) AS words, max(room) AS room FROM e GROUP BY source, block, fine),
f1 AS (SELECT *, sum(words) OVER (PARTITION BY source, block ORDER BY {hash60_sql(f"'{SEED}'", "'fine'", "coalesce(source, chr(0))", 'fine')}, fine ROWS UNBOUNDED PRECEDING) AS fin FROM f0),
f AS (SELECT *, fin <= room AS finside, fin > room AND fin - words < room AS fborder, room - (fin - words) AS last FROM f1),
k AS (SELECT doc_id, finside OR (fborder AND sum(size) OVER (PARTITION BY e.source, e.block, e.fine ORDER BY size, draw, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 <= last) AS picked
  FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.block = f.block AND e.fine = f.fine),
d AS (SELECT p.doc_id, p.source, p.block, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE fully + CASE WHEN inside OR coalesce(picked, false) THEN 1 ELSE 0 END END AS n_copies
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.block = c.block LEFT JOIN k ON p.doc_id = k.doc_id),
units0 AS (SELECT source, block, unnest(generate_series(1, CAST(fully + CASE WHEN inside OR border THEN 1 ELSE 0 END AS BIGINT))) AS copy, 0 AS shard FROM c),
{_tree_sql(LEVELS)}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * n_copies AS BIGINT) AS taken, CAST(n_copies AS BIGINT) AS n_copies,
  coalesce((SELECT string_agg(CAST(shard AS VARCHAR), ',' ORDER BY copy) FROM units{LEVELS} u
    WHERE u.source IS NOT DISTINCT FROM d.source AND u.block = d.block AND u.copy <= d.n_copies), '') AS shards
FROM d"""
