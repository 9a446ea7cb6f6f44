"""Exact duplicates by two passes over a Bloom filter of counts.

Pass one sets ``n_hashes`` bits per text hash and keeps the bits that were hit at least
twice. Pass two tests every row against them on the map side: a row with one bit hit only
once is certainly unique and passes straight through; only the others shuffle (id and
digest, never the text) and are grouped.

The filter has ``filter_bits`` bits, so at most ``filter_bits / 8`` bytes are broadcast
whatever the input. More rows than it can tell apart only send more digests to the
shuffle; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.bits import filter_of, with_test
from barline.llm.common import SPACES, keep_table, whole

def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; a null as the empty text."""
    return F.regexp_replace(whole(text), SPACES, " ")


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bits: int = 1 << 26,
    n_hashes: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised forms are (by SHA-256). Null and empty texts are
    equal to each other. The smallest id of a group stays; null ids come last. Rows that
    repeat an id are copies of each other and share its decision. An empty table gives an
    empty table; other columns are ignored.
    """
    digests = keep_table(
        docs.select(docs[id_col].alias("id"), F.sha2(normalised(docs[text_col]), 256).alias("digest")), "digests"
    )
    repeated = filter_of(digests, ["digest"], filter_bits, n_hashes, at_least=2)
    rows = with_test(digests, ["digest"], repeated, "suspect", filter_bits, n_hashes)
    suspects = rows.filter("suspect").select("id", "digest")
    groups = suspects.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = suspects.join(groups, "digest")
    alone = rows.filter("NOT suspect").select(
        "digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, all columns as they were; ids are taken to be unique."""
    dropped = mark_copies(docs, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("__dropped"))
    return docs.join(dropped, docs[id_col] == dropped["__dropped"], "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)"""
