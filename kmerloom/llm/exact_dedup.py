"""Exact duplicates by a two-pass Bloom filter, in DataFrame functions only.

The filter is cut into bitmaps; a text's hash belongs to one of them and has
two positions there. Pass 1 counts how often each position is hit and keeps
those hit twice or more. Pass 2 tests every row: a hash that occurs twice has
hit both its positions twice, so a row with an unset position is unique and
passes straight through. Only the others are shuffled by hash. The texts
themselves are read once and are never shuffled. The number of bitmaps follows
the number of rows, without an upper bound: while they are small enough they
are sent to the rows, beyond that the narrow rows of (id, hash) meet their
bitmap in a join by shard, which splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tables import bitmaps_for, filter_place, materialise, probe, text_of, with_groups, without


def normalised(text: str = "text") -> Column:
    """Text with each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def repeated_positions(hashes: DataFrame, digest: str, bitmaps: int) -> DataFrame:
    """Pass 1: (shard, bitmap) of the positions that at least two rows hit."""
    shard, places = filter_place(F.col(digest), bitmaps)
    hit = hashes.select(shard.alias("shard"), F.explode(F.array(*places)).alias("at"))
    twice = hit.groupBy("shard", "at").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy("shard").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bitmap"))


def mark_repeated(hashes: DataFrame, digest: str, rows: int, broadcast_bytes: int | None = None) -> DataFrame:
    """Pass 2: ``hashes`` with boolean ``maybe``, false only for digests that occur once."""
    n = bitmaps_for(rows)
    bitmaps = materialise(repeated_positions(hashes, digest, n), "bloom")
    return probe(hashes, F.col(digest), bitmaps, n, "maybe", broadcast_bytes)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null text counts as empty. The smallest id of equal texts stays; null ids
    stay only where all ids of the group are null. Rows that share an id and a
    text are one document: each reports the same answer, and group_size counts
    them all. Texts of any length are hashed whole. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    hashes = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest")), "hashes"
    )
    rows = hashes.count()
    marked = mark_repeated(hashes, "digest", rows, broadcast_bytes)
    again = materialise(marked.where("maybe").drop("maybe"), "maybe-repeated")
    groups = again.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    once = marked.where("not maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = with_groups(again, groups, ["digest"], "group_size", rows)
    return found.select("doc_id", "digest", "keep_id", "group_size").unionByName(once).select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, columns as before; rows that share an id stay if one of them does. Texts are not shuffled."""
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.groupBy(id_col).agg(F.bool_or("kept").alias("stays")).where("not stays").select(id_col)
    return without(docs, id_col, materialise(gone, "copies"))
