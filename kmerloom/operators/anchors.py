"""Anchors at the edges of conserved stretches, and the blocks between two of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.flat import counting, ends_of, flat, strings
from kmerloom.operators import kmers
from kmerloom.operators.kmers import SEGMENT

#: Starts closer than this to the first of their cluster belong to it.
CLUSTER = 10


def boundaries(hits: DataFrame) -> DataFrame:
    """``hits`` with is_start and is_end: the next, or previous, hit of the segment has lower occupancy."""
    w = Window.partitionBy(*SEGMENT).orderBy("start")
    before = F.when(F.lag("start").over(w) == F.col("start") - 1, F.lag("occ").over(w)).otherwise(0)
    after = F.when(F.lead("start").over(w) == F.col("start") + 1, F.lead("occ").over(w)).otherwise(0)
    before, after = F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))
    return hits.withColumn("is_start", (F.col("start") < F.col("n_hits") - 1) & (after < F.col("occ"))).withColumn("is_end", (F.col("start") > 0) & (before < F.col("occ")))


def clustered_starts(starts: DataFrame, span: int = CLUSTER) -> DataFrame:
    """Of each cluster of starts the one with the highest occupancy, the leftmost of equals.

    A cluster opens at its first start and takes those less than ``span`` after
    it; the next start opens another. One fold per segment.
    """
    item = "struct<start:int,occ:bigint,kmer:bigint>"
    ordered = F.array_sort(F.collect_list(F.struct("start", "occ", "kmer")))
    rows = starts.groupBy(*SEGMENT).agg(ordered.alias("s"))
    zero = F.struct(F.lit(None).cast("int").alias("opened"), F.lit(None).cast(item).alias("best"), F.array().cast(f"array<{item}>").alias("out"))

    def step(a, x):
        joins = a["opened"].isNotNull() & (x["start"] < a["opened"] + span)
        best = F.when(joins & (x["occ"] <= a["best"]["occ"]), a["best"]).otherwise(x)
        done = F.when(joins | a["opened"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["best"])))
        return F.struct(F.when(joins, a["opened"]).otherwise(x["start"]).alias("opened"), best.alias("best"), done.alias("out"))

    picked = F.aggregate("s", zero, step, lambda a: F.concat(a["out"], F.array(a["best"])))
    return rows.select(*SEGMENT, F.explode(picked).alias("p")).select(*SEGMENT, "p.start", "p.occ", "p.kmer")


def anchor_pairs(starts: DataFrame, ends: DataFrame, k: int, length_middle: int) -> DataFrame:
    """(segment, start, lk, rk, right): each start with the best end in reach, highest occupancy, then nearest."""
    right = ends.select(*SEGMENT, F.col("start").alias("right"), F.col("occ").alias("r_occ"), F.col("kmer").alias("rk"))
    middle = F.col("right") - F.col("start") - k
    reached = starts.select(*SEGMENT, "start", F.col("kmer").alias("lk")).join(right, SEGMENT).where((middle > 0) & (middle <= length_middle))
    best = F.max_by(F.struct("rk", "right"), F.struct(F.col("r_occ"), -F.col("right"))).alias("b")
    return reached.groupBy(*SEGMENT, "start", "lk").agg(best).select(*SEGMENT, "start", "lk", "b.rk", "b.right")


def observations(segs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(lk, rk, sid, protein_id, seg_id, start, len, block): the residues from the left anchor to the end of the right."""
    size = F.col("right") + k - F.col("start")
    return pairs.join(segs.select(*SEGMENT, "aa"), SEGMENT).select(
        "lk", "rk", *SEGMENT, "start", size.alias("len"), F.col("aa").substr(F.col("start") + 1, size).alias("block")
    )


def hits(segs: DataFrame, k: int, min_needed: int) -> DataFrame:
    """The :func:`boundaries` of all shared hits, by joins; for k-mers too long for a table."""
    return boundaries(kmers.shared_hits(segs, kmers.shared(kmers.occupancy(segs, k), min_needed), k))


def _shared_table(segs: DataFrame, k: int, min_needed: int):
    """The occupancy of every k-mer, 0 of those not shared, sent to the workers."""
    table = kmers.occupancy_table(segs, k)
    table[table < min_needed] = 0
    return segs.sparkSession.sparkContext.broadcast(table)


def _edges(codes: pa.Array, table: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, value, occ, is_start, is_end) of the k-mers at edges."""
    data, ends = flat(codes)
    row, start, value = kmers.rolled(data, ends, k, kmers.STATES)
    occ = table[value]
    last = start == (np.diff(ends) - k)[row]
    is_start = (occ > 0) & ~last & (np.append(occ[1:], table.dtype.type(0))[: len(occ)] < occ)
    is_end = (occ > 0) & (start > 0) & (np.append(table.dtype.type(0), occ[:-1])[: len(occ)] < occ)
    at = np.flatnonzero(is_start | is_end)
    return row[at], start[at], value[at], occ[at].astype(np.int64), is_start[at], is_end[at]


def _long(segs: DataFrame, k: int) -> DataFrame:
    return segs.where(F.length("code") >= 2 * k + 1)


def edges(segs: DataFrame, k: int, min_needed: int) -> DataFrame:
    """(segment, start, kmer, occ, is_start, is_end): shared hits at an edge, segment by segment with one table of all k-mers."""
    if not kmers.dense(k):
        return hits(segs, k, min_needed).where("is_start or is_end").select(*SEGMENT, "start", "kmer", "occ", "is_start", "is_end")
    sent = _shared_table(segs, k, min_needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, value, occ, is_start, is_end = _edges(batch.column(3), sent.value, k)
            ids = [c.take(pa.array(row)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(kmers.octal(value, k)), pa.array(occ), pa.array(is_start), pa.array(is_end)], names=schema.names)

    fields = [T.StructField("start", T.IntegerType()), T.StructField("kmer", T.LongType()), T.StructField("occ", T.LongType()), T.StructField("is_start", T.BooleanType()), T.StructField("is_end", T.BooleanType())]
    schema = T.StructType([*(segs.schema[c] for c in SEGMENT), *fields])
    return _long(segs, k).select(*SEGMENT, "code").mapInArrow(run, schema)


def _cluster_heads(place: np.ndarray, occ: np.ndarray, span: int) -> np.ndarray:
    """Of ascending places, the segments' far apart, which :func:`clustered_starts` picks."""
    following = np.searchsorted(place, place + span)
    opens = np.zeros(len(place) + 1, bool)
    opens[:1] = True
    opens[1:-1] = np.diff(place) >= span  # no cluster before reaches these: they open one in any case
    at = np.flatnonzero(opens[:-1])
    while len(at):
        at = following[at]
        at = at[~opens[at] & (at < len(place))]
        opens[at] = True
    cluster = np.cumsum(opens[:-1])
    order = np.lexsort((place, -occ, cluster))
    return np.sort(order[np.append(True, np.diff(cluster[order]) > 0)]) if len(place) else order


def _best_ends(starts: np.ndarray, ends: np.ndarray, occ: np.ndarray, k: int, length_middle: int) -> np.ndarray:
    """For each start the number of the best end in reach, highest occupancy, then nearest; -1 without."""
    lo, hi = np.searchsorted(ends, starts + k, "right"), np.searchsorted(ends, starts + k + length_middle, "right")
    best = np.where(hi > lo, lo, -1)
    for j in range(1, int((hi - lo).max(initial=0))):
        more = np.flatnonzero(hi - lo > j)
        better = more[occ[lo[more] + j] > occ[best[more]]]
        best[better] = lo[better] + j
    return best


def observed(segs: DataFrame, k: int, min_needed: int, length_middle: int, clustered: bool = True) -> DataFrame:
    """The :func:`observations` of all segments: starts, clustered or not, with their best ends.

    With a table of all k-mers a segment's rows are made where it lies, and nothing but the table's marks is dealt out.
    """
    if not kmers.dense(k):
        found = hits(segs, k, min_needed)
        starts = found.where("is_start")
        return observations(segs, anchor_pairs(clustered_starts(starts) if clustered else starts, found.where("is_end"), k, length_middle), k)
    sent = _shared_table(segs, k, min_needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, value, occ, is_start, is_end = _edges(batch.column(3), sent.value, k)
            aa, begins = flat(batch.column(4))
            place = row * (int(start.max(initial=0)) + k + length_middle + CLUSTER + 1) + start
            s, e = np.flatnonzero(is_start), np.flatnonzero(is_end)
            s = s[_cluster_heads(place[s], occ[s], CLUSTER)] if clustered else s
            best = _best_ends(place[s], place[e], occ[e], k, length_middle)
            s, e = s[best >= 0], e[best[best >= 0]]
            size = start[e] + k - start[s]
            ids, stops = [c.take(pa.array(row[s])) for c in batch.columns[:3]], ends_of(size)
            block = strings(aa[np.repeat(begins[row[s]] + start[s], size) + counting(size)], stops)
            lk, rk = (pa.array(kmers.octal(value[x], k)) for x in (s, e))
            yield pa.RecordBatch.from_arrays([lk, rk, *ids, pa.array(start[s].astype(np.int32)), pa.array(size.astype(np.int32)), block], names=schema.names)

    keys = [T.StructField("lk", T.LongType()), T.StructField("rk", T.LongType())]
    rest = [T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("block", T.StringType())]
    schema = T.StructType([*keys, *(segs.schema[c] for c in SEGMENT), *rest])
    return _long(segs, k).select(*SEGMENT, "code", "aa").mapInArrow(run, schema)
