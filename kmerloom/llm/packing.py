"""Best-fit packing planned on the histogram of lengths.

Lengths are at most the capacity, so their histogram is of bounded size
however many documents there are. Best-fit decreasing runs over its counts and
gives intervals: so many pieces of one length go to consecutive sequences at
one offset. A piece takes its slot by its rank within its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import materialise
from kmerloom.llm.tokens import library_encoder, share_vocabulary, text_slices

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
_PLAN = "length long, rank_from long, n long, sequence_from long, offset long"


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence, offset) that pack all counts.

    Longest first, each into the fullest sequences that still have room; all
    sequences alike are filled in one step, so the number of intervals depends
    on the capacity and not on the counts.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        candidates = [r for r in rooms if r >= length and rooms[r]]
        heapq.heapify(candidates)
        while left:
            while candidates and not rooms[candidates[0]]:
                heapq.heappop(candidates)
            if not candidates:
                each = capacity // length
                for bins, fill in ((left // each, each), (1, left % each)):
                    if bins and fill:
                        plan += [(length, rank + k * bins, bins, opened, k * length) for k in range(fill)]
                        rank += bins * fill
                        rooms[capacity - fill * length].append((opened, bins))
                        opened += bins
                left = 0
                break
            room = candidates[0]
            first, bins = rooms[room].pop()
            take = min(bins, left)
            plan.append((length, rank, take, first, capacity - room))
            rank, left = rank + take, left - take
            if take < bins:
                rooms[room].append((first + take, bins - take))
            rooms[room - length].append((first, take))
            if room - length >= length:
                heapq.heappush(candidates, room - length)
    return plan


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their rank among the pieces of their length in their partition."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(shared), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = END_ID.to_bytes(4, "little")
        for batch, texts in text_slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                data = memoryview(ids + end)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null text counts as empty: one piece that holds the end id alone. Repeated
    rows and ids are packed each for itself. Documents longer than the capacity
    are cut, all others stay whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_documents(docs, id_col, text_col, capacity, vocabulary), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), _PLAN).withColumnRenamed("length", "slot_length")
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n"))
    # the plan's size is bounded by the capacity, whatever the number of documents
    return ranked.join(F.broadcast(plan), inside).select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )
