"""Segments of valid residues, their k-mers and in how many species each occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kmerloom.functions.flat import counting, ends_of, flat, numbered, runs, slices, strings
from kmerloom.functions.recode import LETTERS, states

SEGMENT = ["sid", "protein_id", "seg_id"]
#: Rows of one output batch.
_ROWS = 1 << 18
#: Up to so many k-mers that there can be, their occupancy is one table; it is made in pieces, of at most HELD species at a time in a task.
STATES, DENSE, PIECE, HELD = 6, 1 << 24, 1 << 15, 8


def segments(proteins: DataFrame, scheme: str = "sr6", least: int = 1) -> DataFrame:
    """(sid, protein_id, seg_id, aa, code): maximal runs of valid residues of ``seq``, at least ``least`` long."""
    state = np.arange(256, dtype=np.uint8)
    state[[ord(c) for c in LETTERS]] = [ord(c) for c in states(scheme)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                row, number, sizes, aa = runs(*flat(part.column(2)), least)
                ids, ends = [c.take(pa.array(row)) for c in part.columns[:2]], ends_of(sizes)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(number.astype(np.int32)), strings(aa, ends), strings(state[aa], ends)], names=[*SEGMENT, "aa", "code"])

    text = [T.StructField(n, T.StringType()) for n in ("aa", "code")]
    schema = T.StructType([proteins.schema["sid"], proteins.schema["protein_id"], T.StructField("seg_id", T.IntegerType()), *text])
    return proteins.select("sid", "protein_id", "seq").mapInArrow(run, schema)


def packed(digits: Column) -> Column:
    """State digits as an octal number: three bits a state, 63 bits for the longest k-mer."""
    return F.conv(digits, 8, 10).cast("long")


def unpacked(kmer: Column, k: int) -> Column:
    return F.lpad(F.conv(kmer.cast("string"), 10, 8), k, "0")


def rolled(data: np.ndarray, ends: np.ndarray, k: int, base: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every k-mer of the codes that :func:`flat` took apart: the number of its code, its start there and its value, digits to ``base``."""
    digits = (data - np.uint8(ord("0"))).astype(np.int64)
    value, have, block, span = np.zeros(len(digits) + 1, np.int64), 0, digits, 1
    while have < k and len(digits) >= k:  # windows of 1, 2, 4, ... digits make up those of k
        if k & span:
            n = len(digits) - have - span + 1
            value, have = value[:n] * base**span + block[have : have + n], have + span
        if have < k:
            n = len(digits) - 2 * span + 1
            block, span = block[:n] * base**span + block[span : span + n], 2 * span
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    row, start = np.repeat(np.arange(len(counts)), counts), counting(counts)
    return row, start, value[ends[row] + start]


def kmer_rows(segs: DataFrame, k: int) -> DataFrame:
    """(sid, protein_id, seg_id, n_hits, start, kmer) of every k-mer of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat(batch.column(3))
            row, start, value = rolled(data, ends, k)
            n = (np.diff(ends) - k + 1).astype(np.int32)
            for at in range(0, len(row), _ROWS):
                cut = slice(at, at + _ROWS)
                ids = [c.take(pa.array(row[cut])) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n[row[cut]]), pa.array(start[cut].astype(np.int32)), pa.array(value[cut])], names=[*SEGMENT, "n_hits", "start", "kmer"])

    schema = T.StructType([*(segs.schema[c] for c in SEGMENT), T.StructField("n_hits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("kmer", T.LongType())])
    return segs.where(F.length("code") >= k).select(*SEGMENT, "code").mapInArrow(run, schema)


def distinct_kmers(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, kmer): each k-mer of the ``code`` of a key's rows once; a task sends it once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, value = rolled(*flat(batch.column(len(keys))), k)
            if len(row):
                key, one = numbered(*batch.columns[: len(keys)])
                order = np.lexsort((value, key[row]))
                s, v = key[row][order], value[order]
                first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])))
                columns = [c.take(pa.array(one[s[first]])) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(v[first])], names=[*keys, "kmer"])

    schema = T.StructType([*(rows.schema[n] for n in keys), T.StructField("kmer", T.LongType())])
    return rows.where(F.length("code") >= k).select(*keys, "code").mapInArrow(run, schema).distinct()


def dense(k: int) -> bool:
    """Whether all k-mers that there can be have a place in one small table."""
    return STATES**k <= DENSE


def _occupancy_pieces(segs: DataFrame, k: int) -> DataFrame:
    """(piece, occ): the occupancy of all k-mers there can be, four bytes each, PIECE of them a row, by their value to base STATES.

    A task marks what it has seen of a species in bits and sends these, so that no row is made for a k-mer.
    """
    pieces = -(-(STATES**k) // PIECE)

    def sent(seen: dict) -> Iterator[pa.RecordBatch]:
        for sid, marks in seen.items():
            bits = np.packbits(marks.reshape(pieces, PIECE), axis=1)
            some = np.flatnonzero(bits.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([sid] * len(some), kind), pa.array([b.tobytes() for b in bits[some]], pa.binary())], names=["piece", "sid", "bits"]
            )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            row, _, value = rolled(*flat(batch.column(1)), k, STATES)
            number, first = numbered(batch.column(0))
            for i, at in enumerate(first.tolist()):
                sid = batch.column(0)[at].as_py()
                if sid not in seen:
                    if len(seen) == HELD:
                        yield from sent(seen)
                        seen.clear()
                    seen[sid] = np.zeros(pieces * PIECE, bool)
                seen[sid][value[number[row] == i]] = True
        yield from sent(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(occ + np.unpackbits(bits)).astype("<u4").tobytes()], pa.binary())], names=["piece", "occ"])

        piece = None
        for batch in batches:
            for p, s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                if p != piece:
                    if piece is not None:
                        yield done()
                    piece, sid, bits, occ = p, s, own, np.zeros(PIECE, np.uint32)
                elif s != sid:
                    occ, sid, bits = occ + np.unpackbits(bits), s, own
                else:
                    bits = bits | own
        if piece is not None:
            yield done()

    field = segs.schema["sid"]
    kind = to_arrow_type(field.dataType)
    marks = segs.where(F.length("code") >= k).select("sid", "code").mapInArrow(mark, T.StructType([T.StructField("piece", T.IntegerType()), field, T.StructField("bits", T.BinaryType())]))
    return marks.repartition("piece").sortWithinPartitions("piece", "sid").mapInArrow(count, "piece int, occ binary")


def octal(value: np.ndarray, k: int) -> np.ndarray:
    """The packed k-mers of values to base STATES."""
    out, rest = np.zeros(len(value), np.int64), value.astype(np.int64)
    for j in range(k):
        out |= rest % STATES << 3 * j
        rest //= STATES
    return out


def occupancy_table(segs: DataFrame, k: int) -> np.ndarray:
    """The occupancy of each k-mer by its value to base STATES; ``k`` must be :func:`dense`. The table is as small for any input."""
    table = np.zeros(-(-(STATES**k) // PIECE) * PIECE, np.uint32)
    for r in _occupancy_pieces(segs, k).toLocalIterator():
        table[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["occ"], "<u4")
    return table.astype(np.min_scalar_type(table.max()))


def occupancy(segs: DataFrame, k: int) -> DataFrame:
    """(kmer, occ): the number of species with the k-mer, exact."""
    if not dense(k):
        return distinct_kmers(segs, ["sid"], k).groupBy("kmer").agg(F.count(F.lit(1)).alias("occ"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, occ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.frombuffer(occ, "<u4")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(octal(at + piece * PIECE, k)), pa.array(n[at].astype(np.int64))], names=["kmer", "occ"])

    return _occupancy_pieces(segs, k).mapInArrow(run, "kmer long, occ long")


def shared(occ: DataFrame, min_needed: int) -> DataFrame:
    return occ.where(F.col("occ") >= min_needed)


def shared_hits(segs: DataFrame, shared_occ: DataFrame, k: int) -> DataFrame:
    """Hits of shared k-mers in segments of at least 2k + 1 residues, with ``occ``.

    Others need no row: next to a shared hit they count as occupancy zero.
    """
    return kmer_rows(segs.where(F.length("code") >= 2 * k + 1), k).join(shared_occ, "kmer")
