"""Proteins of bacterial genomes by scored open reading frames.

The composition of a whole genome is an aggregate; the rest is sequential
within a contig and runs as one function per contig.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.flat import ends_of, numbered
from kmerloom.functions.nucleotides import CODONS, STARTS, STOPS
from kmerloom.plans.checkpoints import cut, small

# Lengths, distances and numbers of the scoring rules; here and in the functions below they must be as they are.
MIN_NT, MAX_OVERLAP, NEAR_STARTS, ALTERNATES, ALTERNATE_DROP = 270, 30, 12, 4, 6
GC_SAMPLE, LEAST_ACGT = 300_000, 0.5
#: Bytes of contigs that a task holds at a time to find the first ones.
HELD = 64 << 20
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_INDEX = {a + b + c: 16 * i + 4 * j + k for i, a in enumerate("ACGT") for j, b in enumerate("ACGT") for k, c in enumerate("ACGT")}


#: Each byte's base, 4 for other letters and 5 for N; each codon's kind by three of these.
_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[[ord(c) for c in "ACGTN"]] = 0, 1, 2, 3, 5
_START, _END = 1, 2
_KINDS = np.array([_END if "N" in c or c in STOPS else _START if c in STARTS else 0 for c in (x + y + z for x in "ACGT?N" for y in "ACGT?N" for z in "ACGT?N")], np.uint8)


@dataclass(frozen=True)
class Orf:
    """``begin`` and ``end`` on the forward strand, ``lo`` and ``hi`` on the strand scanned."""

    begin: int
    end: int
    strand: int
    lo: int
    hi: int
    open_end: bool
    score: int


def _div(a: int, b: int) -> int:
    """Integer division toward zero."""
    return int(a / b) if abs(a) < 1 << 50 else (abs(a) // b) * (1 if a > 0 else -1)


def gc_model(gc: float) -> tuple[int, int, int]:
    """Expected per mille of G and C in the three codon places, in single precision."""
    g, f = np.float32(gc), np.float32
    # fixed values: slope, intercept, least and largest share of each codon place
    fits = ((0.684392, 0.233505, 0.20, 0.90), (0.432433, 0.183878, 0.15, 0.75), (1.887194, -0.394644, 0.05, 0.98))
    return tuple(int(math.floor(float(min(max(f(a) * g + f(b), f(lo)), f(hi)) * f(1000)) + 0.5)) for a, b, lo, hi in fits)


def reverse_complement(seq: str) -> str:
    return "".join(c if c in "ACGT" else "N" for c in seq).translate(_COMPLEMENT)[::-1]


def shine_dalgarno(seq: str, start: int) -> int:
    if start < 8:
        return 0
    lo, hi = max(0, start - 20), start - 4
    best = 0
    for at in range(lo, hi):
        local = size = 0
        five = seq[at : at + 5]
        if at + 5 <= hi and len(five) == 5:
            same = sum(x == y for x, y in zip(five, "AGGAG", strict=True))
            local, size = (5, 5) if same == 5 else (3, 5) if same == 4 else (0, 0)
        if not local and at + 4 <= hi and all(c in "AG" for c in seq[at : at + 4]):
            local, size = 1, 4
        if local:
            gap = start - (at + size)
            best = max(best, local + (2 if 6 <= gap <= 10 else 1 if gap in (5, 11) else 0))
    return best


def length_score(nt: int) -> int:
    aa = nt // 3
    return -20 if aa < 20 else 60 * aa // (aa + 80)


def start_term(score: int, nt: int) -> int:
    if nt >= 600:
        return min(max(_div(score, 2), -6), 7)
    if nt >= 300:
        return min(max(_div(2 * score, 3), -8), 9)
    return min(max(score, -10), 10)


def composition_score(seq: str, model: tuple[int, int, int]) -> int:
    n = len(seq) // 3
    if n < 20:
        return 0
    off = [abs(sum(seq[k : 3 * n : 3].count(c) for c in "GC") * 1000 // n - model[k]) for k in range(3)]
    return 90 - (off[0] + off[1] + 2 * off[2]) // 25 + min(n, 400) // 40


def _sparse_starts(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(position, score) without near neighbours: a better one takes the place of the one kept."""
    kept: list[tuple[int, int]] = []
    for s in starts:
        near = next((i for i, k in enumerate(kept) if abs(s[0] - k[0]) < NEAR_STARTS), None)
        if near is None:
            kept.append(s)
        elif s[1] > kept[near][1]:
            kept[near] = s
    return kept


def _segment_orfs(seq: str, strand: int, end: int, open_end: bool, starts: list[tuple[int, int]], model: tuple[int, int, int]) -> list[Orf]:
    ranked = []
    for at, score in _sparse_starts(starts):
        nt = end - at
        if nt >= MIN_NT:
            total = length_score(nt) + composition_score(seq[at:end], model) + start_term(score, nt) - 8 * open_end
            ranked.append((-total, -score, seq[at : at + 3] != "ATG", -nt, at))
    ranked.sort()
    out = []
    for r in ranked[:ALTERNATES]:
        if r[0] - ranked[0][0] > ALTERNATE_DROP:
            break
        at = r[4]
        begin, stop = (at, end) if strand > 0 else (len(seq) - end, len(seq) - at)
        out.append(Orf(begin, stop, strand, at, end, open_end, -r[0]))
    return out


def strand_orfs(seq: str, strand: int, model: tuple[int, int, int]) -> list[Orf]:
    """The frames of one strand. Codons are classed all at once; only stretches long enough from their first start are scored."""
    out: list[Orf] = []
    digits = _DIGITS[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    kinds = _KINDS[(digits[:-2].astype(np.int16) * 36) + (digits[1:-1] * 6) + digits[2:]] if len(seq) > 2 else np.empty(0, np.uint8)
    for frame in range(3):
        last = frame + (len(seq) - frame) // 3 * 3
        own = kinds[frame:last:3]
        starts = frame + 3 * np.flatnonzero(own == _START)
        if not len(starts):
            continue
        ends = np.append(frame + 3 * np.flatnonzero(own == _END), last)
        begin = np.searchsorted(starts, np.append(frame, ends[:-1]))
        stop = np.searchsorted(starts, ends)
        first = starts[np.minimum(begin, len(starts) - 1)]
        for i in np.flatnonzero((stop > begin) & (ends - first >= MIN_NT)).tolist():
            found = [(at, STARTS[seq[at : at + 3]] + shine_dalgarno(seq, at)) for at in starts[begin[i] : stop[i]].tolist()]
            out += _segment_orfs(seq, strand, int(ends[i]), i == len(ends) - 1, found, model)
    return out


def _codon_counts(seq: str) -> np.ndarray:
    n = len(seq) // 3 * 3
    digits = _DIGITS[np.frombuffer(seq[:n].encode("latin-1", "replace"), np.uint8)].reshape(-1, 3).astype(np.int64)
    valid = digits[(digits < 4).all(1)]
    return np.bincount(valid @ np.array([16, 4, 1]), minlength=64)


def adaptive_model(orfs: list[Orf], strands: dict[int, str]) -> list[int] | None:
    """Log ratios of codon use in the better half of long complete frames to that of the whole contig."""
    long = [o for o in orfs if not o.open_end and o.hi - o.lo >= 360]
    if len(long) < 60:
        return None
    long.sort(key=lambda o: (-o.score, o.begin, o.strand))
    seed = long[: min(max(len(long) // 2, 60), len(long))]
    coding = 1 + sum(_codon_counts(strands[o.strand][o.lo : o.hi]) for o in seed)
    around = 1 + sum(_codon_counts(s) for s in strands.values())
    ratio = np.log2((coding / coding.sum()) / (around / around.sum())) * 1000
    return [int(min(max(x, -2200), 2200)) for x in ratio]


def adaptive_score(seq: str, model: list[int]) -> int:
    n = len(seq) // 3  # codons with ambiguous letters count, but add nothing
    if n < 35:
        return 0
    counts = _codon_counts(seq)
    return min(max(_div(_div(int((counts * np.array(model)).sum()), n), 25), -18), 18)


def choose(orfs: list[Orf]) -> list[Orf]:
    """Complete before open frames, then by score and length; none overlaps one chosen before by more than MAX_OVERLAP."""
    kept: list[Orf] = []
    for o in sorted(orfs, key=lambda o: (o.open_end, -o.score, -(o.end - o.begin), o.begin, o.strand)):
        if all(min(o.end, k.end) - max(o.begin, k.begin) <= MAX_OVERLAP for k in kept):
            kept.append(o)
    return kept


def contig_proteins(seq: str, model: tuple[int, int, int]) -> list[tuple[Orf, str]]:
    seq = seq.upper()
    if len(seq) < 3:
        return []
    strands = {1: seq, -1: reverse_complement(seq)}
    orfs = [o for strand, s in strands.items() for o in strand_orfs(s, strand, model)]
    if fit := adaptive_model(orfs, strands):
        orfs = [replace(o, score=o.score + adaptive_score(strands[o.strand][o.lo : o.hi], fit)) for o in orfs]
    out = []
    for o in choose(orfs):
        nt = strands[o.strand][o.lo : o.hi]
        out.append((o, "M" + "".join(CODONS.get(nt[i : i + 3], "X") for i in range(3, len(nt) - 2, 3))))
    return out


def _heads(contigs: DataFrame) -> DataFrame:
    """``contigs`` without those that can't be among the first GC_SAMPLE bases of their genome: what comes before in a task's own part is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            held = held.take(pc.sort_indices(held, [("sid", "ascending"), ("contig_id", "ascending")], null_placement="at_start"))
            size = pc.fill_null(pc.utf8_length(held.column(2)), 0).to_numpy().astype(np.int64)
            number, first = numbered(held.column(0))
            before = ends_of(size)[:-1]
            held = held.filter(pa.array(before - before[first][number] < GC_SAMPLE))
            if held.nbytes > HELD:
                yield held
                held = None
        if held is not None:
            yield held

    rows = contigs.select("sid", "contig_id", "seq")
    return rows.mapInArrow(run, rows.schema)


def genome_composition(contigs: DataFrame) -> DataFrame:
    """(sid, gc, acgt) over the first GC_SAMPLE bases of a genome's contigs in order of contig_id."""
    size = F.length("seq").cast("long")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("sid").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = _heads(contigs).withColumn("left", F.greatest(F.lit(0), F.lit(GC_SAMPLE) - before)).where("left > 0")
    part = head.withColumn("part", F.upper(F.expr("substring(seq, 1, cast(left as int))")))
    sums = part.groupBy("sid").agg(
        F.sum(F.length(F.regexp_replace("part", "[^GC]", ""))).alias("gc"), F.sum(F.length(F.regexp_replace("part", "[^ACGT]", ""))).alias("valid"), F.sum(F.length("part")).alias("total")
    )
    return sums.select("sid", F.when(F.col("valid") == 0, 0.5).otherwise(F.col("gc") / F.col("valid")).alias("gc"), F.when(F.col("total") == 0, 0.0).otherwise(F.col("valid") / F.col("total")).alias("acgt"))


def predict(contigs: DataFrame) -> DataFrame:
    """(sid, contig_id, place, begin, end, strand, score, seq) of the proteins of ``contigs`` (sid, contig_id, seq).

    Genomes with less than half A, C, G or T are an error.
    """
    bad = F.when(F.col("acgt") < LEAST_ACGT, F.raise_error(F.concat(F.lit("too few nucleotides in genome "), F.col("sid").cast("string")))).otherwise(F.col("gc"))
    genomes = small(cut(genome_composition(contigs))).select("sid", bad.alias("gc"))  # one row each
    rows = contigs.join(genomes, "sid").select("sid", "contig_id", "seq", "gc")

    def run(batches):
        for pdf in batches:
            out = []
            for sid, contig_id, seq, gc in zip(pdf.sid, pdf.contig_id, pdf.seq, pdf.gc, strict=True):
                found = enumerate(contig_proteins(seq or "", gc_model(gc)))
                out += [(sid, contig_id, n, o.begin, o.end, o.strand, o.score, protein) for n, (o, protein) in found]
            yield pd.DataFrame(out, columns=["sid", "contig_id", "place", "begin", "end", "strand", "score", "seq"])

    return rows.mapInPandas(run, "sid int, contig_id long, place int, begin int, end int, strand int, score int, seq string")


def as_proteins(predicted: DataFrame) -> DataFrame:
    """(sid, protein_id, name, seq): the proteins of each genome numbered through its contigs, in the order they were chosen."""
    order = Window.partitionBy("sid").orderBy("contig_id", "place")  # the genes of one genome
    numbered = predicted.withColumn("n", F.row_number().over(order))
    return numbered.select("sid", (F.col("n") - 1).cast("long").alias("protein_id"), F.concat(F.lit("protein_"), F.col("n").cast("string")).alias("name"), "seq")
