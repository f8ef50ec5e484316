"""Nucleotide sequences: complements, codons, translation, composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids of the bacterial code (table 11), codons in the order TCAG of each place.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
STOPS = ("TAA", "TAG", "TGA")
STARTS = {"ATG": 8, "GTG": 4, "TTG": 1}


def reverse_complement(seq: Column) -> Column:
    """The other strand; everything but A, C, G and T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def codons(seq: Column) -> Column:
    """Array of the whole codons in frame 0."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: seq.substr(i * 3 + 1, F.lit(3))))


def translated(seq: Column, force_initial_m: bool = False) -> Column:
    """Amino acids of the whole codons, X for ambiguous ones; M first if asked for."""
    table = F.create_map(*(F.lit(x) for pair in CODONS.items() for x in pair))
    out = F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")
    return F.when(F.length(out) > 0, F.concat(F.lit("M"), F.substring(out, 2, 1 << 30))).otherwise(out) if force_initial_m else out


def gc_fraction(seq: Column) -> Column:
    """G and C among A, C, G and T; 0.5 where there are none."""
    gc, acgt = (F.length(seq) - F.length(F.regexp_replace(seq, p, "")) for p in ("[GC]", "[ACGT]"))
    return F.when(acgt == 0, F.lit(0.5)).otherwise(gc / acgt)
