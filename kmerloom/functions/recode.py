"""Amino acids in reduced alphabets of six states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The amino acids and the state of each in every scheme.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
SCHEMES = {
    "dayhoff6": "10225134344212311455",
    "sr6": "04115153233102200345",
    "kgb6": "05114012122101101534",
}


def states(scheme: str) -> str:
    return SCHEMES[scheme.lower()]


def residues(seq: Column) -> Column:
    """Upper-case residues without white space; all that is no amino acid becomes a dot."""
    bare = F.regexp_replace(seq, "[ \\t\\n\\f\\r]", "")
    return F.regexp_replace(F.translate(bare, LETTERS.lower(), LETTERS), f"[^{LETTERS}]", ".")


def recoded(aa: Column, scheme: str) -> Column:
    """State digits of residues; other characters stay as they are, so digits must not occur."""
    return F.translate(aa, LETTERS, states(scheme))


def state_or_null(aa: Column, scheme: str) -> Column:
    """The state of one residue, null for gaps and ambiguous or unknown characters."""
    return F.when(F.lit(LETTERS).contains(aa) & (F.length(aa) == 1), recoded(aa, scheme))
