"""Greedy choice of groups that share no k-mer, in rounds.

The sequential rule takes candidates by coverage, then length, then key, and
drops those that share a k-mer with one taken before. A round takes every
candidate that comes first at all its k-mers and drops the rivals of those
taken; repeated until none is left this gives the same groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.recode import recoded
from kmerloom.operators.kmers import distinct_kmers
from kmerloom.plans.checkpoints import cut

ORDER = ["coverage desc", "raw_len desc", "lk", "rk"]


def overlap_kmers(obs: DataFrame, k: int, scheme: str) -> DataFrame:
    """(lk, rk, kmer) of all selected observations; ``k`` is the overlap length."""
    return distinct_kmers(obs.select("lk", "rk", recoded(F.col("block"), scheme).alias("code")), ["lk", "rk"], k)


def nonoverlapping(cands: DataFrame, kmers: DataFrame) -> DataFrame:
    """The candidates kept; those without k-mers always are."""
    turn = F.struct((-F.col("coverage")).alias("c"), (-F.col("raw_len")).alias("l"), "lk", "rk").alias("turn")
    active = cut(kmers.join(cands, ["lk", "rk"]).select(turn, "kmer"))
    won = cands.join(kmers.select("lk", "rk").distinct(), ["lk", "rk"], "left_anti").select(turn)
    while active.limit(1).count():
        first = active.groupBy("kmer").agg(F.min("turn").alias("first"))
        winners = cut(active.join(first, "kmer").groupBy("turn").agg(F.bool_and(F.col("turn") == F.col("first")).alias("wins")).where("wins").select("turn"))
        won = won.unionByName(winners)
        taken = active.join(winners, "turn", "left_semi").select("kmer").distinct()
        losers = active.join(taken, "kmer", "left_semi").select("turn").distinct()
        active = cut(active.join(losers, "turn", "left_anti"))
    keys = won.select("turn.lk", "turn.rk")
    return cands.join(keys, ["lk", "rk"], "left_semi")


def nonoverlapping_fold(cands: pd.DataFrame, kmers: pd.DataFrame) -> list[tuple[int, int]]:
    """The sequential rule on small tables; the rounds are tested against it."""
    by_key = {k: set(v) for k, v in kmers.groupby(["lk", "rk"])["kmer"]}
    used: set[int] = set()
    kept = []
    for r in sorted(cands.itertuples(), key=lambda r: (-r.coverage, -r.raw_len, r.lk, r.rk)):
        own = by_key.get((r.lk, r.rk), set())
        if not own & used:
            kept.append((r.lk, r.rk))
            used |= own
    return kept
