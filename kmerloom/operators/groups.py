"""Variant groups: one block length for each anchor pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_support(obs: DataFrame) -> DataFrame:
    """(lk, rk, len, coverage): species behind each block length."""
    return obs.select("lk", "rk", "len", "sid").distinct().groupBy("lk", "rk", "len").agg(F.count(F.lit(1)).alias("coverage"))


def candidates(support: DataFrame, min_needed: int, k: int) -> DataFrame:
    """(lk, rk, coverage, raw_len): the length with most species, if no other has as many and it has enough."""
    ties = F.count(F.lit(1)).over(Window.partitionBy("lk", "rk", "coverage"))
    best = support.withColumn("ties", ties).groupBy("lk", "rk").agg(F.max(F.struct("coverage", "len", "ties")).alias("m"))
    return best.where((F.col("m.ties") == 1) & (F.col("m.coverage") >= min_needed) & (F.col("m.len") >= 2 * k + 1)).select(
        "lk", "rk", F.col("m.coverage").alias("coverage"), F.col("m.len").alias("raw_len")
    )


def selected(obs: DataFrame, cands: DataFrame) -> DataFrame:
    """Observations of the candidates' lengths."""
    keep = cands.select("lk", "rk", F.col("raw_len").alias("len"))
    return obs.join(keep, ["lk", "rk", "len"], "left_semi")
