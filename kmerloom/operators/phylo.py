"""Distances between aligned species and a neighbour-joining tree."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.recode import LETTERS

#: One minus the sum of squared LG frequencies.
LG_SCALE = 0.940740913711
LIMIT = 0.999999999


def pairwise_distances(alignment: DataFrame, scale: float = LG_SCALE) -> DataFrame:
    """(i, j, valid, mismatches, d) for i < j: sites where both hold an amino acid, and -ln(1 - p / scale).

    Pairs of species are the result itself; nothing smaller would do.
    """
    a, b = (alignment.select(F.col("sid").alias(i), F.col("seq").alias(x)) for i, x in (("i", "x"), ("j", "y")))
    residue = np.zeros(256, bool)
    residue[[ord(c) for c in LETTERS]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for x, y in zip(*(batch.column(c).cast(pa.binary()) for c in (2, 3)), strict=True):  # a pair at a time, from where it lies
                x, y = (np.frombuffer(s.as_buffer(), np.uint8) for s in (x, y))
                n = min(len(x), len(y))
                valid = residue[x[:n]] & residue[y[:n]]
                counts.append((int(valid.sum()), int((valid & (x[:n] != y[:n])).sum())))
            valid, mismatches = np.array(counts, np.int32).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(valid), pa.array(mismatches)], names=["i", "j", "valid", "mismatches"])

    schema = T.StructType([T.StructField(n, alignment.schema["sid"].dataType) for n in ("i", "j")] + [T.StructField(n, T.IntegerType()) for n in ("valid", "mismatches")])
    pairs = a.join(b, F.col("i") < F.col("j")).select("i", "j", "x", "y")
    counted = pairs.mapInArrow(run, schema)
    share = F.least(F.col("mismatches") / F.col("valid") / scale, F.lit(LIMIT))
    return counted.withColumn("d", F.when(F.col("valid") == 0, F.lit(0.0)).otherwise(-F.log(F.lit(1.0) - share)))


def quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if re.search(r"[ :(),;]", name) else name


def newick(names: Sequence[str], distances: dict[tuple[int, int], float]) -> str:
    """The neighbour-joining tree of at least two names; ``distances`` has (i, j) with i < j."""
    n = len(names)
    if n < 2:
        raise ValueError("a tree needs two rows at least")
    text = {i: quoted(x) for i, x in enumerate(names)}
    d = {**distances, **{(j, i): v for (i, j), v in distances.items()}}
    active = list(range(n))
    while len(active) > 2:
        m = len(active)
        r = dict.fromkeys(active, 0.0)
        for i in active:  # plain additions in this order: sum() would compensate rounding
            for k in active:
                if k != i:
                    r[i] += d[i, k]
        best, pair = math.inf, (active[0], active[1])
        for x, i in enumerate(active):
            for j in active[x + 1 :]:
                q = (m - 2) * d[i, j] - r[i] - r[j]
                if q < best:
                    best, pair = q, (i, j)
        i, j = pair
        li = 0.5 * d[i, j] + (r[i] - r[j]) / (2 * (m - 2))
        lj = d[i, j] - li
        new = len(text)
        text[new] = f"({text[i]}:{max(li, 0.0):.6f},{text[j]}:{max(lj, 0.0):.6f})"
        for k in active:
            if k not in pair:
                d[new, k] = d[k, new] = 0.5 * (d[i, k] + d[j, k] - d[i, j])
        active = [k for k in active if k not in pair] + [new]
    i, j = active
    half = max(d[i, j] * 0.5, 0.0)
    return f"({text[i]}:{half:.6f},{text[j]}:{half:.6f});"


def tree_of(alignment: DataFrame, names: dict[int, str]) -> str:
    """Newick text of an alignment (sid, seq); rows must be of equal length. The matrix of species comes to the driver."""
    lengths = [r[0] for r in alignment.select(F.length("seq")).distinct().collect()]
    if len(lengths) > 1:
        raise ValueError("aligned rows differ in length")
    sids = sorted(names)
    at = {s: k for k, s in enumerate(sids)}
    found = {(at[r["i"]], at[r["j"]]): r["d"] for r in pairwise_distances(alignment).collect()}
    return newick([names[s] for s in sids], found)
