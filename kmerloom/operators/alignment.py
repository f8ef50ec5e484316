"""Columns of each group that go to the alignment, and the alignment of all groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.flat import ends_of, flat, strings
from kmerloom.operators.consensus import GROUP, column_majority, column_report, masked_rows
from kmerloom.params import Params
from kmerloom.plans.checkpoints import cut, small

#: Groups that are numbered by one task; ranges of so many about are numbered side by side.
RANGE = 1 << 16


def kept_columns(rows: DataFrame, groups: DataFrame, p: Params, n_species: int) -> DataFrame:
    """(group, col): middle columns from the first to the last polymorphic one that have enough species, then the tail.

    ``rows`` are masked; species without a row are missing in all columns of
    the group. Groups without such a polymorphic column have no row.
    """
    absent = F.lit(n_species) - F.col("there")
    fine = column_report(rows, p.recode).join(groups.select(*GROUP, "raw_len"), GROUP).where(F.col("missing") + absent <= p.max_missing(n_species))
    right = F.col("raw_len") - p.k
    middle = fine.where((F.col("col") >= p.k) & (F.col("col") < right))
    ends = middle.where("n_states > 1").groupBy(*GROUP).agg(F.min("col").alias("first"), F.max("col").alias("last"))
    inside = F.col("col").between(F.col("first"), F.col("last")) & (F.col("col") >= p.k) & (F.col("col") < right)
    tail = (F.col("col") >= right) & (F.col("col") < right + min(p.tail, p.k))
    return fine.join(ends, GROUP).where(inside | tail).select(*GROUP, "col")


def group_columns(rows: DataFrame, groups: DataFrame, p: Params, n_species: int) -> DataFrame:
    """(group, sid, seq): the kept columns of each row, after masking."""
    masked = masked_rows(rows, column_majority(rows, p.recode), p.mask, p.recode)
    cols = kept_columns(masked, groups, p, n_species).groupBy(*GROUP).agg(F.array_sort(F.collect_list("col")).alias("cols"))  # raw_len at most
    schema = T.StructType([*(rows.schema[n] for n in (*GROUP, "sid")), T.StructField("seq", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat(batch.column(3))
            sizes, at = np.diff(batch.column(4).offsets.to_numpy()), batch.column(4).flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            row, at = row[at < np.diff(ends)[row]], at[at < np.diff(ends)[row]]
            seq = strings(data[ends[row] + at], ends_of(np.bincount(row, minlength=len(sizes))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], seq], names=schema.names)

    return masked.join(small(cut(cols)), GROUP).select(*GROUP, "sid", "block", "cols").mapInArrow(run, schema)


def reachable(rows: DataFrame, coverage: DataFrame, p: Params, n_species: int) -> DataFrame:
    """``rows`` of the groups that can keep a column at all: ``coverage`` (group, coverage) species have them, the others are missing everywhere."""
    enough = coverage.where(F.lit(n_species) - F.col("coverage") <= p.max_missing(n_species)).select(*GROUP)
    return rows.join(small(enough), GROUP, "left_semi")


def ranked(groups: DataFrame) -> DataFrame:
    """Groups with their place in candidate order: ranges of groups are numbered side by side, then shifted by the ranges before."""
    order = [F.desc("coverage"), F.desc("raw_len"), F.asc("lk"), F.asc("rk")]
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(groups.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))  # ranges are sampled: once
    local = parted.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row a range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))
    return local.join(F.broadcast(bases), "part").withColumn("rank", (F.col("base") + F.col("local")).cast("long")).drop("part", "local", "base")


def partitions(columns: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(rank, start_pos, end_pos, length, label, and the group), positions counted from 0, both ends inclusive.

    Ranks of groups without kept columns are passed over; positions are summed
    up within ranges of ranks and over the ranges.
    """
    sizes = columns.groupBy(*GROUP).agg(F.max(F.length("seq")).alias("length"))
    rows = ranked(groups).join(sizes, GROUP).join(labels, GROUP, "left").withColumn("part", F.floor(F.col("rank") / RANGE))
    upto = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("part").agg(F.sum("length").alias("total"))  # one row for RANGE groups
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("end", F.sum("length").over(upto)).join(F.broadcast(totals.select("part", before.alias("base"))), "part")
    end = F.col("base") + F.col("end")
    return placed.select("rank", (end - F.col("length")).alias("start_pos"), (end - 1).alias("end_pos"), F.col("length").cast("long").alias("length"), F.coalesce("label", F.lit("")).alias("label"), *GROUP)


def aligned(columns: DataFrame, parts: DataFrame, species: DataFrame) -> DataFrame:
    """(sid, seq): the kept columns of all groups in candidate order, gaps where a species has no row; empty without any.

    ``parts`` are the :func:`partitions`. A row is one species' alignment, the result itself.
    """
    total = parts.agg(F.coalesce(F.max("end_pos") + 1, F.lit(0)).cast("int").alias("total"))
    piece = F.struct(F.col("start_pos").cast("int").alias("at"), (F.col("end_pos") + 1).cast("int").alias("end"), "seq")
    own = columns.join(small(parts.select(*GROUP, "start_pos", "end_pos")), GROUP).groupBy("sid").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    rows = species.select("sid").join(own, "sid", "left").crossJoin(F.broadcast(total))  # the total is one row
    end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("p", F.greatest(i, F.lit(1)))["end"])
    filled = F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("-"), x["at"] - end_before(i)), x["seq"]))
    last = F.when(F.size("p") > 0, F.element_at("p", -1)["end"]).otherwise(0)
    seq = F.concat(F.array_join(filled, ""), F.repeat(F.lit("-"), F.col("total") - last))
    return rows.select("sid", F.coalesce(seq, F.repeat(F.lit("-"), F.col("total"))).alias("seq"))


def gaps(seq: Column | str) -> Column:
    """Gaps and ambiguous residues."""
    return F.length(seq) - F.length(F.translate(seq, "-X", ""))


def percent(missing: Column, size: Column) -> Column:
    return F.lit(100.0) * missing / F.greatest(size, F.lit(1))


def missing_percent(alignment: DataFrame) -> DataFrame:
    """(sid, pct_missing) with gaps and ambiguous residues."""
    return alignment.select("sid", percent(gaps("seq"), F.length("seq")).alias("pct_missing"))
