"""Tables written between the passes of an operator.

They go to the folder that ``spark.checkpoint.dir`` names, which all executors
share, so a lost executor costs a re-read and never a wrong result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is sent to all executors at most: tables that grow with the data are broadcast only if their size, known before, is no more.
BROADCAST_BYTES = 32 << 20
#: A group is hot with so many rows at least and one in so many of all: there are never more hot groups than the second.
HOT_ROWS, HOT_GROUPS = 256, 10_000
#: Bits of one bitmap (what ``bitmap_construct_agg`` makes), and of a filter for each key.
BITMAP_BITS, BITS_PER_KEY = 32768, 16

#: Rows that a Python worker is sent at once: whole texts are held several times on the way, by the executor and by the worker.
BATCH_ROWS, _BATCH_ROWS = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is set, which a cluster does not allow."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by :func:`release`."""
    path = f"{shared_root(spark)}/kmerloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_quietly, spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get BATCH_ROWS rows at once at most by what runs inside; the session's own setting holds again after."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every path of :func:`scratch` in this application."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def _release_quietly(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the gateway may be gone while Python ends
            pass


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to what ``groups`` (one row a group, ``size`` its number of rows) says of their group.

    The rows of hot groups, at most HOT_GROUPS of them, meet a broadcast where
    they lie; only the others are dealt out by their key. Null keys join nothing.
    """
    least = max(HOT_ROWS, total // HOT_GROUPS)
    hot, cold = F.broadcast(groups.where(F.col(size) >= least)), groups.where(F.col(size) < least)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def bitmaps_for(keys: int) -> int:
    """How many bitmaps a filter of so many keys has."""
    return max(1, -(-keys * BITS_PER_KEY // BITMAP_BITS))


def filter_place(key: Column, bitmaps: int) -> tuple[Column, list[Column]]:
    """The bitmap that is asked about a key, and its two positions there."""
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(bitmaps)), [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITMAP_BITS)).cast("int") for seed in (1, 2)]


def bit_of(bitmap: str, at: Column) -> Column:
    byte = F.conv(F.hex(F.col(bitmap).substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1


def probe(rows: DataFrame, key: Column, bitmaps: DataFrame, n: int, flag: str, broadcast_bytes: int | None = None) -> DataFrame:
    """``rows`` with boolean ``flag``: both positions of ``key`` are set in ``bitmaps`` (shard, bitmap).

    The bitmaps go to the rows if all of them are small enough to be sent, else the rows meet theirs in a join by shard.
    """
    own, other, bitmap = fresh(rows.columns, "shard", "of_bitmap", "bitmap")
    shard, places = filter_place(key, n)
    side = bitmaps.select(F.col("shard").alias(other), F.col("bitmap").alias(bitmap))
    if n * BITMAP_BITS // 8 <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        side = F.broadcast(side)
    joined = rows.withColumn(own, shard).join(side, F.col(own) == F.col(other), "left")
    hit = F.col(bitmap).isNotNull() & bit_of(bitmap, places[0]) & bit_of(bitmap, places[1])
    return joined.withColumn(flag, hit).drop(own, other, bitmap)


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, flag: str, broadcast_bytes: int | None = None) -> DataFrame:
    """``rows`` with boolean ``flag``, false only where ``key`` is not in the one column of ``ids``; no row is moved.

    A Bloom filter of the ids is sent to the rows. Where it is too large for that all flags are true.
    """
    ids = ids.toDF("id")
    n = bitmaps_for(ids.count())
    if n * BITMAP_BITS // 8 > (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return rows.withColumn(flag, F.lit(True))
    shard, places = filter_place(F.col("id"), n)
    bitmaps = ids.select(shard.alias("shard"), F.explode(F.array(*places)).alias("at")).groupBy("shard").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bitmap"))
    return probe(rows, F.col(key), materialise(bitmaps, "id-filter"), n, flag, broadcast_bytes)


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of the one column of ``gone``; only rows that may have such an id are dealt out."""
    flag, other = fresh(docs.columns, "maybe", "gone")
    gone = gone.toDF(other)
    marked = maybe_in(docs, id_col, gone, flag)
    rest = marked.where(flag).join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(other)), "left_anti")
    return marked.where(~F.col(flag)).unionByName(rest).drop(flag)


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(taken: Iterable[str], *names: str):
    """``names`` with underscores in front until none is among ``taken``, whatever its case; a string for one name."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        low.add(n.lower())
        out.append(n)
    return out[0] if len(out) == 1 else out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
