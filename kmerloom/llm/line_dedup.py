"""Line dedup that can take documents in and out again.

The exact reference table holds (key, doc_id) once for each line key of each
document, without a shuffle; its count table holds the number of documents and
the largest doc_id of each key. Frequent keys also stand in cuckoo filters, one
per shard of the key space, which are stored with the index: a key that becomes
frequent when documents come is inserted, one that no longer is when documents
go is deleted. A lookup probes the filter of a reference's shard and asks the
exact table about what the filter lets through, so a false positive never
changes a result. Texts are rewritten in place; only those of documents that
may lose a line meet their list of lost lines in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.tables import BROADCAST_BYTES, fresh, materialise, maybe_in, with_groups
from kmerloom.llm.tokens import drop_heavy

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Keys of one shard's filter on average.
SHARD_KEYS = 100_000
#: References that one task asks a filter about, where filters are not sent to all.
PER_SLICE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_REFS = "doc_id long, hi long, lo long"
_FILTERS = "shard int, n_shards int, n long, filter binary"


def line_key(line: str) -> bytes | None:
    """The key of a line: ASCII white space stripped at both ends, A-Z lower-cased; none if too short."""
    key = line.encode().strip(_SPACE).lower()
    if len(key) < LEAST_CHARS or (not key.isascii() and len(key.decode()) < LEAST_CHARS):
        return None
    return key


def _hashed(key: bytes) -> tuple[int, int]:
    return divmod(int.from_bytes(xxhash.xxh3_128_digest(key), "big"), 1 << 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class CuckooFilter:
    """Approximate set of 64-bit keys: 16-bit fingerprints in buckets of four, with deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(3, int(np.ceil(np.log2(max(capacity, 1) / (self.SLOTS * 0.85)))) if capacity > 1 else 3)
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self._turn = 0

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = self._mix(np.asarray(keys).astype(np.uint64)), np.uint64(len(self.table) - 1)
        print_ = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = h & mask
        return print_, one, one ^ (self._mix(print_) & mask)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full; it must then be built anew, larger."""
        prints, ones, twos = (a.tolist() for a in self._places(keys))
        table, mask = self.table, len(self.table) - 1
        for fp, a, b in zip(prints, ones, twos, strict=True):
            for at in (a, b):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = fp
                    break
            else:
                at = b
                for _ in range(self.KICKS):
                    self._turn = (self._turn + 1) % self.SLOTS
                    fp, table[at, self._turn] = int(table[at, self._turn]), fp
                    at ^= int(self._mix(np.array([fp]))[0]) & mask
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        a, b = a.astype(np.int64), b.astype(np.int64)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, each once."""
        for fp, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray, capacity: int = 0) -> CuckooFilter:
        capacity = max(len(keys), capacity, 16)
        while not (f := cls(capacity)).insert(keys):
            capacity *= 2
        return f

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo): each line key of each document, once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            ids, his, los = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in {k for line in (text or "").split("\n") if len(line) >= LEAST_CHARS and (k := line_key(line))}:
                    hi, lo = _hashed(key)
                    ids.append(doc_id), his.append(_signed(hi)), los.append(_signed(lo))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, his, los)], names=["doc_id", "hi", "lo"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _REFS)


class LineIndex:
    """The reference table, the count table and the sharded filters of a set of documents."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame | None = None, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS):
        self.refs, self.counts, self.least_docs, self.shard_keys = refs, counts, least_docs, shard_keys
        self.frequent = counts.where(F.col("n_docs") >= least_docs)
        self.filters = self._all_filters() if filters is None else filters

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        refs = materialise(references(docs, id_col, text_col), "line-refs")
        return cls(refs, materialise(count_references(refs), "line-counts"), None, least_docs, shard_keys)

    def _all_filters(self) -> DataFrame:
        """(shard, n_shards, n, filter) of the frequent keys, with room for as many again."""
        shards = max(1, -(-self.frequent.count() // self.shard_keys))

        def make(pdf: pd.DataFrame) -> pd.DataFrame:
            drop_heavy()
            table = CuckooFilter.of(pdf.lo.to_numpy(), 2 * len(pdf)).to_bytes()
            return pd.DataFrame({"shard": pdf.shard.iloc[:1], "n_shards": [shards], "n": [len(pdf)], "filter": [table]})

        keys = self.frequent.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "lo")
        return materialise(keys.groupBy("shard").applyInPandas(make, _FILTERS), "cuckoo")

    def _moved(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with ``refs`` and the counts ``touched`` (hi, lo, n_docs, max_doc, was); the others stay as they are.

        Keys that cross the threshold are inserted into the stored filters or
        deleted from them; filters that are too full are built anew from the
        exact table, more shards of them.
        """
        touched = materialise(touched, "line-touched")
        names = ["hi", "lo", "n_docs", "max_doc"]
        kept = self.counts.join(touched, ["hi", "lo"], "left_anti").select(*names)
        counts = materialise(kept.unionByName(touched.where("n_docs > 0").select(*names)), "line-counts")
        shards = (self.filters.select("n_shards").first() or [1])[0]
        now, before = F.col("n_docs") >= self.least_docs, F.col("was") >= self.least_docs
        changes = touched.where(now != before).select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "lo", now.alias("up"))

        def apply(held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            drop_heavy()
            table = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(2 * len(change))
            up, shard = change.up.to_numpy(bool), int((held if len(held) else change).shard.iloc[0])
            n = int(held.n.sum()) + int(up.sum()) - int((~up).sum())
            lo = change.lo.to_numpy()
            table.delete(lo[~up])
            fits = table.insert(lo[up])
            return pd.DataFrame({"shard": [shard], "n_shards": [shards], "n": [n], "filter": [table.to_bytes() if fits else None]})

        filters = materialise(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, _FILTERS), "cuckoo")
        if filters.where("filter is null").limit(1).count():
            filters = None
        return LineIndex(refs, counts, filters, self.least_docs, self.shard_keys)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with more documents; one that the index already holds is replaced, so the same insertion twice is one."""
        new = materialise(references(docs, id_col, text_col), "line-refs")
        held = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct().join(self.refs.select("doc_id").distinct(), "doc_id")
        held = materialise(held, "line-ids")
        base = self.delete(held) if held.limit(1).count() else self
        fresh_counts = count_references(new).select("hi", "lo", F.col("n_docs").alias("n"), F.col("max_doc").alias("top"))
        old = base.counts.join(fresh_counts, ["hi", "lo"], "right")
        was = F.coalesce("n_docs", F.lit(0))
        touched = old.select("hi", "lo", (was + F.col("n")).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc"), was.alias("was"))
        return base._moved(base.refs.unionByName(new), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of ``doc_ids`` (one column doc_id); ids it does not hold change nothing.

        Only keys that a deleted document held are counted anew; the others keep their row.
        """
        ids = doc_ids.distinct()
        gone = self.refs.join(ids, "doc_id", "left_semi").select("hi", "lo").distinct()
        refs = materialise(self.refs.join(ids, "doc_id", "left_anti"), "line-refs")
        again = count_references(refs.join(gone, ["hi", "lo"], "left_semi")).withColumnRenamed("n_docs", "n").withColumnRenamed("max_doc", "top")
        old = self.counts.join(gone, ["hi", "lo"], "left_semi").join(again, ["hi", "lo"], "left")
        return self._moved(refs, old.select("hi", "lo", F.coalesce("n", F.lit(0)).alias("n_docs"), F.col("top").alias("max_doc"), F.col("n_docs").alias("was")))

    def candidates(self, broadcast_bytes: int | None = None) -> DataFrame:
        """References that the filter of their shard lets through.

        The filters go to the references if all of them are small enough to be
        sent, else the references of a shard go to its filter, in slices of
        about PER_SLICE so that one hot line fills no task.
        """
        size, shards = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)), F.coalesce(F.max("n_shards"), F.lit(1))).first()
        spark = self.refs.sparkSession
        if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
            sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})  # of the size just checked

            def probe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                drop_heavy()
                tables = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
                for batch in batches:
                    hi, lo = (batch.column(i).to_numpy() for i in (1, 2))
                    of, hit = hi % shards, np.zeros(len(lo), bool)
                    for shard, table in tables.items():
                        at = np.flatnonzero(of == shard)
                        hit[at] = table.contains(lo[at])
                    yield batch.filter(pa.array(hit))

            return self.refs.mapInArrow(probe_all, _REFS)

        at = F.pmod("hi", F.lit(shards)).cast("int")
        slices = self.refs.groupBy(at.alias("shard")).agg(F.ceil(F.count(F.lit(1)) / PER_SLICE).cast("int").alias("slices"))
        filters = self.filters.join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "hi", "lo")), "filter")
        # one narrow row a shard, a small part of the filters' own size
        refs = self.refs.withColumn("shard", at).join(F.broadcast(slices), "shard")
        refs = refs.select("shard", F.pmod(F.hash("doc_id"), F.col("slices")).alias("slice"), "doc_id", "hi", "lo", F.lit(None).cast("binary").alias("filter"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = filters.unionByName(refs).repartition(n, "shard", "slice").sortWithinPartitions("shard", "slice", F.col("filter").isNull())

        def probe_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_heavy()
            where = table = None
            for batch in batches:
                shard, part = (batch.column(i).to_numpy() for i in (0, 1))
                cuts = np.flatnonzero(np.diff(shard) | np.diff(part)) + 1
                for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                    if end == begin:
                        continue
                    rows = batch.slice(begin, end - begin)
                    if rows.column(5)[0].is_valid:
                        where, table = (shard[begin], part[begin]), CuckooFilter.from_bytes(rows.column(5)[0].as_py())
                        rows = rows.slice(1)
                    if where != (shard[begin], part[begin]) or not len(rows):
                        continue
                    hit = table.contains(rows.column(4).to_numpy())
                    yield pa.RecordBatch.from_arrays([rows.column(i) for i in (2, 3, 4)], names=["doc_id", "hi", "lo"]).filter(pa.array(hit))

        return dealt.mapInArrow(probe_shard, _REFS)

    def losses(self, broadcast_bytes: int | None = None) -> DataFrame:
        """(doc_id, lost): hashes of the keys whose lines a document loses."""
        found = materialise(self.candidates(broadcast_bytes), "line-hits")
        asked = with_groups(found, self.frequent, ["hi", "lo"], "n_docs", found.count())
        lost = asked.where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))


def count_references(refs: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, max_doc); a document that comes in several rows counts once."""
    return refs.distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def strip_lines(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """``docs`` with the lines that are lost taken out of the text, and n_lines, n_dropped.

    Null text is one empty line and stays null unless lines are dropped. A null
    doc_id is smaller than all others and counts as one document. Rows that
    share an id are one document to the counts; each keeps its own text. A key
    that comes twice in a text counts once, and all its lines go or stay. Lines
    and texts of any length are taken whole. Other columns pass unchanged; if
    they have the names of the two counts, these get underscores in front. An
    empty table gives no rows.
    """
    index = index or LineIndex.build(docs, id_col, text_col)
    lost = materialise(index.losses(broadcast_bytes), "line-losses")
    names = docs.columns
    flag, key, hi, lo, n_lines, n_dropped = fresh(names, "maybe", "lost_id", "lost_hi", "lost_lo", "n_lines", "n_dropped")
    # the lists grow with the documents: they are joined in the same way at every size
    lists = lost.select(F.col("doc_id").alias(key), F.col("lost.hi").alias(hi), F.col("lost.lo").alias(lo)).hint("merge")
    marked = maybe_in(docs.withColumn(key, F.col(id_col).cast("long")), key, lost.select("doc_id"), flag, broadcast_bytes)
    met = marked.where(flag).withColumnRenamed(key, f"{key}_of")
    met = met.join(lists, F.col(f"{key}_of").eqNullSafe(F.col(key)), "left").select(*names, hi, lo)
    none = F.lit(None).cast("array<long>")
    joined = met.unionByName(marked.where(~F.col(flag)).select(*names, none.alias(hi), none.alias(lo)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, lines_of, dropped = [], [], []
            for text, his, los in zip(column[text_col].to_pylist(), column[hi].to_pylist(), column[lo].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                lines_of.append(len(lines))
                if his:
                    gone = set(zip(his, los, strict=True))
                    stay = [x for x in lines if len(x) < LEAST_CHARS or not (k := line_key(x)) or tuple(map(_signed, _hashed(k))) not in gone]
                    dropped.append(len(lines) - len(stay))
                    if len(stay) < len(lines):
                        text = "\n".join(stay)
                else:
                    dropped.append(0)
                texts.append(text)
            column[text_col] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(column[n] for n in names), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, n_lines, n_dropped])

    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return joined.mapInArrow(run, schema)


def line_report(docs: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """The digest columns of the line query."""
    done = strip_lines(docs.select("doc_id", "text"), broadcast_bytes=broadcast_bytes)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
