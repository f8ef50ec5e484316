"""Token ids in compressed blocks with a shared zstandard dictionary.

A store is a folder of two Parquet tables, so any place that Spark writes to
will do and the job's commit protocol covers lost executors:

- ``dictionary``: one row (sha256, dictionary, id_width, end_id);
- ``blocks``: (shard, block, first_id, last_id, tokens_before, n_tokens,
  n_docs, payload), in ascending order of the document ids.

A payload, little-endian: magic ``KLTS``, version u16, id width u16, sha256 of
the dictionary (32 bytes), number of documents u32, then per document its id
i64, a null flag u8 and its number of ids u32, then the offset index (number
of documents + 1) u64, then one zstandard frame per document. A document is
found through the blocks' id ranges, which Parquet prunes by, and read through
the offset index without touching its neighbours. A session needs the folder
and nothing else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import materialise, scratch
from kmerloom.llm.tokens import LibraryEncoder, drop_heavy, library_encoder, once, share_vocabulary, text_slices

MAGIC, VERSION = b"KLTS", 1
_HEAD = struct.Struct("<4sHH32sI")
END_ID = 1
#: The dictionary is trained on so many documents, cut into windows of so many ids, on so many windows of them, and has so many bytes.
SAMPLE_DOCS, SAMPLE_IDS, SAMPLE_WINDOWS, DICTIONARY_BYTES = 1_000, 2_048, 2_000, 64 << 10
BLOCK_BYTES = 1 << 20
_BLOCKS = "shard int, block int, first_id long, last_id long, tokens_before long, n_tokens long, n_docs long, payload binary"
_DICTIONARY = "sha256 string, dictionary binary, id_width int, end_id int"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of the samples' own bytes where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def pack_block(doc_ids: list[int | None], frames: list[bytes], counts: list[int], dict_hash: bytes, width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], "u1")
    return b"".join([_HEAD.pack(MAGIC, VERSION, width, dict_hash, len(doc_ids)), ids.tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Block:
    """Reads one block; ``ids(i)`` inflates the frame of its i-th document only."""

    def __init__(self, payload: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, dict_hash, n = _HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        if dict_hash != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.nulls = np.frombuffer(payload, "u1", n, at + 8 * n)
        self.counts = np.frombuffer(payload, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 13 * n)
        self._data, self._begin = payload, at + 13 * n + 8 * (n + 1)
        self._inflate = once("inflate", dict_hash, lambda: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)))

    def ids(self, i: int) -> np.ndarray:
        begin, end = self._begin + int(self.offsets[i]), self._begin + int(self.offsets[i + 1])
        raw = self._inflate.decompress(self._data[begin:end], max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _dictionary_for(docs: DataFrame, vocabulary: Broadcast, width: int) -> bytes:
    """Trained on windows of the whole texts of the SAMPLE_DOCS documents whose hashed ids are smallest.

    Of their windows the SAMPLE_WINDOWS with the smallest hashes are taken,
    wherever in a text they lie.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)  # no texts are sorted
    size = width * SAMPLE_IDS

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for _, texts in text_slices(batches, "text"):
            found = [np.frombuffer(i, "<u4").astype(f"<u{width}").tobytes() for i in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([i[at : at + size] for i in found for at in range(0, len(i), size)], pa.binary())], names=["ids"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")  # SAMPLE_DOCS ids
    cut = sampled.mapInArrow(windows, "ids binary").distinct().orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_WINDOWS)
    return train_dictionary([bytes(r["ids"]) for r in cut.collect()])  # SAMPLE_WINDOWS windows


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Encode all documents and write them to ``path`` in ascending id order."""
    import zstandard

    spark = docs.sparkSession
    shared = share_vocabulary(spark, vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = 2 if LibraryEncoder(shared.value).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = _dictionary_for(rows, shared, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary, width, END_ID)], _DICTIONARY).coalesce(1).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared)
        deflate = zstandard.ZstdCompressor(level=2, dict_data=zstandard.ZstdCompressionDict(sent.value), write_content_size=True)
        end = np.array([END_ID], f"<u{width}").tobytes()
        for batch, texts in text_slices(batches, "text"):
            ids = [np.frombuffer(i, "<u4").astype(f"<u{width}").tobytes() + end for i in encoder.encode(texts)]
            frames, counts = [deflate.compress(i) for i in ids], [len(i) // width for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "tie", "n", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        shard = TaskContext.get().partitionId()
        dict_hash, block, before = hashlib.sha256(sent.value).digest(), 0, 0
        doc_ids, frames, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            known = [d for d in doc_ids if d is not None]
            payload = pack_block(doc_ids, frames, counts, dict_hash, width)
            row = (shard, block, min(known, default=None), max(known, default=None), before, sum(counts), len(counts), payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["shard", "block", "first_id", "last_id", "tokens_before", "n_tokens", "n_docs", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, n_ids, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids.append(doc_id), frames.append(frame), counts.append(n_ids)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, before = block + 1, before + sum(counts)
                    doc_ids, frames, counts, held = [], [], [], 0
        if doc_ids:
            yield flush()

    # whole texts are encoded where they are read; only their frames are put in order
    encoded = materialise(rows.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(encode, "doc_id long, tie long, n long, frame binary"), "token-frames")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "frame")
    ordered.mapInArrow(write, _BLOCKS).write.parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, Broadcast]:
    """The blocks of a store and its dictionary, which must be the one that its hash names."""
    row = spark.read.schema(_DICTIONARY).parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"{path}: the dictionary is damaged")
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), spark.sparkContext.broadcast(dictionary)


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, from the files."""
    blocks, sent = _opened(spark, path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(payload, sent.value)
                starts = base + np.concatenate([[0], np.cumsum(b.counts[:-1], dtype=np.int64)])
                crcs = [zlib.crc32(b.ids(i).tobytes()) for i in range(len(b.counts))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids.astype(np.int64), mask=b.nulls.astype(bool)), pa.array(starts.astype(np.int64)), pa.array(b.counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    return (
        blocks.join(F.broadcast(bases), "shard")
        .select((F.col("base") + F.col("tokens_before")).alias("base"), "payload")
        .mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the documents of a short list of ids; only blocks whose range may hold one are read, only their frames inflated."""
    blocks, sent = _opened(spark, path)
    wanted = sorted({int(d) for d in doc_ids})
    inside = F.lit(False)
    for d in wanted:
        inside = inside | ((F.col("first_id") <= d) & (F.col("last_id") >= d))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                b = Block(payload, sent.value)
                at = np.flatnonzero(np.isin(b.doc_ids, wanted) & (b.nulls == 0)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids[at].astype(np.int64)), pa.array([b.ids(i).tolist() for i in at], pa.list_(pa.int64()))], names=[id_col, "ids"])

    return blocks.where(inside).select("payload").mapInArrow(read, f"`{id_col}` long, ids array<long>")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write the store to ``path``, a scratch folder by default, and read it back.

    Null text counts as empty and is stored as the end id alone. Null ids come
    first in the order. Rows that share an id are stored each for itself,
    ordered by a hash of their texts. Texts of any length are one frame each.
    Other columns are not read. An empty table gives no rows.
    """
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(docs, path, id_col, text_col, vocabulary)
    return read_store(docs.sparkSession, path, id_col)
