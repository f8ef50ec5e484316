"""Near duplicates by improved consistent weighted sampling.

A text is the weighted set of its shingles of five words: how often a shingle
occurs times its inverse document frequency, from a sketch of the document
frequencies of all shingles of all documents (:func:`shingle_idf`). Each of
BANDS * ROWS samples picks one shingle, two texts agreeing on a sample as often
as their weighted Jaccard similarity says. Texts that agree on a whole band
are candidates; a candidate link counts if the exact weighted Jaccard
similarity of the two whole texts is at least 0.8. Classes are the connected
components of the links.

Equal weighted sets are collapsed before any pairing. Within a band bucket
every text is first compared with one leader, the text that shares its buckets
with most others: of many variants of one text it is the one most like all.
Then all pairs of a bucket whose texts are still in different classes are
compared: large buckets are cut into blocks, a pair of blocks is one task's
cell, and blocks of one class alone never meet. A pair that shares several
bands is compared in the first of them only. Two texts whose total weights
differ by more than the similarity allows are never compared: they cannot be
similar enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import materialise, maybe_in, small_batches, with_groups, without
from kmerloom.llm.tokens import drop_heavy, once, text_slices, trim

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
#: Buckets of the sketch of document frequencies, and segments it is summed up in.
SKETCH, SEGMENTS = 1 << 20, 256
#: Members that one copy of a leader's text is compared with before the next copy.
PER_LEADER = 256
#: Texts and total weight that one block of a bucket holds about at most.
BLOCK, BLOCK_MASS = 1024, 1 << 20
_LEVELS = 2048
_of_process: dict = {}


#: Words hashed at once; words of more characters are replaced by their digest.
_BLOCK, _LONG = 1 << 16, 1_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of an odd number and of its inverse, n at least."""
    known = _of_process.get("powers")
    if known is None or len(known[1]) < n:
        base, size = 0x9E3779B97F4A7C15, 1 << max(n - 1, 1).bit_length()
        table = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
        raised = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        known = _of_process["powers"] = (table, *raised)
    return known


def _hash_block(words: list[str]) -> np.ndarray:
    """A polynomial in each word's bytes, from sums over all bytes before its end and its start."""
    data = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
    table, power, inverse = _powers(len(data))
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the lower-cased words of each text."""
    chunked = [t.lower().split() for t in texts]
    flat = list(chain.from_iterable(chunked))
    if max(map(len, flat), default=0) > _LONG:
        flat = [w if len(w) <= _LONG else xxhash.xxh3_128_hexdigest(w.encode()) for w in flat]
    hashes = np.concatenate([np.empty(0, np.uint64), *(_hash_block(flat[i : i + _BLOCK]) for i in range(0, len(flat), _BLOCK))])
    return np.split(hashes, np.cumsum([len(c) for c in chunked])[:-1])[: len(texts)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order and how often each occurs; a shorter text is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n, size = max(len(words) - SHINGLE + 1, 1), min(SHINGLE, len(words))
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = _mix(h + words[j : j + n])
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, n))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order and their weights: count times inverse document frequency."""
    h, n = shingles(words)
    return h, idf[_bucket(h)] * n.astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets."""
    (ha, wa), (hb, wb) = a, b
    at = np.searchsorted(hb, ha)
    both = np.flatnonzero((at < len(hb)) & (hb[np.minimum(at, len(hb) - 1)] == ha)) if len(hb) else np.empty(0, np.int64)
    low = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    high = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low
    return float(low / high) if high else 0.0


class WeightedSampler:
    """Improved consistent weighted sampling with its random variables drawn from tables.

    For each sample and shingle, 32 hashed bits pick r and c from tables of
    Gamma(2, 1) quantiles and beta from even steps.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 32, samples, np.uint32) | np.uint32(1)
        grid, at = (np.arange(_LEVELS) + 0.5) / _LEVELS, np.linspace(1e-4, 20, 200_000)
        gamma = np.interp(grid, 1 - (1 + at) * np.exp(-at), at)  # the distribution function of Gamma(2, 1)
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.inverse_r = (1 / gamma).astype(np.float32)

    def signature(self, hashes: np.ndarray, weights: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(the shingle each sample picks, its level t)."""
        k = len(self.seeds)
        best, pick, level = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int32)
        short = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
        logs = np.log(weights).astype(np.float32)
        for i in range(0, len(hashes), rows):
            u = (short[None, i : i + rows] ^ self.seeds[:, None]) * np.uint32(0x9E3779B1)
            u ^= u >> np.uint32(15)
            u *= np.uint32(0x85EBCA77)
            u ^= u >> np.uint32(13)
            which = (u & np.uint32(_LEVELS - 1)).astype(np.intp)
            beta = (u >> np.uint32(22)).astype(np.float32) * np.float32(1 / 1024)
            c = self.log_c.take(((u >> np.uint32(11)) & np.uint32(_LEVELS - 1)).astype(np.intp))
            t = np.floor(logs[None, i : i + rows] * self.inverse_r.take(which) + beta)
            cost = c - self.r.take(which) * (t - beta + np.float32(1))
            at = cost.argmin(1)
            low = cost[np.arange(k), at]
            better = low < best
            best[better], pick[better], level[better] = low[better], hashes[i + at[better]], t[np.arange(k), at][better].astype(np.int32)
        return pick, level

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        pick, level = self.signature(hashes, weights)
        each = _mix(pick ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).reshape(-1, ROWS)
        out = np.arange(len(each), dtype=np.uint64)
        for j in range(ROWS):
            out = _mix(out + each[:, j])
        return out.view(np.int64)


def shingle_idf(docs: DataFrame) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) / ln(N + 2) for each bucket of shingles, over all documents.

    ``df`` is the number of documents with a shingle of the bucket: never less
    than that of any of its shingles, and more by the other shingles of the
    bucket, on average the number of distinct shingles of all documents over
    SKETCH. A shingle in many more documents than that stands out; rarer ones
    weigh about the same. The table has 4 MB at every size of the corpus.
    """
    part = SKETCH // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        counts, n = np.zeros(SKETCH, np.int64), 0
        for _, texts in text_slices(batches, "text"):
            found = [_bucket(shingles(words)[0]) for words in word_hashes(texts)]
            counts += np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=SKETCH)
            n += len(texts)
        packed = [zlib.compress(x.astype("<u4" if x.max() < 1 << 32 else "<u8").tobytes(), 1) for x in counts.reshape(SEGMENTS, part)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(SEGMENTS), -1], pa.int32()), pa.array([0] * SEGMENTS + [n], pa.int64()), pa.array([*packed, b""], pa.binary())], names=["segment", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for batch in batches:
            for segment, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total[segment] = total.get(segment, 0) + n
                if packed:
                    raw = zlib.decompress(packed)
                    sums[segment] = sums.get(segment, 0) + np.frombuffer(raw, "<u4" if len(raw) == 4 * part else "<u8").astype(np.int64)
        keys = list(total)
        done = [zlib.compress(sums[k].astype("<u8").tobytes(), 1) if k in sums else b"" for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.int64()), pa.array(done, pa.binary())], names=["segment", "n", "counts"])

    schema = "segment int, n long, counts binary"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("text").mapInArrow(count, schema).repartition(tasks, "segment").mapInArrow(add, schema)
    n, df = 0, np.zeros((SEGMENTS, part))
    with small_batches(docs.sparkSession):
        counted = parts.collect()  # SEGMENTS + 1 rows, 8 MB at most
    for r in counted:
        if r["segment"] < 0:
            n = r["n"]
        else:
            df[r["segment"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    return (1 + np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 2)).astype(np.float32).ravel()


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, hi, lo, mass, bands): a 128-bit hash of the weighted set, its total weight and its band values, none without words."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        sampler = once("sampler", BANDS * ROWS, WeightedSampler)
        for batch, texts in text_slices(batches, "text"):
            his, los, masses, bands = [], [], [], []
            for words in word_hashes(texts):
                h, w = weighted_shingles(words, sent.value)
                whole = xxhash.xxh3_128_digest(h.tobytes() + w.tobytes())
                his.append(int.from_bytes(whole[:8], "little", signed=True))
                los.append(int.from_bytes(whole[8:], "little", signed=True))
                masses.append(float(w.sum(dtype=np.float64)))
                bands.append(sampler.bands(h, w).tolist() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(masses, pa.float64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "hi", "lo", "mass", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hi long, lo long, mass double, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The (a, b) whose texts are similar enough; a is a leader that many pairs may share.

    ``texts`` (_id, text) are those of the candidates; they grow with the
    documents, so they are always joined by a shuffle.
    """
    spark = pairs.sparkSession
    sent, texts = spark.sparkContext.broadcast(idf), texts.hint("merge")
    shares = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / PER_LEADER).cast("int"))
    members = with_groups(pairs, shares, ["a"], "n", pairs.count()).select("a", "b", F.pmod(F.hash("b"), F.col("shares")).alias("share"))
    members = members.join(texts, members["b"] == texts["_id"]).select("a", "share", "b", "text")
    leaders = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    leaders = leaders.join(texts, leaders["a"] == texts["_id"]).select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaders.unionByName(members).repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        at, leader = None, None
        for batch, texts in text_slices(batches, "text"):
            out = []
            ids = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), word_hashes(texts), strict=True)
            for a, b, words in ids:
                own = weighted_shingles(words, sent.value)
                if b is None:
                    at, leader = a, own
                elif a == at and weighted_jaccard(leader, own) >= SIMILARITY:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def cells(known: DataFrame) -> DataFrame:
    """(cell, band, high, node, label): pairs of blocks of each bucket of ``known`` (band, node, mass, label) that holds several classes.

    A class too large for one block has blocks of its own, the others of its
    bucket share blocks; two texts of different classes meet in exactly one
    cell of their bucket, from its two blocks or both from its only one.
    """
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_MASS)).cast("int")
    classes = known.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("weight")).withColumn("parts", parts)
    numbered = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("label").cast("string").alias("of"), i.alias("part")))
    small = F.col("parts") == 1
    buckets = classes.groupBy("band").agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(small, F.col("weight"))), F.lit(0.0)).alias("weight"),
        F.flatten(F.collect_list(F.when(~small, numbered))).alias("own"),
    )
    shared = F.expr("if(mixed = 0, array(), sequence(0, mixed - 1))").cast("array<int>")
    buckets = buckets.where("classes > 1").withColumn("mixed", parts).join(known.groupBy("band").agg(F.count(F.lit(1)).alias("held")), "band").select("band", "held", "mixed", F.concat("own", F.transform(shared, lambda i: F.struct(F.lit("").alias("of"), i.alias("part")))).alias("blocks"))
    total = known.count()
    placed = with_groups(with_groups(known, buckets, ["band"], "held", total), classes.select("band", "label", "parts", "n"), ["band", "label"], "n", total)
    mine = F.when(F.col("parts") == 1, F.struct(F.lit("").alias("of"), F.pmod(F.hash("label"), F.col("mixed")).alias("part"))).otherwise(
        F.struct(F.col("label").cast("string").alias("of"), F.pmod(F.hash("node"), F.col("parts")).alias("part"))
    )
    meets = F.filter("blocks", lambda x: (x["of"] == "") | (x["of"] != F.col("mine.of")))
    met = placed.withColumn("mine", mine).select("band", "node", "label", "mine", F.explode(meets).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    cell = F.concat_ws("/", "band", low["of"], low["part"], high["of"], high["part"])
    return met.select(cell.alias("cell"), "band", (F.col("mine") != low).alias("high"), "node", "label")


def cell_links(band: int, rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between the classes of a cell's rows (node, label, high, bands, weighted set), as many as join what is similar.

    Pairs of one class, and pairs that share an earlier band, are left out.
    """
    nodes, labels, sides, bands, sets = zip(*rows, strict=True)
    label, side, bands = np.unique(labels, return_inverse=True)[1], np.array(sides, bool), np.array(bands)
    before = bands[:, : int((bands[0] == band).argmax())]
    at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
    weight, sizes = np.concatenate([w for _, w in sets]), np.array([len(h) for h, _ in sets])
    mass = np.array([w.sum(dtype=np.float64) for _, w in sets])
    ends = np.cumsum(sizes)
    own = np.zeros(at.max() + 1, np.float32)
    out = []
    for x in np.flatnonzero(~side) if side.any() else range(len(nodes)):
        other = side.copy() if side.any() else np.arange(len(nodes)) > x
        other &= (label != label[x]) & (np.minimum(mass, mass[x]) >= np.maximum(mass, mass[x]) * (SIMILARITY - 1e-6))
        other &= ~(before == before[x]).any(1)
        found = np.flatnonzero(other)
        if not len(found):
            continue
        mine, n = slice(ends[x] - sizes[x], ends[x]), sizes[found]
        first = np.cumsum(n) - n
        every = np.arange(n.sum()) + np.repeat(ends[found] - n - first, n)
        own[at[mine]] = weight[mine]
        low = np.add.reduceat(np.minimum(own[at[every]], weight[every]), first, dtype=np.float64)
        own[at[mine]] = 0
        for y in found[low >= (SIMILARITY - 1e-6) * (mass[x] + mass[found] - low)]:
            if label[y] != label[x] and weighted_jaccard(sets[x], sets[y]) >= SIMILARITY:
                out.append((nodes[x], nodes[y]))
                label[label == label[y]] = label[x]
    return out


def crossed(met: DataFrame, sets: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The links (a, b) that the :func:`cells` ``met`` hold, from whole texts."""
    spark = met.sparkSession
    sent, texts = spark.sparkContext.broadcast(idf), texts.hint("merge")
    wanted = met.join(sets.select("node", "bands"), "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.join(texts, wanted["node"] == texts["_id"]).select("cell", "band", "high", "node", "label", "bands", "text").repartition(n, "cell").sortWithinPartitions("cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        drop_heavy()
        at, band, rows = None, 0, []
        for batch, texts in text_slices(batches, "text"):
            out = []
            columns = (batch.column(i).to_pylist() for i in range(6))
            for cell, b, high, node, label, bands, words in zip(*columns, word_hashes(texts), strict=True):
                if cell != at:
                    out += cell_links(band, rows) if len(rows) > 1 else []
                    at, band, rows = cell, b, []
                rows.append((node, label, high, bands, weighted_shingles(words, sent.value)))
            yield batch_of(out)
        if len(rows) > 1:
            yield batch_of(cell_links(band, rows))
        del rows
        trim()

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, by smallest neighbours and label jumping."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select("node", "label"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        new = F.least("label", "near", "_to")
        moved = labels.join(near, labels["node"] == near["a"]).join(jump, labels["label"] == jump["_at"])
        labels = materialise(moved.select("node", new.alias("label"), (new != F.col("label")).alias("moved")), "labels")
        still, labels = labels.where("moved"), labels.select("node", "label")
        if not still.limit(1).count():
            return labels


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, label) of ``labels`` after more links, by components of classes and not of their members."""
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    up = components(ends)
    to = up.select(F.col("node").alias("_from"), F.col("label").alias("_to"))
    moved = labels.join(to, labels["label"] == to["_from"], "left").select("node", F.coalesce("_to", "label").alias("label"))
    return materialise(moved.unionByName(up.join(labels, "node", "left_anti")), "labels")


def _comparable(a: F.Column, b: F.Column) -> F.Column:
    """A weighted Jaccard similarity is at most the smaller total weight over the larger."""
    return F.least(a, b) >= F.greatest(a, b) * (SIMILARITY - 1e-6)


def _most_central(*columns: str) -> F.Column:
    """``columns`` of the row that shares its buckets with most rows, among equals of the smallest node."""
    return F.max_by(F.struct(*columns), F.struct(F.col("met"), -F.col("node")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, kept) for every document; class_id is the smallest id of its class.

    Ids are taken as unique; rows that share an id are one document to the
    links. A document without words is a class of its own, and so is one with a
    null id, whose class_id is null. Texts of any length are taken whole; equal
    weights and similarities of exactly SIMILARITY link. Other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    idf = shingle_idf(docs)
    signed = materialise(signatures(docs, idf), "signatures")
    with_words = signed.where("bands is not null and doc_id is not null")
    sets = with_words.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.min("mass").alias("mass"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    sets = materialise(sets, "sets")
    banded = materialise(sets.select("node", "mass", F.explode("bands").alias("band")), "bands")
    entries = banded.count()
    held = banded.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = with_groups(banded, held, ["band"], "held", entries).withColumn("met", F.sum("held").over(Window.partitionBy("node")))  # BANDS rows a node at most
    shared = materialise(shared, "shared")
    leaders = shared.groupBy("band").agg(_most_central("node", "mass").alias("leader"), F.count(F.lit(1)).alias("held"))
    full = materialise(with_groups(shared.select("band", "node", "mass"), leaders, ["band"], "held", entries).select("band", "node", "mass", "leader"), "buckets")
    # only texts that share a bucket are read again, once; no others move
    wanted = materialise(full.select(F.col("node").alias("id")).distinct(), "candidate-ids")
    texts = maybe_in(docs, "doc_id", wanted, "maybe").where("maybe").select(F.col("doc_id").alias("_id"), "text")
    texts = materialise(texts, "candidate-texts")
    led = full.where(F.col("node") != F.col("leader.node")).where(_comparable(F.col("mass"), F.col("leader.mass")))
    pairs = led.select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(materialise(verified(materialise(pairs, "pairs"), texts, idf), "links"))
    # a leader has met all of its bucket: what is left are pairs of other members, of different classes
    known = full.where(F.col("node") != F.col("leader.node")).join(labels, "node", "left").select("band", "node", "mass", F.coalesce("label", "node").alias("label"))
    met = materialise(cells(materialise(known, "known")), "cells")
    labels = joined_classes(labels, materialise(crossed(met, sets, texts, idf), "links"))
    of_set = sets.join(labels, "node", "left").select("hi", "lo", "copies", F.coalesce("label", "node").alias("class_id"))
    rows = with_words.count()
    classed = materialise(with_groups(with_words.select("doc_id", "hi", "lo"), of_set, ["hi", "lo"], "copies", rows).select("doc_id", "class_id"), "classes")
    sizes = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    done = with_groups(classed, sizes, ["class_id"], "class_size", rows)
    alone = signed.where("bands is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return done.select("doc_id", "class_id", "class_size").unionByName(alone).select(
        F.col("doc_id").alias(id_col), "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest id. Columns as before.

    Rows that share an id stay if one of them does. Texts of what stays are not
    shuffled.
    """
    classes = near_classes(docs)
    gone = classes.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("not stays").select("doc_id")
    return without(docs, "doc_id", materialise(gone, "copies"))
