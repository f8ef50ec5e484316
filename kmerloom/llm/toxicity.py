"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
first letters, so inflected forms share what they have in common. Filters of
several widths run over the words, each keeps its maximum over the whole text,
and a logistic layer makes the score. Thresholds are calibrated by language
for decisions; the score itself sees the text alone.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.tables import fresh, materialise, text_of
from kmerloom.llm.tokens import drop_heavy, heavy, text_slices, trim

BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
PREFIXES = (4, 5, 6, 7)
#: Labelled rows of each class that the classifier is fitted on at most: those whose hashed ids are smallest.
SAMPLE = {1: 2_000, 0: 3_000}
EPOCHS, BATCH, RATE = 6, 32, 0.2
#: Starts of the fit; the model that does best on the rows kept out is taken.
SEEDS = (7, 8, 9)
#: One row in so many is kept out of the fit to set the offset, if that makes so many of each class.
KEPT_OUT, LEAST_KEPT = 6, 20
#: Words whose projections a worker remembers, 29 MB.
KNOWN = 150_000
#: Words that count: letters at their ends only are stripped of these.
_EDGES = " .,;:!?\"'()[]{}<>|#$%&*+-_=/\\~^`"


def word_features(chunk: str) -> list[int]:
    """Hash buckets of a word and of its prefixes."""
    w = chunk.lower().strip(_EDGES)
    return [zlib.crc32(f"w{w}".encode()) % BUCKETS, *(zlib.crc32(f"{n}{w[:n]}".encode()) % BUCKETS for n in PREFIXES)]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS, DIMS
    filters: list[np.ndarray]  # by width: width, DIMS, FILTERS
    bias: np.ndarray  # all filters
    weight: np.ndarray
    offset: float
    quality: float = 0.0  # F1 on the rows kept out

    def projection(self) -> np.ndarray:
        """DIMS to one column for each width, place in the filter and filter."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1)

    def pooled(self, columns: np.ndarray) -> np.ndarray:
        """Maximum of each filter over a text from its words' projections; texts are padded to the widest filter."""
        out, at = [], 0
        pad = max(WIDTHS) - 1
        columns = np.concatenate([columns, np.zeros((pad, columns.shape[1]), np.float32)]) if len(columns) else np.zeros((1 + pad, columns.shape[1]), np.float32)
        n = len(columns) - pad
        for w in WIDTHS:
            total = columns[:n, at : at + FILTERS]
            for j in range(1, w):
                total = total + columns[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(total.max(0))
            at += w * FILTERS
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def logit(self, columns: np.ndarray) -> float:
        return float(self.pooled(columns) @ self.weight + self.offset)

    def score(self, columns: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.logit(columns), -30.0), 30.0)))


def _fresh(rng: np.random.Generator) -> Model:
    n = FILTERS * len(WIDTHS)
    return Model(
        rng.normal(0, 0.3, (BUCKETS, DIMS)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), -2.0,
    )


def best_shift(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """What to add to ``logits`` so that deciding at zero has the best F1 where a share ``prior`` is toxic, and that F1.

    Of equally good places the widest gap between two logits is cut, in its middle.
    """
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order] > 0
    right = np.cumsum(y) / y.sum() * prior
    wrong = np.cumsum(~y) / (~y).sum() * (1 - prior)
    f1 = 2 * right[:-1] / (right + wrong + prior)[:-1]
    gap = z[:-1] - z[1:]
    f1[gap <= 0] = -1
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = good[np.argmax(gap[good])]
    return -float(z[at] + z[at + 1]) / 2, float(f1[at])


def fit(texts: list[str], labels: list[int], seed: int = 7, prior: float | None = None) -> Model:
    """Adagrad on the logistic loss; a gradient reaches only the words that gave a filter its maximum.

    ``prior`` is the toxic share of the corpus, by default that of the rows
    given. One row in KEPT_OUT of each class is not fitted: the offset is set
    so that 0.5 is the best decision on these. With fewer than LEAST_KEPT of a
    class all are fitted and the offset is moved half way to the prior.
    """
    split, rng = np.random.default_rng(0), np.random.default_rng(seed)
    m = _fresh(rng)
    if not texts:
        return m
    known: dict[str, list[int]] = {}
    docs = [np.array([known.get(c) or known.setdefault(c, word_features(c)) for c in t.split()], np.int64).reshape(-1, 1 + len(PREFIXES)) for t in texts]
    y = np.array(labels, np.float32)
    share = min(max(float(y.mean()), 0.01), 0.99)
    prior = share if prior is None else min(max(prior, 0.01), 0.99)
    kept_out = np.zeros(len(docs), bool)
    for label in (0, 1):
        own = split.permutation(np.flatnonzero(y == label))
        kept_out[own[: len(own) // KEPT_OUT]] = True
    if min((y[kept_out] == 0).sum(), (y[kept_out] == 1).sum()) < LEAST_KEPT:
        kept_out[:] = False
    fitted = np.flatnonzero(~kept_out)
    squares = {k: 1e-6 for k in (*(f"f{w}" for w in WIDTHS), "bias", "weight", "offset")}
    emb_squares = np.full(BUCKETS, 1e-6, np.float32)
    pad, each = np.zeros((max(WIDTHS) - 1, DIMS), np.float32), np.arange(FILTERS)

    def step(name: str, value, grad):
        squares[name] = squares[name] + grad * grad
        return value - RATE * grad / np.sqrt(squares[name])

    for _ in range(EPOCHS):
        order = rng.permutation(fitted)
        for b in range(0, len(order), BATCH):
            chosen, columns = order[b : b + BATCH], m.projection()
            grads = [np.zeros_like(f) for f in m.filters]
            g_bias, g_weight, g_offset = np.zeros_like(m.bias), np.zeros_like(m.weight), 0.0
            rows, row_grads = [], []
            for i in chosen:
                ids = docs[i]
                x = np.concatenate([m.embedding[ids].sum(1), pad]) if len(ids) else np.zeros((1 + len(pad), DIMS), np.float32)
                n, at = len(x) - len(pad), 0
                all_columns, best, high = x @ columns, [], []
                for w in WIDTHS:
                    total = all_columns[:n, at : at + FILTERS].copy()
                    for j in range(1, w):
                        total += all_columns[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                    best.append(total.argmax(0))
                    high.append(total[best[-1], each])
                    at += w * FILTERS
                pre = np.concatenate(high) + m.bias
                act = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ m.weight + m.offset, -30, 30)))
                d = (p - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share)) / len(chosen)
                g_weight += d * act
                g_offset += d
                back = (d * m.weight * (pre > 0)).astype(np.float32)
                g_bias += back
                for k, w in enumerate(WIDTHS):
                    gk = back[k * FILTERS : (k + 1) * FILTERS]
                    places = best[k] + np.arange(w)[:, None]  # width, FILTERS
                    grads[k] += (x[places] * gk[:, None]).transpose(0, 2, 1)
                    real = (places < len(ids)) & (gk != 0)
                    if real.any():
                        rows.append(ids[places[real]])
                        row_grads.append((m.filters[k].transpose(0, 2, 1) * gk[:, None])[real])
            if rows:
                flat, g = np.concatenate(rows).ravel(), np.repeat(np.concatenate(row_grads), 1 + len(PREFIXES), 0)
                keys, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(keys), DIMS), np.float32)
                np.add.at(total, inverse, g)
                emb_squares[keys] += (total * total).mean(1)
                m.embedding[keys] -= RATE * total / np.sqrt(emb_squares[keys])[:, None]
            for k, w in enumerate(WIDTHS):
                m.filters[k] = step(f"f{w}", m.filters[k], grads[k])
            m.bias, m.weight = step("bias", m.bias, g_bias), step("weight", m.weight, g_weight)
            m.offset = float(step("offset", m.offset, g_offset))
    if kept_out.any():
        scorer = Scorer(m)
        z = np.array([m.logit(c) for c in scorer.columns([texts[i] for i in np.flatnonzero(kept_out)])])
        shift, m.quality = best_shift(z, y[kept_out], prior)
        m.offset += shift
    else:  # the classes were weighted equally
        m.offset += 0.5 * float(np.log(prior / (1 - prior)))
    return m


class Scorer:
    """Scores whole texts; the projections of at most KNOWN words are remembered, in one table."""

    def __init__(self, model: Model):
        self.model, self._project = model, model.projection().astype(np.float32)
        self._at: dict[str, int] = {}
        self._table = np.empty((0, self._project.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), KNOWN):
            part = words[i : i + KNOWN]
            rows = self.model.embedding[np.array([word_features(w) for w in part], np.int64)].sum(1) @ self._project
            begin = len(self._at)
            if begin + len(part) > len(self._table):
                grown = np.empty((max(2 * len(self._table), begin + len(part), 4096), rows.shape[1]), np.float32)
                grown[:begin] = self._table[:begin]
                self._table = grown
            self._table[begin : begin + len(part)] = rows
            self._at.update(zip(part, range(begin, begin + len(part)), strict=True))

    def columns(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The projections of each text's words."""
        chunked = [t.split() for t in texts]
        words = set().union(*chunked)
        if len(self._at) + len(words) > KNOWN:
            self._at, self._table = {}, self._table[:0].copy()
        self._learn([w for w in words if w not in self._at])
        for c in chunked:
            yield self._table[np.fromiter(map(self._at.__getitem__, c), np.int64, len(c))]

    def scores(self, texts: list[str]) -> list[float]:
        return [self.model.score(c) for c in self.columns(texts)]


def known_labels(labels: DataFrame, hold_out: bool) -> DataFrame:
    """(doc_id, toxic); conflicting labels of an id count as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(fold("doc_id") != 0) if hold_out else known


def sampled(known: DataFrame) -> DataFrame:
    """The rows of ``known`` that the classifier is fitted on, SAMPLE rows at most."""
    picked = None
    for label, most in SAMPLE.items():
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    return picked


def calibrate(scored: DataFrame, labels: DataFrame, score_col: str, hold_out: bool = True) -> dict[str, float]:
    """By language, the threshold with the best F1; 0.5 where a language has few rows to tell.

    Scores are those of all labelled rows outside the fitted sample, counted
    by steps of the grid; each class counts as often as among all labelled rows.
    """
    grid = np.linspace(0.3, 0.9, 25)
    fitted = sampled(known_labels(labels, hold_out)).select("doc_id", F.lit(True).alias("_fitted"))
    known = known_labels(labels, False).where(F.col("toxic").isin(*SAMPLE)).join(F.broadcast(fitted), "doc_id", "left")  # SAMPLE rows at most
    step = sum((F.col(score_col) >= float(g)).cast("int") for g in grid)
    rows = scored.where("lang is not null").select("doc_id", "lang", step.alias("_step")).join(known, "doc_id")
    counts = rows.groupBy("lang", "toxic", F.when(F.col("_fitted"), -1).otherwise(F.col("_step")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    seen: dict[str, np.ndarray] = {}
    for r in counts.collect():  # 2 * 27 rows a language at most
        seen.setdefault(r["lang"], np.zeros((2, len(grid) + 2)))[r["toxic"], r["step"]] = r["n"]  # the last column: fitted rows
    out = {}
    for lang, n in sorted(seen.items()):
        every, outside = n.sum(1), n[:, :-1].sum(1)
        if outside.min() < 20:
            out[lang] = 0.5
            continue
        wrong, right = (n[:, :-1][:, ::-1].cumsum(1)[:, ::-1][:, 1:] * (every / outside)[:, None])
        f1 = 2 * right / np.maximum(right + wrong + every[1], 1)
        good = grid[np.flatnonzero(f1 >= f1.max() - 1e-9)]
        out[lang] = float(good[np.argmin(np.abs(good - 0.5))])
    return out


def training_rows(docs: DataFrame, known: DataFrame) -> list[tuple[str, int]]:
    """(text, label) of the sample, SAMPLE rows at most."""
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sampled(known)), "doc_id")  # SAMPLE rows at most
    return [(t, int(y)) for _, t, y in sorted((r["doc_id"], r["text"], r["toxic"]) for r in found.dropDuplicates(["doc_id"]).collect())]


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, hold_out: bool = True) -> Model:
    """Fitted on the sample from each of SEEDS, in as many tasks; the toxic share is that of all labelled rows."""
    known = known_labels(labels, hold_out)
    rows = training_rows(docs, known)
    held = known.where(F.col("toxic").isin(*SAMPLE)).join(docs.select("doc_id"), "doc_id", "left_semi")
    prior = held.agg(F.avg("toxic").alias("share")).first()["share"]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rows)  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_heavy()
        texts, classes = [t for t, _ in sent.value], [y for _, y in sent.value]
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                done = pickle.dumps(fit(texts, classes, seed, prior))
                yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), pa.array([done], pa.binary())], names=["seed", "model"])
        trim()

    starts = spark.range(min(SEEDS), max(SEEDS) + 1, numPartitions=max(SEEDS) + 1 - min(SEEDS)).where(F.col("id").isin(*SEEDS))
    fitted = [(r["seed"], pickle.loads(r["model"])) for r in starts.mapInArrow(run, "seed long, model binary").collect()]
    return max(fitted, key=lambda x: (x[1].quality, -x[0]))[1]


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score of the whole text. Null text counts as empty; empty texts get the score of no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = heavy(("toxicity", key), lambda: Scorer(sent.value))
        for batch, texts in text_slices(batches, text_col):
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scorer.scores(texts), pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted).

    Equal texts get equal scores, whatever their rows; null texts are scored as
    empty ones, texts of any length whole. A null doc_id counts as not held
    out. Other columns are not read. An empty table gives no rows.
    """
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below their language's threshold, 0.5 for languages without one. Columns as before.

    A null or empty text is scored as one without words; repeated rows are
    judged alike; an empty table gives no rows.
    """
    name = fresh(docs.columns, "toxicity_score")
    scored = materialise(score_texts(docs, train(docs, labels), out_col=name), "scored")
    limit = F.lit(0.5)
    thresholds = calibrate(scored, labels, name) if "lang" in docs.columns else {}
    for lang, t in sorted(thresholds.items()):
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return scored.where(F.col(name) < limit).drop(name)
