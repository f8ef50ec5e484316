"""Rows of a group's alignment: consensus, majority, divergence, missingness, names.

A row is one string for a group and species, with as many columns as the group
has. Per column facts are counted batch by batch over the rows' bytes, so what
is shuffled is a few numbers a column and task and never a row for each residue.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kmerloom.functions.flat import counting, ends_of, flat, numbered, residues_of, slices, strings, together, whole_keys
from kmerloom.functions.recode import LETTERS, states
from kmerloom.plans.checkpoints import BROADCAST_BYTES, cut, small

GROUP = ["lk", "rk"]
_ROW = [*GROUP, "sid", "block"]
_AT = ["sid", "protein_id", "seg_id", "start"]
#: What a task holds of rows, counts or words before it sends them: bytes, and keys.
HELD, KEYS = 64 << 20, 1 << 17
NO_STATE = "."


def is_missing(aa: Column) -> Column:
    return aa.isin("-", "X")


def blocks(texts: DataFrame, width: int) -> DataFrame:
    """(lk, rk, sid, block) of ``texts`` (lk, sid, text): all residues of each text in blocks of ``width``, the last filled with gaps; rk counts them."""
    schema = T.StructType([texts.schema["lk"], T.StructField("rk", T.IntegerType()), texts.schema["sid"], T.StructField("block", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                aa, ends = residues_of(*flat(part.column(2)))
                sizes = np.diff(ends)
                n = -(-sizes // width)
                data = np.full(n.sum() * width, ord("-"), np.uint8)
                data[np.repeat(ends_of(n)[:-1] * width, sizes) + counting(sizes)] = aa
                row = pa.array(np.repeat(np.arange(len(n)), n))
                block = strings(data, np.arange(len(row) + 1) * width)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(counting(n).astype(np.int32)), part.column(1).take(row), block], names=schema.names)

    return texts.select("lk", "sid", "text").mapInArrow(run, schema)


def _matrix(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strings as rows of bytes, filled with 0 to the longest."""
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)), np.uint8)
    out[np.repeat(np.arange(len(sizes)), sizes), counting(sizes)] = data
    return out


def _agreed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch of rows one: the residues all agree on, else X; 0 is no column."""
    hi, lo = np.maximum.reduceat(rows, first), np.minimum.reduceat(np.where(rows == 0, np.uint8(255), rows), first)
    return np.where((lo == hi) | (hi == 0), hi, np.uint8(ord("X")))


def _widened(rows: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((max(n, len(rows)), max(width, rows.shape[1])), rows.dtype)
    out[: len(rows), : rows.shape[1]] = rows
    return out


def _unseen(seen: dict, columns: list[pa.Array], first: np.ndarray) -> np.ndarray:
    """The numbers of keys, those new to ``seen`` taken in."""
    keys = zip(*(c.take(pa.array(first)).to_pylist() for c in columns), strict=True)
    return np.array([seen.setdefault(k, len(seen)) for k in keys], np.int64)


def observed_rows(obs: DataFrame) -> DataFrame:
    """(group, sid, block): per species and column the residue all its observations agree on, else X.

    A task merges what it has of a row before it sends it, at most HELD bytes or KEYS rows at a time, and one that gets all of a row merges these.
    """
    keys = [*GROUP, "sid"]
    schema = T.StructType([obs.schema[n] for n in _ROW])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[:3]]

    def made(ids: list[pa.Array], rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*ids, strings(rows[rows != 0], ends_of((rows != 0).sum(1)))], names=_ROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            return made([pa.array(c, t) for c, t in zip(zip(*seen, strict=True), kinds, strict=True)], held[: len(seen)])

        seen: dict = {}
        held = np.zeros((0, 1), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, first = numbered(*batch.columns[:3])
            order = np.argsort(number, kind="stable")
            own = _agreed(_matrix(*flat(batch.column(3)))[order], np.searchsorted(number[order], np.arange(len(first))))
            if seen and (len(seen) + len(first) > KEYS or (len(seen) + len(first)) * max(held.shape[1], own.shape[1]) > HELD):
                yield sent()
                seen, held = {}, np.zeros((0, 1), np.uint8)
            at = _unseen(seen, batch.columns[:3], first)
            if len(seen) > len(held) or own.shape[1] > held.shape[1]:
                held = _widened(held, 2 * len(seen) if len(seen) > len(held) else 0, own.shape[1])
            before, own = held[at], _widened(own, 0, held.shape[1])
            held[at] = np.where((before == own) | (own == 0), before, np.where(before == 0, own, np.uint8(ord("X"))))
        if seen:
            yield sent()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in whole_keys(batches, 3):
            yield made([c.take(pa.array(first)) for c in batch.columns[:3]], _agreed(_matrix(*flat(batch.column(3))), first))

    return together(obs.select(*_ROW).where("block is not null").mapInArrow(merge, schema), keys).mapInArrow(finish, schema)


def _state_table(scheme: str) -> np.ndarray:
    """The state of each byte, 6 for bytes that are no amino acid."""
    table = np.full(256, 6, np.uint8)
    for aa, s in zip(LETTERS, states(scheme), strict=True):
        table[ord(aa)] = int(s)
    return table


def _per_group(rows: DataFrame, symbol: np.ndarray, n: int, made: Callable[[np.ndarray], tuple[np.ndarray, list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """What ``made`` has of each group's counts: how often each of ``n`` symbols occurs in each column.

    ``symbol`` has the symbol of each byte; ``made`` takes counts [group, column, symbol] and returns the group's number of each row, and its columns.
    A task adds up its rows and sends one matrix a group, at most HELD bytes at a time; one that gets all of a group's matrices adds these.
    """
    keys = [rows.schema[k] for k in GROUP]
    kinds = [to_arrow_type(f.dataType) for f in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            total = held[: len(seen)]
            total = total.astype(np.min_scalar_type(total.max(initial=0)))
            data = strings(total.reshape(-1).view(np.uint8), np.arange(len(total) + 1) * total.shape[1] * total.itemsize, pa.binary())
            ids = [pa.array(c, t) for c, t in zip(zip(*seen, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*ids, pa.array([total.itemsize] * len(total), pa.int32()), data], names=[*GROUP, "bytes", "counts"])

        seen: dict = {}
        held = np.zeros((0, n), np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, first = numbered(*batch.columns[:2])
            data, ends = flat(batch.column(2))
            sizes = np.diff(ends)
            width = max(int(sizes.max(initial=0)), 1)
            cell = np.repeat(number * (width * n), sizes) + counting(sizes) * n + symbol[data]
            own = np.bincount(cell, minlength=len(first) * width * n).reshape(len(first), -1).astype(np.uint32)
            if seen and (len(seen) + len(first)) * max(held.shape[1], own.shape[1]) * 4 > HELD:
                yield sent()
                seen, held = {}, np.zeros((0, n), np.uint32)
            at = _unseen(seen, batch.columns[:2], first)
            if len(seen) > len(held) or own.shape[1] > held.shape[1]:
                held = _widened(held, 2 * len(seen) if len(seen) > len(held) else 0, own.shape[1])
            held[at, : own.shape[1]] += own
        if seen:
            yield sent()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in whole_keys(batches, 2):
            each = [np.frombuffer(c, f"<u{b}") for b, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            total = np.zeros((len(first), max(map(len, each))), np.int64)
            for g, c in zip(np.repeat(np.arange(len(first)), np.diff([*first, len(each)])).tolist(), each, strict=True):
                total[g, : len(c)] += c
            group, columns = made(total.reshape(len(first), -1, n))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)).take(pa.array(group)) for c in batch.columns[:2]), *columns], names=[*GROUP, *(f.name for f in fields)])

    sums = rows.select(*GROUP, "block").where("block is not null").mapInArrow(add, T.StructType([*keys, T.StructField("bytes", T.IntegerType()), T.StructField("counts", T.BinaryType())]))
    return together(sums, GROUP).mapInArrow(finish, T.StructType([*keys, *fields]))


def _commonest(n: int, char: np.ndarray, none: str) -> Callable[[np.ndarray], tuple[np.ndarray, list[pa.Array]]]:
    """The commonest of the first ``n`` symbols of each column, the lowest of equals, as one string a group; ``none`` where there is none of them."""

    def made(counts: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        there = counts.any(2)
        best = np.where(counts[:, :, :n].any(2), char[counts[:, :, :n].argmax(2)], np.uint8(ord(none or "\0")))
        there &= best != 0
        return np.arange(len(counts)), [strings(best[there], ends_of(there.sum(1)))]

    return made


def _state_symbols(scheme: str) -> np.ndarray:
    """The state of each byte; 6 for other characters, 7 for gaps and X."""
    table = _state_table(scheme)
    table[ord("-")] = table[ord("X")] = 7
    return table


def column_majority(rows: DataFrame, scheme: str) -> DataFrame:
    """(group, majority): for each column the commonest state, the lowest of equals, or NO_STATE."""
    return _per_group(rows, _state_symbols(scheme), 8, _commonest(6, np.frombuffer(b"012345", np.uint8), NO_STATE), [T.StructField("majority", T.StringType())])


def column_letters(rows: DataFrame) -> DataFrame:
    """(group, letters): for each column the commonest amino acid, the first of equals; columns without any are left out."""
    table = np.full(256, len(LETTERS), np.uint8)
    table[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    return _per_group(rows, table, len(LETTERS) + 1, _commonest(len(LETTERS), np.frombuffer(LETTERS.encode(), np.uint8), ""), [T.StructField("letters", T.StringType())])


def masked_rows(rows: DataFrame, majority: DataFrame, mask: int, scheme: str) -> DataFrame:
    """``rows`` where a row that differs from the majority in ``mask`` columns running is X throughout."""
    if mask == 0:
        return rows
    joined = rows.join(small(cut(majority)), GROUP).select(*_ROW, "majority")
    schema = T.StructType([f for n in _ROW for f in rows.schema.fields if f.name == n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _state_table(scheme)
        for batch in batches:
            data, ends = flat(batch.column(3))
            own, most = table[data], flat(batch.column(4))[0]
            differs = (own < 6) & (most != ord(NO_STATE)) & (own != most - np.uint8(ord("0")))
            run_of = np.append(differs, np.zeros(mask, bool))
            for j in range(1, mask):
                run_of[: len(differs)] &= np.append(differs[j:], np.zeros(j, bool))[: len(differs)]
            starts = np.flatnonzero(run_of[: len(differs)])
            row = np.searchsorted(ends[1:], starts, "right")
            hit = np.zeros(len(ends) - 1, bool)
            hit[row[starts + mask <= ends[1:][row]]] = True
            shown = np.where(np.repeat(hit, np.diff(ends)), np.uint8(ord("X")), data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], strings(shown, ends)], names=_ROW)

    return joined.mapInArrow(run, schema)


def column_report(rows: DataFrame, scheme: str) -> DataFrame:
    """(group, col, missing, n_states, there) of each column, over the ``there`` rows that there are."""

    def made(counts: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        there = counts.sum(2)
        group, col = np.nonzero(there)
        return group, [pa.array(col.astype(np.int32)), pa.array(counts[group, col, 7]), pa.array((counts[group, col, :6] > 0).sum(1)), pa.array(there[group, col])]

    fields = [T.StructField("col", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("missing", "n_states", "there"))]
    return _per_group(rows, _state_symbols(scheme), 8, made, fields)


def _words(rest: bytes) -> list[bytes]:
    """What the expression \\s+ splits a name into, with the empty words at its ends."""
    words = rest.split()
    return [b""] * rest[:1].isspace() + words + [b""] * rest[-1:].isspace()


def _likely_words(names: DataFrame) -> DataFrame:
    """(group, word) with every word that at least half of a group's names have, and few others.

    Such a word is in half of the names of one task's part at least, so a task sends those of its part, of KEYS words at a time.
    """
    schema = T.StructType([*(T.StructField(k, names.schema[k].dataType) for k in GROUP), T.StructField("word", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            rows = [(*g, w.decode()) for g, own in found.items() for w, c in own.items() if 2 * c >= count[g]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], names=schema.names)

        found, count, held = {}, {}, 0
        for batch in batches:
            for part in slices(batch, 2):
                for lk, rk, rest in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    own = found.setdefault((lk, rk), Counter())
                    count[lk, rk] = count.get((lk, rk), 0) + 1
                    held -= len(own)
                    own.update(set(_words(rest)))
                    held += len(own)
                    if held > KEYS:
                        yield sent()
                        found, count, held = {}, {}, 0
        if count:
            yield sent()

    return names.select(*GROUP, "rest").mapInArrow(run, schema).distinct()


def _word_votes(names: DataFrame, likely: Broadcast | None) -> DataFrame:
    """(group, word, c, places, record, pos) of ``names`` (group, at, rest): what a task has of a word of a group, KEYS words at a time.

    ``c`` names have it, ``places`` is the sum of its first places, the rest the first of these names and its place there. The row of the null
    word counts names. ``likely`` has the words of each group that are of use, if not all are.
    """
    group, kinds = [T.StructField(k, names.schema[k].dataType) for k in GROUP], {f.name: f for f in names.schema["at"].dataType.fields}
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([*group, T.StructField("word", T.StringType()), long("c"), long("places"), *(T.StructField(n, kinds[n].dataType) for n in _AT), long("pos")])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent():
            rows = [(*g, None, c, None, *[None] * len(_AT), None) for g, c in count.items()]
            rows += [(*g, w.decode(), c, places, *(x[1] if x else None for x in at), pos) for g, own in votes.items() for w, (c, places, at, pos) in own.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

        use = None if likely is None else likely.value
        votes, count, held = {}, {}, 0
        for batch in batches:
            for part in slices(batch, 3):
                for lk, rk, at, rest in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    at = tuple(() if at[n] is None else (1, at[n]) for n in _AT)  # null comes first
                    own = votes.setdefault((lk, rk), {})
                    count[lk, rk] = count.get((lk, rk), 0) + 1
                    words, before = _words(rest), len(own)
                    for w in set(words) if use is None else use.get((lk, rk), frozenset()).intersection(words):
                        v, pos = own.get(w), words.index(w)
                        if v is None:
                            own[w] = [1, pos, at, pos]
                        else:
                            v[0] += 1
                            v[1] += pos
                            if at < v[2]:
                                v[2], v[3] = at, pos
                    held += len(own) - before
                    if held > KEYS:
                        yield sent()
                        votes, count, held = {}, {}, 0
        if count:
            yield sent()

    return names.select(*GROUP, "at", "rest").mapInArrow(run, schema)


def _sent_words(likely: DataFrame) -> Broadcast | None:
    """The words of each group, for the workers; None if they are too many to be sent."""
    if (likely.agg(F.sum(F.length("word") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    words: dict = {}
    for lk, rk, word in likely.toLocalIterator():
        words.setdefault((lk, rk), set()).add(word.encode())
    return likely.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in words.items()})


def consensus_names(named: DataFrame) -> DataFrame:
    """(group, label) by a vote over words; ``named`` has group, sid, protein_id, seg_id, start, name.

    The record id is dropped. A word counts once a name, at its first place,
    and stays if half the names have it; words follow their mean place, then
    where they were first seen. Mean places are compared exactly, as fractions.
    """
    rest = F.trim(F.regexp_replace(F.trim("name"), "^\\S+", ""))
    at = F.struct(*_AT)
    own = ["of_lk", "of_rk", "of_at"]
    repeated = small(cut(named.select(*GROUP, at.alias("at")).groupBy(*GROUP, "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*GROUP, "at").toDF(*own)))
    names = named.select(*GROUP, at.alias("at"), rest.alias("rest")).where("rest <> ''")
    likely = _sent_words(cut(_likely_words(names)))
    votes = _word_votes(names, likely)
    if repeated.limit(1).count():  # names of one record count once
        same = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip([*GROUP, "at"], own, strict=True)]
        again = names.join(repeated, same, "left_semi")
        words = again.select(*GROUP, "at", F.posexplode(F.split("rest", "\\s+")).alias("pos", "word"))
        once = words.groupBy(*GROUP, "at", "word").agg(F.min("pos").alias("pos"))
        more = once.select(*GROUP, "word", F.lit(1).cast("long").alias("c"), F.col("pos").cast("long").alias("places"), *(F.col("at")[n].alias(n) for n in _AT), F.col("pos").cast("long").alias("pos"))
        count = again.select(*GROUP, F.lit(1).cast("long").alias("c"))
        votes = _word_votes(names.join(repeated, same, "left_anti"), likely).unionByName(more).unionByName(count, allowMissingColumns=True)
    votes = cut(votes.groupBy(*GROUP, "word").agg(F.sum("c").alias("c"), F.sum("places").alias("places"), F.min(F.struct(at.alias("at"), "pos")).alias("seen")))
    total = votes.where("word is null").select(*GROUP, F.col("c").alias("n"))
    kept = votes.where("word is not null").join(total, GROUP).where(2 * F.col("c") >= F.col("n")).select(*GROUP, F.struct("places", "c", "seen", "word").alias("w"))
    seen = lambda x: F.struct(x["seen"].alias("seen"), x["word"].alias("word"))

    def order(x: Column, y: Column) -> Column:
        a, b = x["places"] * y["c"], y["places"] * x["c"]
        return F.when(a < b, -1).when(a > b, 1).when(seen(x) < seen(y), -1).when(seen(x) > seen(y), 1).otherwise(0)

    ordered = F.array_sort(F.collect_list("w"), order)
    return kept.groupBy(*GROUP).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("label"))
