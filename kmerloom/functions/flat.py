"""Strings of Arrow batches as flat bytes, strings made of these, and rows of a key brought together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerloom.functions.recode import LETTERS

#: Bytes of text that are taken apart at once.
SLICE = 1 << 22
#: Of each byte the residue, GAP for white space that residues pass over, OTHER for what is no amino acid.
OTHER, GAP = 0, 1
_RESIDUE = np.zeros(256, np.uint8)
_RESIDUE[[ord(c) for c in " \t\n\f\r"]] = GAP
for _c in LETTERS:
    _RESIDUE[[ord(_c), ord(_c.lower())]] = ord(_c)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of ``column``, and where each begins, with the end of the last; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """What :func:`flat` takes apart."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind or pa.string(), len(ends) - 1, buffers)


def ends_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(ends_of(sizes)[:-1], sizes)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most SLICE bytes of a column, or of one row."""
    ends, at = flat(batch.column(column))[1], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of residues of at least ``least``: their string's number, their own number there, their sizes and all residues.

    Runs are numbered as the parts that are left when a string is split at what is no residue: from 1 after a beginning that is none.
    """
    found = _RESIDUE[data]
    keep = found != GAP
    bounds = ends_of(keep)[ends]
    found = found[keep]
    good = found > GAP
    begins, stops = good.copy(), good.copy()
    begins[1:] &= ~good[:-1]
    stops[:-1] &= ~good[1:]
    inner = bounds[:-1][(bounds[:-1] < bounds[1:])]
    begins[inner] = good[inner]
    lasts = bounds[1:][(bounds[:-1] < bounds[1:])] - 1
    stops[lasts] = good[lasts]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(bounds, begin, "right") - 1
    shifted = np.zeros(len(bounds) - 1, np.int64)
    shifted[bounds[:-1] < bounds[1:]] = ~good[inner]
    number = np.arange(len(begin)) - np.searchsorted(row, np.arange(len(shifted)))[row] + shifted[row]
    long = stop - begin >= least
    begin, sizes = begin[long], (stop - begin)[long]
    return row[long], number[long], sizes, found[np.repeat(begin, sizes) + counting(sizes)]


def residues_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The residues of each string, all else left out, as :func:`flat` has them."""
    found = _RESIDUE[data]
    keep = found > GAP
    return found[keep], ends_of(keep)[ends]


def numbered(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's key among the distinct keys of ``columns``, and a row of each key; null is a value."""
    number = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    first = np.zeros(number.max(initial=-1) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with all rows of a key in one partition, one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of :func:`together` with ``n`` keys as batches that hold all rows of each of their keys, and where a key begins."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        first = _begins(held, n)
        if len(first) > 1:
            yield held.slice(0, int(first[-1])), first[:-1]
            held = held.slice(int(first[-1]))
    if held is not None:
        yield held, _begins(held, n)


def _begins(batch: pa.RecordBatch, n: int) -> np.ndarray:
    number = numbered(*batch.columns[:n])[0]
    return np.append(0, np.flatnonzero(number[1:] != number[:-1]) + 1)
