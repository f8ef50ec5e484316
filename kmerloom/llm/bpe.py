"""Byte pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its encoding.
It is found among the vocabulary tokens that end the prefix, given by a suffix
automaton of the vocabulary, as the one that is compatible with the last token
of the prefix before it. Following these back from the whole word gives the
ids without running a single merge.

Words are sequences of 512 symbols: a byte, or a byte that ends its word.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tokens import Memo, byte_letters, chunks_of, heavy, share_vocabulary, text_slices, words_of

WORD_END = "</w>"
_PAIRS = 1_000_000
#: Words, and chunks, in one generation of a memo; an encoding is dearer here than what remembering it takes.
REMEMBERED = 300_000
_NEVER = 1 << 30


class SuffixAutomaton:
    """The automaton of all factors of many sequences, with the sequences that end each state's factors."""

    def __init__(self, sequences: dict[int, tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences.values():
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.own: list[list[tuple[int, int]] | None] = [None] * len(self.next)
        for key, s in sequences.items():
            v = 0
            for c in s:
                v = self.next[v][c]
            if self.own[v] is None:
                self.own[v] = []
            self.own[v].append((len(s), key))
        # ``up``: the nearest state on the suffix path, the state itself included, at which sequences end
        self.up = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.own[v]:
                self.own[v].sort(reverse=True)
                self.up[v] = v
            else:
                self.up[v] = self.up[self.link[v]]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest factor and c, split off from its class if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class PrefixEncoder:
    """Encodes words of one vocabulary; ``encode`` takes whole texts."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        model = json.loads(vocabulary)
        vocab, letters = model["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._specials = re.compile("(" + ("|".join(map(re.escape, self.special)) or "(?!)") + ")")
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = {t: (letters[t[0]] + 256 * (t[1:] == WORD_END),) for t in vocab if t[0] in letters and t[1:] in ("", WORD_END)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        sequences = {vocab[t]: s for t, s in symbols.items()}
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left << 20 | right] = rank
            if whole not in sequences:
                self.parts[whole], self.rank[whole] = (left, right), rank
                sequences[whole] = sequences[left] + sequences[right]
        self.automaton = SuffixAutomaton(sequences)
        self._fits: dict[int, bool] = {}
        self._library, self._from_letters = Tokenizer.from_str(vocabulary), letters
        self._special_values = {s: self._value([i]) for s, i in self.special.items()}
        self.words, self.chunks = Memo(self._words, REMEMBERED), Memo(self._chunks, REMEMBERED)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is the two tokens.

        Goes back in time from the finished tokens, undoing the later merge of
        the two that meet at the boundary, and looks for a merge across it that
        would have come before one of them was used up.
        """
        rank, x, y, x_until, y_until = self.rank, left, right, _NEVER, _NEVER
        while True:
            across = self.merged.get(x << 20 | y)
            if across is not None and across < x_until and across <= y_until:
                return False
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x_until, x = rx, self.parts[x][1]
            else:
                y_until, y = ry, self.parts[y][0]

    def _fit(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > _PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.compatible(left, right)
        return known

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        a, last, back = self.automaton, [0], [0]
        nexts, links, lengths, own, up = a.next, a.link, a.length, a.own, a.up
        v = matched = 0
        for p, c in enumerate(symbols, 1):
            while c not in nexts[v]:
                v = links[v]
                matched = lengths[v]
            v = nexts[v][c]
            matched += 1
            u, found = up[v], False
            while not found:
                for size, token in own[u]:
                    if size <= matched and (size == p or self._fit(last[p - size], token)):
                        last.append(token)
                        back.append(p - size)
                        found = True
                        break
                else:
                    u = up[links[u]]
        out, p = [], len(symbols)
        while p:
            out.append(last[p])
            p = back[p]
        return out[::-1]

    def _words(self, words: list[str]) -> Iterator[tuple[bytes, str]]:
        for w in words:
            symbols = list(w.encode())
            symbols[-1] += 256
            yield self._value(self.encode_symbols(symbols))

    def _value(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def _asked(self, chunk: str) -> list[str]:
        """The words of a chunk by the vocabulary's own normalizer and pre-tokenizer; special tokens stand for themselves."""
        out = []
        for s in self._specials.split(chunk):
            if s in self.special:
                out.append(s)
            elif s:
                pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(s))
                out += [bytes(self._from_letters[c] for c in w).decode() for w, _ in pieces]
        return out

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[bytes, str]]:
        split = [words_of(c) for c in chunks]
        split = [self._asked(c) if s is None else s for c, s in zip(chunks, split, strict=True)]
        ids = self.words.ready({w for s in split for w in s}.difference(self.special))
        for words in split:
            if len(words) == 1 and words[0] in ids:
                yield ids[words[0]]
            else:
                found = [self._special_values[w] if w in self.special else ids[w] for w in words]
                yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, the decoded text) of each text."""
        chunked = [chunks_of(t) for t in texts]
        known = self.chunks.ready(set().union(*chunked))
        for c in chunked:
            found = [known[x] for x in c]
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])


def prefix_encoder(vocabulary: Broadcast) -> PrefixEncoder:
    return heavy(("prefix", hash(vocabulary.value)), lambda: PrefixEncoder(vocabulary.value))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array, decoded text) of every document. Null text counts as empty; rows and their order stay."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(shared)
        for batch, texts in text_slices(batches, "text"):
            done = list(encoder.encode(texts))
            ids = pa.array([array("I", i).tolist() for i, _ in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([d for _, d in done], pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document, as :func:`encode_documents` encodes it.

    Null text counts as empty and has no tokens. Texts of any length are
    encoded whole. Repeated rows are encoded each for itself, null ids are
    kept, other columns are not read. An empty table gives no rows.
    """
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(shared)
        for batch, texts in text_slices(batches, "text"):
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, d in encoder.encode(texts)]
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
