"""Token ids by the tokenizers library, remembered by chunk.

The vocabulary's pre-tokenizer never joins characters across white space and
its normalizer works within a chunk, so a text's ids are those of its white
space separated chunks one after the other. Each worker keeps what the library
gave for the chunks it has met, in a memo of bounded size.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Python's split takes these for white space; the vocabulary's patterns do not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(rf"[^\S{_NOT_SPACE}]+")
# Fixed value: the vocabulary's word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(WORDS)
_LATIN = "\u0250"
#: A single mark between a letter and white space: it is a word of its own.
_MARK = re.compile(r"([.,;:!?])(?<=[^\W\d_].)(?!\S)")
_HIGH = re.compile("[\u0250-\U0010ffff]")
#: Chunks in one generation of a memo; at most two generations are held.
MEMO = 60_000
#: The same for the pieces of texts, most of them words in lower case.
PIECES = 120_000
#: Longer keys are never remembered, so a memo's bytes are bounded as its entries are.
MEMO_CHARS = 200

_of_process: dict = {}
_heavy: tuple | None = None


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def share_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's text for the executors: one file of fixed size, about 2 MB."""
    return spark.sparkContext.broadcast(Path(path or default_vocabulary()).read_text(encoding="utf-8"))


def once(kind: str, key, make: Callable):
    """What ``make`` gave for ``key`` in this process; a new key of a kind takes the place of the old one."""
    if (held := _of_process.get(kind)) is None or held[0] != key:
        held = _of_process[kind] = (key, make())
    return held[1]


def trim() -> None:
    """Give freed memory back to the system; the allocators keep it, and idle workers count as much as busy ones."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def drop_heavy() -> None:
    """Give back the memory of what :func:`heavy` holds; workers outlive the stage that filled it."""
    global _heavy
    if _heavy is not None:
        _heavy = None
        gc.collect()
        trim()


def heavy(key: tuple, make: Callable):
    """Like :func:`once` for encoders and models with their memos: a process holds one of them, whatever its kind."""
    global _heavy
    if _heavy is None or _heavy[0] != key:
        drop_heavy()
        _heavy = (key, make())
        trim()
    return _heavy[1]


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in _NOT_SPACE):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def spaced_pieces(text: str) -> str | None:
    """Chunks, or parts of chunks that the vocabulary would part too, most of them single words in lower case; none where only chunks will do."""
    if "<|" in text or any(c in text for c in _NOT_SPACE) or not text.isascii() and _HIGH.search(text):
        return None
    return _MARK.sub(r" \1", text.lower())


class Memo:
    """Values of keys, computed for many keys at once, in two generations of bounded size."""

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = MEMO):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}
        self.long: list[str] = []

    def ready(self, keys: set[str]) -> dict:
        """A dict that has all of ``keys``."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = [k for k in keys if len(k) > MEMO_CHARS]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new = []
        for k in keys.difference(self.young.keys()):
            if (v := self.old.get(k)) is not None:
                self.young[k] = v
            else:
                new.append(k)
        self.young.update(zip(new, self.compute(new), strict=True))
        return self.young

    def values(self, keys: list[str]) -> list:
        """The values of ``keys``, which are distinct, in their order."""
        for k in self.long:
            self.young.pop(k, None)
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        before = [(i, keys[i], self.old.get(keys[i])) for i, v in enumerate(out) if v is None]
        new = [k for _, k, v in before if v is None]
        self.long = [k for k in new if len(k) > MEMO_CHARS]
        made = iter(self.compute(new))
        for i, k, v in before:
            out[i] = self.young[k] = next(made) if v is None else v
        return out


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def words_of(chunk: str) -> list[str] | None:
    """The vocabulary's words of one chunk; none where the library itself must be asked.

    Below U+0250 normalization leaves text as it is but for its case.
    """
    if not chunk.isascii() and max(chunk) >= _LATIN:
        return None
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[-1:] in ".,;:!?" and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return None if "<|" in chunk else _WORDS.findall(low)


class LibraryEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model, held once, fed with words in byte letters that are split already
        self._spaced = Tokenizer(self.tokenizer.model)
        self._spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._letters = {b: c for c, b in byte_letters().items()}
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._ends = ends
        self.words, self.memo = Memo(self._words), Memo(self._chunks, PIECES)

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        spelled = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self._letters) for w in words]
        for e in self._spaced.encode_batch_fast([" ".join(spelled[i : i + 500]) for i in range(0, len(spelled), 500)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, cuts = ids.tobytes(), (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            out += [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; words in lower case are encoded at once, others are split and their words remembered."""
        plain = [c.isalpha() and c.islower() and (c.isascii() or max(c) < _LATIN) for c in chunks]
        encoded = iter(self._words(list(compress(chunks, plain))))
        known: dict[str, bytes] = {}
        split = {c: words_of(c) for c, p in zip(chunks, plain, strict=True) if not p}
        ids = self.words.ready({w for s in split.values() if s for w in s})
        odd = [c for c, s in split.items() if s is None]
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [], strict=True):
            known[c] = np.array(e.ids, "<u4").tobytes()
        for c, s in split.items():
            if s is not None:
                known[c] = ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s])
        return [next(encoded) if p else known[c] for c, p in zip(chunks, plain, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Arrow parts the texts and numbers their distinct pieces; only these are looked up, and the ids gathered by number."""
        spaced = [spaced_pieces(t) if t else "" for t in texts]
        odd = {i: chunks_of(t) for i, (t, s) in enumerate(zip(texts, spaced, strict=True)) if s is None}
        parted = pc.utf8_split_whitespace(pa.array([s or "" for s in spaced], pa.large_string()))
        numbered = pc.dictionary_encode(parted.flatten())
        pieces, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        wanted = list(dict.fromkeys(chain(pieces, *odd.values()))) if odd else pieces
        each = self.memo.values(wanted)
        ids = dict(zip(wanted, each, strict=True)) if odd else {}
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts, counts = np.cumsum(sizes) - sizes, sizes[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) + np.repeat(starts[number] - ends[:-1], counts)
        gathered = np.frombuffer(b"".join(each), "<u4")[at].tobytes()
        cuts = (4 * ends[parted.offsets.to_numpy()]).tolist()
        return [b"".join(map(ids.__getitem__, odd[i])) if i in odd else gathered[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def library_encoder(vocabulary: Broadcast) -> LibraryEncoder:
    return heavy(("library", hash(vocabulary.value)), lambda: LibraryEncoder(vocabulary.value))


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, chars: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each holds about ``chars`` characters or one row; nulls as empty strings.

    After the last of them the memory they took is given back.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        begin = held = 0
        for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            if held and held + size > chars:
                yield batch.slice(begin, i - begin), [x or "" for x in texts.slice(begin, i - begin).to_pylist()]
                begin, held = i, 0
            held += size
        if begin < len(texts):
            yield batch.slice(begin), [x or "" for x in texts.slice(begin).to_pylist()]
    batch = texts = None
    trim()
