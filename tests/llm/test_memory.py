import random

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.llm import near_dup, tables, tokens


def test_workers_get_small_batches_of_texts(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(tables._BATCH_ROWS)
    seen = [r["n"] for r in tables.materialise(spark.range(0, 5_000, numPartitions=1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(seen) == 5_000 and max(seen) <= tables.BATCH_ROWS
    assert spark.conf.get(tables._BATCH_ROWS) == before


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    given = []
    monkeypatch.setattr(tokens, "trim", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 4, None, "b" * 7, "", "c"])], names=["text"])
    slices = [t for _, t in tokens.text_slices(iter([batch, batch]), "text", 10)]
    assert slices == [["aaaa", ""], ["bbbbbbb", "", "c"]] * 2
    assert given == [1]


@pytest.fixture(scope="module")
def encoder():
    return tokens.LibraryEncoder(open(tokens.default_vocabulary(), encoding="utf-8").read())


def test_ids_of_any_white_space_and_marks(encoder):
    rnd = random.Random(4)
    letters = "aéB .,;:!?\x1c\x85\xa0 　İȺß<|>\n\t_-3中\x0b\x0c'"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(2_000)] + ["", None, "<|endoftext|>", " ", "\xa0x "]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert encoder.encode([]) == []


def test_memo_computes_what_it_does_not_hold_once():
    asked = []

    def compute(keys):
        asked.extend(keys)
        return [k.upper() for k in keys]

    memo = tokens.Memo(compute, 2)
    long = "x" * (tokens.MEMO_CHARS + 1)
    assert memo.values(["b", "a", long]) == ["B", "A", long.upper()]
    assert memo.values(["a", "c", "b"]) == ["A", "C", "B"] and asked == ["b", "a", long, "c"]
    assert memo.values([long, "c", "d"]) == [long.upper(), "C", "D"] and asked[4:] == [long, "d"]
    assert memo.values([]) == []


def test_near_classes_count_shingles_in_small_batches(spark, monkeypatch):
    used = []
    held = tables.small_batches
    monkeypatch.setattr(near_dup, "small_batches", lambda s: used.append(1) or held(s))
    near_dup.shingle_idf(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
    assert used == [1]
