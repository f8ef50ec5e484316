"""What is done batch by batch on flat bytes gives what the plain rules give, and deals out no row for a residue or k-mer."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest

from kmerloom.functions import flat, recode
from kmerloom.operators import alignment, anchors, consensus, kmers, orf, phylo
from kmerloom.params import Params
from kmerloom.plans import queries

LETTERS = recode.LETTERS


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_texts(rnd, n):
    parts = ["", " ", "\t", "\n\f\r", ".", "b1", "éſK", "\v", "x" * 3, "ac", "DEF", "W Y", LETTERS, LETTERS.lower()]
    return [None, "", "ACD", ".ACD", "ACD.", " . ", "中ACD中"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def proteins_of(spark, texts, species=3):
    return spark.createDataFrame([(i % species, i, t) for i, t in enumerate(texts)], "sid int, protein_id long, seq string")


def test_runs_are_the_parts_between_what_is_no_residue(spark, monkeypatch):
    monkeypatch.setattr(flat, "SLICE", 50)
    texts = odd_texts(random.Random(1), 300)
    for least in (1, 5):
        want = []
        for i, t in enumerate(texts):
            up = "".join(c.upper() if c in LETTERS.lower() else c for c in re.sub("[ \t\n\f\r]", "", t or ""))
            want += [(i, n, s) for n, s in enumerate(re.split(f"[^{LETTERS}]+", up)) if len(s) >= least]
        got = kmers.segments(proteins_of(spark, texts), "sr6", least).collect()
        assert sorted((r["protein_id"], r["seg_id"], r["aa"]) for r in got) == want
        assert all(r["code"] == r["aa"].translate(str.maketrans(LETTERS, recode.SCHEMES["sr6"])) for r in got)
    part = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]).slice(3, 9)
    assert [x for s in flat.slices(part, 0) for x in s.column(0).to_pylist()] == texts[3:12]


def test_values_of_kmers():
    rnd = random.Random(2)
    codes = ["".join(rnd.choice("012345") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    for k in (1, 2, 7, 9, 21):
        for base in (6, 8):
            row, start, value = kmers.rolled(*flat.flat(pa.array(codes)), k, base)
            want = [(i, at, int(c[at : at + k], base)) for i, c in enumerate(codes) for at in range(len(c) - k + 1)]
            assert list(zip(row.tolist(), start.tolist(), value.tolist(), strict=True)) == want
            assert base == 8 or kmers.octal(value, k).tolist() == [int(codes[i][at : at + k], 8) for i, at, _ in want]
    assert not len(kmers.rolled(*flat.flat(pa.array([], pa.string())), 3)[0])


def test_occupancy_counts_species_once(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(12)]), "".join(rnd.choice("012345") for _ in range(rnd.randint(0, 60)))) for _ in range(300)]
    segs = spark.createDataFrame(rows, "sid int, code string").repartition(3)
    for k in (1, 4, 9, 10):
        own = defaultdict(set)
        for sid, code in rows:
            for at in range(len(code) - k + 1):
                own[int(code[at : at + k], 8)].add(sid)
        assert {r["kmer"]: r["occ"] for r in kmers.occupancy(segs, k).collect()} == {m: len(s) for m, s in own.items()}
    assert kmers.dense(9) and not kmers.dense(10)
    assert "kmer" not in plan_of(kmers._occupancy_pieces(segs, 9))  # bits of many k-mers are dealt out


@pytest.fixture(scope="module")
def long_segments(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(9, 25))) for _ in range(12)]
    texts = [".".join("".join(rnd.choice([*words, rnd.choice(LETTERS) * 3]) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 4))) for _ in range(90)]
    return kmers.segments(proteins_of(spark, texts), "sr6", 9).cache()


def bag(df):
    return sorted(map(tuple, df.collect()))


def test_edges_equal_those_of_joins(long_segments, monkeypatch):
    for k, need in ((9, 2), (4, 3)):
        got = anchors.edges(long_segments, k, need)
        assert "Exchange" not in plan_of(got)
        rows = bag(got)
        with monkeypatch.context() as m:
            m.setattr(kmers, "DENSE", 0)
            assert rows == bag(anchors.edges(long_segments, k, need)) and rows


@pytest.mark.parametrize("clustered", [False, True])
def test_observations_equal_those_of_joins(long_segments, monkeypatch, clustered):
    for k, need, middle in ((9, 2, 35), (4, 2, 60), (6, 3, 12)):
        got = anchors.observed(long_segments, k, need, middle, clustered)
        assert "Exchange" not in plan_of(got)
        rows = bag(got)
        with monkeypatch.context() as m:
            m.setattr(kmers, "DENSE", 0)
            assert rows == bag(anchors.observed(long_segments, k, need, middle, clustered)) and rows


STATE = dict(zip(LETTERS, recode.SCHEMES["sr6"], strict=True))


def test_blocks_have_all_residues(spark):
    texts = odd_texts(random.Random(5), 100)
    want = []
    for i, t in enumerate(texts):
        aa = "".join(c.upper() if c in LETTERS.lower() else c for c in t or "" if c in LETTERS + LETTERS.lower())
        want += [("s", n, i, aa[at : at + 7].ljust(7, "-")) for n, at in enumerate(range(0, len(aa), 7))]
    got = consensus.blocks(spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "lk string, sid long, text string"), 7)
    assert "Generate" not in plan_of(got) and bag(got) == sorted(want)


@pytest.fixture(scope="module")
def many_rows(spark):
    """Rows of groups whose rows are of one length, some of a null group; held by several tasks."""
    rnd = random.Random(6)
    rows = []
    for g in range(12):
        base = "".join(rnd.choice(LETTERS) for _ in range(rnd.choice([1, 6, 14])))
        for _ in range(rnd.randint(1, 60)):
            rows.append((rnd.choice(["a", "b"]) if g else None, g, rnd.randint(0, 5), "".join(rnd.choice(LETTERS + "-XB") if rnd.random() < 0.05 else c for c in base)))
    return rows, spark.createDataFrame(rows, "lk string, rk int, sid long, block string").repartition(5).cache()


@pytest.mark.parametrize("held", [(1 << 20, 1 << 17), (300, 1 << 17), (1 << 20, 3)])
def test_rows_of_a_species_are_merged_before_they_are_sent(many_rows, monkeypatch, held):
    monkeypatch.setattr(consensus, "HELD", held[0])
    monkeypatch.setattr(consensus, "KEYS", held[1])
    rows, df = many_rows
    own = defaultdict(list)
    for lk, rk, sid, block in rows:
        own[lk, rk, sid].append(block)
    want = {(*k, "".join(c[0] if len(set(c)) == 1 else "X" for c in zip(*v, strict=True))) for k, v in own.items()}
    got = consensus.observed_rows(df)
    assert "Generate" not in plan_of(got)  # no row is made for a residue
    assert len(rows) > len(want) and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("held", [1 << 20, 2_000])
def test_columns_are_counted_before_they_are_sent(many_rows, monkeypatch, held):
    monkeypatch.setattr(consensus, "HELD", held)
    rows, df = many_rows
    own = defaultdict(list)
    for lk, rk, _, block in rows:
        own[lk, rk].append(block)
    report, majority, letters = set(), set(), set()
    for key, blocks in own.items():
        columns = list(zip(*blocks, strict=True))
        best = lambda votes: min(votes, key=lambda x: (-votes[x], x)) if votes else "."
        majority.add((*key, "".join(best(Counter(STATE[c] for c in col if c in STATE)) for col in columns)))
        letters.add((*key, "".join(best(Counter(c for c in col if c in STATE)) for col in columns).replace(".", "")))
        report |= {(*key, n, sum(c in "-X" for c in col), len({STATE[c] for c in col if c in STATE}), len(col)) for n, col in enumerate(columns)}
    for got, want in ((consensus.column_report(df, "sr6"), report), (consensus.column_majority(df, "sr6"), majority), (consensus.column_letters(df), letters)):
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "col" not in plan_of(consensus.column_majority(df, "sr6")).replace("collect", "")  # one matrix a group is dealt out


def test_masking_sends_the_majorities(many_rows):
    rows, df = many_rows
    majority = consensus.column_majority(df, "sr6")
    of = {(r["lk"], r["rk"]): r["majority"] for r in majority.collect()}
    want = []
    for lk, rk, sid, block in rows:
        differs = "".join("1" if c in STATE and m != "." and STATE[c] != m else "0" for c, m in zip(block, of[lk, rk], strict=True))
        want += [(lk, rk, sid, "X" * len(block) if "1" in differs else block)] * (lk is not None)
    got = consensus.masked_rows(df, majority, 1, "sr6")
    assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
    assert bag(got) == sorted(want) and any("XX" in w[3] for w in want)


def test_only_groups_that_can_keep_a_column_are_looked_at(spark):
    p, rnd = Params(k=1, mask=0, min_freq=0.6), random.Random(7)
    rows = [(1, g, sid, "".join(rnd.choice("GKEW") for _ in range(6))) for g in range(5) for sid in range(10) if sid < 8 - g]
    df = spark.createDataFrame(rows, "lk long, rk long, sid int, block string")
    groups = df.groupBy("lk", "rk").count().withColumnRenamed("count", "coverage").selectExpr("*", "6 as raw_len")
    near = alignment.reachable(df, groups, p, 10)
    assert {r["rk"] for r in near.collect()} == {0, 1}  # 8 and 7 of 10
    assert bag(alignment.kept_columns(near, groups, p, 10)) == bag(alignment.kept_columns(df, groups, p, 10)) != []


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_words_of_half_the_names(spark, monkeypatch, sent):
    """Names of one record count once; whatever part of the names a task holds."""
    monkeypatch.setattr(consensus, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(consensus, "KEYS", 40)
    rnd, rows = random.Random(8), []
    for i in range(240):
        words = rnd.sample(["heat", "shock", "factor", "of\xa0x", "ß"], rnd.randint(0, 5)) + [f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 4))]
        rows.append((rnd.choice(["a", None]), 0, rnd.choice([0, None]), i // 2 if i < 40 else i, 0, 0, f"id{i} {rnd.choice([' ', chr(9), ''])}" + rnd.choice([" ", "\t ", "\n"]).join(words)))
    # the rule, one name at a time
    want = {}
    for g in ("a", None):
        names = [(r[2:6], re.sub(r"^[^ \t\n\x0b\f\r]+", "", r[6].strip(" ")).strip(" ")) for r in rows if r[0] == g]
        names = [(at, re.split(r"[ \t\n\x0b\f\r]+", rest)) for at, rest in names if rest]
        first: dict = {}
        for at, words in names:
            for pos, w in enumerate(words):
                first[at, w] = min(first.get((at, w), pos), pos)
        votes = defaultdict(list)
        for (at, w), pos in first.items():
            votes[w].append(((tuple(-1 if x is None else x for x in at), pos), pos))
        kept = [(Fraction(sum(p for _, p in v), len(v)), min(a for a, _ in v), w) for w, v in votes.items() if 2 * len(v) >= len(names)]
        want[g] = " ".join(w for _, _, w in sorted(kept))
    named = spark.createDataFrame(rows, "lk string, rk int, sid int, protein_id long, seg_id int, start int, name string").repartition(4)
    got = consensus.consensus_names(named)
    assert {r["lk"]: r["label"] for r in got.collect()} == {"a": want["a"]} and want["a"]


def test_missing_percent_holds_no_rows(spark):
    assert "collect_list" not in plan_of(queries.missing_percent(spark, "/root/testdata/sf0.001"))


def test_composition_needs_the_first_contigs_only(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 1, 2]), i, None if rnd.random() < 0.1 else "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 40)))) for i in range(400)]
    want = {}
    for sid in range(3):
        head = "".join(s or "" for g, _, s in rows if g == sid)[:200]
        valid = sum(c in "ACGT" for c in head)
        want[sid] = (pytest.approx(sum(c in "GC" for c in head) / valid), pytest.approx(valid / len(head)))
    df = spark.createDataFrame(rows, "sid int, contig_id long, seq string").repartition(4)
    monkeypatch.setattr(orf, "GC_SAMPLE", 200)
    assert orf._heads(df).count() < 200
    for held in (1 << 20, 100):
        monkeypatch.setattr(orf, "HELD", held)
        assert {r["sid"]: (r["gc"], r["acgt"]) for r in orf.genome_composition(df).collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(orf.predict(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan  # contigs stay where they are


def test_distances_of_uneven_rows(spark):
    rnd = random.Random(10)
    rows = [(i, "".join(rnd.choice(LETTERS[:4] + "-XB") for _ in range(30 + i))) for i in range(5)] + [(9, "")]
    want = []
    for i, x in rows:
        for j, y in rows:
            if i < j:
                both = [(a, b) for a, b in zip(x, y, strict=False) if a in LETTERS and b in LETTERS]
                want.append((i, j, len(both), sum(a != b for a, b in both)))
    got = phylo.pairwise_distances(spark.createDataFrame(rows, "sid int, seq string"))
    assert "arrays_zip" not in plan_of(got) and bag(got.select("i", "j", "valid", "mismatches")) == want
