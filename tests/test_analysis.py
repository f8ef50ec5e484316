"""The analysis on proteins: table-driven cases, a worked data set, and rounds against the fold."""

from __future__ import annotations

import gzip
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import nucleotides, recode
from kmerloom.operators import alignment, anchors, consensus, groups, kmers, orf, overlap, phylo
from kmerloom.params import Params, overlap_k
from kmerloom.plans import pipeline, run
from kmerloom.sources import fasta, sinks

# The worked data set's sequence B, what its samples differ in, and its tree.
B = "MVLFFQILGFALFIFWLLLIARVVVEFIRSFSRDWHPTGITVVVLEIIMSITDPPVKLLRRLIPQLTIGAVRFDLSIMVLLLVAFIGMQLAFGAAA"


def edited(*changes):
    s = list(B)
    for at, aa in changes:
        s[at] = aa
    return "".join(s)


#: A's sequence is inferred from the aligned columns; the others are given.
SAMPLES = {
    "A": edited((35, "P")), "B": B, "C": edited((30, "R")), "D1": edited((30, "R"), (33, "Q")), "D2": edited((30, "R"), (33, "Q")), "E1": B, "E2": B, "E3": B,
}
TREE = "((E2:0.000000,(A:0.129463,B:0.000000):0.001888):0.000944,(E3:0.000000,(E1:0.000000,(C:0.000000,(D1:0.000000,D2:-0.000000):0.137158):0.137255):0.001888):0.000944);"


@pytest.mark.parametrize("scheme", ["dayhoff6", "kgb6"])
def test_three_differences(spark, tmp_path, scheme):
    for name, seq in SAMPLES.items():
        data = f">{name} ribosomal protein 12\n{seq[:50]}\n{seq[50:]}\n".encode()
        if name == "A":
            (tmp_path / "A.fas.gz").write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))
        else:
            (tmp_path / f"{name}.fas").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no input")
    (tmp_path / "list.tsv").write_text("".join(f"{n}\t{n}.fas{'.gz' if n == 'A' else ''}\n" for n in SAMPLES) + "\n")
    inputs = fasta.inputs(spark, manifest=str(tmp_path / "list.tsv")) if scheme == "kgb6" else fasta.inputs(spark, folder=str(tmp_path))
    assert [r["name"] for r in inputs.collect()] == sorted(SAMPLES)
    given = {"manifest": str(tmp_path / "list.tsv")} if scheme == "kgb6" else {"folder": str(tmp_path)}
    done = run.run(spark, str(tmp_path / "res.v1"), **given, params=Params(recode=scheme), nj=True)
    assert (done.species, done.filtered_groups, done.length, done.pct_missing) == (8, 1, 9, 0.0)
    want = {"A": "FSRDWPPTG", "C": "RSRDWHPTG", "D1": "RSRQWHPTG", "D2": "RSRQWHPTG"}
    assert (tmp_path / "res.v1_alignment.fas").read_text() == "".join(f">{n}\n{want.get(n, 'FSRDWHPTG')}\n" for n in sorted(SAMPLES))
    assert (tmp_path / "res.v1_partitions.tsv").read_text().split("\n")[1] == "0\t8\t9\tribosomal protein 12"
    assert (tmp_path / "res.v1_missing.tsv").read_text().split("\n")[:2] == ["species\tpct_missing", "A\t0.0"]
    assert (tmp_path / "res.v1_NJ.tree").read_text().strip() == TREE


def test_thresholds_follow_single_precision():
    assert (Params(min_freq=0.85).min_needed(20), Params(min_freq=0.85).max_missing(20)) == (17, 2)
    assert [overlap_k(k) for k in (1, 9, 10, 20)] == [3, 19, 21, 21]
    with pytest.raises(ValueError):
        Params(k=22).checked()


def test_recoding_is_ascii_and_digits_are_no_states(spark):
    rows = spark.createDataFrame([(0, 1, "ac 1d\nſßeY*" + "ACDEF" * 2), (0, 2, None), (0, 3, "")], "sid int, protein_id long, seq string")
    got = [(r["aa"], r["code"]) for r in kmers.segments(rows, "sr6").orderBy("protein_id", "seg_id").collect()]
    assert got == [("AC", "04"), ("D", "1"), ("EY", "15"), ("ACDEFACDEF", "0411504115")]
    for s in recode.SCHEMES.values():
        assert len(s) == 20
    assert spark.range(1).select(kmers.packed(F.lit("5" * 21)), kmers.unpacked(F.lit(8), 4)).first()[:] == (6588122883467697005, "0010")


def obs_of(spark, rows):
    return spark.createDataFrame(rows, "lk long, rk long, sid int, protein_id long, seg_id int, start int, len int, block string")


def test_length_choice(spark):
    rows = []
    for key, lengths in ((1, {9: 3, 10: 1}), (2, {9: 2, 10: 2}), (3, {9: 1}), (4, {6: 3})):
        sid = 0
        for n, count in lengths.items():
            for _ in range(count):
                rows.append((key, 0, sid, 0, 0, 0, n, "A" * n))
                sid += 1
    got = groups.candidates(groups.length_support(obs_of(spark, rows)), 2, 3).collect()
    assert [(r["lk"], r["coverage"], r["raw_len"]) for r in got] == [(1, 3, 9)]


def test_start_clusters_reopen(spark):
    starts = [(0, 5), (4, 7), (9, 7), (10, 1), (19, 2), (20, 9)]
    df = spark.createDataFrame([(0, 0, 0, s, o, s) for s, o in starts], "sid int, protein_id long, seg_id int, start int, occ long, kmer long")
    assert sorted(r["start"] for r in anchors.clustered_starts(df).collect()) == [4, 19, 20]


def test_rounds_equal_the_fold(spark):
    rnd = random.Random(9)
    for n in (30, 60):
        cands = pd.DataFrame([(i, rnd.randint(0, 5), rnd.randint(1, 4), rnd.randint(20, 24)) for i in range(n)], columns=["lk", "rk", "coverage", "raw_len"])
        own = pd.DataFrame([(r.lk, r.rk, k) for r in cands.itertuples() for k in {rnd.randint(0, n) for _ in range(rnd.randint(0, 4))}], columns=["lk", "rk", "kmer"])
        got = overlap.nonoverlapping(spark.createDataFrame(cands), spark.createDataFrame(own))
        assert sorted((r["lk"], r["rk"]) for r in got.collect()) == sorted(overlap.nonoverlapping_fold(cands, own))


def rows_of(spark, rows):
    return consensus.observed_rows(obs_of(spark, [(0, 0, i, 0, 0, 0, len(r), r) for i, r in enumerate(rows)]))


def by_hand(rows, p, n):
    """The kept columns of one group's rows, by the rules and one residue at a time."""
    state = dict(zip(recode.LETTERS, recode.SCHEMES[p.recode], strict=True))
    width = len(rows[0])
    most = []
    for c in range(width):
        votes = Counter(state[r[c]] for r in rows if r[c] in state)
        most.append(min(votes, key=lambda s: (-votes[s], s)) if votes else None)
    shown = []
    for r in rows:
        differs = "".join("1" if r[c] in state and most[c] and state[r[c]] != most[c] else "0" for c in range(width))
        shown.append("X" * width if p.mask and "1" * p.mask in differs else r)
    fine = [c for c in range(width) if n - len(rows) + sum(r[c] in "-X" for r in shown) <= p.max_missing(n)]
    middle = [c for c in fine if p.k <= c < width - p.k]
    varied = [c for c in middle if len({state[r[c]] for r in shown if r[c] in state}) > 1]
    if not varied:
        return ["" for _ in shown]
    kept = [c for c in middle if varied[0] <= c <= varied[-1]] + [c for c in fine if width - p.k <= c < width - p.k + p.tail]
    return ["".join(r[c] for c in kept) for r in shown]


def columns_of(spark, rows, p, n):
    given = rows_of(spark, rows)
    found = spark.createDataFrame([(0, 0, 1, len(rows[0]))], "lk long, rk long, coverage long, raw_len int")
    cols = alignment.group_columns(given, found, p, n)
    labels = spark.createDataFrame([], "lk long, rk long, label string")
    species = spark.createDataFrame([(i,) for i in range(n)], "sid int")
    return [r["seq"] for r in alignment.aligned(cols, alignment.partitions(cols, found, labels), species).orderBy("sid").collect()]


def test_columns_against_the_rules(spark):
    rnd = random.Random(11)
    some = 0
    for k, tail, mask, freq, n in ((1, 0, 0, 0.75, 6), (2, 2, 2, 0.5, 5), (3, 1, 3, 0.6, 8), (2, 2, 4, 1.0, 4)):
        p = Params(k=k, constant=tail, mask=mask, min_freq=freq)
        base = "".join(rnd.choice("GAVLIKREDW") for _ in range(14))
        rows = ["".join(rnd.choice("GKEW-X") if rnd.random() < 0.25 else c for c in base) for _ in range(n - 1)]
        want = by_hand(rows, p, n)
        some += bool(want[0])
        assert columns_of(spark, rows, p, n) == [*want, "-" * len(want[0])]  # the last species has no row
    assert some


def test_groups_are_concatenated_in_order(spark):
    """Ranks follow coverage, length and keys; a species without a row in a group gets gaps."""
    columns = spark.createDataFrame([(1, 1, 0, "KK"), (2, 1, 0, "RRR"), (2, 1, 1, "EEE"), (3, 1, 1, "W")], "lk long, rk long, sid int, seq string")
    found = spark.createDataFrame([(1, 1, 5, 9), (2, 1, 7, 9), (3, 1, 5, 12), (4, 1, 99, 9)], "lk long, rk long, coverage long, raw_len int")
    labels = spark.createDataFrame([(3, 1, "three")], "lk long, rk long, label string")
    parts = alignment.partitions(columns, found, labels)
    assert [tuple(r)[1:5] for r in parts.orderBy("rank").collect()] == [(0, 2, 3, ""), (3, 3, 1, "three"), (4, 5, 2, "")]
    got = alignment.aligned(columns, parts, spark.createDataFrame([(0,), (1,), (2,)], "sid int")).orderBy("sid").collect()
    assert [r["seq"] for r in got] == ["RRR-KK", "EEEW--", "------"]


def test_observations_of_a_species_are_merged(spark):
    rows = obs_of(spark, [(0, 0, 0, 0, 0, 0, 4, "GAVL"), (0, 0, 0, 1, 0, 0, 4, "GKVL"), (0, 0, 1, 2, 0, 0, 4, "WWWW"), (0, 0, 1, 3, 0, 0, 4, "WWWW")])
    assert sorted((r["sid"], r["block"]) for r in consensus.observed_rows(rows).collect()) == [(0, "GXVL"), (1, "WWWW")]


def test_majority_takes_the_lowest_of_equals(spark):
    # W and Y alone are states 4 and 5 of sr6 on their own terms; the lowest of two equal votes wins, gaps and X have none
    s = dict(zip(recode.LETTERS, recode.SCHEMES["sr6"], strict=True))
    got = consensus.column_majority(rows_of(spark, ["WK-G", "YKXB", "WEX-", "YE-Z"]), "sr6").first()["majority"]
    assert got == min(s["W"], s["Y"]) + min(s["K"], s["E"]) + "." + s["G"]


@pytest.mark.parametrize(("row", "want"), [("KKGWWKGWK", "KKGWWKGWK"), ("GWWWGGGGG", "XXXXXXXXX"), ("WWG-WWXWW", "WWG-WWXWW"), ("GGGGGGWWW", "XXXXXXXXX")])
def test_masking(spark, row, want):
    """Rows against a majority of G and K: W differs from both; three running are masked, gaps and X break a run."""
    s = dict(zip(recode.LETTERS, recode.SCHEMES["sr6"], strict=True))
    plain = "".join(s[c] if c in "GK" else s["G"] for c in row)
    majority = spark.createDataFrame([(0, 0, plain)], "lk long, rk long, majority string")
    assert consensus.masked_rows(rows_of(spark, [row, row]), majority, 3, "sr6").first()["block"] == want


def test_names(spark):
    rows = [(0, 0, i, 0, 0, 0, n) for i, n in enumerate(["r1 heat shock factor alpha", "r2 shock factor", "r3 heat factor beta", "r4 heat", "r5", ""])]
    named = spark.createDataFrame(rows, "lk long, rk long, sid int, protein_id long, seg_id int, start int, name string")
    # heat: 3 of 4 names at places 0, 0, 0; shock: 2 at 1, 0; factor: 3 at 2, 1, 1
    assert [r["label"] for r in consensus.consensus_names(named).collect()] == ["heat shock factor"]
    assert fasta.label("id7 some enzyme, putative  [Genus species]") == "id7 some enzyme, putative"


def test_sources(tmp_path):
    assert [fasta.species_name(x) for x in ("a/b.fa.gz", "X.FA.GZ", "c.d.fna", "e.txt")] == ["b", "X", "c.d", "e.txt"]
    assert fasta.parse_fasta(b">a b > c\r\nAC\r\nD E\n>d\n") == [("a b > c", "ACDE"), ("d", "")]
    assert fasta.parse_fasta(b" \n") == []
    with pytest.raises(ValueError, match="no FASTA"):
        fasta.parse_fasta(b"ACGT\n>a\nAC\n")
    for bad in ("one\n", "a\tb\tc\n", "a\tnone.fa\n"):
        (tmp_path / "m.tsv").write_text(bad)
        with pytest.raises(ValueError):
            fasta.manifest_inputs(str(tmp_path / "m.tsv"))
    (tmp_path / "p.fa").write_text(">x\nA\n")
    (tmp_path / "p.faa").write_text(">x\nA\n")
    with pytest.raises(ValueError):
        fasta.folder_inputs(str(tmp_path))


def test_records_are_split_and_numbered(spark, tmp_path):
    rnd = random.Random(2)
    records = [(f"r{i} some > name [x y]", "".join(rnd.choice("ACDEFGHIK") for _ in range(rnd.randint(0, 300)))) for i in range(400)]
    text = "\n" + "".join(f">{h}\n" + "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60)) for h, s in records)
    (tmp_path / "a b.fa").write_text(text)
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(text[:500].encode()) + gzip.compress(text[500:].encode()))
    (tmp_path / "d.FA.GZ").write_bytes(gzip.compress(text.replace("\n", "\r\n").encode()))
    (tmp_path / "e.fas").write_text("")
    inputs = fasta.inputs(spark, folder=str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001b")
    try:
        got = {}
        for r in fasta.read_fasta(spark, inputs).collect():
            got.setdefault(r["sid"], {})[r["protein_id"]] = (r["name"], r["seq"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = dict(enumerate((h.split(" [")[0], s) for h, s in records))
    assert got == {0: want, 1: want, 2: want}
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nACGT\n")
    with pytest.raises(Exception, match="no FASTA"):
        fasta.read_fasta(spark, fasta.inputs(spark, folder=str(tmp_path))).collect()


def test_nucleotides(spark):
    row = spark.createDataFrame([("ATGGCTNNNT",)], "s string").select(
        nucleotides.reverse_complement(F.col("s")), nucleotides.translated(F.col("s")), nucleotides.translated(F.lit("GTG"), True), nucleotides.codons(F.col("s")), nucleotides.gc_fraction(F.col("s"))
    ).first()
    assert row[0] == "ANNNAGCCAT" and row[1] == "MAX" and row[2] == "M" and row[3] == ["ATG", "GCT", "NNN"] and row[4] == pytest.approx(3 / 7)
    assert orf._codon_counts("ATGGCTNNNT").sum() == 2


def test_adaptive_codons():
    rich, poor = "GCT" * 150, "AAA" * 150
    seq = rich + poor
    orfs = [orf.Orf(0, 450, 1, 0, 450, False, 100 - i) for i in range(60)] + [orf.Orf(450, 900, 1, 450, 900, False, 1) for _ in range(60)]
    model = orf.adaptive_model(orfs, {1: seq, -1: orf.reverse_complement(seq)})
    assert model[orf._INDEX["GCT"]] > 0 > model[orf._INDEX["AAA"]]
    assert orf.adaptive_model(orfs[:59], {1: seq}) is None
    fixed = [0] * 64
    fixed[orf._INDEX["GCT"]], fixed[orf._INDEX["AAA"]] = 2200, -2200
    assert [orf.adaptive_score(s, fixed) for s in ("GCT" * 34, "GCT" * 35, "AAA" * 35)] == [0, 18, -18]
    # ambiguous codons are counted and add nothing: 15 * 2200 // 60 = 550, 550 // 25 = 22 -> 18; 8 * 2200 // 60 = 293 -> 11
    assert [orf.adaptive_score("GCT" * n + "GCN" * (60 - n), fixed) for n in (15, 8)] == [18, 11]
    assert orf.adaptive_score("GCT" * 34 + "GCN" * 10, fixed) == 18


def test_frames_against_a_walk_over_codons():
    rnd, model, found = random.Random(6), orf.gc_model(0.5), 0
    for letters in ("ACGT", "ACGT" * 40 + "N", "ACGT" * 60 + "NR", "ACG", "A"):
        for size in (0, 2, 5, 900, 2500):
            seq = "".join(rnd.choice(letters) for _ in range(size))
            want = []
            for frame in range(3):
                last, starts = frame + (size - frame) // 3 * 3, []
                for at in range(frame, last, 3):
                    codon = seq[at : at + 3]
                    if "N" in codon or codon in nucleotides.STOPS:
                        want += orf._segment_orfs(seq, 1, at, False, starts, model)
                        starts = []
                    elif codon in nucleotides.STARTS:
                        starts.append((at, nucleotides.STARTS[codon] + orf.shine_dalgarno(seq, at)))
                want += orf._segment_orfs(seq, 1, last, True, starts, model)
            assert orf.strand_orfs(seq, 1, model) == want
            found += len(want)
    assert found


def test_predicted_proteins(spark):
    rng = np.random.default_rng(3)
    codons = [c for c, a in nucleotides.CODONS.items() if a != "*"]
    gene = "ATG" + "".join(rng.choice(codons, 150)) + "TAA"
    contig = "TAACTAGCTAACCC" + gene + "TTAGTTAACTAA"
    rows = [(0, 0, contig), (0, 1, orf.reverse_complement(contig)), (0, 2, "AC"), (0, 3, None)]
    got = orf.predict(spark.createDataFrame(rows, "sid int, contig_id long, seq string")).collect()
    want = "M" + "".join(nucleotides.CODONS[gene[i : i + 3]] for i in range(3, len(gene) - 3, 3))
    assert any(r["contig_id"] == 0 and r["strand"] == 1 and want.endswith(r["seq"][1:]) for r in got)
    assert any(r["contig_id"] == 1 and r["strand"] == -1 and want.endswith(r["seq"][1:]) for r in got)
    with pytest.raises(Exception, match="too few nucleotides"):
        orf.predict(spark.createDataFrame([(0, 0, "X" * 50)], "sid int, contig_id long, seq string")).collect()


#: Fixed value: the contig of the worked genome B.
GENOME_B = (
    "cgcggaagatcttagcgatgcgctgatggaagcgggtgccgtttctatcacttttcaggatacccacgatacgccagtatttgaaccgctgccgggcgaaacgcgcctgtggggcgacaccgatgtgattggtctgttcgacgctgaa"
    "accgatatgaacgacgtggtggcgattctggaaaaccatccgctgctcggcgcaggcttcgcgcataaaaacgaacaactagaagataaagactgggagcgcgaatggatggataatttccacccgatgcgctttggtgaacgactgt"
    "ggatctgccctagctggcgtgatgtgccggacgaaaacgccgtcaacgtgatgttagatccagggctggcgtttggtacgggtacccatccaaccacctctctgtgcctgcaatggctcgacagcctcgatttaaccggtaaaacagt"
    "catcgactttggctgtggttccggcattctggcgatcgcggcgctgaaactgggtgcagcaaaagccattggtattgatatcgatccgcaggcgattcaggccagccgcgataacgccgaacgtaatggcgtttctgaccgtctggaa"
    "ctctacttaccgaaagatcagccagaagaaatgaaagccgacgtggtggtcgctaacatccttgcaggcccattacgtgaactggcaccgttaatcagcgtcctgccggtttcaggcggtttgctgggcctttccggtattctggcaa"
)


def test_genomes(spark, tmp_path):
    """The worked pair of genomes. B is given; A is inferred: B with the codon of the aligned F changed to one of I."""
    forward = orf.reverse_complement(GENOME_B.upper())
    at = next(f for f in range(3) for m in [forward[f:]] if "SFLCAKPAPSS" in "".join(nucleotides.CODONS[m[i : i + 3]] for i in range(0, len(m) - 2, 3)))
    protein = "".join(nucleotides.CODONS[forward[i : i + 3]] for i in range(at, len(forward) - 2, 3))
    codon = at + 3 * (protein.index("SFLCAKPAPSS") + 1)
    other = forward[:codon] + "ATT" + forward[codon + 3 :]
    for name, seq in (("genome_A", orf.reverse_complement(other).lower()), ("genome_B", GENOME_B)):
        (tmp_path / f"{name}.fas").write_text(f">random\n{seq}\n")
    done = run.run(spark, str(tmp_path / "out"), folder=str(tmp_path), genomes=True, params=Params(length_middle=50))
    assert (done.species, done.filtered_groups, done.length, done.pct_missing) == (2, 1, 4, 0.0)
    assert (tmp_path / "out_alignment.fas").read_text() == ">genome_A\nILCA\n>genome_B\nFLCA\n"
    assert (tmp_path / "out_missing.tsv").read_text() == "species\tpct_missing\ngenome_A\t0.0\ngenome_B\t0.0\n"
    assert (tmp_path / "out_partitions.tsv").read_text().split("\n")[1] == "0\t3\t4\t"


def test_arguments_are_checked_first(spark, tmp_path):
    for given in ({"params": Params(k=30)}, {"params": Params(min_freq=0.5)}, {"params": Params(k=2, constant=3)}, {}):
        with pytest.raises(ValueError):
            run.run(spark, str(tmp_path / "x"), folder=str(tmp_path), **given)
    with pytest.raises(ValueError, match="no such folder"):
        run.run(spark, str(tmp_path / "none" / "x"), folder=str(tmp_path))
    with pytest.raises(SystemExit):
        run.main(["-k", "5"])
