"""Queries on the driver's tables and the SQL that gives the same rows.

A document's text stands for a protein, ``doc_id % 3`` for its species.
Aligned rows, which prose lacks, are all the letters of each document's text
that are amino acids, cut into blocks of 40 columns, the last filled with gaps:
the group is the source and the block's number, the row the document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions import nucleotides
from kmerloom.functions.recode import LETTERS, SCHEMES, residues, recoded
from kmerloom.operators import alignment, anchors, consensus, groups, kmers, orf, phylo
from kmerloom.params import Params
from kmerloom.plans import pipeline
from kmerloom.plans.checkpoints import cut, spread

P, ALIGN = Params(k=9, min_freq=0.6), Params(k=9, min_freq=0.6, mask=16)
NEED = P.min_needed(3)
WIDTH, MASK, ROW_SPECIES = 40, 4, 97
_UPPER, _NO_BASES = bytes.maketrans(b"acgt", b"ACGT"), bytes(c for c in range(256) if c not in b"acgtACGTN")
_LETTERS_ONLY = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.documents_as_proteins(_docs(spark, sf_dir), F.col("doc_id") % 3)


def _segments(spark: SparkSession, sf_dir: str, least: int = P.k) -> DataFrame:
    return kmers.segments(_proteins(spark, sf_dir), P.recode, least)


def _digits(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: kmers.unpacked(F.col(n), P.k) for n in names})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.edges(_segments(spark, sf_dir), P.k, NEED)


def recode_segments(spark, sf_dir):
    return _segments(spark, sf_dir, 1).withColumn("seg_id", F.col("seg_id").cast("long"))


def recode_schemes(spark, sf_dir):
    aa = residues(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *(F.md5(recoded(aa, s)).alias(s) for s in SCHEMES))


def kmer_occupancy(spark, sf_dir):
    return _digits(kmers.occupancy(_segments(spark, sf_dir), P.k), "kmer")


def shared_kmers(spark, sf_dir):
    return _digits(kmers.shared(kmers.occupancy(_segments(spark, sf_dir), P.k), NEED), "kmer")


def occupancy_histogram(spark, sf_dir):
    return kmers.occupancy(_segments(spark, sf_dir), P.k).groupBy("occ").agg(F.count(F.lit(1)).alias("n"))


def _anchor_rows(df):
    return _digits(df, "kmer").select("protein_id", F.col("seg_id").cast("long").alias("seg_id"), F.col("start").cast("long").alias("start"), "kmer", "occ")


def anchor_starts(spark, sf_dir):
    return _anchor_rows(_edges(spark, sf_dir).where("is_start"))


def anchor_ends(spark, sf_dir):
    return _anchor_rows(_edges(spark, sf_dir).where("is_end"))


def start_clusters(spark, sf_dir):
    return _anchor_rows(anchors.clustered_starts(_edges(spark, sf_dir).where("is_start")))


def _pair_rows(obs):
    return _digits(obs, "lk", "rk").select("protein_id", F.col("seg_id").cast("long").alias("seg_id"), F.col("start").cast("long").alias("start"), "lk", "rk", F.col("len").cast("long").alias("len"), "block")


def bubble_pairs(spark, sf_dir):
    return _pair_rows(anchors.observed(_segments(spark, sf_dir), P.k, NEED, P.length_middle, clustered=False))


def _observations(spark, sf_dir):
    return anchors.observed(_segments(spark, sf_dir), P.k, NEED, P.length_middle)


def clustered_pairs(spark, sf_dir):
    return _pair_rows(_observations(spark, sf_dir))


def length_support(spark, sf_dir):
    return _digits(groups.length_support(_observations(spark, sf_dir)), "lk", "rk").select("lk", "rk", F.col("len").cast("long").alias("len"), "coverage")


def best_length(spark, sf_dir):
    got = groups.candidates(groups.length_support(_observations(spark, sf_dir)), NEED, P.k)
    return _digits(got, "lk", "rk").select("lk", "rk", "coverage", F.col("raw_len").cast("long").alias("raw_len"))


def nonoverlap_groups(spark, sf_dir):
    kept = pipeline.variant_groups(_proteins(spark, sf_dir), 3, P).kept
    return _digits(kept, "lk", "rk").select("lk", "rk", "coverage", F.col("raw_len").cast("long").alias("raw_len"))


def _rows(spark, sf_dir):
    """(source, doc_id, rk, block): every block of every text."""
    texts = _docs(spark, sf_dir).select(F.col("source").alias("lk"), F.col("doc_id").alias("sid"), "text")
    return consensus.blocks(texts, WIDTH).select(F.col("lk").alias("source"), F.col("sid").alias("doc_id"), "rk", "block")


def _observed(spark, sf_dir):
    """One row a group and species, doc_id % ROW_SPECIES."""
    return consensus.observed_rows(_rows(spark, sf_dir).select(F.col("source").alias("lk"), "rk", (F.col("doc_id") % ROW_SPECIES).alias("sid"), "block"))


def _by_doc(spark, sf_dir):
    """One row a group and document."""
    return _rows(spark, sf_dir).select(F.col("source").alias("lk"), "rk", F.col("doc_id").alias("sid"), "block")


def _out(df, *columns):
    return df.select(F.col("lk").alias("source"), F.col("rk").cast("long").alias("block_no"), *(F.col(c).cast("long").alias(c) if c in ("sid", "col", "missing", "n_states") else F.col(c) for c in columns))


def species_consensus(spark, sf_dir):
    return _out(_observed(spark, sf_dir), "sid", "block")


def column_majority(spark, sf_dir):
    return _out(consensus.column_majority(_by_doc(spark, sf_dir), P.recode), "majority")


def masked_rows(spark, sf_dir):
    rows = _by_doc(spark, sf_dir)
    return _out(consensus.masked_rows(rows, consensus.column_majority(rows, P.recode), MASK, P.recode), "sid", "block")


def column_report(spark, sf_dir):
    return _out(consensus.column_report(_observed(spark, sf_dir), P.recode), "col", "missing", "n_states")


def _one_alignment(spark, sf_dir):
    """(rows, groups, number of species): every document is a species, the group is the block's number."""
    rows = _rows(spark, sf_dir).select(F.lit("all").alias("lk"), "rk", F.col("doc_id").alias("sid"), "block")
    groups = cut(rows.groupBy("lk", "rk").agg(F.count(F.lit(1)).alias("coverage")).withColumn("raw_len", F.lit(WIDTH)))
    n = rows.where("rk = 0").select("sid").distinct().count()  # every document with a row has this
    return cut(alignment.reachable(rows, groups, ALIGN, n)), groups, n


def kept_columns(spark, sf_dir):
    rows, groups, n = _one_alignment(spark, sf_dir)
    return alignment.kept_columns(rows, groups, ALIGN, n).select(F.col("rk").cast("long").alias("block_no"), F.col("col").cast("long").alias("col"))


def _partitioned(spark, sf_dir):
    rows, groups, n = _one_alignment(spark, sf_dir)
    columns = cut(alignment.group_columns(rows, groups, ALIGN, n))
    labels = groups.select("lk", "rk", F.concat_ws("/", "lk", F.col("rk").cast("string")).alias("label"))
    return rows, columns, cut(alignment.partitions(columns, groups, labels))


def whole_alignment(spark, sf_dir):
    """Masked rows, kept columns, partitions and the concatenation of all groups: each document's alignment."""
    rows, columns, parts = _partitioned(spark, sf_dir)
    return alignment.aligned(columns, parts, rows.where("rk = 0").select("sid").distinct()).select(F.col("sid").cast("long").alias("sid"), "seq")


def partition_table(spark, sf_dir):
    """The partitions of :func:`whole_alignment`."""
    return _partitioned(spark, sf_dir)[2].select("start_pos", "end_pos", "length", "label")


def missing_percent(spark, sf_dir):
    sums = _observed(spark, sf_dir).groupBy("lk", "sid").agg(F.sum(alignment.gaps("block")).alias("gaps"), F.sum(F.length("block")).alias("size"))
    return sums.select(F.concat_ws("/", "lk", "sid").alias("sid"), F.round(alignment.percent(F.col("gaps"), F.col("size")), 6).alias("pct_missing"))


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    """All that is no letter becomes blanks."""
    return text.map(lambda t: None if t is None else t.encode().translate(_LETTERS_ONLY).decode())


def consensus_label(spark, sf_dir):
    named = _docs(spark, sf_dir).select(F.col("source").alias("lk"), F.lit(0).alias("rk"), F.lit(0).alias("sid"), F.col("doc_id").alias("protein_id"), F.lit(0).alias("seg_id"), F.lit(0).alias("start"), _plain("text").alias("name"))
    return consensus.consensus_names(named).select(F.col("lk").alias("source"), "label")


def _source_rows(spark, sf_dir):
    """(sid, seq): for each source the commonest letter of every column of its documents, whole texts, gaps to the longest."""
    best = consensus.column_letters(_rows(spark, sf_dir).select(F.col("source").alias("lk"), "rk", "block"))
    parts = F.array_sort(F.collect_list(F.struct("rk", "letters")))  # no more than the longest text has
    rows = cut(best.groupBy(F.col("lk").alias("source")).agg(F.array_join(F.transform(parts, lambda x: x["letters"]), "").alias("seq")))
    longest = rows.agg(F.max(F.length("seq")).alias("n"))
    return cut(rows.join(F.broadcast(longest)).select(F.regexp_replace("source", "src", "").cast("int").alias("sid"), F.rpad("seq", F.col("n"), F.lit("-")).alias("seq")))  # one number


def pairwise_distance(spark, sf_dir):
    rows = _source_rows(spark, sf_dir).withColumn("sid", F.col("sid").cast("long"))
    return phylo.pairwise_distances(rows).select("i", "j", F.col("valid").cast("long").alias("valid"), F.col("mismatches").cast("long").alias("mismatches"), F.round("d", 6).alias("d"))


def nj_newick(spark, sf_dir):
    rows = _source_rows(spark, sf_dir)
    names = {r["sid"]: f"src{r['sid']}" for r in rows.select("sid").collect()}
    return spark.createDataFrame([(phylo.tree_of(rows, names),)], "newick string")


def _dna(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _bases("text").alias("seq"))


@F.pandas_udf(T.StringType())
def _bases(text: pd.Series) -> pd.Series:
    """Upper-case nucleotides, all else left out."""
    return text.map(lambda t: None if t is None else t.encode().translate(_UPPER, _NO_BASES).decode())


def reverse_complement(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", nucleotides.reverse_complement(F.col("seq")).alias("rc"))


def codon_histogram(spark, sf_dir):
    codon = F.explode(nucleotides.codons(F.col("seq"))).alias("codon")
    return _dna(spark, sf_dir).select(codon).where("codon not like '%N%'").groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


def translated(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", nucleotides.translated(F.col("seq"), True).alias("protein"))


def gc_content(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", F.round(nucleotides.gc_fraction(F.col("seq")), 9).alias("gc"))


def predicted_proteins(spark, sf_dir):
    contigs = _dna(spark, sf_dir).select((F.col("doc_id") % 3).cast("int").alias("sid"), F.col("doc_id").alias("contig_id"), "seq")
    return orf.predict(contigs).drop("place")


ALL = (
    recode_segments, recode_schemes, kmer_occupancy, shared_kmers, occupancy_histogram, anchor_starts, anchor_ends, start_clusters, bubble_pairs, clustered_pairs, length_support,
    best_length, nonoverlap_groups, species_consensus, column_majority, masked_rows, column_report, kept_columns, whole_alignment, partition_table, missing_percent, consensus_label, pairwise_distance, nj_newick,
    reverse_complement, codon_histogram, translated, gc_content, predicted_proteins,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

_AA = rf"regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]', '', 'g'), '{LETTERS.lower()}', '{LETTERS}'), '[^{LETTERS}]', '.', 'g')"
_CODE = f"translate(%s, '{LETTERS}', '{SCHEMES['sr6']}')"
_STATE = f"CASE WHEN aa IN ({', '.join(repr(c) for c in LETTERS)}) THEN {_CODE % 'aa'} END"
_SEG = rf"""
runs AS (SELECT doc_id, regexp_split_to_array({_AA}, '\.+') AS l FROM documents),
seg AS (SELECT doc_id % 3 AS sid, doc_id AS protein_id, seg_id, aa, {_CODE % 'aa'} AS code
        FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS seg_id, unnest(l) AS aa FROM runs) WHERE aa <> '')"""
_KMERS = f"""{_SEG},
km AS (SELECT sid, protein_id, seg_id, start, length(code) AS n, substr(code, start + 1, {P.k}) AS kmer
       FROM (SELECT *, unnest(range(0, length(code) - {P.k} + 1)) AS start FROM seg WHERE length(code) >= {P.k})),
occ AS (SELECT kmer, count(DISTINCT sid) AS occ FROM km GROUP BY kmer)"""
_HITS = f"""{_KMERS},
h AS (SELECT km.*, o.occ, lag(o.occ) OVER w AS before, lead(o.occ) OVER w AS after FROM km JOIN occ o USING (kmer)
      WHERE n >= {2 * P.k + 1} WINDOW w AS (PARTITION BY protein_id, seg_id ORDER BY start)),
st AS (SELECT protein_id, seg_id, start, kmer, occ FROM h WHERE occ >= {NEED} AND after < occ),
en AS (SELECT protein_id, seg_id, start, kmer, occ FROM h WHERE occ >= {NEED} AND before < occ)"""
_CLUSTERS = f"""{_HITS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY protein_id, seg_id ORDER BY start) AS rn FROM st),
walk AS (
  SELECT protein_id, seg_id, rn, start AS opened FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.protein_id, o.seg_id, o.rn, CASE WHEN o.start < w.opened + 10 THEN w.opened ELSE o.start END
  FROM walk w JOIN ordered o ON o.protein_id = w.protein_id AND o.seg_id = w.seg_id AND o.rn = w.rn + 1),
cl AS (SELECT o.protein_id, o.seg_id, o.start, o.kmer, o.occ FROM ordered o JOIN walk w USING (protein_id, seg_id, rn)
       QUALIFY row_number() OVER (PARTITION BY o.protein_id, o.seg_id, w.opened ORDER BY o.occ DESC, o.start) = 1)"""


def _pairs(starts: str) -> str:
    return f"""
pr AS (SELECT s.protein_id, s.seg_id, s.start, s.kmer AS lk, e.kmer AS rk, e.start AS right_start
       FROM {starts} s JOIN en e ON s.protein_id = e.protein_id AND s.seg_id = e.seg_id
        AND e.start > s.start + {P.k} AND e.start <= s.start + {P.k + P.length_middle}
       QUALIFY row_number() OVER (PARTITION BY s.protein_id, s.seg_id, s.start ORDER BY e.occ DESC, e.start) = 1),
ob AS (SELECT p.protein_id, p.seg_id, p.start, lk, rk, right_start + {P.k} - p.start AS len,
              substr(aa, p.start + 1, right_start + {P.k} - p.start) AS block, sid
       FROM pr p JOIN seg s ON s.protein_id = p.protein_id AND s.seg_id = p.seg_id)"""


_SUPPORT = f"{_CLUSTERS}, {_pairs('cl')}, su AS (SELECT lk, rk, len, count(DISTINCT sid) AS coverage FROM ob GROUP BY lk, rk, len)"
_BEST = f"""{_SUPPORT}, ranked AS (
  SELECT *, rank() OVER (PARTITION BY lk, rk ORDER BY coverage DESC) AS r, count(*) OVER (PARTITION BY lk, rk, coverage) AS ties FROM su),
best AS MATERIALIZED (SELECT lk, rk, coverage, len AS raw_len FROM ranked WHERE r = 1 AND ties = 1 AND coverage >= {NEED} AND len >= {2 * P.k + 1})"""
_ROWS = f"""
text_ AS MATERIALIZED (SELECT source, doc_id, replace({_AA}, '.', '') AS aa FROM documents),
block_ AS MATERIALIZED (
  SELECT source, doc_id, blk, rpad(substr(aa, CAST(blk * {WIDTH} + 1 AS BIGINT), {WIDTH}), {WIDTH}, '-') AS block
  FROM (SELECT source, doc_id, aa, unnest(range(0, CAST(ceil(length(aa) / {WIDTH}) AS BIGINT))) AS blk FROM text_ WHERE aa <> ''))"""
_BY_DOC = f"""{_ROWS}, cell AS MATERIALIZED (SELECT source, blk, doc_id AS sid, col, substr(block, col + 1, 1) AS aa FROM block_, range({WIDTH}) t(col))"""
_BY_SPECIES = f"""{_ROWS}, cell AS MATERIALIZED (
  SELECT source, blk, sid, col, CASE WHEN min(aa) = max(aa) THEN min(aa) ELSE 'X' END AS aa
  FROM (SELECT source, blk, doc_id % {ROW_SPECIES} AS sid, col, substr(block, col + 1, 1) AS aa FROM block_, range({WIDTH}) t(col)) GROUP BY source, blk, sid, col)"""
_MAJORITY = """mj AS MATERIALIZED (
  SELECT source, blk, col, state FROM (SELECT source, blk, col, %s AS state, count(*) AS n FROM cell GROUP BY ALL) WHERE state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, blk, col ORDER BY n DESC, state) = 1)""" % _STATE


def _masked(mask: int) -> str:
    return f"""{_MAJORITY}, fl AS (
  SELECT source, blk, sid, string_agg(CASE WHEN {_STATE} <> state THEN '1' ELSE '0' END, '' ORDER BY col) AS f
  FROM cell LEFT JOIN mj USING (source, blk, col) GROUP BY source, blk, sid),
shown AS MATERIALIZED (SELECT source, blk, sid, col, CASE WHEN contains(f, '{'1' * mask}') THEN 'X' ELSE aa END AS aa FROM cell JOIN fl USING (source, blk, sid))"""


def _report(cells: str) -> str:
    return f"""rep AS MATERIALIZED (
  SELECT source, blk, col, count(*) FILTER (WHERE aa IN ('-', 'X')) AS missing, count(DISTINCT {_STATE}) AS n_states, count(*) AS there FROM {cells} GROUP BY source, blk, col),
num AS (SELECT count(DISTINCT sid) AS n FROM cell),
fine AS (SELECT rep.* FROM rep, num WHERE CAST(missing + n - there AS FLOAT) / CAST(n AS FLOAT) <= CAST(1 AS FLOAT) - CAST({ALIGN.min_freq} AS FLOAT)),
ends AS (SELECT source, blk, min(col) AS a, max(col) AS b FROM fine WHERE col BETWEEN {P.k} AND {WIDTH - P.k - 1} AND n_states > 1 GROUP BY source, blk),
kept AS MATERIALIZED (
  SELECT source, blk, col FROM fine JOIN ends USING (source, blk) WHERE col BETWEEN a AND b AND col < {WIDTH - P.k} OR col BETWEEN {WIDTH - P.k} AND {WIDTH - P.k + P.tail - 1})"""


_ALL = f"""{_ROWS}, cell AS MATERIALIZED (SELECT 'all' AS source, blk, doc_id AS sid, col, substr(block, col + 1, 1) AS aa FROM block_, range({WIDTH}) t(col))"""
_ALIGNED = f"""{_ALL}, {_masked(ALIGN.mask)}, {_report("shown")},
cover AS (SELECT source, blk, count(DISTINCT sid) AS coverage FROM cell GROUP BY source, blk),
size_ AS (SELECT source, blk, count(*) AS length FROM kept GROUP BY source, blk),
part_ AS MATERIALIZED (
  SELECT source, blk, length, row_number() OVER o AS rank, sum(length) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM size_ JOIN cover USING (source, blk) WINDOW o AS (ORDER BY coverage DESC, source, blk))"""
_DNA = "dna AS (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGTN]', '', 'g') AS seq FROM documents)"
_CODONS = f"{_DNA}, co AS (SELECT doc_id, i, substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT doc_id, seq, unnest(range(length(seq) // 3)) AS i FROM dna))"
_TABLE = "CASE " + " ".join(f"WHEN codon = '{c}' THEN '{a}'" for c, a in nucleotides.CODONS.items()) + " ELSE 'X' END"
_PICKED = f"""{_ROWS}, most AS (
  SELECT source, blk * {WIDTH} + col AS pos, substr(block, col + 1, 1) AS aa FROM block_, range({WIDTH}) t(col) WHERE substr(block, col + 1, 1) <> '-'),
al AS MATERIALIZED (
  SELECT CAST(replace(source, 'src', '') AS BIGINT) AS sid, pos, aa FROM (SELECT source, pos, aa, count(*) AS n FROM most GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY n DESC, aa) = 1)"""

ORACLE_SQL: dict[str, str] = {
    "recode_segments": f"WITH {_SEG} SELECT CAST(sid AS INTEGER) AS sid, protein_id, seg_id, aa, code FROM seg",
    "recode_schemes": "SELECT doc_id, " + ", ".join(f"md5(translate({_AA}, '{LETTERS}', '{s}')) AS {n}" for n, s in SCHEMES.items()) + " FROM documents",
    "kmer_occupancy": f"WITH {_KMERS} SELECT kmer, occ FROM occ",
    "shared_kmers": f"WITH {_KMERS} SELECT kmer, occ FROM occ WHERE occ >= {NEED}",
    "occupancy_histogram": f"WITH {_KMERS} SELECT occ, count(*) AS n FROM occ GROUP BY occ",
    "anchor_starts": f"WITH {_HITS} SELECT * FROM st",
    "anchor_ends": f"WITH {_HITS} SELECT * FROM en",
    "start_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM cl",
    "bubble_pairs": f"WITH {_HITS}, {_pairs('st')} SELECT protein_id, seg_id, start, lk, rk, len, block FROM ob",
    "clustered_pairs": f"WITH RECURSIVE {_CLUSTERS}, {_pairs('cl')} SELECT protein_id, seg_id, start, lk, rk, len, block FROM ob",
    "length_support": f"WITH RECURSIVE {_SUPPORT} SELECT lk, rk, len, coverage FROM su",
    "best_length": f"WITH RECURSIVE {_BEST} SELECT lk, rk, coverage, raw_len FROM best",
    "nonoverlap_groups": f"""WITH RECURSIVE {_BEST},
own AS (
  SELECT lk, rk, list(DISTINCT substr(code, i + 1, {P.overlap_k})) AS kms
  FROM (SELECT o.lk, o.rk, {_CODE % 'o.block'} AS code, unnest(range(0, length(o.block) - {P.overlap_k} + 1)) AS i
        FROM ob o JOIN best b ON o.lk = b.lk AND o.rk = b.rk AND o.len = b.raw_len) GROUP BY lk, rk),
cand AS MATERIALIZED (
  SELECT b.*, coalesce(kms, CAST([] AS VARCHAR[])) AS kms, row_number() OVER (ORDER BY coverage DESC, raw_len DESC, lk, rk) AS turn FROM best b LEFT JOIN own USING (lk, rk)),
pick AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS used, false AS took
  UNION ALL
  SELECT c.turn, CASE WHEN list_has_any(p.used, c.kms) THEN p.used ELSE list_concat(p.used, c.kms) END, NOT list_has_any(p.used, c.kms) FROM pick p JOIN cand c ON c.turn = p.turn + 1)
SELECT lk, rk, coverage, raw_len FROM cand JOIN pick USING (turn) WHERE took""",
    "species_consensus": f"WITH {_BY_SPECIES} SELECT source, blk AS block_no, sid, string_agg(aa, '' ORDER BY col) AS block FROM cell GROUP BY source, blk, sid",
    "column_majority": f"""WITH {_BY_DOC}, {_MAJORITY}
SELECT source, blk AS block_no, string_agg(coalesce(state, '.'), '' ORDER BY col) AS majority
FROM (SELECT DISTINCT source, blk FROM block_) CROSS JOIN range({WIDTH}) t(col) LEFT JOIN mj USING (source, blk, col) GROUP BY source, blk""",
    "masked_rows": f"WITH {_BY_DOC}, {_masked(MASK)} SELECT source, blk AS block_no, sid, string_agg(aa, '' ORDER BY col) AS block FROM shown GROUP BY source, blk, sid",
    "column_report": f"WITH {_BY_SPECIES}, {_report('cell')} SELECT source, blk AS block_no, col, missing, n_states FROM rep",
    "kept_columns": f"WITH {_ALL}, {_report('cell')} SELECT blk AS block_no, col FROM kept",
    "whole_alignment": f"""WITH {_ALIGNED}
SELECT sid, coalesce(string_agg(aa, '' ORDER BY rank, col), '') AS seq
FROM (SELECT DISTINCT sid FROM cell) LEFT JOIN (
  SELECT s.sid, p.rank, k.col, coalesce(c.aa, '-') AS aa FROM (SELECT DISTINCT sid FROM cell) s CROSS JOIN kept k JOIN part_ p USING (source, blk)
  LEFT JOIN shown c ON c.source = k.source AND c.blk = k.blk AND c.col = k.col AND c.sid = s.sid) USING (sid) GROUP BY sid""",
    "partition_table": f"WITH {_ALIGNED} SELECT CAST(upto - length AS BIGINT) AS start_pos, CAST(upto - 1 AS BIGINT) AS end_pos, length, source || '/' || blk AS label FROM part_",
    "missing_percent": f"WITH {_BY_SPECIES} SELECT source || '/' || sid AS sid, round(100.0 * count(*) FILTER (WHERE aa IN ('-', 'X')) / count(*), 6) AS pct_missing FROM cell GROUP BY source, sid",
    "consensus_label": r"""WITH nm AS (
  SELECT source, doc_id, trim(regexp_replace(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), '^\S+', '')) AS rest FROM documents),
ok AS (SELECT * FROM nm WHERE rest <> ''),
w AS (SELECT source, doc_id, unnest(string_split(rest, ' ')) AS word, generate_subscripts(string_split(rest, ' '), 1) - 1 AS pos FROM ok),
o AS (SELECT source, doc_id, word, min(pos) AS pos FROM w GROUP BY ALL),
v AS (SELECT source, word, count(*) AS c, sum(pos) AS s, min((doc_id, pos)) AS seen FROM o GROUP BY source, word),
n AS (SELECT source, count(*) AS n FROM ok GROUP BY source)
SELECT source, string_agg(word, ' ' ORDER BY s / c, seen, word) AS label FROM v JOIN n USING (source) WHERE 2 * c >= n GROUP BY source""",
    "pairwise_distance": f"""WITH {_PICKED}, c AS (
  SELECT x.sid AS i, y.sid AS j, count(*) FILTER (WHERE a.aa IS NOT NULL) AS valid, count(*) FILTER (WHERE a.aa <> b.aa) AS mismatches
  FROM (SELECT DISTINCT sid FROM al) x JOIN (SELECT DISTINCT sid FROM al) y ON x.sid < y.sid
  LEFT JOIN (al a JOIN al b ON a.pos = b.pos AND a.sid < b.sid) ON a.sid = x.sid AND b.sid = y.sid GROUP BY x.sid, y.sid)
SELECT i, j, valid, mismatches, CASE WHEN valid = 0 THEN 0.0 ELSE round(-ln(1 - least(mismatches / valid / {phylo.LG_SCALE}, {phylo.LIMIT})), 6) END AS d FROM c""",
    "reverse_complement": f"WITH {_DNA} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM dna",
    "codon_histogram": f"WITH {_CODONS} SELECT codon, count(*) AS n FROM co WHERE codon NOT LIKE '%N%' GROUP BY codon",
    "translated": f"""WITH {_CODONS}, pr AS (SELECT doc_id, string_agg({_TABLE}, '' ORDER BY i) AS p FROM co GROUP BY doc_id)
SELECT doc_id, CASE WHEN p IS NULL THEN '' ELSE 'M' || substr(p, 2) END AS protein FROM dna LEFT JOIN pr USING (doc_id)""",
    "gc_content": f"""WITH {_DNA} SELECT doc_id, round(CASE WHEN length(regexp_replace(seq, '[^ACGT]', '', 'g')) = 0 THEN 0.5
  ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / length(regexp_replace(seq, '[^ACGT]', '', 'g')) END, 9) AS gc FROM dna""",
}
