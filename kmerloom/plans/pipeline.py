"""From proteins to variant groups, the alignment and the tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import alignment, anchors, consensus, groups, kmers, overlap
from kmerloom.params import Params
from kmerloom.plans.checkpoints import cut


@dataclass
class Groups:
    """What the stages up to the choice of groups hand on."""

    segments: DataFrame
    observations: DataFrame
    support: DataFrame
    candidates: DataFrame
    kept: DataFrame
    selected: DataFrame


def variant_groups(proteins: DataFrame, n_species: int, p: Params) -> Groups:
    segs = kmers.segments(proteins, p.recode, p.k)
    need = p.min_needed(n_species)
    obs = cut(anchors.observed(segs, p.k, need, p.length_middle))
    support = groups.length_support(obs)
    cands = cut(groups.candidates(support, need, p.k))
    chosen = groups.selected(obs, cands)
    kept = cut(overlap.nonoverlapping(cands, overlap.overlap_kmers(chosen, p.overlap_k, p.recode)))
    return Groups(segs, obs, support, cands, kept, groups.selected(obs, kept))


@dataclass
class Analysis:
    """The groups, the alignment (sid, seq) and its partitions."""

    groups: Groups
    alignment: DataFrame
    parts: DataFrame


def analyse(proteins: DataFrame, species: DataFrame, p: Params) -> Analysis:
    """From ``proteins`` (sid, protein_id, name, seq) of all ``species`` (sid) to their alignment."""
    n = species.count()
    found = variant_groups(proteins, n, p)
    rows = cut(consensus.observed_rows(found.selected))
    columns = cut(alignment.group_columns(rows, found.kept, p, n))
    named = found.selected.join(proteins.select("sid", "protein_id", "name"), ["sid", "protein_id"])
    parts = cut(alignment.partitions(columns, found.kept, consensus.consensus_names(named)))
    return Analysis(found, alignment.aligned(columns, parts, species), parts)


def align(proteins: DataFrame, species: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(alignment (sid, seq), partitions) of all species."""
    done = analyse(proteins, species, p)
    return done.alignment, done.parts


def documents_as_proteins(documents: DataFrame, sid) -> DataFrame:
    """Texts in the place of protein sequences."""
    return documents.select(sid.cast("int").alias("sid"), F.col("doc_id").alias("protein_id"), F.lit("").alias("name"), F.coalesce("text", F.lit("")).alias("seq"))
