"""One call from input files to result files, and its command line."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from kmerloom.functions.recode import SCHEMES
from kmerloom.operators import orf, phylo
from kmerloom.params import Params
from kmerloom.plans import pipeline
from kmerloom.plans.checkpoints import cut
from kmerloom.sources import fasta, sinks


@dataclass(frozen=True)
class Summary:
    """What a run counted on its way."""

    species: int
    raw_groups: int
    sorted_groups: int
    filtered_groups: int
    length: int
    pct_missing: float


def run(spark: SparkSession, output: str, folder: str | None = None, manifest: str | None = None, genomes: bool = False, params: Params | None = None, nj: bool = False) -> Summary:
    """Read the inputs, find the variant groups and write alignment, missingness, partitions and, with ``nj``, the tree.

    With ``genomes`` the inputs are nucleotide sequences whose proteins are
    predicted first. Arguments and inputs are checked before any work is done.
    """
    p = (params or Params()).checked()
    if not Path(output).resolve().parent.is_dir():
        raise ValueError(f"{output}: no such folder")
    inputs = fasta.inputs(spark, folder, manifest)
    if genomes:
        proteins = orf.as_proteins(cut(orf.predict(fasta.read_contigs(spark, inputs))))
    else:
        proteins = fasta.read_fasta(spark, inputs)
    names = {r["sid"]: r["name"] for r in inputs.collect()}  # one row a species
    done = pipeline.analyse(cut(proteins), inputs, p)
    alignment, parts = cut(done.alignment), done.parts
    tree = phylo.tree_of(alignment, names) if nj else None
    length, missing = sinks.write_results(output, names, alignment, parts, tree)
    found = done.groups
    return Summary(len(names), found.candidates.count(), found.kept.count(), parts.count(), length, missing)


def main(arguments: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="kmerloom")
    a.add_argument("-i", "--input-directory", dest="folder")
    a.add_argument("-I", "--input-file", dest="manifest")
    a.add_argument("--genomes", action="store_true")
    a.add_argument("-k", type=int, default=13)
    a.add_argument("-f", "--min-freq", type=float, default=0.85)
    a.add_argument("-o", "--output", default="kmerloom")
    a.add_argument("-c", "--constant", type=int)
    a.add_argument("-l", "--length-middle", type=int, default=35)
    a.add_argument("-m", "--mask", type=int, default=5)
    a.add_argument("-r", "--recode", choices=sorted(SCHEMES), default="sr6")
    a.add_argument("--nj", action="store_true")
    args = a.parse_args(arguments)
    if not (args.folder or args.manifest):
        a.error("an input directory or an input file is needed")
    spark = SparkSession.builder.appName("kmerloom").getOrCreate()
    p = Params(args.k, args.min_freq, args.constant, args.length_middle, args.mask, args.recode)
    try:
        s = run(spark, args.output, args.folder, args.manifest, args.genomes, p, args.nj)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"groups: {s.raw_groups} raw, {s.sorted_groups} sorted, {s.filtered_groups} filtered; alignment: length={s.length} missing={s.pct_missing:.1f}%", file=sys.stderr)
    return 0
