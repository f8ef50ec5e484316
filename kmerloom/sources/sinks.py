"""Result files: alignment, missingness, partitions and tree. Their size is that of the alignment."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame


def wrapped(seq: str, width: int = 60) -> str:
    return "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width))


def output_paths(prefix: str) -> dict[str, Path]:
    names = {"alignment": "_alignment.fas", "missing": "_missing.tsv", "partitions": "_partitions.tsv", "tree": "_NJ.tree"}
    return {k: Path(prefix + v) for k, v in names.items()}


def write_results(prefix: str, names: dict[int, str], alignment: DataFrame, parts: DataFrame, tree: str | None = None) -> tuple[int, float]:
    """Write the files; (length of the alignment, percent missing over all). Rows come to the driver one partition after the other."""
    paths = output_paths(prefix)
    length = cells = gaps = 0
    with paths["alignment"].open("w") as fas, paths["missing"].open("w") as tsv:
        tsv.write("species\tpct_missing\n")
        for r in alignment.orderBy("sid").toLocalIterator():
            seq, name = r["seq"], names[r["sid"]]
            own = seq.count("-") + seq.count("X")
            fas.write(f">{name}\n{wrapped(seq)}")
            tsv.write(f"{name}\t{100 * own / max(len(seq), 1):.1f}\n")
            length, cells, gaps = length or len(seq), cells + len(seq), gaps + own
    with paths["partitions"].open("w") as out:
        out.write("start_pos\tend_pos\tlength\tconsensus protein name\n")
        for r in parts.orderBy("rank").toLocalIterator():
            out.write(f"{r['start_pos']}\t{r['end_pos']}\t{r['length']}\t{r['label']}\n")
    if tree is not None:
        paths["tree"].write_text(tree + "\n")
    return length, 100 * gaps / max(cells, 1)
