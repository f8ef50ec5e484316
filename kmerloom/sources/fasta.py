"""FASTA files, plain or gzip, as rows; inputs from folders and manifests."""

from __future__ import annotations

import gzip
import os
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.plans.checkpoints import cut

# File name endings.
ENDINGS = (".fa", ".fasta", ".fas", ".faa", ".fna")
INPUTS = "sid int, name string, path string"


def species_name(path: str) -> str:
    """The file name without .gz and one FASTA ending; case does not matter."""
    name = os.path.basename(path)
    if name.lower().endswith(".gz"):
        name = name[:-3]
    for e in ENDINGS:
        if name.lower().endswith(e):
            return name[: -len(e)]
    return name


def _is_fasta(name: str) -> bool:
    low = name.lower()
    return (low[:-3] if low.endswith(".gz") else low).endswith(ENDINGS)


def _unique(pairs: list[tuple[str, str]], where: str) -> list[tuple[str, str]]:
    for n, times in Counter(n for n, _ in pairs).items():
        if times > 1:
            raise ValueError(f"{where}: the name {n!r} comes twice")
    return sorted(pairs)


def folder_inputs(folder: str) -> list[tuple[str, str]]:
    """(name, path) of the FASTA files directly in a folder; links and other files are left out."""
    files = [e.path for e in os.scandir(folder) if e.is_file(follow_symlinks=False) and _is_fasta(e.name)]
    return _unique([(species_name(f), f) for f in sorted(files)], folder)


def manifest_inputs(manifest: str) -> list[tuple[str, str]]:
    """(name, path) of a table with two tab-separated columns and no header; relative paths start at the manifest."""
    pairs, base = [], Path(manifest).resolve().parent
    for n, line in enumerate(Path(manifest).read_text().split("\n"), 1):
        line = line.rstrip()
        if not line:
            continue
        cells = [c.strip() for c in line.split("\t")]
        if len(cells) != 2 or not all(cells):
            raise ValueError(f"{manifest}, line {n}: two columns are needed")
        path = base / cells[1]
        if not path.is_file():
            raise ValueError(f"{manifest}, line {n}: {path} is no file")
        pairs.append((cells[0], str(path)))
    return _unique(pairs, manifest)


def inputs(spark: SparkSession, folder: str | None = None, manifest: str | None = None) -> DataFrame:
    """(sid, name, path): the manifest's files, then the folder's, numbered in that order."""
    pairs = (manifest_inputs(manifest) if manifest else []) + (folder_inputs(folder) if folder else [])
    if not pairs:
        raise ValueError("no input files")
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(pairs)], INPUTS)


def parse_fasta(data: bytes) -> list[tuple[str, str]]:
    """(header, sequence) of each record; white space inside sequences goes. Text before the first record is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").lstrip()
    if not text:
        return []
    if not text.startswith(">"):
        raise ValueError("no FASTA: the first record does not begin with >")
    out = []
    for record in re.split(r"\n>", text[1:]):
        header, _, body = record.partition("\n")
        out.append((header, re.sub(r"[ \t\n\f\r]", "", body)))
    return out


def label(header: str) -> str:
    """The header up to the first bracketed part."""
    return header.strip().split(" [", 1)[0].rstrip()


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it in the metadata of what it reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where).toUri().toString()


def read_records(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(sid, place, header, seq) of all records of ``sources`` (sid, name, path), numbered from 0 in each file.

    Files are read as lines that end before a record mark, so a large plain
    file is split among tasks; in sequences white space goes and case stays.
    Text before the first record of a file is an error. Records are counted
    by split, and the splits of a file (one narrow row each) are summed up.
    """
    paths = {r["path"]: r["sid"] for r in sources.select("sid", "path").collect()}  # one row a file
    odd = {p: s for p, s in paths.items() if p.lower().endswith(".gz") and not p.endswith(".gz")}  # the codec goes by the ending
    rows = []
    if plain := {p: s for p, s in paths.items() if p not in odd}:
        of = spark.createDataFrame([(s, re.sub(r"^file:/+", "file:/", _qualified(spark, p))) for p, s in plain.items()], "sid int, file string")
        read = spark.read.option("lineSep", "\n>").text(list(plain)).select(
            "value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")
        )
        read = cut(read.join(F.broadcast(of), "file").select("sid", "split", "at", "value"))
        blank = F.min_by(F.length(F.regexp_replace("value", r"\s+", "")) == 0, "at")
        splits = read.groupBy("sid", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), blank.alias("blank"))
        before = Window.partitionBy("sid").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
        lead = F.max(((F.col("split") == 0) & F.col("blank")).cast("int")).over(Window.partitionBy("sid"))  # white space before the first record
        splits = splits.select("sid", "split", "first", (F.coalesce(F.sum("n").over(before), F.lit(0)) - lead).alias("base"))
        numbered = read.join(F.broadcast(splits), ["sid", "split"]).withColumn("n", F.col("base") + F.col("at") - F.col("first"))
        opens = (F.col("split") == 0) & (F.col("at") == F.col("first"))
        text = F.when(opens, F.regexp_replace("value", r"^\s+", "")).otherwise(F.concat(F.lit(">"), F.col("value")))
        whole = numbered.where("n >= 0").select("sid", "n", text.alias("text")).where("text <> ''")
        wrong = F.raise_error(F.concat(F.lit("no FASTA: the first record does not begin with >, in input "), F.col("sid").cast("string")))
        line = F.substring_index("text", "\n", 1)
        header = F.when(F.col("text").startswith(">"), F.regexp_replace(F.substring(line, 2, 1 << 30), "\r$", "")).otherwise(wrong)
        body = F.regexp_replace(F.col("text").substr(F.length(line) + 2, F.length("text")), r"[ \t\n\f\r]", "")
        rows.append(whole.select("sid", F.col("n").alias("place"), header.alias("header"), body.alias("seq")))
    if odd:
        of = spark.createDataFrame([(s, re.sub(r"^file:/+", "file:/", _qualified(spark, p))) for p, s in odd.items()], "sid int, file string")
        files = spark.read.format("binaryFile").load(list(odd)).select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), "content")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for sid, content in zip(pdf.sid, pdf.content, strict=True):
                    records = parse_fasta(bytes(content))
                    yield pd.DataFrame({"sid": sid, "place": range(len(records)), "header": [h for h, _ in records], "seq": [x for _, x in records]})

        rows.append(files.join(F.broadcast(of), "file").select("sid", "content").mapInPandas(run, "sid int, place long, header string, seq string"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def read_fasta(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(sid, protein_id, name, seq) of all records."""
    name = F.rtrim(F.substring_index(F.trim(F.regexp_replace("header", r"^\s+|\s+$", "")), " [", 1))
    return read_records(spark, sources).select("sid", F.col("place").alias("protein_id"), name.alias("name"), "seq")


def read_contigs(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(sid, contig_id, seq) of the nucleotide records of genomes."""
    return read_records(spark, sources).select("sid", F.col("place").alias("contig_id"), "seq")
