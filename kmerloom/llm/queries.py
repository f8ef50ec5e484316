"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import bpe, exact_dedup, html_text, line_dedup, media, near_dup, packing, secrets, token_store, toxicity
from kmerloom.llm.tables import documents, materialise


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(materialise(media.media_table(documents(spark, sf_dir)), "media"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_secret_scan,
        op3_best_fit_packing,
        op4_line_dedup,
        op5_toxicity,
        op6_token_store,
        op7_near_dedup,
        op8_media,
        op9_html_text,
        op10_prefix_bpe,
    )
}



def _matches_sql(kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT * FROM (
  SELECT doc_id, owner, repo, kind, rank, whole, val, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY n) AS stop
  FROM (SELECT doc_id, owner, repo, '{kind}' AS kind, {secrets.ORDER.index(kind)} AS rank, unnest(regexp_extract_all(t, {quoted}, 0)) AS whole,
               unnest(regexp_extract_all(t, {quoted}, {group})) AS val, unnest(regexp_split_to_array(t, {quoted})) AS gap, generate_subscripts(regexp_split_to_array(t, {quoted}), 1) AS n FROM d)
  WHERE whole IS NOT NULL) WHERE length(val) >= {least}"""


_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents),
found AS MATERIALIZED ({" UNION ALL ".join(_matches_sql(*k) for k in secrets.KINDS)}),
held AS (SELECT val, count(DISTINCT owner) < {secrets.EXAMPLE_OWNERS} AND count(DISTINCT repo) < {secrets.EXAMPLE_REPOS} AS live FROM found GROUP BY val),
base AS (SELECT doc_id, rank, kind, stop - length(whole) AS start, stop, stop - length(val) AS val_start, live FROM found JOIN held USING (val)),
every AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT DISTINCT doc_id, {secrets.ORDER.index(secrets.LIVE)}, '{secrets.LIVE}', val_start, stop FROM base WHERE live),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in secrets.KINDS)}, count(*) FILTER (WHERE live) AS n_live,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS listed FROM base GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in secrets.KINDS)}, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": _SECRETS_SQL,
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, n, line, f.k IS NOT NULL AND doc_id <> f.top AS gone FROM keyed LEFT JOIN freq f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
