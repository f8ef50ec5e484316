"""Secret scans judged by corpus-wide ownership, in DataFrame functions only.

Every match becomes a candidate with the hash of its value. For each hash the
distinct repositories and owners are counted over the whole corpus: a value
that several owners hold, or that few owners have spread over many
repositories, is a copied example; one that stays with its owner and in few
repositories is a live-looking credential and gets a span of kind ``live``
around the value.
Positions come from lengths: ``split`` gives the gaps and
``regexp_extract_all`` the matches, and a running sum turns both into offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.tables import fresh, materialise, maybe_in, text_of, with_groups

# Kind, pattern, group of the value, least length of the value.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
LIVE = "live"
ORDER = [*(k[0] for k in KINDS), LIVE]
#: A value held by at least so many owners, or in at least so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6


def _matches(pattern: str, group: int) -> F.Column:
    """Array of (gap before the match, its length, its value), null where nothing matches."""
    text = F.col("_text")
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(
        F.filter(zipped, lambda x: x["whole"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document with what each pattern found; the texts stay behind."""
    repo = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in repo_cols))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner"), repo.alias("repo")
    )
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("_text").alias("text_key"), "owner", "repo", *(_matches(p, g).alias(k) for k, p, g, _ in KINDS)
    )


def spans_of(scanned: DataFrame) -> DataFrame:
    """(row, owner, repo, kind, start, end, value_start, digest) of every match long enough."""
    parts = []
    for kind, _, _, least in KINDS:
        parts.append(
            scanned.where(F.col(kind).isNotNull())
            .select("row", "owner", "repo", F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.posexplode(kind).alias("n", "m"))
        )
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    upto = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    size = F.length("m.value")
    return every.withColumn("end", end).where(size >= F.col("least")).select(
        "row", "owner", "repo", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", (F.col("end") - size).alias("value_start"), F.sha2("m.value", 256).alias("digest")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos, n_spans) over the corpus, aggregated before each shuffle."""
    held = spans.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Per document: counts by kind, ``base`` and ``all_spans`` (arrays of start, kind number, kind, end), live and example counts.

    Null text counts as empty, null owners and repositories as one owner named
    by the empty string. Documents without a match get zeros and empty arrays.
    Repeated rows are scanned each for itself, but count once among the owners
    and repositories. Texts of any length are scanned whole; matches that begin
    at one place are listed in the order of KINDS. An empty table gives no
    rows. Only the named columns are read.
    """
    scanned = materialise(scan(docs, id_col, text_col, owner_col, repo_cols), "scanned")
    spans = materialise(spans_of(scanned), "spans")
    judged = with_groups(spans, ownership(spans), ["digest"], "n_spans", spans.count())
    judged = judged.withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(ORDER)) for x in pair)), F.col("kind"))
    base = F.struct("start", rank.alias("rank"), "kind", "end")
    live = F.struct(F.col("value_start").alias("start"), F.lit(ORDER.index(LIVE)).alias("rank"), F.lit(LIVE).alias("kind"), "end")
    found = judged.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in KINDS),
        F.count_if("live").alias("n_live"),
        F.array_sort(F.collect_list(base)).alias("base"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("live"), live)))).alias("live_spans"),
    )
    counts = [f"n_{k}" for k, *_ in KINDS] + ["n_live"]
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    spans_or_none = {c: F.coalesce(F.col(c), empty) for c in ("base", "live_spans")}
    return scanned.select("row", "doc_id", "text_key").join(found, "row", "left").select(
        F.col("doc_id").alias(id_col), "text_key", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), *(v.alias(k) for k, v in spans_or_none.items())
    )


def listed(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the secrets query."""
    found = find_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "live_spans"))).alias("spans"), "n_live",
    )


def mask_live(docs: DataFrame, mask: str = "<secret>", id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with each live-looking value replaced by ``mask``; examples stay. Columns and rows as before.

    Only rows that may hold a live value are dealt out, by their id; null texts
    stay null, and repeated rows are masked alike.
    """
    key, of, spans, flag = fresh(docs.columns, "live_id", "live_text", "live_spans", "maybe")
    found = find_secrets(docs, id_col, text_col, **columns).where(F.size("live_spans") > 0).select(
        F.col(id_col).alias(key), F.col("text_key").alias(of), F.col("live_spans").alias(spans)
    ).dropDuplicates([key, of])
    found = materialise(found, "live")  # grows with the documents: joined in the same way at every size
    text = text_of(text_col)
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    marked = maybe_in(docs, id_col, found.select(key).distinct(), flag)
    joined = marked.where(flag).join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(of)), "left")
    masked = F.when(F.col(spans).isNotNull(), done).otherwise(F.col(text_col)).alias(text_col)
    rows = joined.select(*(masked if c == text_col else F.col(c) for c in docs.columns))
    return marked.where(~F.col(flag)).select(*docs.columns).unionByName(rows)
