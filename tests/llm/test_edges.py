"""Nulls, ties, repeats, empty tables, clashing columns, and the ways that only large tables take."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import bpe, exact_dedup, html_text, line_dedup, media, near_dup, packing, secrets, tables, token_store, tokens, toxicity
from tests.llm.test_operators import LINE, brute_classes, brute_lines, brute_spans, ids_of, sha

CLASHES = ["_id", "_hi", "_lo", "lost_id", "lost_hi", "n_lines", "n_dropped", "maybe", "_spans", "live_id", "live_spans", "live_text", "toxicity_score", "_toxicity_score", "shard", "bitmap", "of_bitmap", "gone", "_kept_id", "row"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with null and repeated ids, repeated rows, ties, and columns with the operators' own names."""
    lines = "\n".join([LINE, LINE.upper(), "short", LINE + " "])
    rows = [(None, "a  b"), (None, "a b"), (1, "a b"), (1, "a b"), (1, lines), (2, None), (2, ""), (3, LINE), (4, LINE), (5, LINE), (6, LINE), (7, LINE), (8, "password = abcdefgh12"), (8, "password = abcdefgh12"), (9, "x " * 30_000), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_exact_groups_of_null_and_repeated_ids(odd):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    given = [(r["doc_id"], norm(r["text"])) for r in odd.collect()]
    groups = defaultdict(list)
    for k, v in given:
        groups[v].append(k)
    want = []
    for k, v in given:
        ids = [x for x in groups[v] if x is not None]
        keep = min(ids) if ids else None
        want.append((k, keep, len(groups[v]), k == keep, sha(v)))
    for sent in (None, 0):
        got = rows_of(exact_dedup.exact_groups(odd, broadcast_bytes=sent), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_hot_groups_are_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    rows = spark.range(40).selectExpr("id", "if(id < 20, 0, id) as k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = tables.with_groups(rows, groups, ["k"], "n", 40)
    assert rows_of(got, "id", "n") == [(i, 20 if i < 20 else 1) for i in range(40)]


@pytest.mark.parametrize("sent", [None, 0])
def test_maybe_in_never_misses(spark, sent):
    rows = spark.range(2000).withColumn("shard", F.lit("clash"))
    marked = tables.maybe_in(rows, "id", rows.where("id % 10 = 0").select("id"), "flag", sent)
    assert marked.where("id % 10 = 0 and not flag").count() == 0
    assert sent == 0 or marked.where("flag").count() < 400
    assert rows_of(tables.without(rows, "id", rows.where("id < 1990").select("id")), "id") == [(i,) for i in range(1990, 2000)]


def line_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]


def test_lines_of_null_and_repeated_ids(odd):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    rows, held = line_rows(odd), defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(k)
    gone = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), k) == k]
        want.append((k, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    got = line_dedup.line_report(odd)
    assert rows_of(got, *got.columns) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    out = line_dedup.strip_lines(odd)
    assert out.columns == [*odd.columns, "_n_lines", "_n_dropped"] and out.where("n_lines = 'clash' and maybe = 'clash'").count() == odd.count()


@pytest.fixture(scope="module")
def many_lines(spark):
    rnd = random.Random(4)
    pool = [f"line number {i} is long enough to be a key of its own, {i}" for i in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6))) + "\n" + pool[0] * (i % 2)) for i in range(120)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("sent", "per_slice"), [(None, 1 << 20), (0, 1 << 20), (0, 7)])
def test_lines_with_many_shards(many_lines, monkeypatch, sent, per_slice):
    rows, docs = many_lines
    monkeypatch.setattr(line_dedup, "PER_SLICE", per_slice)
    index = line_dedup.LineIndex.build(docs, shard_keys=3)
    assert index.filters.count() > 5
    got = line_dedup.strip_lines(docs, index, broadcast_bytes=sent)
    want = brute_lines(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["text"])) for r in got.collect()} == want


def test_stored_filters_follow_insertions_and_deletions(many_lines):
    rows, docs = many_lines

    def state(index):
        """Keys that the filters hold; the frequent ones, all of which they must hold."""
        frequent = [(r["hi"], r["lo"]) for r in index.frequent.collect()]
        held = {r["shard"]: (r["n_shards"], r["n"], line_dedup.CuckooFilter.from_bytes(bytes(r["filter"]))) for r in index.filters.collect()}
        shards = max((n for n, _, _ in held.values()), default=1)
        assert all(held[hi % shards][2].contains(np.array([lo])).all() for hi, lo in frequent)
        assert sum(n for _, n, _ in held.values()) == len(frequent)
        assert sum(int((f.table > 0).sum()) for _, _, f in held.values()) == len(frequent)
        return sorted(frequent), rows_of(index.counts, "hi", "lo", "n_docs", "max_doc"), rows_of(index.refs, "doc_id", "hi", "lo")

    first, rest = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    small = line_dedup.LineIndex.build(first, shard_keys=5)
    grown = small.insert(rest)
    assert state(grown) == state(line_dedup.LineIndex.build(docs, shard_keys=5))
    assert state(grown.insert(rest)) == state(grown)
    back = grown.delete(rest.select("doc_id"))
    assert state(back) == state(small)
    assert state(back.delete(rest.select("doc_id"))) == state(small)
    nothing = back.delete(first.select("doc_id"))
    assert nothing.counts.count() == nothing.refs.count() == 0 and state(nothing)[0] == []
    assert state(nothing.insert(docs)) == state(grown)


def test_secrets_of_repeated_rows_and_clashing_columns(odd, spark):
    found = rows_of(secrets.secret_report(odd), "doc_id", "n_assign", "base_sha256", "spans")
    assert len(found) == odd.count()
    assert {r for r in found if r[0] == 8} == {(8, 1, sha("assign:0:21"), "assign:0:21,live:11:21")}
    masked = secrets.mask_live(odd)
    assert masked.columns == odd.columns and rows_of(masked.where("doc_id = 8"), "text") == [("password = <secret>",)] * 2
    assert rows_of(masked.where("doc_id <> 8 or doc_id is null"), "doc_id", "text") == rows_of(odd.where("doc_id <> 8 or doc_id is null"), "doc_id", "text")
    other = odd.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), "lang", "source")
    assert rows_of(secrets.mask_live(other, id_col="k", text_col="t").where("k = 8"), "t") == [("password = <secret>",)] * 2


def test_many_repositories_make_an_example(spark):
    rows = [(i, "token = manyrepos1234", f"l{i}", "one owner") for i in range(6)] + [(10 + i, "token = fewrepos12345", f"l{i}", "one owner") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    live = {r["doc_id"]: r["n_live"] for r in secrets.secret_report(docs).collect()}
    assert all(live[i] == (i >= 10) for i in live)


def test_packing_of_null_and_repeated_ids(odd, library):
    want = Counter()
    for r in odd.collect():
        n = len(ids_of(library, r["text"])) + 1
        want[r["doc_id"]] += n
    got = Counter()
    for r in packing.pack(odd).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_codecs_of_null_and_repeated_ids(odd, library):
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(bpe.encoding_digests(odd), "doc_id", "n_tokens") == sorted(((k, len(ids_of(library, t))) for k, t in given), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert rows_of(media.media_features(media.media_table(odd)), "doc_id", "n_bytes") == sorted(((k, len((t or "").encode())) for k, t in given), key=lambda r: (r[0] is not None, r[0], r[1]))
    stored = sorted(token_store.token_table(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in stored] == sorted((k for k, _ in given), key=lambda k: (k is not None, k))
    assert [r["start"] for r in stored] == np.cumsum([0, *(r["n_tokens"] for r in stored)])[:-1].tolist()


def test_store_is_read_by_its_path_alone(odd, library, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd, path)
    session = odd.sparkSession.newSession()
    assert token_store.read_store(session, path).count() == odd.count()
    want = sorted([*ids_of(library, t).tolist(), token_store.END_ID] for k, t in line_rows(odd) if k in (2, 9))
    assert sorted(r["ids"] for r in token_store.lookup(session, path, [9, 2, 77]).collect()) == want
    (tmp_path / "other").mkdir()
    session.createDataFrame([("00", b"x", 2, 1)], token_store._DICTIONARY).write.parquet(f"{path}2/dictionary")
    with pytest.raises(ValueError, match="damaged"):
        token_store.read_store(session, f"{path}2")


def test_near_classes_of_null_and_repeated_ids(odd):
    got = near_dup.near_classes(odd)
    assert got.count() == odd.count()
    assert {(r["class_id"], r["class_size"], r["kept"]) for r in got.where("doc_id is null").collect()} == {(None, 1, True)}
    assert {r["class_id"] for r in got.where("doc_id in (3, 4, 5, 6, 7)").collect()} == {3}
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (4, 5, 6, 7)").count() == 0 and kept.where("doc_id = 8").count() == 2


def test_shingle_frequencies(spark):
    """With few shingles each has a bucket of its own but for rare collisions: frequencies are exact or too high."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(50)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf, df = near_dup.shingle_idf(docs), Counter()
    for t in texts:
        df.update(near_dup.shingles(near_dup.word_hashes([t or ""])[0])[0].tolist())
    exact = {h: 1 + np.log(53 / (n + 1)) / np.log(54) for h, n in df.items()}
    got = {h: idf[int(h) % near_dup.SKETCH] for h in df}
    assert all(got[h] <= exact[h] + 1e-5 for h in df)
    assert np.mean([abs(got[h] - exact[h]) < 1e-5 for h in df]) > 0.99


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.drop_exact_copies(empty).count() == secrets.mask_live(empty).count() == line_dedup.strip_lines(empty).count() == near_dup.keep_one(empty).count() == 0
    assert toxicity.keep_clean(empty, labels).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
    assert line_dedup.LineIndex.build(empty).insert(empty).delete(empty.select("doc_id")).counts.count() == 0


# pages

PARTS = {
    "share flag": ('<div class="entry share-enabled">', "</div>"), "no sidebar": ('<div class="post no-sidebar">', "</div>"), "size": ('<section class="hidden-xs two-col">', "</section>"), "category": ('<article class="category-ads tag-footer">', "</article>"),
    "whole page form": ('<form action="/"><h1>T</h1>', "</form>"), "aria": ('<div aria-hidden="true"><h1>T</h1>', "</div>"), "deep": ("<div>" * 700, "</div>" * 700),
}


@pytest.mark.parametrize("name", PARTS)
def test_names_do_not_take_the_article(name):
    before, after = PARTS[name]
    body = "<p>First paragraph with quite some words in it.</p><p title=it's>Second one, also of some length &amp; weight.</p>"
    got = html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{before}{body}{after}<footer>Footer words here</footer></body>")
    want = "First paragraph with quite some words in it. Second one, also of some length & weight."
    assert got == ("T " if "<h1>" in before else "") + want


def test_what_is_left_out():
    text = "<p>The words of the article are many, and they go on for a good while.</p>"
    outside = [
        "<div class='comments-area'><ol class=commentlist><li class=comment><article class=comment-body><p>" + "A reader writes a long comment here. " * 9 + "</p></article></ol></div>",
        "<div id=cookie-notice>We use cookies</div>", "<aside>Aside words</aside>", "<div class=share-buttons>Share this</div>", "<div class='related-posts'><a href=1>One</a></div>", "<div hidden>secret</div>",
        "<div role=complementary>More</div>", "<form><input><label>Name</label></form>", "<style>p{}</style><script>x='</div>'</script><noscript>no</noscript>", "<select><option>A</select>", "<svg><text>t</text></svg>",
    ]
    for x in outside:
        assert html_text.main_text(f"<body><div><h1>T</h1>{text}{x}</div>") == "T The words of the article are many, and they go on for a good while.", x
        assert html_text.main_text(f"<body><article><h1>T</h1>{text}{x}</article>") == "T The words of the article are many, and they go on for a good while.", x


def test_what_stays_in():
    assert html_text.main_text("<article><p>x <math><mi>a</mi><mo>+</mo><mn>1</mn></math></p><p><a href=x>only a link</a></p><table><tr><td><a href=1>l1</a><td><a href=2>l2</a></table></article>") == "x a+1 only a link l1 l2"
    assert html_text.main_text('<article><p>a<p title="never closed>b</p><p>c</article>') == "a b c"
    assert html_text.main_text("<body>plain &lt;words&gt; &amp &eacute; 1 < 2 <3 <br>new<!-- no > --> line<!-->x</body>") == "plain <words> & é 1 < 2 <3 new linex"
    assert html_text.main_text("<p>in<b>line</b> <i>parts</i><span class=comment># code</span></p>") == "inline parts# code"


def test_broken_pages_take_linear_time():
    import time

    for part in ("<a <b ", '<p title="x', "</div x", "<div><i>", "</b>", "<td></div>", "<!--", "<", "&#", "\"<p class='"):
        began = time.perf_counter()
        html_text.main_text("<body><p>x</p>" + part * 20_000)
        assert time.perf_counter() - began < 4, part


def brute_best(node, share):
    """(best sum, its element) over an ElementTree, by the definition."""
    import math

    def facts(e):
        own = "".join([e.text or "", *(c.tail or "" for c in e)])
        chars, tags, lc, lt = len("".join(own.split())), 0, 0, 0
        for c in e:
            a, b, x, y = facts(c)
            chars, tags, lc, lt = chars + a, tags + b + 1, lc + (a if c.tag == "a" else x), lt + y + (c.tag == "a")
        return chars, tags, lc, lt

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t, k, lt = max(t, 1), max(lc, 1), max(lt, 1)
        ratio = c / k * t / lt
        return c / t * math.log(ratio) / math.log(math.log(c * lc / max(c - lc, 1) + share * c + math.e) + 1) if ratio > 1 else 0.0

    if share is None:
        c, _, lc, _ = facts(node)
        share = lc / max(c, 1)
    best = (-1.0, None)
    for e in node.iter():
        if e.tag in ("div", "body", "p"):
            blocks = [c for c in e if c.tag in ("div", "p")]
            inline = [c for c in e if c.tag in ("a", "b")]
            chars = len("".join("".join([e.text or "", *(c.tail or "" for c in e)]).split()))
            links = sum(facts(c)[0] for c in inline if c.tag == "a")
            own = density(chars + sum(facts(c)[0] for c in inline), 1 + len(inline), links, sum(c.tag == "a" for c in inline))
            total = own + sum(density(*facts(c)) for c in blocks)
            if total > best[0] * (1 + 1e-9):
                best = (total, e)
    return best[1]


def test_main_text_against_brute_force():
    from xml.etree import ElementTree

    rnd = random.Random(12)

    def inline():
        words = " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 25)))
        return rnd.choice(["{}", "{}", "{} <b>bold</b>", "<a>{}</a>"]).format(words)

    def block(depth):
        if depth == 0 or rnd.random() < 0.3:
            return f"<p>{inline()}</p>"
        return "<div>" + "".join(block(depth - 1) for _ in range(rnd.randint(1, 4))) + "</div>"

    for _ in range(150):
        page = "<body>" + "".join(block(3) for _ in range(rnd.randint(1, 4))) + "</body>"
        tree = ElementTree.fromstring(page)
        nodes = html_text.parse(page)
        html_text.leave_out(nodes)
        best, _ = html_text.select(nodes)
        want = brute_best(tree, None)
        pieces, stack = [], [best]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                pieces.append(x)
            else:
                stack += reversed(x.parts)
        assert best.tag == want.tag and "".join(pieces) == "".join(want.itertext())


# the pipeline


def test_stages_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"wort{i}" for i in range(400)]
    texts = []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        if i % 5 == 0:
            w[rnd.randrange(len(w))] = "schimpfwort"
        texts.append(" ".join(w) + ("\n" + LINE if i % 3 == 0 else "") + (f"\npassword = geheim{i:04d}" if i % 7 == 0 else ""))
    texts += [texts[1], texts[1] + " mehr", None, "", texts[2]]
    rows = [(i, t, ["de", "en", None][i % 3], f"s{i % 4}" if i % 9 else None, len(t or ""), "x") for i, t in enumerate(texts)] + [(None, "ohne Nummer", "de", "s", 11, "x"), (1, texts[1], "en", "s1", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, maybe string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    folder = f"{tables.shared_root(spark)}/stages"
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        given = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept.collect()]
        done = tables.materialise(stage(spark, kept, folder), name)
        if name != "best_fit_packing":
            assert done.columns == docs.columns
        out = [(r["doc_id"], r["text"]) for r in done.collect()] if name != "best_fit_packing" else []
        if name == "toxicity":
            bad = [i for i, t, *_ in given if "schimpfwort" in (t or "")]
            left = Counter(i for i, _ in out)
            assert sum(left[i] == 0 for i in bad) > 0.9 * len(bad) and sum(i not in bad for i, _ in out) > 0.95 * (len(given) - len(bad))
        elif name == "line_dedup":
            holders = {i for i, t, *_ in given if LINE in (t or "")}
            want = [(i, t if i == max(holders) else (t.replace("\n" + LINE, "") if t else t)) for i, t, *_ in given]
            assert Counter(out) == Counter(want)
            assert all(r["n_chars"] == len(r["text"] or "") for r in done.collect())
        elif name == "near_dedup":
            idf = near_dup.shingle_idf(kept)
            want = brute_classes(sorted({(i, t) for i, t, *_ in given if i is not None}, key=lambda r: r[0]), idf)
            assert Counter(i for i, _ in out) == Counter(i for i, *_ in given if i is None or want[i] == i)
        elif name == "secret_scan":
            owners, repos = defaultdict(set), defaultdict(set)
            for _, t, lang, source in given:
                for _, _, v in brute_spans(t or "")[1]:
                    owners[v].add(source or "")
                    repos[v].add((source or "", lang or ""))
            want = []
            for i, t, *_ in given:
                for v in {v for _, _, v in brute_spans(t or "")[1] if len(owners[v]) < 3 and len(repos[v]) < 6}:
                    t = t.replace(v, "<secret>")
                want.append((i, t))
            assert Counter(out) == Counter(want) and any("<secret>" in (t or "") for _, t in out)
        else:
            pieces = done.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
            assert done.select("doc_id").distinct().count() == len({i for i, *_ in given}) and pieces.where("n <> end or n > 2048").count() == 0
        kept = done


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{tables.shared_root(spark)}/no-stages"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.materialise(stage(spark, docs, folder), name)
        assert docs.count() == 0
