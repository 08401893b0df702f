"""Clustering, main text and resampling against SQL, brute force and awkward input."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import centroid_clusters as K
from framelake.llm import importance_sample as I
from framelake.llm import main_text as E
from framelake.llm.page_labels import LABELLED_PAGES
from framelake.llm.registry import oracle_sql, queries

from ..conftest import table


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_importance_sample"])
def test_query_equals_sql(spark, duck, sf, name):
    df, want = queries()[name](spark, sf), duck.sql(oracle_sql()[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


# Clustering


def brute_clusters(vectors, k, rounds, dim, scale, salt):
    rows = []
    for vec_id, v in vectors:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            rows.append((vec_id, [math.floor(scale * x) for x in v]))
    hashed = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in hashed[:k]]

    def nearest(x):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(nearest(x)[0], []).append(x)
        for c, xs in groups.items():
            centroids[c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    return sorted(((i, *nearest(x)) for i, x in rows), key=repr), centroids


@pytest.mark.parametrize("size", [1.0, 3e5])  # the second needs wide dot products
def test_clusters_equal_brute_force(spark, size):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(i % 4, 1) * size for _ in range(6)]) for i in range(200)]
    vectors += [(7, vectors[7][1]), (7, vectors[8][1]), (None, vectors[9][1]), (301, None), (302, []), (303, [1.0] * 5), (304, [1.0] * 5 + [None]), (305, [1.0] * 5 + [math.nan]), (306, [math.inf] * 6), (307, [-0.001] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(None).cast("string") for c in ("x", "norm", "dots", "cluster", "distance")})
    got, centroids = K.cluster(df, k=9, rounds=4, dim=6, scale=256, salt="2")
    want, best = brute_clusters(vectors, 9, 4, 6, 256, "2")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert centroids.tolist() == best


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [1e30] * 64)], "vec_id long, embedding array<double>")
    got = K.op11_centroid_clusters(df).collect()
    digest = hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, digest)] * 2  # equal centroids: the smaller number; 1e30 does not fit
    empty = K.op11_centroid_clusters(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_changes_touch_only_what_moved():
    rng = np.random.default_rng(0)
    for top in (100, 1 << 26):
        old, x = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (50, 8))
        new = old.copy()
        new[1, 3] += 2
        new[4, :2] -= 7
        moved = K.changes(old, new)
        assert [(c, at.tolist()) for c, at, _ in moved] == [(1, [3]), (4, [0, 1])]
        dots = old @ x.T
        K.add_changes(dots, np.ascontiguousarray(x.T), moved)
        assert np.array_equal(dots, new @ x.T)


# Main text


@pytest.fixture(scope="module")
def tree():
    return E.labelled_tree(LABELLED_PAGES)


def test_main_text_equals_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    got = E.op12_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_fits_its_table(tree):
    for page in LABELLED_PAGES:
        found = E.blocks(page)
        assert tree.judge(E.features(found)).tolist() == [b.marked for b in found]


PAGES = {
    '<body class="has-sidebar"><header><h1><a href=/>Site</a></h1></header><div class="cookie-banner"><p>We use cookies and other things that you should know about before you go on.</p></div><div id="content"><article class="post category-legal">'
    '<h1>Title &amp; more</h1><p>Some&nbsp;text  here.</p><div class="ad">Buy now</div><p>Short.</p><ul><li>one<li>two</ul></article><section class="comments"><article class="comment"><p>A comment of some words.</p></article></section></div>'
    '<aside id="sidebar">Foo</aside><footer>&copy; 2020</footer>': "Title & more\n\nSome text here.\n\nShort.\n\none\n\ntwo",
    '<div id=header>My site</div><div id=nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div id=main><h2>Head</h2><p>Para one<p>Para two &lt;b&gt; &#x41;<br>line<script>if (a<b) {x("</div>")}</script></div><div id=footer>Foot</div>': "Head\n\nPara one\n\nPara two <b> A line",
    '<form id="aspnetForm"><div class="menu"><a>x</a></div><div class="article-body"><p>Hi there.</p><p>Two.</p></div><input name=q><label>Name</label></form>': "Hi there.\n\nTwo.",
    '<main><p>x</p><div class="newsletter-signup"><p>Sign up</p></div><p>y</p><form><p>Name</p></form><div hidden>z</div></main>': "x\n\ny",
    '<div class="notice">Soon closed</div><div role="main"><h1>T</h1><p>a<!-- b --><em>b</em>c</p></div><div role="contentinfo">z</div>': "T\n\nabc",
    "<article>Loose <p>text</p>tail <textarea>no</textarea><style>p{}</style><title>no</title></article": "Loose\n\ntext\n\ntail",
    "<article><p>a < b &amp;&amp; c > d</p><!-- never closed <p>no</p>": "a < b && c > d",
    "<nav>only</nav>": "",
    "  ": "",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_layouts(tree, page):
    assert E.main_text(page, tree) == PAGES[page]


def test_pages_awkward_and_empty(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x</article>"), (3, "u", "<article>x</article>"), (3, "u", "<article>x</article>"), (4, "u", "<article>" + "<p>wörd\x00 " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "tree")})
    got = sorted(map(tuple, E.op12_main_text(df).collect()), key=repr)
    long = "\n\n".join(["wörd\x00"] * 100_000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "u", "x", 1), (3, "u", "x", 1), (4, "u", long, len(long))], key=repr)
    assert E.op12_main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("page", ["<p>a" * 50_000 + "</div>" * 50_000, "<article>" + '<div><b x="' * 50_000, "<article>" + "<div>" * 50_000 + "</p>" * 50_000, "<a " * 100_000, "<script>" * 100_000, "<!--" * 100_000])
def test_broken_pages_in_linear_time(tree, page):
    E.main_text(page, tree)


def test_own_labelled_table(spark):
    own = spark.createDataFrame([("<td>menu menu</td><td data-main>alpha beta gamma</td>",), (None,), ("<td data-main>one two three</td><td>menu</td>",)], "html string")
    pages = spark.createDataFrame([(1, "u", "<td>a b c d</td><td>e</td>")], "page_id long, url string, html string")
    assert E.extract(pages, own).first().text == "a b c d"
    assert E.extract(pages, own.where("false")).first().text == ""


# Resampling


def brute_sample(docs, target, percent=10, least=20, salt="2024", n=1):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in docs:
        np.add.at(s, feats(text)[1], 1)
    for text in target:
        np.add.at(t, feats(text)[1], 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in docs:
        words, f = feats(text)
        h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_sample_equals_brute_force(spark, n):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Ä", "b9", "c", "Dd", "e-f", "g"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, None), (None, "x " * 25), (400, ""), (401, "ü" * 40_000 + " w" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("score", "rank", "row", "part", "k0", "weight", "bucket", "n")})
    target = ["b9 C dd", None, "ä ä"]
    got = I.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, n=n)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, brute_sample(docs, target, 30, n=n)), key=repr)


def test_sample_splits_ties(spark):
    """Whole rows repeat, a third of all; the drawn number is exact and ranks have no gaps."""
    docs = spark.range(600).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("word " * 20).alias("text"))
    for percent in (1, 10, 35, 100):
        got = I.resample(docs, docs.where("false"), percent=percent).collect()
        assert len(got) == 600
        drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
        assert [r.rank for r in drawn] == list(range(1, 6 * percent + 1))
        order = sorted(got, key=lambda r: (-r.score, r.doc_id))
        assert [(r.score, r.doc_id) for r in drawn] == [(r.score, r.doc_id) for r in order[: len(drawn)]]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_do_not_depend_on_exchange_reuse(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = spark.range(20_000).select(F.xxhash64("id").alias("key"))
        got = [r.key for r in I.ranked(rows, ["key"]).orderBy("rank").collect()]
        assert len(got) == 20_000 and got == sorted(got)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_sample_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [tuple(r)[-1] for r in I.op13_importance_sample(docs, docs).collect()] == [None, None]
    assert I.op13_importance_sample(docs.where("false"), docs).count() == 0


def test_least_reaching(spark):
    rows = spark.createDataFrame([(v,) for v in (-5, -5, 0, 3, 3, 3, 1000)], "v long")
    assert [I.least_reaching(rows, F.col("v"), -5, 1000, k) for k in range(1, 8)] == [-5, -5, 0, 3, 3, 3, 1000]
