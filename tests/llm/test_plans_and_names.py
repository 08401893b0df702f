"""What must not depend on how Spark plans, on repeated ids, or on the names of other columns."""

from __future__ import annotations

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import chat_format as C
from framelake.llm import curve_packing as P
from framelake.llm import fingerprint as G
from framelake.llm import jaccard_join as J
from framelake.llm import secret_scan as X


@pytest.fixture(params=[("true", "true"), ("true", "false"), ("false", "true"), ("false", "false")], ids=lambda p: f"reuse-{p[0]}-adaptive-{p[1]}")
def planned(spark, request):
    """The session with exchange reuse and adaptive planning on or off, and enough partitions for bounds to matter."""
    settings = {"spark.sql.exchange.reuse": request.param[0], "spark.sql.adaptive.enabled": request.param[1], "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_offsets_are_whole_however_planned(planned):
    keys = planned.range(30_000).select(F.col("id").alias("row"), F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("n"))
    got = P.curve_offsets(keys).collect()
    lengths, at, end = {r: r % 7 for r in range(30_000)}, 0, sum(r % 7 for r in range(30_000))
    assert len(got) == 30_000 and len({r.row for r in got}) == 30_000
    covered = sorted((r.global_at, lengths[r.row]) for r in got if lengths[r.row])
    for place, n in covered:
        assert place == at
        at += n
    assert at == end


def test_followers_are_whole_however_planned(planned):
    docs = planned.range(4_000).select((F.col("id") % 3_000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(planned.createDataFrame([(None, "none"), (None, "none either"), (-(1 << 63), "least")], "doc_id long, text string"))
    rows = [(d, t) for d, t in docs.collect()]
    got = G.op2_fingerprints(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in rows)
    # Descending ids, none last: every follower's fingerprint is that of a row with the next smaller or the same id.
    order = sorted((d for d, _ in rows if d is not None), reverse=True) + [None, None]
    texts = collections.defaultdict(set)
    for d, t in rows:
        texts[d].add(t)
    after = {}
    for d, e in zip(order, order[1:] + order[:1], strict=True):
        after.setdefault(d, set()).update(texts[e])
    for r in got:
        wanted = {hashlib.sha256(G.edit(t, n).encode()).hexdigest() for t in texts[r.doc_id] for n in after[r.doc_id]}
        assert r.edited_sha256 in wanted


def test_one_id_with_many_linked_texts(spark):
    """Near copies under a single id: each class asks for its own text alone, so the work is linear in the rows."""
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(3_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit(f"{base} v"), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, f"{base} other"), (9, "quite another text of some words")], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.component_id) for r in J.op6_jaccard_join(docs).collect())
    assert got == {(5, 2): 3_000, (2, 2): 1, (9, 9): 1}


NAMES = ("row", "row_", "__row", "secret_spans", "__secret_spans", "SECRET_SPANS_", "fields", "safe", "component_id", "place", "layout_", "digest", "part", "hash")


def test_other_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdef123456"'), (2, "plain words"), (3, None)], "doc_id long, text string")
    named = docs.withColumns({n: F.lit(n) for n in NAMES})
    for done in (X.redact(named), corpus_pipeline.near_duplicates(spark, named, ""), corpus_pipeline.secret_scan(spark, named, "")):
        assert done.columns == named.columns
        assert all(r[n] == n for r in done.collect() for n in NAMES)
    records = spark.createDataFrame([('{"prompt": "a", "response": "b"}',), (None,)], "record string").withColumns({n: F.lit(n) for n in NAMES})
    assert all(r[n] == n for r in C.format_turns(C.canonical_turns(records)).collect() for n in NAMES)
