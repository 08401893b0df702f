"""The similarity join without counts of links: the same components, in work that a family of near copies does not square."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import jaccard_join as J

from .test_corpus_operators import _brute_components


def components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = J.jaccard_components(df, count_links=False).collect()
    assert all(r.n_links is None for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def near(base, rng, vocabulary, changes):
    w = base[:]
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
    return " ".join(w)


@pytest.mark.parametrize("pivots", [1, 3, 32])
def test_components_equal_brute_force(spark, monkeypatch, pivots):
    """Families of many bands, of near copies with outliers and chains, of texts that only share a line, in small blocks."""
    rng = random.Random(pivots)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = {i: near(base, rng, vocabulary, rng.randint(0, 4)) for i in range(90)}
    texts |= {100 + i: " ".join(vocabulary[: 5 + i * 3 + rng.randint(0, 2)]) for i in range(80)}
    texts |= {200 + i: "one very common line of nine words in all\n" + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for i in range(60)}
    texts |= {300 + i: texts[i] for i in range(0, 90, 9)} | {400: "", 401: None}
    monkeypatch.setattr(J, "BLOCK_ROWS", 9)
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "HOT", 8)
    monkeypatch.setattr(J, "PIVOTS", pivots)
    want = {d: v[:2] for d, v in _brute_components({d: t or "" for d, t in texts.items()}).items()}
    got = components(spark, texts)
    assert {d: got[d] for d in want if want[d][0]} == {d: v for d, v in want.items() if v[0]}


def test_near_copies_meet_pivots_alone(spark, monkeypatch):
    """Every set of a family of near copies goes to a task three times at most, whatever the number of its blocks."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 50)
    seen = {}
    product = J._pivot_pairs
    rest = J._outside_pairs
    monkeypatch.setattr(J, "_pivot_pairs", lambda sets: seen.setdefault("pivots", product(sets)))
    monkeypatch.setattr(J, "_outside_pairs", lambda sets: seen.setdefault("outside", rest(sets)))
    monkeypatch.setattr(J, "PIVOTS", 4)
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.range(2_000).select("id", F.concat(F.lit(f"{base} v"), "id").alias("text"))
    got = J.jaccard_components(docs, id_col="id", count_links=False)
    assert got.select("component_id").distinct().count() == 1
    sent = seen["pivots"].count()
    assert "outside" not in seen and sent <= 3 * 2_000 + 4 * 3 * (2_000 // 50 + 2)
