"""Families by sketches: links stay exact, and sets that only share a line are not sent."""

from __future__ import annotations

import random

import numpy as np

from framelake.llm import jaccard_join as J

from .test_corpus_operators import _brute_components
from .test_jaccard_pivots import near


def test_sketches_differ_in_no_more_cells_than_sets():
    rng = np.random.default_rng(3)
    for n, m, both in [(40, 45, 38), (64, 65, 60), (900, 1100, 890), (1, 1, 0), (70, 130, 20)]:
        words = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = np.sort(words[:n]), np.sort(words[n - both :])
        x, y = (np.frombuffer(J.sketch(s), np.uint64)[None, :] for s in (a, b))
        least = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(J.folded(x, least) ^ J.folded(y, least)).sum())
        assert apart <= n + m - 2 * both and (apart - (n + m)) % 2 == 0


def test_components_and_links_equal_brute_force(spark, monkeypatch):
    """Families of many bands and sizes around powers of two, in small blocks of sketches and of sets."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    texts = {i: near(base, rng, vocabulary, rng.randint(0, 3)) for i in range(80)}
    texts |= {100 + i: " ".join(vocabulary[: 5 + i * 2 + rng.randint(0, 2)]) for i in range(90)}
    texts |= {300 + i: texts[i] for i in range(0, 80, 9)} | {400: ""}
    for name, value in (("SKETCH_ROWS", 11), ("BLOCK_ROWS", 9), ("SMALL", 4), ("HOT", 8)):
        monkeypatch.setattr(J, name, value)
    got = J.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = _brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.n_shingles} == {d: v[:2] for d, v in want.items() if v[0]}
    sets = {d: set(J.shingles(t).tolist()) for d, t in texts.items()}
    links = {d: sum(e != d and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for e, b in sets.items()) for d, a in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == links


def test_sets_that_share_a_line_alone_are_not_sent(spark, monkeypatch):
    """Sixty long texts with one line in common are a family by its list; only the two that are linked send their sets."""
    rng = random.Random(8)
    line = "one line of many words that all of the texts have at their beginning and that nothing tells is frequent"
    texts = {i: line + " " + " ".join(f"w{rng.randrange(9_000)}" for _ in range(300)) for i in range(60)}
    texts[60] = texts[0] + " end"
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "FREQUENT", 0)
    sent = []
    make = J._block_pairs

    def watched(sets, *columns):
        if not columns:
            sent.append(sets.count())
        return make(sets, *columns)

    monkeypatch.setattr(J, "_block_pairs", watched)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {60: 0}
    assert sent == [2]
