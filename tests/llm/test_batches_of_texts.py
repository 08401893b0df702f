"""Whole texts travel and are held few at a time, so that long ones do not fill an executor."""

from __future__ import annotations

import pyarrow as pa
from tokenizers import Tokenizer

from framelake.llm import common as C
from framelake.llm import curve_packing as P
from framelake.llm import quality_rules as Q


def test_judged_rows_are_handed_on_few_at_a_time():
    texts = [None if i % 7 == 3 else f"text {i} of some words" * (i % 5) for i in range(2 * C.TEXTS + 300)]
    row = pa.StructArray.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "body"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["en"] * len(texts)), row], names=["doc_id", "stratum", "row"])
    got = list(Q._count_rows(iter([batch]), "body"))
    assert [b.num_rows for b in got] == [C.TEXTS, C.TEXTS, 300]
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["row"] for r in rows] == row.to_pylist()
    assert [tuple(r[c] for c in Q._COUNTS) for r in rows] == [Q.count_text(t or "") for t in texts]


def test_staged_texts_reach_python_few_at_a_time(spark):
    sizes = lambda: {r.n for r in C.staged_texts(spark.range(0, 2 * C.TEXTS + 300, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long")).collect()}
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit, None)
    assert sizes() == {C.TEXTS, 300}
    assert spark.conf.get(limit, None) == before
    spark.conf.set(limit, "150")
    try:
        assert max(sizes()) == 150
        assert spark.conf.get(limit) == "150"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def test_encoder_reads_its_vocabulary_once(monkeypatch):
    """One tokenizer gives the ids of runs that spell special tokens and of those that do not, in any order."""
    read = []

    class Counted:
        from_file = staticmethod(lambda path: read.append(path) or Tokenizer.from_file(path))

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    encoder = P.RunEncoder(P.default_vocabulary())
    assert len(read) == 1
    plain = Tokenizer.from_file(P.default_vocabulary())
    special = sorted(x.content for x in plain.get_added_tokens_decoder().values())
    texts = ["Äpfel, 12 x-3 don't", special[0].upper() + " a1 " + special[-1], "b2 " + special[0], special[-1].upper() + " c3?", ""]
    for t in [*texts, *texts[::-1]]:
        encoder.known = dict(encoder.marked)
        assert encoder.encode([t]) == [P._packed(plain.encode(t, add_special_tokens=False).ids)]
