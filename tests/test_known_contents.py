"""Known contents: what a batch opens, merging, and batches that come again."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from framelake.streaming import known as W
from framelake.streaming import streams as S


def contents(spark, names):
    return spark.createDataFrame([(n,) for n in names], "content string")


def test_a_batch_opens_what_may_hold_its_contents(spark, tmp_path, monkeypatch):
    """Ten batches of a thousand contents each, merged on the way: new contents open next to nothing, known ones their own
    folders, and however many batches there were, there are few runs."""
    monkeypatch.setattr(W, "FAN", 3)
    store = W.KnownContents(spark, str(tmp_path / "k"), digits=1)
    for n in range(10):
        store.merge(n)
        store.add(spark.range(1_000).select(F.concat(F.lit(f"c{n}-"), "id").alias("content")), n)
    assert [name for _, _, name in store.runs(10)] == ["level2-0", "level0-9"]
    new, opened = store.probe(contents(spark, [f"new{i}" for i in range(60)]), 10)
    assert new.count() == 0 and len(opened) <= 4  # false alarms, of 32 folders
    some, opened = store.probe(contents(spark, ["c3-17", "c9-5", "fresh"]), 10)
    assert sorted(r.content for r in some.collect()) == ["c3-17", "c9-5"] and 2 <= len(opened) <= 4
    none, opened = store.probe(contents(spark, ["c9-5"]), 9)  # as batch 9 itself saw it
    assert none.count() == 0 and len(opened) <= 1
    assert store.probe(contents(spark, ["c9-5"]), 0)[1] == []


def test_ingest_over_many_batches(spark, tmp_path, monkeypatch):
    """Decisions equal those of a dictionary over batches in order, with merges in between, and again when all is replayed."""
    monkeypatch.setattr(W, "FAN", 2)
    rng = random.Random(5)
    seen, want = set(), {}
    schema = "file_path string, file_hash string"
    for n in range(7):
        batch = [(f"f{n}-{i}", rng.choice([f"h{rng.randint(0, 25)}", None]) if i else f"only{n}") for i in range(8)]
        for h in {h for _, h in batch}:
            first = min(p for p, g in batch if g == h)
            want |= {p: "inserted" if h is not None and h not in seen and p == first else "duplicate_copy" for p, g in batch if g == h}
        seen |= {h for _, h in batch if h is not None}
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    opened = {}
    for cp in ("cp1", "cp2"):
        source = S.read_stream(spark, str(tmp_path / "in"), schema)
        done = S.ingest_contents(source, str(tmp_path / "log"), str(tmp_path / cp), opened=opened.__setitem__)
        assert {r.file_path: r.action for r in done.collect()} == want
    assert sorted(opened) == list(range(7)) and opened[0] == []
