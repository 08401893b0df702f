"""The keyed store: what a change writes, who wins, what old versions say."""

from __future__ import annotations

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framelake.sources import keyed_store as K


def frame(spark, rows, schema="k long, v string, n long"):
    return spark.createDataFrame(rows, schema)


def held(store, version=None):
    return sorted((tuple(r) for r in store.read(version).collect()), key=repr)


def files(path):
    return {p for p in Path(path).rglob("part-*.parquet")}


def test_one_row_writes_one_bucket(spark, tmp_path):
    store = K.KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=16)
    assert store.upsert(spark.range(5_000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.col("id").alias("n"))) == 1
    before = files(tmp_path)
    assert len({p.parent.name for p in before}) == 16
    assert store.upsert(frame(spark, [(7, "b", 0)])) == 2
    new = files(tmp_path) - before
    assert len(new) == 1 and before <= files(tmp_path)
    assert {r.k: r.v for r in store.read().where("k in (6, 7)").collect()} == {6: "a", 7: "b"}
    assert store.read(1).where("k = 7").first().v == "a"
    # Buckets without deltas are scanned as they are; the merge reads the changed bucket's files alone.
    plan = store.read(2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("BatchScan") == 3
    assert store.deltas() == {int(next(iter(new)).parent.name.split("=")[1]): 1}


def test_operations_and_versions(spark, tmp_path):
    store = K.KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=4)
    store.upsert(frame(spark, [(1, "a", 1), (2, "b", 2), (2, "later", 9), (None, "none", 0)]), [F.desc("n")])
    store.set_by_key(frame(spark, [(1, "set"), (8, "nobody")], "k long, v string"))
    store.delete(frame(spark, [(2,), (77,)], "k long"))
    store.set_by_key(frame(spark, [(2, "deleted is unknown")], "k long, v string"))
    store.upsert(frame(spark, [(3, 5)], "k long, n long"))  # without v: null
    store.set_where(F.col("n") < 2, v=None, n=F.col("n") + 100)
    store.set_by_key(frame(spark, [(3, 2.5)], "k long, w double"))  # a new column
    versions = [held(store, v) for v in store.versions()]
    assert versions == [
        [(1, "a", 1), (2, "later", 9), (None, "none", 0)],
        [(1, "set", 1), (2, "later", 9), (None, "none", 0)],
        [(1, "set", 1), (None, "none", 0)],
        [(1, "set", 1), (None, "none", 0)],
        [(1, "set", 1), (3, None, 5), (None, "none", 0)],
        [(1, None, 101), (3, None, 5), (None, None, 100)],
        [(1, None, 101, None), (3, None, 5, 2.5), (None, None, 100, None)],
    ]
    store.upsert(frame(spark, [(2, "back", 1)]))
    assert (2, "back", 1, None) in held(store)
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [(1, 1)], "k long, v long"))
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [(1, "x")], "k long, _op string"))
    assert store.delete(frame(spark, [], "k long")) == 8  # nothing to do, no version


def test_against_a_dictionary(spark, tmp_path):
    """Random changes, compactions among them, replayed in memory. Keys have two columns."""
    rng, store, want = random.Random(4), K.KeyedStore(spark, str(tmp_path / "s"), ["a", "b"], buckets=3), {}
    schema = "a long, b string, x long, y string"
    for step in range(14):
        keys = [(rng.randint(0, 6), rng.choice("pq")) for _ in range(rng.randint(1, 8))]
        kind = "put" if step == 0 else rng.choice(["put", "put", "delete", "set", "where", "compact"])
        if kind == "put":
            rows = {k: (rng.randint(0, 9), rng.choice(["u", None])) for k in keys}
            store.upsert(frame(spark, [(*k, *v) for k, v in rows.items()], schema))
            want |= rows
        elif kind == "delete":
            store.delete(frame(spark, keys, "a long, b string"))
            want = {k: v for k, v in want.items() if k not in keys}
        elif kind == "set":
            store.set_by_key(frame(spark, [(*k, step) for k in set(keys)], "a long, b string, x long"))
            want |= {k: (step, want[k][1]) for k in keys if k in want}
        elif kind == "where":
            store.set_where(F.col("x") > 4, y="big")
            want |= {k: (v[0], "big") for k, v in want.items() if v[0] > 4}
        else:
            store.compact(1)
            assert max(store.deltas().values(), default=0) <= 1
        assert held(store) == sorted(((*k, *v) for k, v in want.items()), key=repr), kind
    store.compact()
    assert not store.deltas() and held(store) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    dead = store.vacuum(1)
    assert dead and len(store.versions()) == 1 and held(store) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    """Both see version 1. One creates version 2; the other is refused and goes under 3, its rows written once."""
    path = str(tmp_path / "s")
    one, two = (K.KeyedStore(spark, path, ["k"], 4) for _ in range(2))
    one.upsert(frame(spark, [(i, "a", 0) for i in range(20)]))
    refused, create = [], K.Folder.create

    def first(self, name, text):
        if not refused:
            refused.append(name)
            two.upsert(frame(spark, [(2, "two", 0), (3, "two", 0)]))  # comes in between
        return create(self, name, text)

    monkeypatch.setattr(K.Folder, "create", first)
    assert one.upsert(frame(spark, [(1, "one", 0), (2, "one", 0)])) == 3 and one.versions() == [1, 2, 3]
    assert {r.k: r.v for r in two.read().where("k < 4").collect()} == {0: "a", 1: "one", 2: "one", 3: "two"}
    with pytest.raises(K.VersionTaken):
        one.log.create(f"{3:020d}.json", "{}")
    assert not [n for n in one.log.names() if n.endswith(".json") and n.startswith(".")]


def test_by_predicate_is_worked_out_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    one, two = (K.KeyedStore(spark, path, ["k"], 4) for _ in range(2))
    one.upsert(frame(spark, [(1, "a", 0), (2, "a", 0)]))
    calls, create = [], K.Folder.create

    def first(self, name, text):
        calls.append(name)
        if len(calls) == 1:
            two.upsert(frame(spark, [(2, "z", 0), (3, "a", 0)]))
        return create(self, name, text)

    monkeypatch.setattr(K.Folder, "create", first)
    one.set_where(F.col("v") == "a", v="hit")
    assert held(one) == [(1, "hit", 0), (2, "z", 0), (3, "hit", 0)]


def test_compaction_beside_writers(spark, tmp_path, monkeypatch):
    """A delta that comes while buckets are compacted stays after the new base; a second compaction gives up."""
    path = str(tmp_path / "s")
    one, two = (K.KeyedStore(spark, path, ["k"], 2) for _ in range(2))
    one.upsert(frame(spark, [(i, "a", 0) for i in range(8)]))
    one.upsert(frame(spark, [(i, "b", 0) for i in range(4)]))
    calls, create = [], K.Folder.create

    def first(self, name, text):
        calls.append(name)
        if len(calls) == 1:
            two.upsert(frame(spark, [(0, "c", 0)]))
            two.compact()
            two.upsert(frame(spark, [(1, "d", 0)]))
        return create(self, name, text)

    monkeypatch.setattr(K.Folder, "create", first)
    one.compact()
    want = [(0, "c", 0), (1, "d", 0), (2, "b", 0), (3, "b", 0)] + [(i, "a", 0) for i in range(4, 8)]
    assert held(one) == want
    one.compact()
    assert held(one) == want and not one.deltas()


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "s")
    K.KeyedStore(spark, path, ["k"], 2).upsert(frame(spark, [(0, "a", 0)]))
    jobs = [threading.Thread(target=lambda i=i: K.KeyedStore(spark, path, ["k"]).upsert(frame(spark, [(i, "w", i)]))) for i in range(1, 7)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    store = K.KeyedStore(spark, path, ["k"])
    assert store.versions() == list(range(1, 8)) and [r[0] for r in held(store)] == list(range(7))


def test_empty(spark, tmp_path):
    store = K.KeyedStore(spark, str(tmp_path / "s"), ["k"])
    with pytest.raises(ValueError):
        store.read()
    store.upsert(frame(spark, []))
    assert held(store) == [] and store.read().columns == ["k", "v", "n"]
    store.upsert(frame(spark, [(1, "a", 1)]))
    assert held(store) == [(1, "a", 1)]
