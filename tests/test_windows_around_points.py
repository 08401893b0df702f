"""Readings around points: running sums and rank lookups against direct computation."""

from __future__ import annotations

import random

import pytest

from framelake.operators import joins as J


def direct(points, readings, seconds, digits):
    out = {}
    for i, source, t in points:
        near = sorted((r for r in readings if source is not None and t is not None and r[0] == source and r[1] is not None and abs(r[1] - t) <= seconds), key=lambda r: r[2])
        mean = lambda xs, d: round(sum(xs) / len(xs), d) if xs else None
        rates, stress = [r[3] for r in near if r[3] is not None], [r[5] for r in near if r[5] is not None]
        out[i] = (len(near) or None, mean(rates, digits[0]), round(max(rates), digits[0]) if rates else None, near[len(near) // 2][4] if near else None, mean(stress, digits[1]))
    return out


@pytest.mark.parametrize("rises", [True, False, None])
def test_windows_equal_direct(spark, rises):
    """Sources whose seq rises with time, falls with it, or both kinds; edges at exactly the distance, ties and gaps."""
    rng = random.Random(8)
    readings = []
    for s in ("a", "b", "hot"):
        times = sorted(rng.randint(-40, 300) for _ in range(200 if s == "hot" else 30))
        falls = rises is False or (rises is None and s == "b")
        for i, t in enumerate(times):
            readings.append((s, t, -i if falls else i, rng.choice([None, float(rng.randint(40, 160)) / 4]), f"act{i % 7}", rng.choice([None, rng.randint(0, 8) / 8])))
    readings += [("a", None, 999, 1.0, "none", 0.5), (None, 5, 1, 1.0, "nobody", 0.5)]
    points = [(i, rng.choice(["a", "b", "hot", "empty"]), rng.randint(-80, 340)) for i in range(150)] + [(900, None, 5), (901, "a", None), (902, "hot", 10_000)]
    df = J.window_readings(spark.createDataFrame(points, "id long, source string, t long"), spark.createDataFrame(readings, "source string, t long, seq long, rate double, activity string, stress double"), 15, digits=(6, 6))
    got = {r.id: (r.n, r.avg_rate, r.max_rate, r.activity, r.avg_stress) for r in df.collect()}
    want = direct(points, readings, 15, (6, 6))
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g[0], g[2], g[3]) == (w[0], w[2], w[3]), i
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-6) for x, y in ((g[1], w[1]), (g[4], w[4]))), i


def test_no_readings(spark):
    points = spark.createDataFrame([(1, "a", 5)], "id long, source string, t long")
    none = spark.createDataFrame([], "source string, t long, seq long, rate double, activity string, stress double")
    assert [tuple(r) for r in J.window_readings(points, none).collect()] == [(1, None, None, None, None, None)]
