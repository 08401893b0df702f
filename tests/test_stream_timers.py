"""Timers of keyed streams: one for each key and batch, and none is missing."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

from framelake.streaming import streams as S

START = datetime(2024, 1, 1)


class Cell:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, rows):
        self.held = list(rows)

    update = put

    def appendList(self, rows):
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers: list[int] = []

    def getListState(self, name, schema):
        return Cell()

    def getValueState(self, name, schema):
        return Cell()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def rows(minutes):
    return pd.DataFrame({"ts": [pd.Timestamp(START + timedelta(minutes=m)) for m in minutes], "seq": minutes, "status": [f"s{m // 2}" for m in minutes]})


def test_one_timer_for_many_rows_of_a_key():
    handle = Handle()
    made = S._Changes(86_400_000)
    made.init(handle)
    first = S._ms(START)
    list(made.handleInputRows((7,), iter([rows(list(range(50, 100))), rows(list(range(50)))]), Clock(0)))
    assert handle.timers == [first]

    got = pd.concat(made.handleExpiredTimer((7,), Clock(first + 30 * 60_000), None))
    assert got["seq"].tolist() == list(range(0, 31, 2))
    assert sorted(set(handle.timers)) == [first, first + 31 * 60_000, first + 30 * 60_000 + 86_400_000]

    got = pd.concat(made.handleExpiredTimer((7,), Clock(first + 200 * 60_000), None))
    assert got["seq"].tolist() == list(range(32, 100, 2)) and not made.waiting.exists()


def test_milliseconds_with_and_without_a_zone():
    at = datetime(2024, 1, 1, 0, 0, 0, 1_999)
    want = pd.Timestamp(at).value // 1_000_000
    assert S._ms(at) == S._ms(pd.Timestamp(at)) == S._ms(pd.Timestamp(at, tz="UTC").tz_convert("Asia/Tokyo")) == want
    assert S._ms(datetime(1969, 12, 31, 23, 59, 59, 999_500)) == -1
