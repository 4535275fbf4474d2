"""How often a key's state is asked: every call is a message to the JVM."""

from __future__ import annotations

import pandas as pd

from bulletinlake.streaming import state


class _Held:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers, self.said = set(), []

    def getValueState(self, name, schema):
        return _Held()

    def listTimers(self):
        self.said.append("list")
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.said.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.said.append("delete")
        self.timers.discard(at)


class _Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_timer_is_set_anew_only_where_its_time_changes():
    spans, handle = state._Spans("ts", "v", ["k", "first_at", "last_at", "expired_at", "n"], 1000), _Handle()
    spans.init(handle)
    rows = lambda *ms: iter([pd.DataFrame({"ts": pd.to_datetime(list(ms), unit="ms"), "v": "x"})])
    assert [len(f) for f in spans.handleInputRows((1,), rows(5000, 5300), None)] == []
    assert [len(f) for f in spans.handleInputRows((1,), rows(5600), None)] == []
    assert handle.said == ["register"] and handle.timers == {5000}
    assert list(spans.handleExpiredTimer((1,), _Times(5400), None)) == [] and handle.timers == {5600}
    out = list(spans.handleExpiredTimer((1,), _Times(7000), None))
    assert [f.values.tolist() for f in out] == [[[1, *pd.to_datetime([5000, 5600, 6600], unit="ms"), 3]]]
    assert handle.timers == set() and spans.held.value is None and "list" not in handle.said
