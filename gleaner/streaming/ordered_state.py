"""Stateful stream operators that see a key's rows in event-time order, however they arrive.

Rows wait in state until the watermark has passed them and are then folded in order. Between two rows a fold may owe
something to the clock (an alarm, the end of a wait); it says when, and one event-time timer per key stands for whatever
comes first. A key that nothing came for in ``idle_ms`` is forgotten. Rows go through as rows, and a call asks the state store no more
often than it must: with many keys of few rows each, that is what a stream costs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class OrderedProcessor(StatefulProcessor):
    """Subclasses give ``row_schema`` (DDL after ``at long``), ``state_schema`` (DDL), ``output`` and the three hooks."""

    row_schema: str
    state_schema: str
    output: T.StructType

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def first(self) -> tuple:
        """State before any row."""
        raise TypeError("a subclass gives the first state")

    def step(self, state: tuple, row: tuple, out: list) -> tuple:
        """State after ``row`` (``at`` first); rows to emit go to ``out``."""
        raise TypeError("a subclass folds rows")

    def advance(self, state: tuple, now: int, out: list) -> tuple:
        """State when the clock reads ``now`` and no row came since the last step."""
        return state

    def due(self, state: tuple) -> int | None:
        """When ``advance`` would next do something."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [column.split()[0] for column in f"at long, {self.row_schema}".split(", ")]
        self.head = handle.getValueState("head", f"{self.state_schema}, last long, timer long")
        self.pending = handle.getListState("pending", f"at long, {self.row_schema}")

    def _load(self) -> tuple[tuple, int, int]:
        head = self.head.get()
        if head is None:
            return self.first(), -1, -1
        *state, last, timer = head
        return tuple(state), last, timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ahead = [tuple(r[c] for c in self.names) for r in rows if r.at > watermark]
        if ahead:
            self.pending.appendList(ahead)
            state, last, timer = self._load()
            first, newest = min(r[0] for r in ahead), max(r[0] for r in ahead)
            earlier = timer < 0 or first < timer
            if earlier:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            if earlier or newest > last:
                self.head.update((*state, max(last, newest), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state, last, _ = self._load()
        # Rows of one time are in the order of their other columns, so that arrival does not matter.
        rows = sorted((tuple(r) for r in self.pending.get()), key=lambda r: tuple((v is not None, v) for v in r))
        out: list[tuple] = []
        for row in rows:
            if row[0] <= watermark:
                state = self.step(self.advance(state, row[0], out), row, out)
        ahead = [r for r in rows if r[0] > watermark]
        ends = last + self.idle_ms
        # What is owed after the last row is owed until the key is forgotten.
        state = self.advance(state, min(watermark + 1, ends), out)
        if ahead:
            self.pending.put(ahead)
        elif rows:
            self.pending.clear()
        if ends <= watermark and not ahead:
            self.head.clear()
        else:
            following = min(x for x in (ends, self.due(state), *(r[0] for r in ahead[:1])) if x is not None)
            self.handle.registerTimer(max(following, watermark + 1))
            self.head.update((*state, last, max(following, watermark + 1)))
        emitted = Row(*self.output.names)
        return iter([emitted(*key, *r) for r in out])

    def close(self) -> None:
        pass
