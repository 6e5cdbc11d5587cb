"""Keyed state that follows event time, whatever the order in which events arrive.

An event waits in its key's state until the watermark has passed it; then all that are due are applied in order of time
and id.  So a shuffled arrival gives the result of the sorted log, as long as nothing comes later than the lateness
allowed; what does is dropped by the watermark.  A key has one timer at a time, for its earliest waiting event.

A key's waiting events are one value, which is read and written once for each batch that concerns the key: a call to
the state for each event costs far more than the event.  Memory follows what one key receives within a batch and the
allowed lateness (bound the files of a batch when a long backlog is read).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What is kept of a key: the time of its timer, its waiting events (a JSON array of [at, id, event] to a line) and its state.
KEPT = "timer bigint, waiting string, state string"

Step = Callable[[dict, dict], dict]
Rows = Callable[[dict], list[dict]]


class InOrder(StatefulProcessor):
    """Applies ``step`` (state, event -> state) to a key's events in event time; ``rows`` says what a state shows."""

    def __init__(self, step: Step, rows: Rows, key: str, columns: list[str]):
        self.step, self.rows, self.key, self.show = step, rows, key, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", KEPT)

    def _get(self) -> tuple[int | None, str, str]:
        return tuple(self.kept.get() or (None, "", "{}"))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, waiting, state = self._get()
        new = [r["event"] for r in rows]
        at = min(int(event[1 : event.index(",")]) for event in new)
        if timer is None or at < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.kept.update((timer, "\n".join(([waiting] if waiting else []) + new), state))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, (_, waiting, state) = timerValues.getCurrentWatermarkInMs(), self._get()
        lines = sorted(waiting.split("\n"))  # the text settles what time and id leave open
        events = sorted(zip(json.loads(f"[{','.join(lines)}]"), lines, strict=True), key=lambda e: e[0][:2])
        due = sum(e[0] <= now for e, _ in events)
        shown = json.loads(state)
        for (_, _, event), _ in events[:due]:
            shown = self.step(shown, event)
        timer = events[due][0][0] if due < len(events) else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.kept.update((timer, "\n".join(line for _, line in events[due:]), json.dumps(shown)))
        for r in self.rows(shown):
            found = {self.key: key[0], **r}
            yield self.show(*(found[c] for c in self.show))

    def close(self) -> None:
        pass


def in_event_order(events: DataFrame, key: str, id_: str, step: Step, rows: Rows, schema: str, late: str = "10 minutes") -> DataFrame:
    """The rows of each key's state, whenever it changes.

    events: a stream with ``ts``, the key, an id that settles equal times, and whatever else ``step`` reads; those without a
    time have no place and are left out.
    """
    spark: SparkSession = events.sparkSession
    spark.conf.set(*STORE)
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    body = F.to_json(F.struct(*(c for c in events.columns if c not in ("ts", key))))
    line = F.format_string("[%d,%d,%s]", F.unix_millis("ts"), F.col(id_).cast("bigint"), body)
    stream = events.filter("ts is not null").withWatermark("ts", late).select(key, "ts", line.alias("event"))
    return stream.groupBy(key).transformWithState(InOrder(step, rows, key, columns), schema, "Update", "eventTime")
