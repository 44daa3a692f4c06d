"""Time to live as state: a stream of answers and questions in, hits, misses and evictions out.

Each key's newest answer is a state value with a timer at the end of its life. Time is the events' own: a question finds
an answer if it is not more than ``ttl_seconds`` older, and the answer is evicted once the watermark has passed its end.
So a replay gives the same rows, whenever it runs (Spark's own time to live of state goes by the clock of the machines).
Keys are spread over the stores by hash; a key's state is one row, so a hot key costs time but no memory.

The session needs ``STORE`` among its settings. Times count in whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need, as a setting of the session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: What comes in: ``kind`` is 'answer' or 'ask'; other kinds and null times are passed over.
EVENTS = "kind string, query_hash string, at timestamp, entry_id long, response string"
#: What goes out: ``event`` is 'hit' or 'miss' (entry_id: the question's, answer_id: the answer's), or 'evicted'.
OUTCOMES = "event string, query_hash string, at timestamp, entry_id long, answer_id long, response string"
_ANSWER = "time long, entry_id long, response string"


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


class _Lives(StatefulProcessor):
    def __init__(self, ttl_seconds: float):
        self.ttl = round(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", _ANSWER)

    def _timer(self, time: int) -> int:
        """The first millisecond after the end of an answer's life."""
        return (time + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.answer.get() if self.answer.exists() else None
        held = first
        for part in self._ordered(rows):
            out = []
            for kind, at, time, number, response in part:
                number = None if pd.isna(number) else int(number)
                if kind == "answer":
                    if held is None or (time, -1 if number is None else number) >= (held[0], -1 if held[1] is None else held[1]):
                        held = (time, number, response)
                elif held is not None and 0 <= time - held[0] <= self.ttl:
                    out.append(("hit", key[0], at, number, held[1], held[2]))
                else:
                    out.append(("miss", key[0], at, number, None, None))
            yield self._frame(out)
        if held is not None and held is not first:
            if first is not None:
                self.handle.deleteTimer(self._timer(first[0]))
            self.answer.update(held)
            self.handle.registerTimer(self._timer(held[0]))

    @staticmethod
    def _ordered(rows: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """A micro-batch's events of one key in order of time, answers before questions of the same time.

        Their texts aside from answers' are short, and ``maxFilesPerTrigger`` or the like bounds a micro-batch.
        """
        every = pd.concat([r for r in rows], ignore_index=True)
        every = every[every["kind"].isin(["answer", "ask"]) & every["at"].notna()]
        every = every.assign(time=_micros(every["at"])).sort_values(["time", "kind", "entry_id"], kind="stable")
        yield list(every[["kind", "at", "time", "entry_id", "response"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["event", "query_hash", "at", "entry_id", "answer_id", "response"])
        made["at"] = pd.to_datetime(made["at"])
        return made.astype({"entry_id": "Int64", "answer_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.answer.get() if self.answer.exists() else None
        if held is not None and self._timer(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.answer.clear()
            yield self._frame([("evicted", key[0], pd.Timestamp(held[0] + self.ttl, unit="us"), None, held[1], held[2])])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """Rows of ``OUTCOMES`` from a stream of ``EVENTS``.

    ``late`` is how far behind the newest event of earlier micro-batches one may come: longer waits keep answers longer.
    What is as far behind as that or further is dropped by the watermark, as are events at the epoch or before. Of answers to one key the newest counts, of equal times the largest entry_id.
    """
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be above 0: without an end nothing is ever evicted")
    rows = events.select("kind", "query_hash", "at", "entry_id", "response").withWatermark("at", late)
    return rows.groupBy("query_hash").transformWithStateInPandas(_Lives(ttl_seconds), OUTCOMES, "Append", "EventTime")
