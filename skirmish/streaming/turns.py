"""Live battles as keyed state with timers: a row per turn, and battles that fall silent are closed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATE = "nth INT, turn INT, active STRING, messages BIGINT, last BIGINT, timer BIGINT"
_ROW = "nth INT, turn INT, active STRING, messages BIGINT, closed STRING"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Turns(StatefulProcessor):
    """One small row of state per open battle, and one event-time timer."""

    def __init__(self, key: str, silence_ms: int) -> None:
        self.key, self.silence = key, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("battle", _STATE)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["nth", "turn", "active", "messages", "closed"])
        out.insert(0, self.key, key[0])
        out["turn"] = out["turn"].astype("Int32")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The messages of one trigger, in their order; the row of a turn comes with the message that ends it."""
        new = pd.concat(list(rows)).sort_values(["m_at", "m_tie"], kind="stable")
        nth, turn, active, messages, last, timer = self.state.get() if self.state.exists() else (0, None, None, 0, 0, None)
        out, open_ = [], True
        for at, kind, value in zip(new["m_at"], new["m_kind"], new["m_value"]):
            if kind == "turn":
                if nth:
                    out.append((nth, turn, active, messages, "turn"))
                nth, turn = nth + 1, int(value)
            elif kind == "switch":
                active = value
            messages, last, open_ = messages + 1, max(last, int(at)), True
            if kind == "end":
                out.append((nth, turn, active, messages, "end"))
                nth, turn, active, messages, open_ = 0, None, None, 0, False
        if timer is not None:
            self.handle.deleteTimer(timer)
        if open_:
            timer = last + self.silence
            self.handle.registerTimer(timer)
            self.state.update((nth, turn, active, messages, last, timer))
        else:
            self.state.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = []
        if self.state.exists():
            nth, turn, active, messages, _, _ = self.state.get()
            rows.append((nth, turn, active, messages, "expired"))
            self.state.clear()
        yield self._rows(key, rows)

    def close(self) -> None:
        pass


def live_turns(messages: DataFrame, battle: str, ts: str, tie: str, turn: Column, switched: Column, ended: Column,
               late: str = "10 minutes", silence: str = "INTERVAL 30 MINUTES") -> DataFrame:
    """A row per battle and turn of a message stream: ``battle``, nth, turn, active, messages, closed.

    nth counts the turn messages of a battle (0: before the first), ``active`` is the last known switch and ``messages`` the
    messages so far when the turn ends.  A turn is closed by the next turn message, by the end of the battle, or
    once the watermark (``late`` behind the newest message) passes ``silence`` after the battle's last message; then its
    state goes, and what comes later counts as a new battle.  Messages behind the watermark are dropped.  ``turn`` (int),
    ``switched`` (string) and ``ended`` (boolean) are read from each message; null means neither.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    silent = int(spark.range(1).select((F.expr(f"unix_millis(timestamp_seconds(0) + {silence})")).alias("ms")).first()["ms"])
    kind = F.when(turn.isNotNull(), "turn").when(switched.isNotNull(), "switch").when(ended, "end").otherwise("")
    rows = messages.withWatermark(ts, late).select(
        battle, ts, F.unix_millis(ts).alias("m_at"), F.col(tie).alias("m_tie"), kind.alias("m_kind"),
        F.coalesce(turn.cast("string"), switched, F.lit("")).alias("m_value"))
    key_kind = rows.schema[battle].dataType.simpleString()
    return rows.groupBy(battle).transformWithStateInPandas(
        statefulProcessor=_Turns(battle, silent), outputStructType=f"{battle} {key_kind}, {_ROW}", outputMode="Append", timeMode="EventTime")
