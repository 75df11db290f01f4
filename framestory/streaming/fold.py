"""Step functions of the batch folds run as keyed streaming state."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from framestory.plans.fold import Step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many groups; a group's states are one value of the state store.
KEY_GROUPS = 1024
#: A step sees so many rows at once.
STEP_ROWS = 20_000


class FoldProcessor(StatefulProcessor):
    """Keeps the fold states and last positions of a group of keys.

    A call of the state store costs more than a step on a short key's rows, so
    keys share groups: their states are read and written together, each key
    (as JSON) is stepped on its own.  Rows of a micro-batch are sorted before
    the step.  Rows before the last position of an earlier batch are late: the
    step doesn't see them, and they come out as rows of their own if ``late``
    is asked for.  Rows at that very position are ties and are taken; rows
    without a position only move the watermark.  With an idle time the keys are
    closed by event-time timers: the step is told that the key has ended and
    its state is removed.
    """

    def __init__(self, order: str, step: Step, out: T.StructType, event_time: str | None, idle_ms: int | None, late: bool):
        self.order, self.step = order, step
        self.names = [f.name for f in out.fields] + (["late_position"] if late else [])
        self.event_time, self.idle_ms, self.late = event_time, idle_ms, late

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", T.StructType([T.StructField("states", T.StringType())]))

    def _held(self) -> dict[str, list]:
        """[state, position, last event time] of every key of the group."""
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _keep(self, held: dict[str, list]) -> None:
        if held:
            self.state.update((json.dumps(held),))
        else:
            self.state.clear()

    def _wait(self, held: dict[str, list]) -> None:
        """One timer, for the key that is idle first."""
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if held:
                self.handle.registerTimer(min(h[2] for h in held.values()) + self.idle_ms)

    def _latest(self, times: pd.Series) -> int | None:
        return None if self.idle_ms is None else int(times.max().timestamp() * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self._held()
        for k, at in initialState.groupby("fold_key").indices.items():
            row = initialState.iloc[at]
            held[k] = [json.loads(row["state"].iloc[0]), float(row["position"].iloc[0]), self._latest(row[self.event_time]) if self.idle_ms is not None else None]
        self._keep(held)
        self._wait(held)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf[pdf[self.order].notna()]
        if len(pdf) == 0:
            return
        codes, names = pd.factorize(pdf["fold_key"])
        places = pdf[self.order].to_numpy(np.float64) if pdf[self.order].dtype == object else pdf[self.order].to_numpy()
        along = np.lexsort((places, codes))
        pdf, codes, places = pdf.iloc[along], codes[along], places[along].astype(np.float64)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        held, given = self._held(), []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            name = names[codes[lo]]
            state, position, _ = held.get(name, (None, None, None))
            if position is not None:
                fresh = lo + int(np.searchsorted(places[lo:hi], position, side="left"))
                if self.late:
                    given += [(name, {"late_position": float(p)}) for p in places[lo:fresh]]
                lo = fresh
            for at in range(lo, hi, STEP_ROWS):
                state, emitted = self.step(state, pdf.iloc[at:min(at + STEP_ROWS, hi)], False)
                given += [(name, r) for r in emitted]
                if hi - lo > STEP_ROWS:
                    state = json.loads(json.dumps(state))
                if len(given) >= STEP_ROWS:
                    yield self._frame(given)
                    given = []
            if lo < hi:
                held[name] = [state, float(places[hi - 1]), self._latest(pdf[self.event_time].iloc[lo:hi]) if self.idle_ms is not None else None]
        self._keep(held)
        self._wait(held)
        if given:
            yield self._frame(given)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, given, now = self._held(), [], timerValues.getCurrentWatermarkInMs()
        for name in [k for k, h in held.items() if h[2] + self.idle_ms <= now]:
            empty = pd.DataFrame({c: pd.Series([], dtype=object) for c in self.columns_hint()})
            given += [(name, r) for r in self.step(held.pop(name)[0], empty, True)[1]]
        self._keep(held)
        if held:
            self.handle.registerTimer(min(h[2] for h in held.values()) + self.idle_ms)
        for at in range(0, len(given), STEP_ROWS):
            yield self._frame(given[at:at + STEP_ROWS])

    def columns_hint(self) -> list[str]:
        return list(getattr(self.step, "columns", ())) or [self.order]

    def _frame(self, given: list[tuple[str, dict]]) -> pd.DataFrame:
        return pd.DataFrame({"fold_key": [k for k, _ in given], **{n: pd.Series([r.get(n) for _, r in given], dtype=object) for n in self.names}})

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys: Sequence[str], order: str, step: Step, out: T.StructType | str, event_time: str | None = None,
                idle_ms: int | None = None, late: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """The rows ``step`` emits, as a stream in append mode.

    Needs the RocksDB state store.  ``idle_ms`` closes keys by event time and
    needs a watermark on ``event_time``.  ``late`` adds the column
    ``late_position``: rows that have it are late rows of their key, which went
    nowhere else.  ``initial`` holds the keys' ``state`` and ``position`` (and
    ``event_time``) from a batch fold over earlier rows (``plans.fold.fold_states``).
    Keys are whole numbers, strings or booleans.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if isinstance(out, str):
        out = T.StructType.fromDDL(out)
    key_schema = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys])
    if any(not isinstance(f.dataType, (T.IntegralType, T.StringType, T.BooleanType)) for f in key_schema):
        raise ValueError("keys of a stream are whole numbers, strings or booleans")
    full = T.StructType([T.StructField("fold_key", T.StringType()), *out.fields] + ([T.StructField("late_position", T.DoubleType())] if late else []))
    mode = "EventTime" if idle_ms is not None else "None"

    def grouped(df: DataFrame):  # Python gets rows as named tuples, whose names must not begin with an underscore
        return df.withColumns({"fold_key": F.to_json(F.struct(*keys)), "fold_group": F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))}).groupBy("fold_group")

    proc = FoldProcessor(order, step, out, event_time, idle_ms, late)
    got = grouped(stream).transformWithStateInPandas(proc, full, "Append", mode, None if initial is None else grouped(initial))
    return got.withColumn("fold_key", F.from_json("fold_key", key_schema)).select("fold_key.*", *full.fieldNames()[1:])
