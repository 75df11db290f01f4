"""State machines over ordered rows, cut into blocks.

``ordered_fold`` runs a step function over the rows of each key in ``seq``
order.  Keys longer than one block are cut; all blocks run at once from an
assumed entry state, and blocks whose real entry state (the exit state of the
block before) turns out different are run again until nothing changes.  The
result is exactly the sequential one: the first block is right after round one,
so round n fixes at least block n, and machines that forget their past settle
after two or three rounds.  No task holds more than one block.  What a round
gives is written once; a block's rows are those of its last run.

A machine whose open state may last for many blocks would need a round for each.
Such a step is a ``Machine``: it also says what a block does to every entry state
at once (``survey``: a small block map from the finite part of the state, with
carried values left symbolic) and what a map makes of a real state (``advance``).
All maps are made in one job, a second one chains the maps of each key, a third
one runs every block from its real entry state, whatever the number of blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestory.session import cut_lineage

FOLD_BLOCK_ROWS = 50_000

Step = Callable[[Any, pd.DataFrame, bool], tuple[Any, list[dict]]]


class Machine:
    """A step with block maps: ``survey(rows)`` and ``advance(state, map)`` are JSON in and out; ``advance`` takes None at the start of a key."""

    def __init__(self, step: Step, survey: Callable[[pd.DataFrame], Any], advance: Callable[[Any, Any], Any], columns: Sequence[str] = ()):
        self.step, self.survey, self.advance, self.columns = step, survey, advance, tuple(columns)

    def __call__(self, state: Any, rows: pd.DataFrame, last: bool) -> tuple[Any, list[dict]]:
        return self.step(state, rows, last)


def passed_tokens(rows: list[tuple], tokens: dict[tuple, list], move: Callable[[tuple, tuple], list[tuple[tuple, Any]]]) -> list[tuple[Any, tuple]]:
    """``(label, exit state)`` of every entry label after all rows; states that meet go on as one.

    ``move(state, row)`` gives the next states: ``(state, None)`` passes the
    labels on, ``(state, label)`` is a branch that opens a label of its own.
    """
    for row in rows:
        following: dict[tuple, list] = {}
        for state, labels in tokens.items():
            for nxt, branch in move(state, row):
                held = following.setdefault(nxt, [])
                if branch is None:
                    held.extend(labels)
                else:
                    held.append(branch)
        tokens = following
    return [(label, state) for state, labels in tokens.items() for label in labels]


def ordered_fold(df: DataFrame, keys: Sequence[str], step: Step, out: T.StructType, seq: str = "seq",
                 block: int = FOLD_BLOCK_ROWS, close: bool = True) -> DataFrame:
    """Rows emitted by ``step(state, rows, last) -> (state, emitted)`` per key.

    ``state`` is None at the start of a key and JSON-serialisable afterwards;
    ``last`` is true for the final block of a key, unless ``close`` is false
    because more rows will follow (see ``fold_states``).
    """
    keys, bkeys = list(keys), [*keys, "_blk"]
    names = [f.name for f in out.fields]
    key_fields = [df.schema[k] for k in keys]
    raw = T.StructType([*key_fields, T.StructField("_blk", T.LongType()), *out.fields, T.StructField("_exit", T.StringType())])
    d = df.withColumn("_blk", F.floor(F.col(seq) / block).cast("long"))
    ends = d.groupBy(*keys).agg(F.max("_blk").alias("_end"))
    d = cut_lineage(d.join(ends, keys).withColumn("_last", F.col("_blk") == F.col("_end")).drop("_end"))

    def stepped(key, rows, text):
        state = json.loads(text) if isinstance(text, str) else None
        state, emitted = step(state, rows, close and bool(rows["_last"].iloc[0]))
        return key, emitted, json.dumps(state)

    def ran(key, rows, text):
        return _frame([stepped(key, rows.sort_values(seq, kind="stable"), text)] if len(rows) else [], bkeys, names)

    def again(key, rows, entry):
        return ran(key, rows, entry["_entry"].iloc[0] if len(entry) else None) if len(entry) else ran(key, rows[:0], None)

    if isinstance(step, Machine):
        return _mapped(d, keys, step, seq, ran, stepped, raw).select(*keys, *names)
    along = Window.partitionBy(*keys).orderBy("_blk")
    runs = [cut_lineage(_opened(d, bkeys, seq, stepped, raw))]
    exits = runs[0].where(F.col("_exit").isNotNull()).select(*bkeys, "_exit", F.lit(None).cast("string").alias("_entry"), F.lit(0).alias("_run"))
    while True:
        real = exits.withColumn("_real", F.lag("_exit").over(along))
        changed = real.where(~F.col("_real").eqNullSafe(F.col("_entry"))).select(*bkeys, F.col("_real").alias("_entry"))
        changed = cut_lineage(changed)
        if changed.isEmpty():
            break
        mine = changed.select(*[F.col(c).alias(c) for c in changed.columns])  # column ids of its own for the cogroup
        todo = d.join(changed.select(*bkeys), bkeys, "left_semi")
        runs.append(cut_lineage(_spread(todo, bkeys).groupBy(*bkeys).cogroup(_spread(mine, bkeys).groupBy(*bkeys)).applyInPandas(again, raw)))
        new = runs[-1].where(F.col("_exit").isNotNull()).select(*bkeys, "_exit").join(changed, bkeys).withColumn("_run", F.lit(len(runs) - 1))
        exits = cut_lineage(exits.join(changed.select(*bkeys), bkeys, "left_anti").select(exits.columns).unionByName(new.select(exits.columns)))
    if len(runs) == 1:
        return runs[0].where(F.col("_exit").isNull()).select(*keys, *names)
    final = exits.select(*bkeys, "_run")
    kept = [r.where(F.col("_exit").isNull()).join(final.where(F.col("_run") == n).select(*bkeys), bkeys, "left_semi").select(*keys, *names)
            for n, r in enumerate(runs)]
    out_rows = kept[0]
    for k in kept[1:]:
        out_rows = out_rows.unionByName(k)
    return out_rows


def _opened(d: DataFrame, bkeys: list[str], seq: str, stepped: Callable, raw: T.StructType) -> DataFrame:
    """Rows and exit of every block, run from the start of a key.

    Short keys have a block each, and a call of Python for every block costs more
    than its rows; so a call takes a batch of sorted rows, and the part of the
    last block that has come waits for the rest.
    """
    names = [f.name for f in raw.fields if f.name not in (*bkeys, "_exit")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, last = [], None

        def block(parts):
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            return stepped(tuple(rows[k].iloc[0] for k in bkeys), rows, None)

        for pdf in frames:
            if not len(pdf):
                continue
            changed = np.zeros(len(pdf) - 1, bool)
            for k in bkeys:
                v = pdf[k].to_numpy()
                changed |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(pdf)]
            done = []
            for lo, hi in zip(cuts, cuts[1:]):
                part = pdf.iloc[lo:hi]
                key = [part[k].iloc[0] for k in bkeys]
                if waiting and key != last:
                    done.append(block(waiting))
                    waiting = []
                waiting.append(part)
                last = key
            yield _frame(done, bkeys, names)
        if waiting:
            yield _frame([block(waiting)], bkeys, names)

    return _spread(d, bkeys).sortWithinPartitions(*bkeys, seq).mapInPandas(run, raw)


def _mapped(d: DataFrame, keys: list[str], machine: Machine, seq: str, ran: Callable, stepped: Callable, raw: T.StructType) -> DataFrame:
    """Rows of all blocks, each run once from its real entry state."""
    bkeys = [*keys, "_blk"]

    def entered(key, rows, entry):
        return ran(key, rows, entry["_entry"].iloc[0] if len(entry) else None)

    inner = d.where("NOT _last")
    if inner.isEmpty():
        rows = _opened(d, bkeys, seq, stepped, raw)
    else:
        entries = cut_lineage(_chained(inner, keys, machine, seq).withColumn("_blk", F.col("_blk") + 1))
        later = _spread(d.where("_blk > 0"), bkeys).groupBy(*bkeys).cogroup(_spread(entries, bkeys).groupBy(*bkeys)).applyInPandas(entered, raw)
        rows = _opened(d.where("_blk <= 0"), bkeys, seq, stepped, raw).unionByName(later)
    return rows.where(F.col("_exit").isNull())


def _chained(d: DataFrame, keys: list[str], machine: Machine, seq: str) -> DataFrame:
    """``_entry``, the state after each block: all blocks' maps at once, then the maps of a key one after the other."""
    bkeys = [*keys, "_blk"]
    kept = [T.StructField(k, d.schema[k].dataType) for k in bkeys]

    def mapped(key, rows):
        return pd.DataFrame({**{k: [v] for k, v in zip(bkeys, key)}, "_map": [json.dumps(machine.survey(rows.sort_values(seq, kind="stable")))]})

    def chained(key, maps):
        maps = maps.sort_values("_blk")
        state, states = None, []
        for text in maps["_map"]:
            state = machine.advance(state, json.loads(text))
            states.append(json.dumps(state))
        return pd.DataFrame({**{k: [v] * len(maps) for k, v in zip(keys, key)}, "_blk": maps["_blk"].to_numpy(), "_entry": states})

    maps = _spread(d, bkeys).groupBy(*bkeys).applyInPandas(mapped, T.StructType([*kept, T.StructField("_map", T.StringType())]))
    return maps.groupBy(*keys).applyInPandas(chained, T.StructType([*kept, T.StructField("_entry", T.StringType())]))


def fold_states(df: DataFrame, keys: Sequence[str], machine: Machine, seq: str = "seq", event_time: str | None = None,
                block: int = FOLD_BLOCK_ROWS) -> DataFrame:
    """The state of every key after its last row: ``state`` (JSON), ``position`` (its last ``seq``) and, if asked for, its last ``event_time``.

    A stream that goes on with later rows takes it as its initial state.
    """
    keys = list(keys)
    d = df.withColumn("_blk", F.floor(F.col(seq) / block).cast("long"))
    states = _chained(d, keys, machine, seq).groupBy(*keys).agg(F.max_by("_entry", "_blk").alias("state"))
    times = [F.max(event_time).alias(event_time)] if event_time else []
    return states.join(df.groupBy(*keys).agg(F.max(seq).cast("double").alias("position"), *times), keys)


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitions by key that AQE leaves alone: Python work is heavy for its bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _frame(done: list[tuple], keys: list[str], names: list[str]) -> pd.DataFrame:
    """What blocks ``(key, emitted, exit)`` give: their rows, and one with the exit."""
    rows = [(key, r, None) for key, emitted, _ in done for r in emitted] + [(key, {}, exit_) for key, _, exit_ in done]
    data = {k: [key[i] for key, _, _ in rows] for i, k in enumerate(keys)} if rows else {k: pd.Series([], dtype=object) for k in keys}
    for n in names:
        data[n] = pd.Series([r.get(n) for _, r, _ in rows], dtype=object)
    data["_exit"] = pd.Series([e for _, _, e in rows], dtype=object)
    return pd.DataFrame(data, columns=[*keys, *names, "_exit"])
