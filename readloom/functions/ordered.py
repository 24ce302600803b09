"""Ordered work over rows dealt by ranges, so that no key must fit one task.

Rows are sorted by (key, order) over all partitions; a part is what one partition holds. What
depends on the rows before (a place, a running state) is summed up for each part, and only the
few keys that reach over a border need what the parts before have found.
"""

import pickle
from collections.abc import Iterator
from functools import partial
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.tables import stored


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column key) stored in the order of key, `order`, with part and at; at
    ascends in that order. Rows that tie are in some fixed order."""
    by = ["key", *order, "tie"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    laid = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    return stored(laid.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))


def parts(rows: DataFrame, **more: Any) -> DataFrame:
    """(key, part, rows, ...) of dealt rows: some rows for each partition, plus one for each
    key that lies within one."""
    return rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in more.items()])


def numbered(rows: DataFrame) -> DataFrame:
    """Dealt rows with place, from 0 in the order of their key."""
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts(rows, first=F.min("at")).select("key", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shift, ["key", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("shift")


class Machine(Protocol):
    """Cuts a key's rows into groups, by a state that each row moves on.

    run gives, for consecutive rows, whether each begins a group, and the state after them
    (None before a key's first row). summary of a part's rows, of a size that does not grow
    with them, must let `after` tell how any state comes out of them, and how many groups
    begin: a summary composes where a state cannot be known yet."""

    columns: list[str]

    def run(self, state: Any, *columns: np.ndarray) -> tuple[np.ndarray, Any]: ...

    def summary(self, *columns: np.ndarray) -> Any: ...

    def after(self, state: Any, summary: Any) -> tuple[Any, int]: ...


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((key, part), from, to) of a batch's consecutive rows."""
    keys, part = batch.column("key").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])])) if len(part) else []
    for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
        yield (keys[a], int(part[a])), int(a), int(b)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _summed_up(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def told() -> pa.RecordBatch:
        found = pickle.dumps(machine.summary(*[np.concatenate(c) for c in zip(*held, strict=True)]))
        return pa.record_batch([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([found], pa.binary())], ["key", "part", "summary"])

    for batch in batches:
        columns = _numbers(batch, machine.columns)
        for which, a, b in _runs(batch):
            if which != now:
                if held:
                    yield told()
                now, held = which, []
            held.append([c[a:b] for c in columns])
    if held:
        yield told()


def _composed(part: pd.DataFrame, machine: Machine) -> pd.DataFrame:
    """The state and the groups begun before each part of one key but its first."""
    part = part.sort_values("part")
    out, state, begun = [], None, 0
    for number, summary in zip(part["part"], part["summary"], strict=True):
        if state is not None:
            out.append((part["key"].iloc[0], number, pickle.dumps(state), begun))
        state, more = machine.after(state, pickle.loads(summary))
        begun += more
    return pd.DataFrame(out, columns=["key", "part", "state", "begun"])


def _run(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    now, state, group = None, None, -1
    for batch in batches:
        columns, groups = _numbers(batch, machine.columns), np.zeros(batch.num_rows, np.int64)
        for which, a, b in _runs(batch):
            if which != now:
                given = batch.column("state")[a].as_py()
                now, state = which, None if given is None else pickle.loads(given)
                group = -1 if given is None else batch.column("begun")[a].as_py() - 1
            begins, state = machine.run(state, *[c[a:b] for c in columns])
            groups[a:b] = group + np.cumsum(begins)
            group = int(groups[b - 1])
        kept = batch.drop_columns(["state", "begun"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(groups)], names=[*kept.schema.names, "group"])


def grouped(rows: DataFrame, machine: Machine, then: list[str] | None = None) -> DataFrame:
    """Dealt rows with group, from 0 in each key, as the machine cuts them in the order of
    at (then `then`). Parts pass side by side: only keys of several parts are summed up, of
    which each part holds two at most, so the broadcast tables have two rows a part."""
    order = ["key", "part", "at", *(then or [])]
    spread = Window.partitionBy("key")
    wide = F.broadcast(parts(rows).withColumn("of", F.count(F.lit(1)).over(spread)).where("of > 1").select("key", "part"))
    lined = lambda df: df.repartition("key", "part").sortWithinPartitions(*order)
    summaries = lined(rows.select(*order, *machine.columns).join(wide, ["key", "part"], "left_semi")).mapInArrow(partial(_summed_up, machine=machine), "key string, part long, summary binary")
    states = stored(summaries.groupBy("key").applyInPandas(lambda part: _composed(part, machine), "key string, part long, state binary, begun long"))
    kind = T.StructType([*rows.schema.fields, T.StructField("group", T.LongType())])
    given = rows.join(F.broadcast(states), ["key", "part"], "left").select(*rows.columns, "state", "begun")
    return lined(given).mapInArrow(partial(_run, machine=machine), kind)
