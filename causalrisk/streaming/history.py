"""Entity history as keyed state, equal to the batch windows for rows that arrive in time order.

Rows without the key pass by the state with NULL history. NULL amounts count as
rows, but not towards mean and spread. A row older than one that its entity
already had is late: it counts as seen after the rows before it, its gap and
trailing count are NULL, and the newest time stays. State per entity is a few
numbers and the row counts of the seconds in the trailing horizon, so it does
not grow with the entity's rows; with `ttl_ms` it goes when the entity has been
silent for so long, and the entity starts anew. A task holds an entity's rows of
one micro-batch to put them in order; `files_per_batch` of the source limits it.

`event_history` follows event time instead. Rows wait in a buffer, in keyed
state, until the watermark (the newest time seen before the batch, less
`delay` seconds) has passed them; they are then released in the order of
time and id, so that rows which arrive in any order within the delay get the
history that a batch gives them. A row older than the watermark comes too late:
it goes to a side output, flagged and without history, and changes no state.
Rows of the last `delay` seconds wait for later ones. With `ttl` an entity whose
last released row is more than that many seconds older than the watermark is
forgotten, when its group is next called, and starts anew. Entities are dealt by
hash to a fixed number of groups, which share one state and one call of the
task, as a call of its own costs an entity far more than its rows. A task holds
a group's entities, their waiting rows and the rows of one micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from causalrisk.operators.entity import DAY, amount_ratio, history_names
from causalrisk.spec import EntityKey

STATE = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("known", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("dev", T.DoubleType()),
    T.StructField("last", T.LongType()),
    T.StructField("seconds", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
])


State = tuple[int, int, float, float, int | None, list[int], list[int]]
NEW: State = (0, 0, 0.0, 0.0, None, [], [])


def history_values(state: State, t: np.ndarray, a: np.ndarray, horizon: int) -> tuple[list[np.ndarray], State]:
    """The six values of an entity's rows in time order, and the state after them."""
    n, known, mean, dev, last, seconds, counts = state
    there = ~np.isnan(a)
    prior = n + np.arange(len(t))
    # Sums around the known mean, each without the current row.
    centre = mean if known else (a[there][0] if there.any() else 0.0)
    off = np.where(there, a - centre, 0.0)
    seen = known + np.concatenate([[0], np.cumsum(there)])
    sums = np.concatenate([[0.0], np.cumsum(off)])
    squares = dev + np.concatenate([[0.0], np.cumsum(off * off)])
    some = np.where(seen[:-1] > 0, seen[:-1], np.nan)
    mean_prior = centre + sums[:-1] / some
    std_prior = np.sqrt(np.maximum(squares[:-1] / some - (sums[:-1] / some) ** 2, 0.0))
    newest = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if last is None else last], t]))[:-1]
    late = t < newest
    previous = np.where(newest == np.iinfo(np.int64).min, np.nan, newest)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    seconds = np.asarray(seconds, dtype=np.int64)

    def rows_before(limit: np.ndarray) -> np.ndarray:
        return before[np.searchsorted(seconds, limit, "left")] + np.searchsorted(t, limit, "left")

    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = a / mean_prior
    gap = np.where(late, np.nan, t - previous)
    recent = np.where(late, np.nan, rows_before(t) - rows_before(t - horizon))

    shift = sums[-1] / seen[-1] if seen[-1] else 0.0
    latest = max(int(t[-1]), last if last is not None else int(t[-1]))
    merged, place = np.unique(np.concatenate([seconds, t]), return_inverse=True)
    sizes = np.zeros(len(merged), dtype=np.int64)
    np.add.at(sizes, place, np.concatenate([np.asarray(counts, dtype=np.int64), np.ones(len(t), dtype=np.int64)]))
    recently = merged >= latest - horizon
    return [prior, mean_prior, std_prior, ratio, gap, recent], (
        int(n + len(t)), int(seen[-1]), float(centre + shift), float(max(squares[-1] - seen[-1] * shift * shift, 0.0)), latest,
        merged[recently], sizes[recently],
    )


def _with_values(pdf: pd.DataFrame, names: list[str], values: list[np.ndarray]) -> pd.DataFrame:
    out = pdf.assign(**dict(zip(names, values)))
    for name in (names[0], names[4], names[5]):
        out[name] = out[name].astype("Int64")
    return out


def history_step(state: State, pdf: pd.DataFrame, names: list[str], time: str, amount: str, horizon: int) -> tuple[pd.DataFrame, State]:
    """Rows of one entity in time order with their history, and the state after them."""
    values, (*numbers, seconds, counts) = history_values(
        state, pdf[time].to_numpy(dtype=np.int64), pdf[amount].to_numpy(dtype=float), horizon)
    return _with_values(pdf, names, values), (*numbers, seconds.tolist(), counts.tolist())


class HistoryProcessor(StatefulProcessor):
    def __init__(self, key: EntityKey, time: str, amount: str, id: str, columns: list[str], horizon: int,
                 ttl_ms: int | None) -> None:
        self.names = history_names(key)
        self.time, self.amount, self.id = time, amount, id
        self.columns, self.horizon, self.ttl_ms = columns, horizon, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.time, self.id], kind="stable")
        before = self.state.get() if self.state.exists() else NEW
        out, after = history_step(before, pdf, self.names, self.time, self.amount, self.horizon)
        self.state.update(after)
        yield out[[*self.columns, *self.names]]

    def close(self) -> None:
        pass


def stream_history(stream: DataFrame, key: EntityKey, time: str, amount: str, id: str, horizon: int = DAY,
                   ttl_ms: int | None = None) -> DataFrame:
    """Add the six history columns of one key to a stream of rows.

    State is kept in RocksDB, so it may exceed executor memory.
    """
    spark = stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType()]
    schema = T.StructType([
        *stream.schema.fields, *[T.StructField(n, k) for n, k in zip(history_names(key), kinds)],
    ])
    processor = HistoryProcessor(key, time, amount, id, stream.columns, horizon, ttl_ms)
    absent = F.greatest(*[F.col(c).isNull() for c in (*key.columns, key.columns[0])])
    without = stream.where(absent).select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(history_names(key), kinds)])
    kept = (
        stream.where(~absent).groupBy(*key.columns)
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=schema, outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )
    return _with_ratio(kept, key, amount).unionByName(without)


def _with_ratio(rows: DataFrame, key: EntityKey, amount: str) -> DataFrame:
    """The ratio from the columns, as pandas can't tell NaN from NULL."""
    _, mean, _, ratio, _, _ = history_names(key)
    return rows.withColumn(ratio, amount_ratio(F.col(amount), F.col(mean)))


#: Seconds (158 years) by which event times are moved for the engine, so that it drops no row before the operator sees how late it is.
SHIFT = 5 * 10**9
LATE = "late"


#: Groups of entities, each with one state. A group's state is read and written as a whole, whatever the number of its entities.
GROUPS = 1024


def _pack(known: dict[tuple, State], waiting: pd.DataFrame | None) -> bytes:
    """The states of a group's entities and its waiting rows, as plain numbers and numpy arrays."""
    states = [*known.values()]
    counted = [np.concatenate([s[i] for s in states]) if states else np.zeros(0, np.int64) for i in (5, 6)]
    rows = None if waiting is None else {c: waiting[c].to_numpy() for c in waiting.columns}
    return pickle.dumps(([*known], [s[:5] for s in states], [len(s[5]) for s in states], counted, rows), 5)


def _unpack(packed: bytes) -> tuple[dict[tuple, State], pd.DataFrame | None]:
    keys, numbers, sizes, (seconds, counts), rows = pickle.loads(packed)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    known = {
        key: (*first, seconds[end - size : end], counts[end - size : end])
        for key, first, size, end in zip(keys, numbers, sizes, ends, strict=True)
    }
    return known, None if rows is None else pd.DataFrame(rows)


class EventTimeHistory:
    """What a group of entities does with a micro-batch: late rows go out, rows that the watermark has passed get their history, the others wait."""

    def __init__(self, key: EntityKey, time: str, amount: str, id: str, columns: list[str], horizon: int, ttl: int | None) -> None:
        self.names, self.key = history_names(key), list(key.columns)
        self.time, self.amount, self.id = time, amount, id
        self.columns, self.horizon, self.ttl = columns, horizon, ttl

    def __call__(self, group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known, waiting = _unpack(bytes(state.get[0])) if state.exists else ({}, None)
        parts = [] if waiting is None else [waiting]
        for pdf in batches:
            pdf = pdf[self.columns]
            late = pdf[self.time].to_numpy(dtype=np.int64) * 1000 < watermark
            if late.any():
                yield self._columns(pdf[late].assign(**{n: None for n in self.names}), True)
            if not late.all():
                parts.append(pdf[~late])
        rest = None
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            ready = rows[self.time].to_numpy(dtype=np.int64) * 1000 < watermark
            if ready.any():
                yield self._columns(self._release(rows[ready], known), False)
            rest = None if ready.all() else rows[~ready]
        self._keep(known, rest, watermark, state)

    def _columns(self, out: pd.DataFrame, late: bool) -> pd.DataFrame:
        return out.assign(**{LATE: late})[[*self.columns, *self.names, LATE]]

    def _entities(self, rows: pd.DataFrame) -> list[tuple]:
        """The key of every row, with None for NaN, which equals nothing."""
        columns = [[None if v != v else v for v in rows[c].tolist()] for c in self.key]
        return [*zip(*columns, strict=True)]

    def _release(self, rows: pd.DataFrame, known: dict[tuple, State]) -> pd.DataFrame:
        """Rows with their history, which goes on from and is added to what is known."""
        rows = rows.sort_values([self.time, self.id], kind="stable")
        codes, keys = pd.factorize(pd.Series(self._entities(rows), dtype=object))
        rows = rows.iloc[np.argsort(codes, kind="stable")]
        t, a = rows[self.time].to_numpy(dtype=np.int64), rows[self.amount].to_numpy(dtype=float)
        found, end = [], 0
        for key, size in zip(keys, np.bincount(codes, minlength=len(keys)).tolist(), strict=True):
            at, end = end, end + size
            state, cut = known.get(key, NEW), [at, end]
            if self.ttl is not None:
                # A gap of more than `ttl` starts the entity anew.
                gap = np.diff(t[at:end], prepend=t[at] if state[4] is None else state[4])
                cut = [at, *(at + np.flatnonzero(gap > self.ttl)).tolist(), end]
            for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
                if i:
                    state = NEW
                if hi > lo:
                    values, state = history_values(state, t[lo:hi], a[lo:hi], self.horizon)
                    found.append(values)
            known[key] = state
        return _with_values(rows, self.names, [np.concatenate(v) for v in zip(*found, strict=True)])

    def _keep(self, known: dict[tuple, State], rest: pd.DataFrame | None, watermark: int, state: GroupState) -> None:
        """Store the group, to be called again for its first waiting row or to forget its longest silent entity."""
        calls = [] if rest is None else [int(rest[self.time].min()) * 1000 + 1]
        if self.ttl is not None:
            held = set() if rest is None else set(self._entities(rest))
            for key, s in [*known.items()]:
                end = (s[4] + self.ttl) * 1000
                if end < watermark and key not in held:
                    del known[key]
                elif end >= watermark:
                    calls.append(end + 1)
        if known or rest is not None:
            state.update((_pack(known, rest),))
            if calls:
                state.setTimeoutTimestamp(min(calls))
        elif state.exists:
            state.remove()


def event_history(stream: DataFrame, key: EntityKey, time: str, amount: str, id: str, delay: int, horizon: int = DAY,
                  ttl: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Add the six history columns of one key by event time, and `late`; `time` and `delay` are in whole seconds.

    Rows without key or time pass by with NULL history, as no others come before them.
    `groups` must stay the same as long as a checkpoint is used.
    """
    spark = stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType()]
    added = [T.StructField(n, k) for n, k in zip(history_names(key), kinds)]
    schema = T.StructType([*stream.schema.fields, *added, T.StructField(LATE, T.BooleanType())])
    history = EventTimeHistory(key, time, amount, id, stream.columns, horizon, ttl)
    absent = F.greatest(*[F.col(c).isNull() for c in (*key.columns, time)])
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in added]
    without = stream.where(absent).select("*", *nothing, F.lit(False).alias(LATE))
    timed = stream.where(~absent).withColumns({
        "_event_time": F.timestamp_seconds(F.col(time) + SHIFT),
        "_group": F.pmod(F.xxhash64(*key.columns), F.lit(groups)),
    })
    kept = (
        timed.withWatermark("_event_time", f"{delay + SHIFT} seconds").groupBy("_group")
        .applyInPandasWithState(history, schema, "packed binary", "append", "EventTimeTimeout")
    )
    return _with_ratio(kept, key, amount).unionByName(without)
