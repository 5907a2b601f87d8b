"""The fold of a stream of planned events (K12) on keyed state, table by table.

State of a table is a map of its settled columns, written only where a column changes, and the events that came lately, packed in chunks. What is known at
any time is the settled columns with the late events replayed on them in id order, so an id that comes late, within the delay, falls into its place. A timer settles events
that are older than the delay: they are folded into the columns, in id order, and leave the chunks. Repeats of an id that waits are dropped; of a
settled one, if it is older than the last, comes out as a row of ordinal -1, after which the caller rebuilds that table with
`triplake.operators.fold.fold`; repeats of any age are best dropped before, as `changes.marked_repeats` does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from triplake.operators.evolve import FOLDED, fold_column

_EVENT = ["id", "alter_type", "column_name", "column_type", "old_column", "new_column"]
_COLUMN = "physical string, logical string, type string, active boolean, added long"
_WAITING = "arrived long, events binary"
#: Events of a chunk, which state holds in one value: an event costs no call to the store.
CHUNK = 1 << 14
#: The state store that keyed state needs; and no micro-batches without data, which timers would ask for without end where all that waits is read once.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Packed:
    """Events as columns: numbers, and places in a list of the texts that occur, so that a log with few names takes some bytes an event."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, names: list[str | None]):
        self.ids, self.codes, self.names = ids, codes, names

    @staticmethod
    def of(pdf: pd.DataFrame) -> Packed:
        """A batch's rows, in their order."""
        codes, names = [], []
        for c in _EVENT[1:]:
            code, found = pd.factorize(pdf[c], use_na_sentinel=True)
            codes.append(np.where(code < 0, -1, code + len(names)))
            names += found.tolist()
        return Packed(pdf["id"].to_numpy(np.int64), np.array(codes, np.int32).reshape(len(codes), -1), names)

    @staticmethod
    def read(data: bytes) -> Packed:
        n, size = np.frombuffer(data, np.int64, 2).tolist()
        ids = np.frombuffer(data, np.int64, n, 16)
        codes = np.frombuffer(data, np.int32, n * len(_EVENT[1:]), 16 + 8 * n).reshape(-1, n)
        return Packed(ids, codes, json.loads(data[len(data) - size :]))

    def write(self) -> bytes:
        names = json.dumps(self.names).encode()
        return np.array([len(self.ids), len(names)], np.int64).tobytes() + self.ids.tobytes() + np.ascontiguousarray(self.codes).tobytes() + names

    def at(self, which: np.ndarray) -> Packed:
        used, codes = np.unique(self.codes[:, which], return_inverse=True)
        names = [self.names[i] for i in used[used >= 0]]
        return Packed(self.ids[which], (codes.reshape(len(self.codes), len(which)) - int(len(used) > len(names))).astype(np.int32), names)

    @staticmethod
    def joined(parts: list[Packed]) -> Packed:
        if not parts:
            return Packed(np.zeros(0, np.int64), np.zeros((len(_EVENT) - 1, 0), np.int32), [])
        place: dict[str, int] = {}
        codes = []
        for p in parts:
            own = np.array([*(place.setdefault(n, len(place)) for n in p.names), -1], np.int32)
            codes.append(own[p.codes])
        return Packed(np.concatenate([p.ids for p in parts]), np.concatenate(codes, axis=1), list(place))

    def in_order(self) -> Iterator[tuple]:
        """Events by id, a slice of them as Python objects at a time."""
        order, names = np.argsort(self.ids, kind="stable"), np.array([*self.names, None], object)
        for a in range(0, len(order), CHUNK):
            here = order[a : a + CHUNK]
            yield from zip(self.ids[here].tolist(), *(names[c].tolist() for c in self.codes[:, here]), strict=True)


class TableFold(StatefulProcessor):
    """One table's columns; events settle after `delay` milliseconds."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = handle.getMapState("columns", "place int", _COLUMN)
        self.waiting = handle.getMapState("waiting", "chunk long", _WAITING)
        self.settled = handle.getValueState("settled", "last_id long, n long")

    def _known(self) -> tuple[list[list], int, int]:
        columns = sorted(((k[0], list(v)) for k, v in self.columns.iterator()), key=lambda c: c[0])
        last, n = (int(x) for x in self.settled.get()) if self.settled.exists() else (-1, 0)
        return [c for _, c in columns], last, n

    def _chunks(self) -> dict[int, tuple[int, Packed]]:
        """What waits, by the chunk's number: when it came, and its events."""
        found = {}
        for number in sorted(int(k[0]) for k in self.waiting.keys()):
            arrived, data = self.waiting.getValue((number,))
            found[number] = (int(arrived), Packed.read(bytes(data)))
        return found

    def _replayed(self, columns: list[list], events: Packed) -> list[list]:
        live = {c[0]: i for i, c in enumerate(columns) if c[3]}
        for e in events.in_order():
            fold_column(columns, live, e)
        return columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns, last, n = self._known()
        now, late, fresh = timerValues.getCurrentProcessingTimeInMs(), [], []
        for pdf in rows:
            old = pdf["id"].to_numpy(np.int64) <= last
            late += pdf["id"][old].astype(int).tolist()
            fresh.append(Packed.of(pdf[~old]))
        chunks = self._chunks()
        there, came = Packed.joined([events for _, events in chunks.values()]), Packed.joined(fresh)
        _, first = np.unique(came.ids, return_index=True)
        first = np.sort(first)
        came = came.at(first[~np.isin(came.ids[first], there.ids)])  # the first of repeats counts
        number = max(chunks, default=-1) + 1
        for i, a in enumerate(range(0, len(came.ids), CHUNK)):
            self.waiting.updateValue((number + i,), (now, came.at(np.arange(a, min(a + CHUNK, len(came.ids)))).write()))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.delay)
        waiting = Packed.joined([there, came])
        yield self._told(key[0], self._replayed(columns, waiting), max([last, *waiting.ids.max(keepdims=True, initial=last).tolist()]), n + len(waiting.ids), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        columns, last, n = self._known()
        before = [list(c) for c in columns]
        now = timerValues.getCurrentProcessingTimeInMs()
        chunks = self._chunks()
        old = [k for k, (arrived, _) in chunks.items() if arrived + self.delay <= now]
        if old:
            upto = max(int(chunks[k][1].ids.max()) for k in old)  # what comes before in order settles with it
            done = Packed.joined([events.at(np.flatnonzero(events.ids <= upto)) for _, events in chunks.values()])
            for i, c in enumerate(self._replayed(columns, done)):
                if i >= len(before) or before[i] != c:
                    self.columns.updateValue((i,), tuple(c))
            for k, (arrived, events) in chunks.items():
                left = np.flatnonzero(events.ids > upto)
                if not len(left):
                    self.waiting.removeKey((k,))
                elif len(left) < len(events.ids):
                    self.waiting.updateValue((k,), (arrived, events.at(left).write()))
            self.settled.update((upto, n + len(done.ids)))
        if len(chunks) > len(old):
            self.handle.registerTimer(now + self.delay)
        yield self._told(key[0], [], last, n, [])

    def _told(self, table: str, columns: list[list], last: int, n: int, late: list[int]) -> pd.DataFrame:
        told = [[table, i, c[0], c[1], c[2], bool(c[3]), last, n] for i, c in enumerate(columns, 1)] + [[table, -1, None, None, None, False, x, n] for x in late]
        return pd.DataFrame(told, columns=[c.split()[0] for c in FOLDED.split(", ")])

    def close(self) -> None:
        pass


def fold_keyed(events: DataFrame, delay: int = 600_000) -> DataFrame:
    """Planned events of a stream to their tables' columns, a table's whole list each time it changes; the row with the largest n_applied is the latest.

    The stream must start with the session's SETTINGS.
    """
    ready = events.where("table_name is not null and id is not null").select("table_name", F.col("id").cast("long").alias("id"), *_EVENT[1:])
    return ready.groupBy("table_name").transformWithStateInPandas(TableFold(delay), FOLDED, "append", "processingtime")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """The session with SETTINGS while a stream runs, and as it was after."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(rows: DataFrame) -> DataFrame:
    """The last list of each table among all that fold_keyed gave; lists are few and short."""
    last = rows.where("ordinal > 0").groupBy("table_name").agg(F.max("n_applied").alias("n_applied"))
    return rows.where("ordinal > 0").join(last, ["table_name", "n_applied"], "left_semi").distinct()
