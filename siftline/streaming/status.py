"""Current status of a key from append-only facts, in keyed state (ST4).

A correction is a new fact that names the id of the fact it supersedes. It may arrive before that
fact, and a fact may arrive after later ones. The current fact of a key is the latest one, by event
time and id, that no fact of the key supersedes. State of a key: the current fact, the earlier facts
that would follow if it is superseded, and the superseded ids. Facts and ids older than ``horizon``
behind the watermark go by timer, and the whole key when its current fact is older than ``ttl``; so
state is bounded by the live keys and by the facts within the horizon.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: State stores that hold maps and timers; the session that runs the stream needs this setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CurrentFact(StatefulProcessor):
    """One row out per key and batch whose current fact has changed; ids are null where none is left."""

    def __init__(self, keys: Sequence[str], id_type: str, horizon_us: int, ttl_us: int):
        self.keys, self.id_type, self.horizon, self.ttl = list(keys), id_type, horizon_us, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", f"at bigint, id {self.id_type}, fact string")
        self.earlier = handle.getMapState("earlier", f"id {self.id_type}", "at bigint, fact string")
        self.superseded = handle.getMapState("superseded", f"id {self.id_type}", "at bigint")

    def _load(self) -> tuple[tuple | None, dict, dict]:
        now = tuple(self.current.get()) if self.current.exists() else None
        earlier = {k[0]: tuple(v) for k, v in self.earlier.iterator()} if self.earlier.exists() else {}
        gone = {k[0]: v[0] for k, v in self.superseded.iterator()} if self.superseded.exists() else {}
        return now, earlier, gone

    def _save(self, state, old) -> None:
        """Writes only what has changed, and one timer for the next thing to expire."""
        (now, earlier, gone), (was, earlier_was, gone_was) = state, old
        if now is None:
            self.current.clear()
        elif now != was:
            self.current.update(now)
        for held, new, before in ((self.earlier, earlier, earlier_was), (self.superseded, gone, gone_was)):
            for k in before.keys() - new.keys():
                held.removeKey((k,))
            for k in new.keys():
                if before.get(k) != new[k]:
                    held.updateValue((k,), new[k] if isinstance(new[k], tuple) else (new[k],))
        due = [at + self.horizon for at, _ in earlier.values()] + [at + self.horizon for at in gone.values()]
        due += [now[0] + self.ttl] if now else []
        wanted = min(due) // 1000 + 1 if due else None
        known = [t for t in self.handle.listTimers()]
        for t in known:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in known:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self._load()
        was, earlier, gone = old[0], dict(old[1]), dict(old[2])
        live = {**earlier, **({was[1]: (was[0], was[2])} if was else {})}
        for frame in rows:
            for at, own, supersedes, fact in zip(*[frame.iloc[:, c].tolist() for c in range(-4, 0)]):  # names don't survive there
                if isinstance(supersedes, str):  # a text, since whole numbers beside nulls would come as doubles
                    supersedes = type(own)(supersedes)
                    gone[supersedes] = max(at, gone.get(supersedes, at))
                    live.pop(supersedes, None)
                if own not in gone:
                    live[own] = (at, fact)
        now = None
        if live:
            own = max(live, key=lambda i: (live[i][0], i))
            now = (live[own][0], own, live[own][1])
            live.pop(own)
        self._save((now, live, gone), old)
        if now != was:
            at, own, fact = now or (None, None, None)
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "_id": [own], "_at": pd.array([at], "Int64"), "_fact": [fact]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, mark = self._load(), timerValues.getCurrentWatermarkInMs() * 1000
        earlier = {i: v for i, v in old[1].items() if v[0] + self.horizon >= mark}
        gone = {i: at for i, at in old[2].items() if at + self.horizon >= mark}
        now = old[0] if old[0] and old[0][0] + self.ttl >= mark else None
        self._save((now, earlier, gone) if now else (None, {}, {}), old)
        return iter(())

    def close(self) -> None:
        pass


def stream_current(src: DataFrame, keys: Sequence[str], id_col: str, supersedes: str, time: str, cols: Sequence[str], delay: str, horizon_seconds: int, ttl_seconds: int) -> DataFrame:
    """Changes of the current fact per key: ``keys``, the id, the time and ``cols``; run in update mode.

    Ids are numbers or texts, unique per fact, and a correction has the key of its fact. A fact that is
    sent twice counts once. Rows without id or time are left out. A key whose facts are all superseded
    has a row with a null id. The facts of one key in one batch are read by one task, in chunks.
    """
    kinds = {f.name: f.dataType for f in src.schema}
    id_type = kinds[id_col].simpleString()
    timed = src.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull() & F.col(id_col).isNotNull()).withWatermark(time, delay)
    asked = timed.select(
        *keys, time, F.unix_micros(F.col(time)).alias("_at"), F.col(id_col).alias("_id"), F.col(supersedes).cast("string").alias("_supersedes"), F.to_json(F.struct(*cols)).alias("_fact"),
    )
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("_id", kinds[id_col]), T.StructField("_at", T.LongType()), T.StructField("_fact", T.StringType())])
    processor = CurrentFact(keys, id_type, horizon_seconds * 1_000_000, ttl_seconds * 1_000_000)
    changes = asked.groupBy(*keys).transformWithStateInPandas(processor, out, "Update", "EventTime")
    fact = F.from_json("_fact", T.StructType([T.StructField(c, kinds[c]) for c in cols]))
    return changes.select(*keys, F.col("_id").alias(id_col), F.timestamp_micros("_at").alias(time), *[fact[c].alias(c) for c in cols])
