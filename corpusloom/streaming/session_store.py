"""A keyed store of sessions with a sliding expiry, as a stream and as a replay of the same operations over a table.

A save holds a payload for a time to live, which each further save begins anew; a load gives what is held, a delete drops it.
Times are those of the operations, so a stream and a replay agree whatever the batches are: the stream keeps a key's
operations until the watermark has passed them and then takes them in order, by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.conversations import carried_before

TTL_SECONDS = 24 * 3600
_FIELDS = ["conversation_id", "created_at", "last_active", "messages", "turn_count"]
_STATE = "conversation_id string, created_at string, last_active string, messages array<map<string, string>>, turn_count int"
#: State of the stream per key: operations that wait for the watermark, and what is held.
_WAITING, _HELD = "us long, seq long, op string, payload string", "deadline long, payload string"
_OUT = "key string, seq long, ts timestamp, held string"


def valid_state(payload: Column) -> Column:
    """Whether a stored payload is a session: a JSON object of these fields and no others, with an id and two times; messages and
    the number of turns may be missing; no message is the system's."""
    parsed, keys = F.from_json(payload, _STATE), F.json_object_keys(payload)
    has = lambda field: F.array_contains(keys, field)
    timed = F.try_to_timestamp(parsed["created_at"]).isNotNull() & F.try_to_timestamp(parsed["last_active"]).isNotNull()
    messages = ~has("messages") | (parsed["messages"].isNotNull() & ~F.exists(parsed["messages"], lambda m: F.coalesce(m["role"] == "system", F.lit(False))))
    turns = ~has("turn_count") | parsed["turn_count"].isNotNull()
    only = F.size(F.array_except(keys, F.array(*map(F.lit, _FIELDS)))) == 0
    return F.coalesce(keys.isNotNull() & only & parsed["conversation_id"].isNotNull() & timed & messages & turns, F.lit(False))


def _loads(rows: DataFrame) -> DataFrame:
    """What loads give: a payload that doesn't parse is none."""
    return rows.withColumn("loaded", F.when(valid_state(F.col("held")), F.col("held"))).select("key", "seq", "ts", "loaded", (F.col("held").isNotNull() & F.col("loaded").isNull()).alias("broken"))


def replay(ops: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(key, seq, ts, loaded, broken) per load of `ops` (key, ts, seq, op, payload): the payload held at that time, null where none
    is, where it has expired, and where it isn't a session, which `broken` tells. Operations of a key are in the order of ts and
    seq. Rows of other operations, and with a null key or time, are passed over. No key is gathered in a task."""
    rows = ops.where("key IS NOT NULL AND ts IS NOT NULL AND op IN ('save', 'load', 'delete')")
    change = F.when(F.col("op") != "load", F.struct("op", "ts", "payload"))
    held = F.col("carried")
    alive = (held["op"] == "save") & (F.unix_micros(F.col("ts")) < F.unix_micros(held["ts"]) + ttl_seconds * 1_000_000)
    return _loads(carried_before(rows, "key", ["ts", "seq"], change).where("op = 'load'").select("key", "seq", "ts", F.when(alive, held["payload"]).alias("held")))


class _Store(StatefulProcessor):
    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            none = part["payload"].isna()
            self.waiting.appendList([(int(t), int(s), o, None if n else p) for t, s, o, p, n in zip(us, part["seq"], part["op"], part["payload"], none, strict=True)])
            for ms in {int(t) // 1000 for t in us}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ops = sorted(tuple(r) for r in self.waiting.get())
        due, later = [o for o in ops if o[0] // 1000 <= now], [o for o in ops if o[0] // 1000 > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        deadline, payload = self.held.get() if self.held.exists() else (0, None)
        out = []
        for us, seq, op, given in due:
            if op == "load":
                out.append((key[0], seq, pd.Timestamp(us, unit="us", tz="UTC"), payload if us < deadline else None))
            else:
                deadline, payload = (us + self.ttl, given) if op == "save" else (0, None)
        if deadline // 1000 > now:
            self.held.update((deadline, payload))
            self.handle.registerTimer(deadline // 1000)
        elif self.held.exists():
            self.held.clear()  # expired or deleted: nothing stays of the key
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "ts", "held"])

    def close(self) -> None:
        pass


def served(ops: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same rows as replay(), of a stream: each once the watermark, `late` behind the newest operation, has passed it.
    Operations that come later than that are dropped. State per key: the operations that still wait, and one session until
    its deadline. Needs the RocksDB state store."""
    rows = ops.where("key IS NOT NULL AND ts IS NOT NULL AND op IN ('save', 'load', 'delete')").select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "op", "payload")
    return _loads(rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Store(ttl_seconds), _OUT, "append", "eventtime"))
