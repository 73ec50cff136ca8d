"""Players' states from streams of their events, by tab.

Events: (tab, at timestamp, type, index, total, bytes_billed, cache_hits, signature, error). A command sets the status; a
progress report replaces only what it brings; a new document of the same signature keeps what was billed; navigation and
closing clear a tab. With idle_ms, a tab that is silent for so long is forgotten; that suits triggers by processing time, as
a query with timeouts never runs out of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import MapType, StringType

EVENT_SCHEMA = "tab long, at timestamp, type string, index int, total int, bytes_billed long, cache_hits long, signature string, error string"
STATE_SCHEMA = "status string, index int, total int, bytes_billed long, cache_hits long, signature string, error string"
#: The status that a command leads to.
STATUS = {"extract": "extracting", "load": "buffering", "play": "playing", "resume": "playing", "pause": "paused", "stop": "idle", "error": "error"}
EMPTY = ("idle", 0, 0, 0, 0, "", None)


def step(state: tuple, event: dict) -> tuple:
    """The state after one event."""
    status, index, total, billed, hits, signature, error = state
    kind = event["type"]
    given = lambda name, old: old if event.get(name) is None else event[name]
    if kind in ("navigate", "close"):
        return EMPTY
    if kind == "load":
        same = event.get("signature") == signature
        return ("buffering", 0, given("total", 0), billed if same else 0, hits if same else 0, given("signature", ""), None)
    if kind == "seek":
        return (status, max(0, min(given("index", index), max(0, total - 1))), total, billed, hits, signature, error)
    if kind in ("next", "prev"):
        return (status, max(0, min(index + (1 if kind == "next" else -1), max(0, total - 1))), total, billed, hits, signature, error)
    if kind == "progress":
        return (status, given("index", index), given("total", total), given("bytes_billed", billed), given("cache_hits", hits), signature, error)
    if kind == "ended":
        return ("idle", index, total, given("bytes_billed", billed), given("cache_hits", hits), signature, None)
    return (STATUS.get(kind, status), index, total, billed, hits, signature, given("error", None) if kind == "error" else None)


def states(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A row (tab, state) for each tab and micro-batch that has events of it."""
    import pandas as pd

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else EMPTY
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for event in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            # pandas makes whole numbers with gaps floating ones.
            now = step(tuple(now), {k: int(v) if isinstance(v, float) else v for k, v in event.items()})
        if now == EMPTY:
            state.remove()
        else:
            state.update(now)
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        yield pd.DataFrame([{"tab": key[0], **dict(zip(names, now, strict=True))}])

    return events.groupBy("tab").applyInPandasWithState(fold, f"tab long, {STATE_SCHEMA}", STATE_SCHEMA, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def debounced(patches: DataFrame, gap: str = "300 milliseconds", by: tuple[str, ...] = (), late: str = "10 seconds") -> DataFrame:
    """Patches (at, key, value, by) merged: a burst, in which no patch comes later than `gap` after the one before, is given out
    as one map when it is over, with each key's last value. (by, began, ended, patch); ended is the last patch and the gap. In
    a stream a burst is over when the watermark is past its end. Of equal times the larger value counts; null keys are left
    out."""
    rows = patches.filter("key IS NOT NULL")
    rows = rows.withWatermark("at", late) if patches.isStreaming else rows
    # A stream's sessions need a key beside their time; without one all patches share this.
    keys = by or (F.pmod(F.xxhash64("key"), F.lit(1)).alias("__all"),)
    burst = rows.groupBy(F.session_window("at", gap).alias("burst"), *keys).agg(F.sort_array(F.collect_list(F.struct("at", "key", "value"))).alias("all"))
    kind = patches.schema["value"].dataType
    none = F.create_map().cast(MapType(StringType(), kind))
    merge = lambda done, p: F.map_concat(F.map_filter(done, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"]))
    return burst.select(*by, F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), F.aggregate("all", none, merge).alias("patch"))
