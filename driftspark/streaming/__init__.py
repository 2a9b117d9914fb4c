"""The live path: windowed counts and entry/exit events over a stream of states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_counts(stream: DataFrame, ts: str, width: str, late: str, *keys: Column | str) -> DataFrame:
    """Counts by tumbling windows and keys; rows later than ``late`` are dropped with their windows' state."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *[c for c in counts.columns if c not in ("w", "n")], "n")


EVENTS = "id long, ts timestamp, poly long, flag long"
_STATE = "poly long, inside boolean, at array<long>, event array<long>, place array<long>"
#: A particle that has not been seen for so long is forgotten.
FORGET_MS = 30 * 86_400_000


def edges_in_order(poly: int, inside: bool, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Times, polygons and signs of the entries (+1) and exits (-1) in states in order of time, and what holds after them.

    An exit tells the polygon of entry; from one polygon to another without a gap is no event.
    """
    now = place >= 0
    change = np.flatnonzero(now != np.concatenate([[inside], now[:-1]]))
    enters = now[change]
    # the polygon of an entry is its own, that of an exit the one of the entry before it
    entered = np.where(enters, place[change], 0)
    last = np.maximum.accumulate(np.where(enters, np.arange(len(change)), -1)) if len(change) else change
    told = np.where(last >= 0, entered[last], poly) if len(change) else entered
    return at[change], told, np.where(enters, 1, -1), int(told[-1]) if len(change) else poly, bool(now[-1]) if len(now) else inside


def _edges(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one particle, of the rows that the watermark has passed; later ones wait, so that late rows find their place."""
    poly, inside, at, event, place = state.get if state.exists else (-1, False, [], [], [])
    held = pd.DataFrame({"at": at, "event": event, "place": place}, dtype="int64")
    if not state.hasTimedOut:
        new = pd.concat(list(parts))
        at = new.ts.astype("datetime64[us]").astype("int64")
        held = pd.concat([held, pd.DataFrame({"at": at.to_numpy(), "event": new.event_id.to_numpy(), "place": new.poly.to_numpy()}, dtype="int64")])
    passed = state.getCurrentWatermarkMs() * 1000
    held = held.sort_values(["at", "event"])
    ready = held["at"].to_numpy() <= passed
    when, told, flags, poly, inside = edges_in_order(poly, inside, held["at"].to_numpy()[ready], held["place"].to_numpy()[ready])
    wait = held[~ready]
    if state.hasTimedOut and not len(wait) and not ready.any():
        state.remove()  # it has not been seen for long
    else:
        state.update((poly, inside, *(wait[n].tolist() for n in ("at", "event", "place"))))
        next_ms = int(wait["at"].min() // 1000) + 1 if len(wait) else max(state.getCurrentWatermarkMs(), 0) + FORGET_MS
        state.setTimeoutTimestamp(max(next_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"id": np.full(len(when), key[0]), "ts": pd.to_datetime(when, unit="us"), "poly": told.astype("int64"), "flag": flags.astype("int64")})


def live_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """EVENTS of a stream of id, ts, event_id and poly (-1 outside), each once the watermark has passed it; a particle unseen for 30 days is forgotten."""
    rows = stream.select("id", "ts", "event_id", "poly").withWatermark("ts", late)
    return rows.groupBy("id").applyInPandasWithState(_edges, EVENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
