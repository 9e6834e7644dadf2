"""File life cycle as a stream: report files that stay in ``analyzing`` too long.

``stuck_stream`` is a feed of alarms. ``stuck_episodes`` also tells when a file moves on, so that its rows and what the state
still holds at the end of a bounded run (``stuck_at_end``) give what the batch form gives, whatever the batches were.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sieveline.operators.activity import STUCK_SECONDS

#: files are followed in so many groups, dealt by a hash of their id: a call of Python costs milliseconds, a file microseconds
GROUPS = 1024
#: the state of a group, an entry a file; ``unnamed`` marks the file without an id, ``at`` is the time a file waits for
_KEPT = {"unnamed": "boolean", "file_id": "long", "since_ms": "long", "event_id": "long", "analyzing": "boolean", "at": "long",
         "told": "boolean"}
_OUT = "file_id long, since_ms long"


def _followed(events: DataFrame, delay: str, groups: int, out: str, step) -> DataFrame:
    """Follow the last status of every file, with a timeout for each; of equal times the higher ``event_id`` counts, as in
    the batch form. Rows without a time are left out, those later than the watermark dropped.

    ``step(files, watermark)`` gets the files of a group as arrays: ``fresh`` ones have rows in this batch, ``moved`` ones
    among them a change that was not known, ``due`` ones waited for a time that has passed. It sets the times they wait for
    and returns which files to keep, which to emit and what to add to these rows. Rows arrive in batches and are never held
    together.
    """
    kinds = {n: bool if kind == "boolean" else "int64" for n, kind in _KEPT.items()}

    def joined(one, other):
        return {n: np.concatenate([one[n], other[n]]) for n in one}

    def by_file(rows):
        """Rows in the order of files, times and events, equal ones as they came, and which are the last of their file."""
        order = np.lexsort((rows["event_id"], rows["since_ms"], rows["file_id"], rows["unnamed"]))
        rows = {n: values[order] for n, values in rows.items()}
        last = np.ones(len(order), dtype=bool)
        last[:-1] = (rows["unnamed"][1:] != rows["unnamed"][:-1]) | (rows["file_id"][1:] != rows["file_id"][:-1])
        return rows, last

    def picked(rows, which):
        return {n: values[which] for n, values in rows.items()}

    def follow(key, frames, state):
        watermark = state.getCurrentWatermarkMs()
        held = state.get if state.exists else [()] * len(kinds)
        files = {n: np.array(values, dtype=kind) for (n, kind), values in zip(kinds.items(), held)}
        files["fresh"] = files["moved"] = np.zeros(len(files["at"]), dtype=bool)
        if not state.hasTimedOut:
            new = None
            for frame in frames:
                rows = {n: frame[n].to_numpy() for n in ("unnamed", "file_id", "since_ms", "event_id", "analyzing")}
                new = picked(*by_file(rows if new is None else joined(new, rows)))
            some = np.ones(len(new["file_id"]), dtype=bool)
            new |= {"at": np.zeros(len(some), dtype="int64"), "told": some, "fresh": some, "moved": some}
            # the row of the state comes before the new one of its file, or behind it if that is older
            rows, last = by_file(joined(files, new))
            before = np.flatnonzero(~last)
            after = before + 1
            same = (rows["since_ms"][before] == rows["since_ms"][after]) & (rows["event_id"][before] == rows["event_id"][after])
            rows["moved"][after] &= ~same
            rows["told"][after] = np.where(rows["fresh"][after], rows["told"][before], rows["told"][after])
            rows["fresh"][after] = True
            files = picked(rows, last)
        files["due"] = ~files["fresh"] & (files["at"] < watermark)
        keep, emit, more = step(files, watermark)
        if keep.any():
            state.update(tuple(files[n][keep].tolist() for n in kinds))
            state.setTimeoutTimestamp(max(int(files["at"][keep].min()), watermark))
        else:
            state.remove()
        if emit.any():
            ids, unnamed = files["file_id"][emit], files["unnamed"][emit]
            if unnamed.any():
                ids = np.where(unnamed, None, ids.astype(object))
            yield pd.DataFrame({"file_id": ids, "since_ms": files["since_ms"][emit]} | {n: values[emit] for n, values in more.items()})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(
        F.pmod(F.xxhash64("file_id"), F.lit(groups)).alias("part"), "ts", F.col("file_id").isNull().alias("unnamed"),
        F.coalesce("file_id", F.lit(0)).cast("long").alias("file_id"), F.unix_millis("ts").alias("since_ms"),
        F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"),
        F.coalesce(F.col("status") == "analyzing", F.lit(False)).alias("analyzing")).filter(F.col("since_ms") >= 0)
    return rows.groupBy("part").applyInPandasWithState(
        follow, out, ", ".join(f"{n} array<{kind}>" for n, kind in _KEPT.items()), "append", GroupStateTimeout.EventTimeTimeout)


def stuck_stream(events: DataFrame, delay: str = "10 minutes", seconds: int = STUCK_SECONDS, groups: int = GROUPS) -> DataFrame:
    """Emit a file once its last status has been ``analyzing`` for ``seconds`` of event time
    without a newer one.  Late rows beyond the watermark are dropped.
    """
    wait = seconds * 1000

    def step(files, watermark):
        files["at"] = np.where(files["fresh"], np.maximum(files["since_ms"] + wait, watermark + 1), files["at"])
        return ~files["due"], files["due"] & files["analyzing"], {}

    return _followed(events, delay, groups, _OUT, step)


_EPISODE = "file_id long, since_ms long, stuck boolean"
KEEP_SECONDS = 24 * 3600


def stuck_episodes(events: DataFrame, delay: str = "10 minutes", seconds: int = STUCK_SECONDS,
                   keep_seconds: int = KEEP_SECONDS, groups: int = GROUPS) -> DataFrame:
    """``file_id, since_ms, stuck``: true once a file has been ``analyzing`` for ``seconds``, false when a status comes for a
    file that was reported or that nothing is known of.

    The state of a file is dropped ``keep_seconds`` of event time after its last report and as soon as a finished file can no
    longer get stuck, so it holds the files at work and not all there ever were. Rows later than the watermark are dropped;
    ``dropped_late`` tells how many.
    """
    wait, keep = seconds * 1000, keep_seconds * 1000

    def step(files, watermark):
        moves = files["fresh"] & files["moved"] & files["told"]
        sticks = files["due"] & files["analyzing"] & ~files["told"]
        files["told"] = (files["told"] & ~moves) | sticks
        due = np.maximum(files["since_ms"] + wait + np.where(files["told"], keep, 0), watermark + 1)
        files["at"] = np.where(files["fresh"] | sticks, due, files["at"])
        return ~files["due"] | sticks, moves | sticks, {"stuck": sticks}

    return _followed(events, delay, groups, _EPISODE, step)


def stuck_at_end(told: DataFrame, checkpoint: str, now, seconds: int = STUCK_SECONDS) -> DataFrame:
    """``file_id, since_ms``: the files that are stuck at ``now``, from the rows of ``stuck_episodes`` and the state that its
    stream left in ``checkpoint``. The stream has to have stopped."""
    state = told.sparkSession.read.format("statestore").load(checkpoint)
    held = state.select("value.groupState.*").select(F.inline(F.arrays_zip(*_KEPT))).select(
        F.when(~F.col("unnamed"), F.col("file_id")).alias("file_id"), "since_ms", F.col("analyzing").alias("stuck"))
    last = told.unionByName(held).groupBy("file_id").agg(F.max(F.struct("since_ms", "stuck")).alias("x"))
    return last.filter("x.stuck").select("file_id", "x.since_ms").filter(
        F.unix_seconds(now) - F.floor(F.col("since_ms") / 1000) > seconds)


def dropped_late(query) -> int:
    """Rows that a stream's stateful operators dropped as later than the watermark, over the progress it still remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
