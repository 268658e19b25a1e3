"""Streams: session state, request latencies, incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "session_id long, turns long, last_user string, last_assistant string"


def fold_sessions(turns: DataFrame) -> DataFrame:
    """(session_id, turns, last_user, last_assistant) of whole sessions: the batch twin of ``stream_sessions``.

    ``turns``: session_id, turn, role, text. Null texts count as turns but never replace a text.
    """
    last = lambda role: F.max_by("text", F.when((F.col("role") == role) & F.col("text").isNotNull(), F.col("turn")))
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def stream_sessions(turns: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """The session state after every micro-batch; a session that is idle for longer is forgotten.

    ``turns``: session_id, ts, turn, role, text. State is four values of each session.
    """
    minutes = int(idle.split()[0]) * 60_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, user, user_at, bot, bot_at = state.get if state.exists else (0, None, -1, None, -1)
        for f in frames:
            n += len(f)
            for r in f.itertuples(index=False):
                if r.text is not None and r.role == "user" and r.turn >= user_at:
                    user, user_at = r.text, r.turn
                elif r.text is not None and r.role == "assistant" and r.turn >= bot_at:
                    bot, bot_at = r.text, r.turn
        state.update((int(n), user, int(user_at), bot, int(bot_at)))
        state.setTimeoutDuration(minutes)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "last_user": [user], "last_assistant": [bot]})

    return turns.groupBy("session_id").applyInPandasWithState(step, SESSION, "n long, user string, user_at long, bot string, bot_at long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latency_windows(events: DataFrame, window: str = "1 hour", late: str | None = None, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, kind, n, mean, most) of tumbling windows; with ``late``, a stream drops events later than that."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if late else e
    out = e.groupBy(F.window("_t", window).alias("w"), F.col(kind).alias(kind)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "mean", "most")


def sliding_latency(events: DataFrame, window: str, slide: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, n, mean) of sliding windows."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), window, slide).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), "n", "mean")


def visits(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, visit_start, n) of visits that end after a ``gap`` without events."""
    out = events.groupBy(F.col(user), F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("visit_start"), "n")


def ingest_new(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, late: str = "1 day"):  # noqa: ANN201
    """A running query that appends rows of unseen keys to a table; repeats within ``late`` are dropped in the stream, older ones against the table."""
    from lectern.sources.sinks import append_new

    fresh = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, path, key)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
