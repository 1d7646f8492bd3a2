"""Streaming variants of the batch summaries: late and repeated deliveries, totals by service and year, live sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearken.functions.classify import is_play
from hearken.functions.instants import instant_us


def arrivals(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Listens of a stream once each: repeated deliveries within the watermark are dropped."""
    at = F.timestamp_micros(instant_us(F.col("ts")))
    rows = stream.withColumn("at", at).where("at is not null").withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["username", "at", "spotify_track_uri", "master_metadata_track_name"])


def running_totals(listens: DataFrame, *, window: str = "1 day") -> DataFrame:
    """Events, plays and milliseconds by service and window."""
    return listens.groupBy(F.window("at", window), "service").agg(F.count(F.lit(1)).alias("events"), F.count_if(is_play(F.col("ms_played"))).alias("plays"), F.sum(F.coalesce("ms_played", F.lit(0))).alias("ms"))


def live_sessions(listens: DataFrame, *, gap: str = "10 minutes") -> DataFrame:
    """Sessions of each account by inactivity gap, closed once the watermark passes their end."""
    p = listens.where(is_play(F.col("ms_played")))
    return p.groupBy(F.session_window("at", gap).alias("session"), "username").agg(F.count(F.lit(1)).alias("n_plays")).select("username", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_plays")


def album_runs(listens: DataFrame, *, gap_s: int = 600, least: int = 4) -> DataFrame:
    """Album sessions of each account, with the open run as state; a run is put out when the next play ends it or its gap times out.

    Plays of a micro-batch are taken in time order; one that arrives behind its account's open run ends nothing and
    counts as a run of its own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["username", "album", "start", "end", "n_plays"]
        done: list[tuple] = []
        run = state.get if state.exists else None

        def close(r: tuple | None) -> None:
            if r and r[3] >= least:
                done.append((key[0], r[0], pd.Timestamp(r[1], unit="us"), pd.Timestamp(r[2], unit="us"), r[3]))

        if state.hasTimedOut:
            close(run)
            state.remove()
            yield pd.DataFrame(done, columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values(["us", "album", "reason_start"], na_position="first")
        for us, album, why in zip(rows["us"], rows["album"], rows["reason_start"], strict=True):
            if run and album == run[0] and why == "trackdone" and 0 <= us - run[2] < gap_s * 1_000_000:
                run = (run[0], run[1], int(us), run[3] + 1)
            elif not run or us >= run[2]:
                close(run)
                run = (album, int(us), int(us), 1) if isinstance(album, str) and album else None
        if run:
            state.update(run)
            state.setTimeoutTimestamp(max(run[2] // 1000 + gap_s * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=columns)

    p = listens.where(is_play(F.col("ms_played"))).select("username", "at", F.unix_micros("at").alias("us"), F.col("master_metadata_album_album_name").alias("album"), "reason_start")
    return p.groupBy("username").applyInPandasWithState(step, "username string, album string, start timestamp, end timestamp, n_plays bigint", "album string, start bigint, last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
