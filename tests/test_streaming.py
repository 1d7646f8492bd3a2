from hearken.streaming.listens import album_runs, arrivals, live_sessions, running_totals

COLUMNS = "username string, ts string, ms_played bigint, spotify_track_uri string, master_metadata_track_name string, master_metadata_album_album_name string, reason_start string, service string"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def listen(minute, album="Blue", why="trackdone", who="me", uri=None):
    return (who, f"2020-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", 60_000, uri or f"u{minute}", "Sea", album, why, "spotify")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_repeats_are_dropped_and_counted(spark, tmp_path):
    stream = feed(spark, tmp_path, [[listen(1), listen(1), listen(2)], [listen(1), listen(3)]])
    run(running_totals(arrivals(stream)), "totals", "complete")
    assert [(r.events, r.plays, r.ms) for r in spark.table("totals").collect()] == [(3, 3, 180_000)]


def test_album_runs_and_sessions(spark, tmp_path):
    first = [listen(0, why="clickrow"), *[listen(m) for m in (4, 8, 12)], listen(20, album="Red", why="clickrow")]
    stream = feed(spark, tmp_path, [first, [listen(60 * 23, album="Red", why="clickrow")]])
    run(album_runs(arrivals(stream, late="1 minute")), "runs")
    assert [(r.album, r.n_plays) for r in spark.table("runs").collect()] == [("Blue", 4)]
    run(live_sessions(arrivals(stream, late="1 minute")), "sessions")
    assert [r.n_plays for r in spark.table("sessions").collect()] == [5]
