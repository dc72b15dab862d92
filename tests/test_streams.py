"""Streams and file sources."""

import datetime as dt

from pyspark.sql import functions as F

from tradeq.sources.envelope import read_envelope
from tradeq.sources.files import list_files, pending_files, write_files
from tradeq.streaming import jobs as J


def test_guard_accepts_blocks_accepts(rows):
    events = rows("user long, id long, sent_at long", (1, 1, 0), (1, 2, 240), (1, 3, 480), (2, 4, 100), (1, 5, 780), (1, 6, 781))
    got = sorted(r.id for r in J.accept_spaced(events, ["user"]).collect())
    assert got == [1, 3, 4, 6]


def test_capture_stream_skips_accepted(spark, rows, tmp_path):
    for branch, names in {"live": ["a.PNG", "b.jpg", "note.txt"], "test": ["c.bmp"]}.items():
        (tmp_path / branch).mkdir()
        for n in names:
            (tmp_path / branch / n).write_bytes(b"x")
    accepted = rows("source_key string", ("B.JPG",))
    stream = J.stream_captures(spark, {"LIVE": str(tmp_path / "live"), "PTU": str(tmp_path / "test")}, accepted)
    got = sorted((r.branch, r.name) for r in J.run_appends(stream, "captures").collect())
    assert got == [("LIVE", "a.PNG"), ("PTU", "c.bmp")]


def test_capture_stream_goes_on_where_it_stopped(spark, rows, tmp_path):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "out")
    name = "name string, content string"
    accepted = rows("source_key string", ("OLD.PNG",))
    read = lambda: J.run_appends(J.stream_captures(spark, {"LIVE": inbox}, accepted), "captures", target=target)
    assert write_files(rows(name, ("a.png", "1"), ("old.png", "2"), ("note.txt", "3")), inbox) == 3
    assert [r.name for r in read().collect()] == ["a.png"]
    write_files(rows(name, ("b.JPG", "4"), ("c.bmp", "5")), inbox)
    assert sorted(r.name for r in read().collect()) == ["a.png", "b.JPG", "c.bmp"]
    assert sorted(r.name for r in pending_files(list_files(spark, inbox), accepted).collect()) == ["a.png", "b.JPG", "c.bmp"]
    assert pending_files(list_files(spark, inbox), accepted, since=4_000_000_000).count() == 0


def test_late_older_price_never_wins(spark, rows, tmp_path):
    schema = "id_terminal long, id_commodity long, side string, ts long, price double, stock double, status int"
    for i, (ts, price) in enumerate([(10, 1.0), (30, 3.0), (20, 2.0)]):
        rows(schema, (1, 1, "BUY", ts, price, 1.0, 1)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = J.run_updates(J.stream_latest(stream), ["id_terminal", "id_commodity", "side"], "late").collect()
    assert [(r.ts, r.price) for r in got] == [(30, 3.0)]


EVENTS = "user_id long, id long, sent_at long, ts timestamp"


def _feed(rows, folder, name, *events):
    """One more file of events (user, id, second)."""
    data = [(u, i, t, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for u, i, t in events]
    shifted = rows(EVENTS, *data).withColumn("sent_at", F.unix_seconds("ts"))
    shifted.coalesce(1).write.parquet(str(folder / "in" / name))


def _stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def _base(spark):
    return spark.sql("SELECT unix_seconds(timestamp'2024-01-01 00:00:00') AS s").first().s


def test_quota_counts_the_half_hour_before_each_report(spark, rows, tmp_path):
    base = _base(spark)
    first = [(1, i, 180 + i % 60) for i in range(4)] + [(2, 50, 10)]
    _feed(rows, tmp_path, "a", *first)
    # three at the far end of 33 minutes: they fit no window that starts every five minutes together with the first
    second = [(1, 10 + i, 180 + 1799 - i) for i in range(3)] + [(1, 20, 182 + 1800)]
    target = str(tmp_path / "out")
    told = J.run_updates(J.stream_quota(_stream(spark, tmp_path), "user_id", limit=6), ["user_id", "sent_at"], "q", target=target)
    assert {(r.user_id, r.sent_at - base, r.n_reports) for r in told.collect()} == {(1, 180, 1), (1, 181, 2), (1, 182, 3), (1, 183, 4), (2, 10, 1)}
    _feed(rows, tmp_path, "b", *second)
    _feed(rows, tmp_path, "c", (1, 30, 190))  # late, but not too late: it counts for all after it
    told = J.run_updates(J.stream_quota(_stream(spark, tmp_path), "user_id", limit=6), ["user_id", "sent_at"], "q", target=target)
    every = first + second + [(1, 30, 190)]
    want = {(u, t, sum(v == u and t - 1800 < x <= t for v, _, x in every)) for u, _, t in every}
    got = {(r.user_id, r.sent_at - base, r.n_reports): r.over_limit for r in told.collect()}
    assert set(got) == want and {k for k, over in got.items() if over} == {k for k in want if k[2] > 6} != set()


def test_guard_goes_on_where_it_stopped(spark, rows, tmp_path):
    base, target = _base(spark), str(tmp_path / "out")
    run = lambda: J.run_appends(J.stream_accept(_stream(spark, tmp_path), ["user_id"]), "g", target=target)
    _feed(rows, tmp_path, "a", (1, 1, 0), (1, 2, 240), (2, 9, 5), (2, 8, 5), (2, 7, 5))
    assert sorted((r.id, r.sent_at - base) for r in run().collect()) == [(1, 0), (7, 5)]
    _feed(rows, tmp_path, "b", (1, 3, 290), (1, 4, 480))
    _feed(rows, tmp_path, "c", (1, 5, 700), (1, 6, 781), (2, 10, 305), (2, 11, 306))
    assert sorted(r.id for r in run().collect()) == [1, 4, 6, 7, 11]


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"status":"OK","data":[{"id":1,"name":"x","more":2},{"id":2}]}')
    (tmp_path / "b.json").write_text('{\n"status":"ok",\n"data":{"id":3,"name":"z"}}')
    (tmp_path / "c.json").write_text('{"status":"error","message":"no","http_code":500}')
    data, rejects = read_envelope(spark, str(tmp_path), "id int, name string")
    assert sorted((r.id, r.name) for r in data.collect()) == [(1, "x"), (2, None), (3, "z")]
    assert [(r.status, r.http_code) for r in rejects.collect()] == [("error", 500)]
