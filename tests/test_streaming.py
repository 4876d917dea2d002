import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from vacanta import source_queries
from vacanta.functions import pay, role
from vacanta.streaming import jobs
from vacanta.streaming.store import Store


SCHEMA = "source_key string, company string, platform string, url string, payload string"


def land(folder, name, items, key="k"):
    row = {"source_key": key, "company": "C", "platform": "lever", "url": "u", "payload": json.dumps(items)}
    (folder / name).write_text(json.dumps(row) + "\n")


def screen(p):
    uid = role.uid(F.col("url"), F.col("company"), F.col("title"), F.col("location"))
    return p.select(uid.alias("uid"), "source_key", "place", "title", "description", "salary")


def posts(*titles, url=None):
    return [{"text": t, "hostedUrl": f"https://x.example.com/{url or t}"} for t in titles]


def test_runs_are_batches(spark, tmp_path):
    """Two files of payloads are two runs; roles keep their first run, and running on without new files changes nothing."""
    folder, root = tmp_path / "in", str(tmp_path / "roles")
    folder.mkdir()
    run = lambda day: jobs.ingest(jobs.landed(spark, str(folder), SCHEMA), root, screen, F.lit(day), 3)
    land(folder, "a.json", posts("one", "two", "two") + posts("two again", url="two"))
    run("2026-01-01")
    land(folder, "b.json", posts("two", "three"))
    run("2026-01-02")
    store = run("2026-01-03")
    got = {r["title"]: (r["first_run"], r["last_seen"]) for r in store.roles().collect()}
    assert got == {"one": (1, "2026-01-01"), "two": (1, "2026-01-02"), "three": (2, "2026-01-02")}
    assert [tuple(r) for r in store.runs().select("run", "sources", "postings", "kept", "new", "roles").orderBy("run").collect()] == [(1, 1, 4, 2, 2, 2), (2, 1, 2, 2, 1, 3)]
    assert [r["title"] for r in store.new_roles().collect()] == ["three"]


def batch(spark, *rows):
    return spark.createDataFrame(rows, "uid string, place int, title string, description string").withColumn("salary", pay.salary())


def counts(spark, **n):
    return spark.createDataFrame([(k, k.upper(), v) for k, v in n.items()], "source_key string, company string, n long")


def test_a_run_is_merged_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    assert store.roles() is None and store.current()["run"] == 0
    one = batch(spark, ("a", 2, "last", "x"), ("a", 1, "first", "xx"), ("b", 1, "b", None))
    for day in ("2026-01-01", "2026-01-09"):
        assert store.merge(one, counts(spark, s=3, t=5), 1, F.lit(day)) == (day == "2026-01-01")
    assert sorted((r["uid"], r["title"], r["last_seen"]) for r in store.roles().collect()) == [("a", "last", "2026-01-01"), ("b", "b", "2026-01-01")]
    assert store.new_roles().count() == 0 and store.throttled().count() == 0
    store.merge(batch(spark), counts(spark, s=0, t=0, u=0), 2, F.lit("2026-01-02"))
    assert store.roles().count() == 2 and sorted(r[0] for r in store.throttled().collect()) == ["S", "T"]


def test_a_failed_run_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.merge(batch(spark, ("a", 1, "a", "")), counts(spark, s=1), 1, F.lit("2026-01-01"))
    with monkeypatch.context() as m:
        m.setattr(store, "_switch", lambda state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge(batch(spark, ("a", 1, "changed", ""), ("c", 1, "c", "")), counts(spark, s=2), 2, F.lit("2026-01-02"))
    assert [r["title"] for r in store.roles().collect()] == ["a"] and store.runs().count() == 1
    store.merge(batch(spark, ("a", 1, "changed", ""), ("c", 1, "c", "")), counts(spark, s=2), 2, F.lit("2026-01-03"))
    assert sorted((r["title"], r["first_run"], r["last_seen"]) for r in store.roles().collect()) == [("c", 2, "2026-01-03"), ("changed", 1, "2026-01-03")]


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    store.merge(batch(spark, *((f"u{i}", 1, "x", "") for i in range(60))), counts(spark), 1, F.lit("2026-01-01"))
    for run in (2, 3, 4):
        store.merge(batch(spark, ("u7", 1, f"run {run}", "")), counts(spark), run, F.lit("2026-01-02"))
    held = {b: run for b, (run, _) in store.current()["buckets"].items()}
    assert sorted(held.values()) == [1] * 7 + [4]
    folders = sorted(str(f.relative_to(tmp_path / "s" / "roles")) for f in (tmp_path / "s" / "roles").glob("run=*/bucket=*"))
    mine = next(b for b, run in held.items() if run == 4)
    assert folders == sorted([f"run=1/bucket={b}" for b in held if b != mine] + [f"run=3/bucket={mine}", f"run=4/bucket={mine}"])
    assert store.roles().count() == 60 and Store(spark, str(tmp_path / "s"), 99).buckets == 8


def test_other_columns_of_stored_roles_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    store.merge(batch(spark, ("a", 1, "a", "")).withColumn("fit", F.lit(70)), counts(spark), 1, F.lit("2026-01-01"))
    store.merge(batch(spark, ("a", 1, "b", "")).withColumn("sector", F.lit("it")), counts(spark), 2, F.lit("2026-01-01"))
    assert [(r["title"], r["fit"], r["sector"]) for r in store.roles().collect()] == [("b", 70, "it")]


def test_gone_does_not_depend_on_batches(spark, tmp_path):
    """A key is gone a week after its last sighting, each time; late sightings between others change nothing."""
    day = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    rows = [("a", 0.0), ("a", 3.0), ("a", 11.5), ("b", 1.0), ("c", 20.0), ("a", 12.0), ("d", 13.5), ("d", 13.25), (None, 2.0)]
    for i, cuts in enumerate(([30], [2, 12, 30], [5, 10, 15, 30])):
        folder = str(tmp_path / f"in{i}")
        frame = spark.createDataFrame([(k, day(d), next(j for j, c in enumerate(cuts) if d < c)) for k, d in rows], "key string, ts timestamp_ntz, part int")
        jobs.arriving(frame, F.col("part"), len(cuts), folder)
        got = jobs.collected(jobs.gone(jobs.files(spark, folder, frame.schema, "1 hour"), "key", days=7), "gone")
        shown = sorted((r["key"] or "", r["at"]) for r in got.select("key", jobs.in_utc(F.col("gone_at")).alias("at")).collect())
        assert shown == [("", day(9)), ("a", day(10)), ("a", day(19)), ("b", day(8))]


def test_gone_runs_no_python_for_a_key(spark, tmp_path):
    """Keys by the million: their state is kept inside Spark, a Python call for each would take hours."""
    folder = str(tmp_path / "in")
    frame = spark.createDataFrame([("a", datetime(2026, 1, 1))], "key string, ts timestamp_ntz")
    jobs.arriving(frame, F.lit(0), 1, folder)
    plan = jobs.gone(jobs.files(spark, folder, frame.schema, "1 hour"), "key")._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "InPySpark" not in plan


def test_gone_after_more_than_the_days_only(spark, tmp_path):
    """Seen again exactly so many days later, a key was never gone; a microsecond later, it was."""
    first, week = datetime(2026, 1, 1, 0, 0, 0, 5), timedelta(days=7)
    rows = [("same", first, 0), ("same", first + week, 1), ("late", first, 0), ("late", first + week + timedelta(microseconds=1), 1), ("end", first + timedelta(days=9), 1)]
    for parts in (1, 2):
        folder = str(tmp_path / f"in{parts}")
        frame = spark.createDataFrame(rows, "key string, ts timestamp_ntz, part int")
        jobs.arriving(frame, F.col("part") % parts, parts, folder)
        got = jobs.collected(jobs.gone(jobs.files(spark, folder, frame.schema, "1 hour"), "key", days=7), "gone")
        assert [(r["key"], r["seen"], r["at"]) for r in got.select("key", jobs.in_utc(F.col("last_seen")).alias("seen"), jobs.in_utc(F.col("gone_at")).alias("at")).collect()] == [("late", first, first + week)]


@pytest.mark.parametrize("ahead", [timedelta(0), timedelta(days=70), timedelta(days=-70)])
def test_gone_up_to_the_end_of_the_input(spark, tmp_path, ahead):
    """stream_gone equals its SQL: a key seen again in the last hour was gone, one that may still come was not, to the microsecond; whatever the days."""
    end, tick = datetime(2024, 1, 30, 12, 0, 0, 700) + ahead, timedelta(microseconds=1)
    hour, week = timedelta(hours=1), timedelta(days=7)
    seen = {
        1: [end], 2: [end - week - hour / 2, end - hour / 4], 3: [end - week - hour / 2], 4: [end - week - hour], 5: [end - week - hour + tick], 6: [end - week - hour / 2, end - hour / 2],
        7: [end - 3 * week, end - week - hour / 2, end - hour / 2 + tick], 8: [end - 3 * week], 9: [end - 4 * week, end - 2 * week, end - 2 * week + tick, end - hour],
    }
    rows = [(0, at, key, "view", 0.0, "{}") for key, times in seen.items() for at in times]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(source_queries.oracle_sql()["stream_gone"]).fetchall()
    assert sorted(map(tuple, source_queries.stream_gone(spark, str(tmp_path)).collect())) == sorted(want)
    assert sorted(k // 40 for k, *_ in want) == [2, 4, 7, 7, 8, 9, 9]
