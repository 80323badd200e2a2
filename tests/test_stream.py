"""Streams of events: order within the delay, and state that ends."""

import datetime as dt

from loomtrace.streaming.dfg import follow

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "case_id string, activity string, ts timestamp, pos long"


def run(spark, tmp_path, batches, name, **options):
    for k, rows in enumerate(batches):
        data = [(c, a, T0 + dt.timedelta(minutes=m), n) for n, (c, a, m) in enumerate(rows)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = follow(src, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    return {(r["case_id"], r["source"], r["target"]) for r in spark.sql(f"SELECT * FROM {name}").collect()}, held


def test_state_ends(spark, tmp_path):
    """200 cases leave the state once the watermark has passed their last event and the idle time; the case that
    moved the watermark stays."""
    cases = [(f"c{k}", a, m) for k in range(200) for a, m in (("a", k % 5), ("b", 10 + k % 5))]
    got, held = run(spark, tmp_path, [cases, [("end", "x", 500)], [("end", "y", 501)], [("end", "z", 502)]], "ended", delay="10 minutes", idle="60 minutes")
    assert {p for p in got if p[0] != "end"} == {(f"c{k}", "a", "b") for k in range(200)}
    assert max(held) >= 200 and held[-1] == 1


def test_a_case_goes_on_while_it_is_not_idle(spark, tmp_path):
    got, _ = run(spark, tmp_path, [[("1", "a", 0)], [("2", "t", 40)], [("1", "b", 50)], [("2", "t", 300)], [("1", "c", 310)], [("2", "t", 900)], [("2", "t", 901)]], "goes_on", delay="5 minutes", idle="60 minutes")
    assert {p for p in got if p[0] == "1"} == {("1", "a", "b")}  # c comes hours later and begins anew
    assert ("2", "t", "t") not in {p for p in got if p[0] == "1"}


def test_late_events_fall_into_place(spark, tmp_path):
    got, _ = run(spark, tmp_path, [[("1", "a", 0), ("1", "c", 20)], [("1", "b", 15)], [("9", "e", 600)], [("9", "e", 601)]], "late", delay="30 minutes", idle="1 day")
    assert {p for p in got if p[0] == "1"} == {("1", "a", "b"), ("1", "b", "c")}
