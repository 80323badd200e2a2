"""The jobs over growing copies of their input, run again, and against their SQL."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import dialog_flow, queries, trade_performance
from jobs.common import read_config

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
KEYS = ["conv_id", "source", "target", "count", "words"]


def rows(df, columns=KEYS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sql(con_sql, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.sql(con_sql)


def add(spark, folder, turns):
    spark.createDataFrame(turns, dialog_flow.TURNS).coalesce(1).write.mode("append").parquet(folder)


FIRST = [(1, 0, "user", "how many?"), (1, 1, "assistant", "ten " * 80), (2, 0, "system", None), (2, 1, "user", ""), (None, 3, "user", "lost"), (4, None, "user", "lost too"), (5, 2, None, "late turns before this one")]
SECOND = [(1, 2, "user", "thanks"), (5, 0, "user", "first?"), (5, 1, "assistant", "second"), (1, 1, "assistant", "ten " * 80), (9, 0, "user", "new"), (9, 0, "user", "new"), (9, 0, "user", "other text of the same turn")]


def test_dialog_flow_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level("INFO", "jobs")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add(spark, source, FIRST)
    first = rows(dialog_flow.run(spark, source, out, mark))
    want = lambda: sorted(sql(f"SELECT {', '.join(KEYS)} FROM ({dialog_flow.ORACLE})", conversations=f"{source}/*.parquet").fetchall(), key=repr)
    assert first == want() and {r[0] for r in first} == {1, 2, 5}
    assert rows(dialog_flow.run(spark, source, out, mark)) == first  # nothing new
    assert spark.read.parquet(f"{out}/runs").count() == 1
    add(spark, source, SECOND)
    second = rows(dialog_flow.run(spark, source, out, mark))
    assert second == want() and {r[0] for r in second} == {1, 2, 5, 9} and (5, "user:question", "assistant:short", 1, 1) in second
    runs = {r["batch"]: r for r in spark.read.parquet(f"{out}/runs").collect()}
    assert [runs[k]["events"] for k in (0, 1)] == [5, 7] and runs[0]["unplaced"] == 2 and runs[1]["unplaced"] == 0
    assert spark.read.parquet(f"{out}/unplaced").count() == 2
    assert "read 5 placed and 2 unplaced turns" in caplog.text


def test_dialog_flow_replays_a_batch(spark, tmp_path):
    """A batch that failed after it wrote is run again from the checkpoint, and changes nothing."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add(spark, source, FIRST)
    first = rows(dialog_flow.run(spark, source, out, mark))
    (tmp_path / "mark" / "commits" / "0").unlink()
    crc = tmp_path / "mark" / "commits" / ".0.crc"
    crc.unlink(missing_ok=True)
    assert rows(dialog_flow.run(spark, source, out, mark)) == first
    assert spark.read.parquet(f"{out}/events").count() == 5


def test_dialog_flow_touches_only_its_buckets(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add(spark, source, [(k, 0, "user", "x") for k in range(50)])
    dialog_flow.run(spark, source, out, mark, {"buckets": 8})
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "edges").rglob("part-*")}
    before = files()
    add(spark, source, [(3, 1, "assistant", "y")])
    dialog_flow.run(spark, source, out, mark, {"buckets": 8})
    assert len({p.parent for p in set(before) - set(files())}) == 1


def test_dialog_flow_writes_few_files(spark, tmp_path):
    """Many small input files and one long conversation: a file for each bucket and batch, or as many as are allowed."""
    source = str(tmp_path / "in")
    turns = [(7 if k % 3 == 0 else k, k, "user", f"turn {k}") for k in range(300)]
    spark.createDataFrame(turns, dialog_flow.TURNS).repartition(8).write.parquet(source)
    got = []
    for files in (1, 3):
        out = tmp_path / f"out{files}"
        got.append(rows(dialog_flow.run(spark, source, str(out), str(tmp_path / f"mark{files}"), {"buckets": 4, "files_per_bucket": files})))
        for name in ("events", "edges"):
            held = [len(list(b.rglob("part-*"))) for b in (out / name).iterdir() if b.is_dir()]
            assert len(held) == 4 and all(1 <= n <= files for n in held)
    assert got[0] == got[1] and sum(r[3] for r in got[0] if r[0] == 7) == 102


def test_dialog_flow_empty_input(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add(spark, source, [])
    assert rows(dialog_flow.run(spark, source, out, mark)) == []


def test_dialog_flow_small_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in (FIRST, SECOND, FIRST):
        add(spark, source, part)
    got = rows(dialog_flow.run(spark, source, out, mark, {"files_per_batch": 1}))
    assert spark.read.parquet(f"{out}/runs").count() == 3
    add(spark, str(tmp_path / "in2"), FIRST + SECOND + FIRST)
    assert got == rows(dialog_flow.run(spark, str(tmp_path / "in2"), str(tmp_path / "out2"), str(tmp_path / "mark2")))


PERF = ["month", "activity", "delaying_type", "events", "long_waits", "mean_sojourn_h", "max_sojourn_h", "mean_sync_h", "max_sync_h"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_trade_performance_by_month(spark, tmp_path):
    out = str(tmp_path / "out")
    whole = rows(trade_performance.run(spark, D, out), PERF)
    assert rows(trade_performance.run(spark, D, out), PERF) == whole
    months = sorted({r[0] for r in whole})
    some = {"from_month": months[2], "to_month": months[3]}
    kept = [p for p in (tmp_path / "out" / f"month={months[0]}").iterdir() if p.name.startswith("part-")]
    assert rows(trade_performance.run(spark, D, out, some), PERF) == whole and all(p.exists() for p in kept)
    only = rows(trade_performance.run(spark, D, str(tmp_path / "some"), some), PERF)
    assert only == [r for r in whole if r[0] in months[2:4]] and len(only) > 1


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_sql(spark, name):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = queries.QUERIES[name](spark, D)
    tables = {f.removesuffix(".parquet"): f"{D}/{f}" for f in os.listdir(D)}
    want = sql(queries.ORACLES[name], **tables).df()
    columns = sorted(want.columns)
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    listed = lambda xs: sorted((tuple(map(cell, x)) for x in xs), key=repr)
    assert sorted(got.columns) == columns and listed(rows(got, columns)) == listed(want[columns].astype(object).itertuples(index=False)) and len(want)
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 3}))
    assert read_config(spark, str(tmp_path / "c.json"), dialog_flow.DEFAULTS) == dialog_flow.DEFAULTS | {"buckets": 3}
    assert read_config(spark, f"{ROOT}/jobs/trade_performance.json", trade_performance.DEFAULTS) == trade_performance.DEFAULTS
    assert read_config(spark, f"{ROOT}/jobs/dialog_flow.json", dialog_flow.DEFAULTS) == dialog_flow.DEFAULTS
    (tmp_path / "c.json").write_text('{"bucket": 3}')
    with pytest.raises(ValueError, match="unknown settings"):
        read_config(spark, str(tmp_path / "c.json"), dialog_flow.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, str(tmp_path / "in"), FIRST)
    run = subprocess.run([sys.executable, "-m", "jobs.dialog_flow", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", "jobs/dialog_flow.json"], cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "read 5 placed and 2 unplaced turns" in run.stderr
    assert {r[0] for r in rows(spark.read.schema(dialog_flow.EDGES).parquet(f"{tmp_path}/out/edges").withColumn("x", F.lit(0)))} == {1, 2, 5}


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_command_line_of_performance(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"patience_hours": 24}))
    run = subprocess.run([sys.executable, "-m", "jobs.trade_performance", "--input", D, "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json"], cwd=ROOT, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert f"read {D}" in run.stderr and "rows of" in run.stderr
    out = spark.read.schema(trade_performance.SCHEMA).parquet(f"{tmp_path}/out")
    assert out.count() > 0 and {f.name.split("=")[0] for f in (tmp_path / "out").iterdir() if f.is_dir()} == {"month"}
    patient = trade_performance.run(spark, D, str(tmp_path / "patient"))
    total = lambda df: df.agg(F.sum("long_waits")).first()[0]
    assert total(out) > total(patient)
