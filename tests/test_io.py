import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.timestamps import parse_timestamp, typed
from loomtrace.log import OCLog
from loomtrace.sources import ocel, xes

T = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
E = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def log(spark):
    h = dt.timedelta(hours=1)
    return OCLog.of(
        spark, [("e1", "place order", T), ("e2", "pick", T + h)], [("o1", "order"), ("i1", "item"), ("i2", "item")],
        [("e1", "o1", ""), ("e1", "i1", "part-of"), ("e2", "i1", "x"), ("e2", "i2", "")], [("o1", "i1", "has"), ("o1", "i2", "has")],
        [("i1", "price", "5", T), ("i2", "price", "7", T + 3 * h), ("o1", "state", "new", T)], [("e1", "area", "in & <out>")])


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", ["a.json", "a.json.gz", "a.xml", "a.ocel.csv", "a.sqlite", "a.duckdb", "a.parquet"])
def test_object_centric_round_trip(spark, tmp_path, name):
    a = log(spark)
    path = str(tmp_path / name)
    ocel.write_ocel(a, path)
    b = ocel.read_ocel(spark, path)
    assert rows(a.ev, "ev_id", "ev_type", "ts") == rows(b.ev, "ev_id", "ev_type", "ts")
    assert rows(a.ob, "ob_id", "ob_type") == rows(b.ob, "ob_id", "ob_type")
    assert rows(a.e2o, "ev_id", "ob_id", "qualifier") == rows(b.e2o, "ev_id", "ob_id", "qualifier")
    assert rows(a.o2o, "src_id", "tgt_id", "qualifier") == rows(b.o2o, "src_id", "tgt_id", "qualifier")
    assert rows(a.obj_attr, "ob_id", "name", "value", "ts") == rows(b.obj_attr, "ob_id", "name", "value", "ts")
    assert rows(a.ev_attr, "ev_id", "name", "value") == rows(b.ev_attr, "ev_id", "name", "value")


def test_csv_cells_and_rows(spark, tmp_path):
    assert ocel.parse_refs('i1#part-of{"price": "5/6 }"}/ i2 ') == [("i1", "part-of", {"price": "5/6 }"}), ("i2", "", None)]
    with pytest.raises(ValueError):
        ocel.parse_refs("#q")
    p = tmp_path / "x.csv"
    p.write_text('id,activity,timestamp,ot:order,OT:item,ea:area\ne1,place,2026-01-22T09:57:28+0000,o1,"i1#part-of{""price"": ""5€""}/i2",in\n,,2026-01-25T09:57:28+0000,,"i1{""price"": ""50€""}",\no1,O2O,,,i1#has/i2#has,\nzz,o2o,,,i1#has,\n')
    b = ocel.read_csv(spark, str(p))
    assert rows(b.obj_attr, "name", "value") == [("price", "50€"), ("price", "5€")]
    assert rows(b.o2o, "src_id", "tgt_id") == [("o1", "i1"), ("o1", "i2")]
    with pytest.raises(ValueError):
        ocel.read_csv(spark, str(p), strict=True)


def test_formats():
    assert xes.infer_format("a/x.xes.gz") == "xes.gz" and xes.infer_format("x.json") == "json" and xes.infer_format("x") is None
    assert [ocel.infer_format(x) for x in ("a.jsonocel", "a.xmlocel.gz", "a.db", "b.ocel.csv", "q.txt")] == ["json", "xml", "sqlite", "csv", None]


@pytest.mark.parametrize("text", ["2023-10-06T09:30:21+00:00", "2023-10-06T09:30:21+0000", "Fri, 06 Oct 2023 09:30:21 +0000", "2023-10-06 09:30:21", "2023-10-06T09:30:21", "2023-10-06 09:30:21 UTC", "Fri Oct 06 2023 11:30:21 GMT+0200 (CEST)"])
def test_timestamps(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.unix_micros(parse_timestamp(F.col("t"))).alias("u"))
    assert df.first()["u"] == 1696584621000000


def test_values(spark):
    df = spark.createDataFrame([("1.5",), ("2.0",), ("x",), ("TRUE",), ("null",)], "v string")
    got = df.select(typed(F.col("v"), "integer").alias("i"), typed(F.col("v"), "boolean").alias("b"), typed(F.col("v"), "float").alias("f")).collect()
    assert [r["i"] for r in got] == [None, 2, None, None, None] and got[3]["b"] is True and got[4]["f"] != got[4]["f"]


def test_xes(spark, tmp_path):
    p = tmp_path / "a.xes"
    p.write_text("""<?xml version="1.0"?><log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="u"/><global scope="trace"><string key="concept:name" value="__INVALID__"/></global>
<global scope="event"><string key="concept:name" value="none"/><string key="my key" value="d"/></global>
<classifier name="c" keys="concept:name my key"/>
<trace><string key="concept:name" value="A"/><event><string key="concept:name" value="x"/><date key="time:timestamp" value="2024-01-01T00:00:00Z"/><int key="n" value="3"><string key="child" value="q"/></int></event>
<event><date key="time:timestamp" value="2023-01-01T00:00:00Z"/></event></trace>
<trace/></log>""")
    h = xes.read_header(str(p))
    assert h.classifiers == {"c": ["concept:name", "my key"]} and h.trace_globals == {"concept:name": "__INVALID__"}
    assert xes.parse_classifier("'testing 123' test") == ["testing 123", "test"]
    df = xes.read_xes(spark, str(p), globals_=h)
    got = sorted(df.select("case_id", "activity", "pos").collect(), key=repr)
    assert [tuple(r) for r in got] == [("A", "none", 1), ("A", "x", 0), ("__INVALID__", "none", None)]
    assert df.filter("pos = 0").select(F.col("attrs")["n"]["children"].alias("c")).first()["c"].count("child") == 1
    assert [r["activity"] for r in xes.read_xes(spark, str(p), globals_=h, sort_by_time=True).filter("pos IS NOT NULL").orderBy("pos").collect()] == ["none", "x"]
    assert xes.identity(df.filter("pos = 0"), h, "c").first()["identity"] == "x+d"
    xes.write_xes(df, str(tmp_path / "b.xes.gz"), h)
    again = xes.read_xes(spark, str(tmp_path / "b.xes.gz"), globals_=xes.read_header(str(tmp_path / "b.xes.gz")))
    assert sorted(map(tuple, again.filter("pos IS NOT NULL").select("case_id", "activity", "ts").collect()), key=repr) == sorted(map(tuple, df.filter("pos IS NOT NULL").select("case_id", "activity", "ts").collect()), key=repr)
    flat = xes.to_flat(df.filter("pos IS NOT NULL"), ["concept:name", "time:timestamp", "n"])
    assert xes.from_flat(flat).filter("activity = 'x'").select(F.col("attrs")["n"]["value"].alias("n")).first()["n"] == "3"


def test_graph_store(spark, tmp_path):
    assert ocel.write_graph(log(spark), str(tmp_path / "g")).count("CREATE") == 4
    assert "Event_place_order" in ocel.write_graph(log(spark), str(tmp_path / "t"), typed=True)
