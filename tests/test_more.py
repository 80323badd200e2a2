import datetime as dt
import random

import pytest

from loomtrace.functions import registry
from loomtrace.operators import cases, objects, paths
from loomtrace.plans import maps
from loomtrace.plans.countermodel import entails
from loomtrace.plans.declare import Arc, Label, reduce_arcs
from loomtrace.plans.negative import Knowledge, edges
from loomtrace.plans.partial import PartialTrace
from loomtrace.sources import ocel
from loomtrace.streaming.dfg import follow

from .test_declare import FIXTURE, micro

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(c, a, T0 + dt.timedelta(minutes=m), k) for k, (c, a, m) in enumerate(rows)], "case_id string, activity string, ts timestamp, pos long")


def test_case_helpers(spark):
    df = log(spark, [("1", "a", 0), ("1", "b", 1), ("1", "a", 2), ("2", "b", 0)])
    e = cases.dfg_edges(df)
    assert {tuple(r) for r in cases.neighbours(e, "a").collect()} == {("b", 1)} and {tuple(r) for r in cases.neighbours(e, "a", incoming=True).collect()} == {("b", 1)}
    assert cases.without_activity(e, "a").count() == 0 and cases.without_relation(e, "a", "b").count() == 1
    assert {tuple(r) for r in cases.add_relation(e, "a", "b", 4).collect()} == {("a", "b", 5), ("b", "a", 1)}
    assert cases.histogram(log(spark, [("1", "a", 5), ("1", "b", 5)]), 3).select("bin").distinct().collect()[0][0] == 0
    assert [p.count() for p in cases.split_by_activities(df, [{"a"}, {"b"}])] == [2, 2]
    with pytest.raises(ValueError):
        cases.split_by_activities(df, [{"a"}])
    parts = cases.random_activity_split(list("abcdef"), 2, 1)
    assert set().union(*parts) == set("abcdef") and not parts[0] & parts[1]
    assert {r["part"] for r in cases.random_event_split(df, 3, 1).collect()} <= {0, 1, 2}


def test_edits(spark):
    a = micro(spark, FIXTURE, ["z9"], [("o1", "i1")])
    assert objects.without_orphans(a).ob.count() == 4
    b = objects.add_events(a, spark.createDataFrame([("e0", "x", T0), ("n1", "x", T0)], "ev_id string, ev_type string, ts timestamp"), spark.createDataFrame([("n1", "o1", "q")], "ev_id string, ob_id string, qualifier string"))
    assert b.ev.count() == 8 and b.e2o.count() == a.e2o.count() + 1
    c = objects.delete_objects(b, spark.createDataFrame([("o1",)], "ob_id string"))
    assert c.o2o.count() == 0 and c.e2o.filter("ob_id = 'o1'").count() == 0
    assert objects.delete_events(b, spark.createDataFrame([("n1",)], "ev_id string")).e2o.count() == a.e2o.count()
    with pytest.raises(KeyError):
        objects.attribute_changes(a, "nobody")
    broken = a.with_(e2o=a.e2o.unionByName(spark.createDataFrame([("e0", "ghost", "q"), ("ghost", "o1", "q")], "ev_id string, ob_id string, qualifier string")))
    assert objects.linked(broken).e2o.count() == a.e2o.count()


def test_paths(spark):
    a = micro(spark, FIXTURE, [], [("o1", "i1"), ("o1", "i2"), ("o2", "i2")])
    graph = paths.type_graph(a)
    found = paths.enumerate_schemas(graph, ("event", "place"), ("event", "ship"), 2)
    assert len(found) == 2 and all(s.distinct_types for s in found)
    assert len(paths.enumerate_schemas(graph, ("event", "place"), ("event", "ship"), 4, cycles=True)) > len(paths.enumerate_schemas(graph, ("event", "place"), ("event", "ship"), 4))
    rows = paths.discover(a, ("event", "place"), ("event", "ship"), 2)
    assert {r["support"] for r in rows} and all(0 <= r["selectivity"] <= 1 for r in rows)
    s = found[0]
    every, ahead = paths.connections(a, s).count(), paths.connections(a, s, "forward").count()
    assert ahead <= every and paths.connections(a, s, selection="first").count() == paths.connections(a, s).select("source").distinct().count()
    assert paths.connections(a, s, dedup=False).count() >= every


def test_partial_traces():
    a, b = PartialTrace.of_sequence(list("abc")), PartialTrace({"z": "c", "x": "a", "y": "b"}, {("x", "y"), ("y", "z")})
    assert a.same_as(b) and a.starts() == {"e0"} and a.ends() == {"e2"} and "digraph" in a.to_dot()
    b.relate("x", "z")
    assert not a.same_as(b)
    b.remove("y")
    assert b.before("z") == {"x"} and b.after("x") == {"z"}


def test_maps():
    ms = [("item", "order", "of"), ("order", "customer", "by"), ("route", "item", "has")]
    assert maps.rebuilt({"item"}, ms) == {"item", "order", "customer"} and maps.least_kept({"item", "order", "customer", "route", "lone"}, ms) == {"route", "lone"}


def test_rules_have_no_small_countermodel():
    """Reductions and negative rules against all logs within small bounds."""
    arc = lambda a, b, arrow, v: Arc(a, b, arrow, Label([("x", v)]))
    r = random.Random(3)
    for _ in range(12):
        some = [arc(r.choice("abc"), r.choice("abc"), r.choice(("AS", "EF", "EP")), 2) for _ in range(4)]
        some = [a for a in some if a.source != a.target]
        kept = reduce_arcs(some)
        for gone in set(some) - set(kept):
            assert entails(kept, gone), (kept, gone)
    carried = lambda log: all(any(o[0] == "x" for o in objs) for _, objs in log)
    facts = {(s, "x"): (True, False) for s in "abc"}
    for arrow in ("AS", "EF", "EP"):
        for step in ("AS", "EF", "EP"):
            pos = arc("a", "b", step, 2)
            k = Knowledge([pos], facts, {})
            p, c = Arc("b", "c", arrow, Label.of(any=["x"]), 0, 0), Arc("a", "c", arrow, Label.of(any=["x"]), 0, 0)
            if edges([p, c], k, ["source"]):
                assert entails([pos, p], c, side=carried), (step, arrow)
            p, c = Arc("c", "b", arrow, Label.of(any=["x"]), 0, 0), Arc("c", "a", arrow, Label.of(any=["x"]), 0, 0)
            if edges([p, c], k, ["target"]):
                assert entails([pos, p], c, side=carried), (step, arrow)


def test_registry(spark, tmp_path):
    names = registry.functions()
    assert len(names) > 80 and names["oc_conversion"].schema()["required"] == ["log", "activity", "src_type", "tgt_type"]
    ocel.write_ocel(micro(spark, FIXTURE), str(tmp_path / "a.json"))
    got = registry.plain(registry.call(spark, "oc_dfg_of_type", {"log": str(tmp_path / "a.json"), "ob_type": "o"}))
    assert {"source": "place", "target": "pay", "count": 2} in got
    assert registry.plain(registry.call(spark, "declare_discover", {"log": str(tmp_path / "a.json"), "options": '{"noise": 0.0}'}))
    with pytest.raises(TypeError):
        registry.call(spark, "oc_facts", {"nope": 1})


def test_stream(spark, tmp_path):
    schema = "case_id string, activity string, ts timestamp, pos long"
    for k, rows in enumerate(([("1", "a", 0), ("1", "c", 20)], [("1", "b", 15), ("2", "x", 40)], [("9", "end", 600)], [("9", "end", 601)])):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = follow(src, "30 minutes").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["source"], r["target"]) for r in spark.sql("SELECT * FROM pairs WHERE case_id = '1'").collect()} == {("a", "b"), ("b", "c")}
