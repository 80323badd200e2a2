"""Cells of event tables, and names of graph tables."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.log import OCLog
from loomtrace.sources import ocel

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_plain_cells_equal_the_grammar(spark):
    r = random.Random(2)
    cells = ["", " ", "/", "a", "a#q", " a # q / b ", "#q", "a/#q", "a#q#r", "a//b/", "é#ü", "\ta\n/ b"] + ["".join(r.choice("ab#/ \t") for _ in range(r.randrange(9))) for _ in range(300)]

    def plain(cell):
        try:
            return [tuple(x) for x in ocel.parse_refs(cell)]
        except ValueError:
            return []

    got = spark.createDataFrame(list(enumerate(cells)), "i int, cell string").select("i", ocel.plain_refs(F.col("cell")).alias("r")).orderBy("i").collect()
    assert [[tuple(x) for x in row["r"]] for row in got] == [plain(c) for c in cells]


def test_cells_with_and_without_attributes(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,activity,timestamp,ot:order\ne1,a,2026-01-22T09:00:00Z,"o1/o2#q{""p"": ""1/2""}"\ne2,a,2026-01-22T10:00:00Z,o1 / o3#r\n')
    log = ocel.read_csv(spark, str(p))
    assert sorted(map(tuple, log.e2o.collect())) == [("e1", "o1", ""), ("e1", "o2", "q"), ("e2", "o1", ""), ("e2", "o3", "r")]
    assert [tuple(x)[:3] for x in log.obj_attr.collect()] == [("o2", "p", "1/2")]
    p.write_text("id,activity,timestamp,ot:order\ne1,a,2026-01-22T09:00:00Z,o1/#q\n")
    assert ocel.read_csv(spark, str(p)).e2o.collect() == []
    with pytest.raises(Exception, match="no object id"):
        ocel.read_csv(spark, str(p), strict=True).e2o.collect()


def test_names():
    name = ocel.Names(("id",))
    assert [name("Event", "a b"), name("Event", "a-b"), name("Event", "A_B"), name("Event", "a b"), name("id")] == ["Event_a_b", "Event_a_b_2", "Event_A_B_3", "Event_a_b", "id_2"]
    assert name("E2O", "x_y", "z") != name("E2O", "x", "y_z")


def test_types_with_one_clean_name_keep_their_tables(spark, tmp_path):
    log = OCLog.of(spark, [("e1", "pick up", T), ("e2", "pick-up", T)], [("o1", "big box"), ("o2", "big/box")], [("e1", "o1", ""), ("e2", "o2", "")], [("o1", "o2", "in")], (), [("e1", "a b", "1"), ("e1", "a-b", "2")])
    ddl = ocel.write_graph(log, str(tmp_path / "g"), typed=True)
    tables = [x.split("(")[0].split()[-1] for x in ddl.splitlines() if x.startswith("CREATE")]
    assert len(tables) == len({t.lower() for t in tables}) and {"Event_pick_up", "Event_pick_up_2", "Object_big_box", "Object_big_box_2"} <= set(tables)

    def ids(table):
        return sorted(r[0] for f in (tmp_path / "g" / table).glob("*.csv") for r in list(csv.reader(f.open()))[1:])

    assert ids("Event_pick_up") + ids("Event_pick_up_2") == ["e1", "e2"] and ids("Object_big_box") + ids("Object_big_box_2") == ["o1", "o2"]
    assert "a_b STRING, a_b_2 STRING" in ddl
