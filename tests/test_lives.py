"""Neighbours within long lives, and the operators that use them."""

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.log import OCLog
from loomtrace.operators import cases, lives, objects


def plain(rows, step):
    w = W.partitionBy("k").orderBy("t", "i")
    return rows.select("*", F.lead("v", step).over(w).alias("a"), F.lead("t", step).over(w).alias("b"))


@pytest.mark.parametrize("step", [1, -1])
def test_neighbours_equal_the_window(spark, step):
    """Every third row is of one key, another key is null, times tie."""
    k = F.when(F.col("i") % 3 == 0, "hot").when(F.col("i") % 7 == 0, None).otherwise((F.col("i") % 900).cast("string"))
    rows = spark.range(60_000).withColumnRenamed("id", "i").select("i", k.alias("k"), (F.pmod(F.xxhash64("i"), F.lit(4000))).alias("t"), F.concat(F.lit("v"), (F.col("i") % 11).cast("string")).alias("v"))
    got = lives.neighbours(rows, ["k"], ["t", "i"], {"a": "v", "b": "t"}, step, long=5000)
    want = plain(rows, step)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_long_life_is_spread(spark):
    """A third of a million rows of one key: no range has three times the rows of the median one."""
    rows = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("t"), F.col("id").alias("i")).filter("i % 3 = 0")
    n = [r["count"] for r in lives.ranged(rows, ["k"], ["t", "i"], 333_334).groupBy("k", "_range").count().collect()]
    assert len(n) > 100 and max(n) < 3 * statistics.median(n) and sum(n) == 333_334


def test_one_time_for_all(spark):
    """Equal rows cannot be cut apart, which changes nothing."""
    rows = spark.range(3000).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), F.lit(2).alias("i"), F.lit("v").alias("v"))
    got = lives.neighbours(rows, ["k"], ["t", "i"], {"a": "v"}, long=10)
    assert got.filter("a IS NULL").count() == 1 and got.count() == 3000
    assert lives.neighbours(rows.limit(0), ["k"], ["t", "i"], {"a": "v"}, long=10).collect() == []


def test_operators_on_long_lives(spark, monkeypatch):
    r = random.Random(3)
    ev = [(f"e{i}", r.choice("abc"), None) for i in range(400)]
    times = {e: r.randrange(150) for e, _, _ in ev}
    log = OCLog.of(spark, ev, [(f"o{k}", "order" if k % 2 else "item") for k in range(12)], [(e, f"o{o}", "q") for e, _, _ in ev for o in {0 if r.random() < 0.5 else r.randrange(12), r.randrange(12)}])
    at = spark.createDataFrame(list(times.items()), "ev_id string, s long")
    log = log.with_(ev=log.ev.drop("ts").join(at, "ev_id").select("ev_id", "ev_type", F.timestamp_seconds("s").alias("ts")))
    flat = objects.flatten(log, "item")
    made = (
        lambda: objects.object_dfg(log), lambda: objects.dfg_of_type(log, "item"), lambda: objects.sync_times(log), lambda: objects.sojourn_times(log),
        lambda: objects.waiting_times(log), lambda: cases.dfg_edges(flat))
    rows = lambda f: sorted(map(tuple, f().collect()), key=repr)
    want = [rows(f) for f in made]
    counted, own = [], lives._ranges
    monkeypatch.setattr(lives.neighbours, "__defaults__", (1, None, 40))
    monkeypatch.setattr(lives, "_ranges", lambda *a: counted.append(1) or own(*a))
    assert [rows(f) for f in made] == want and len(counted) == len(made)
    both = {r[0]: (r[3], r[4], r[5]) for r in want[4]}
    assert {r[0]: (r[2], r[3]) for r in want[2]} == {k: v[1:] for k, v in both.items()} and {r[0]: r[2] for r in want[3]} == {k: v[0] for k, v in both.items()}


def test_starts_and_ends(spark):
    log = spark.createDataFrame([("1", "a", None, 0), ("1", "b", None, 1), ("1", "a", None, 2), ("2", "c", None, 5)], "case_id string, activity string, ts timestamp, pos long")
    assert sorted(map(tuple, cases.dfg_nodes(log).collect())) == [("a", 2, 1, 1), ("b", 1, 0, 0), ("c", 1, 1, 1)]
