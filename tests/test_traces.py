"""Traces that can't be read harm no other; attributes are read, set and removed by path."""

import gzip

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import attributes as at
from loomtrace.sources import xes

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="2.0">\n<extension name="Concept" prefix="concept" uri="u"/>\n'


def trace(k, inside="", end="</trace>\n"):
    return f'<trace><string key="concept:name" value="c{k}"/><event><string key="concept:name" value="a &lt;{k}&gt;"/><date key="time:timestamp" value="2024-01-01T00:00:0{k % 10}Z"/></event>{inside}{end}'


BROKEN = {
    "a tag that is not closed": lambda k: trace(k, "<event><string key='x' value='1'></event>"),
    "an end that is missing": lambda k: trace(k, end="\n"),
    "text that is no markup": lambda k: trace(k, "<event <<< & >"),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_one_broken_trace(spark, tmp_path, name):
    p = tmp_path / "log.xes"
    p.write_text(HEAD + "".join(BROKEN[name](k) if k == 4 else trace(k) for k in range(10)) + "</log>\n")
    events, errors = xes.read_xes_safely(spark, str(p))
    assert sorted(r["case_id"] for r in events.collect()) == [f"c{k}" for k in range(10) if k != 4]
    bad = errors.collect()
    assert len(bad) == 1 and 'value="c4"' in bad[0]["text"] and bad[0]["file"].endswith("log.xes")
    assert {r["activity"] for r in events.collect()} == {f"a <{k}>" for k in range(10) if k != 4}


def test_sound_files_read_alike(spark, tmp_path):
    text = HEAD + "".join(trace(k, '<event><list key="l"><values><int key="n" value="1"/></values></list></event>' * (k % 3)) for k in range(7)) + "<trace/>\n<trace><string key='concept:name' value='none'/></trace></log>"
    (tmp_path / "a.xes").write_text(text)
    with gzip.open(tmp_path / "b.xes.gz", "wt") as f:
        f.write(text)
    for name in ("a.xes", "b.xes.gz"):
        events, errors = xes.read_xes_safely(spark, str(tmp_path / name))
        assert errors.collect() == []
        plain = xes.read_xes(spark, str(tmp_path / name))
        key = lambda xs: sorted(xs, key=repr)
        assert key(map(repr, strip_all(events))) == key(map(repr, strip_all(plain)))


def strip_all(df):
    return [(None if r["case_id"].startswith("trace") else r["case_id"], r["activity"], r["ts"], r["pos"], sorted((r["attrs"] or {}).items())) for r in df.collect()]


@pytest.mark.parametrize("at_", ["event", "between"])
def test_a_file_that_ends_early(spark, tmp_path, at_):
    """Even when what is there would be a whole trace, were it closed."""
    p = tmp_path / "log.xes"
    p.write_text(HEAD + trace(0) + trace(1) + (trace(2, end="") if at_ == "between" else trace(2, "<event><str", end="")))
    events, errors = xes.read_xes_safely(spark, str(p))
    assert sorted(r["case_id"] for r in events.collect()) == ["c0", "c1"]
    assert [r["error"] for r in errors.collect()] == ["the file ends before the trace"]


def test_large_files_are_read_in_ranges(spark, tmp_path):
    p = tmp_path / "log.xes"
    n = 12_000
    p.write_text(HEAD + "".join("<trace><broken></trace>" if k == 7777 else trace(k, "<event><string key='pad' value='" + "x" * 700 + "'/></event>") for k in range(n)) + "</log>")
    assert p.stat().st_size > 10_000_000
    scan = xes.scan_traces(spark, str(p))
    assert spark.read.option("lineSep", "</trace>").text(str(p)).rdd.getNumPartitions() > 1
    assert scan.filter("error IS NULL").count() == n - 1 and scan.filter("error IS NOT NULL").count() == 1


def attrs(spark):
    nested = '{"string":[{"_key":"c","_value":"1"}],"int":[{"_key":"d","_value":"2"}]}'
    listed = '{"values":{"string":[{"_key":"e","_value":"x"},{"_key":"e","_value":"y"}]}}'
    rows = [(1, {"a": ("string", "v", nested), "l": ("list", None, listed), "k": ("container", None, listed), "i": ("id", "{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}", None)}), (2, {}), (3, None)]
    return spark.createDataFrame(rows, f"n int, attrs {at.ATTRS}")


def one(df, col):
    return [None if r["x"] is None else tuple(r["x"]) for r in df.select("n", col.alias("x")).orderBy("n").collect()]


def test_get(spark):
    df, m = attrs(spark), F.col("attrs")
    assert one(df, at.get(m, "a")) == [("string", "v"), None, None] and one(df, at.get(m, "a", "d")) == [("int", "2"), None, None]
    assert one(df, at.get(m, "l", "e")) == [("string", "x"), None, None] and one(df, at.get(m, "a", "zz")) == [None] * 3 and one(df, at.get(m, "zz", "c")) == [None] * 3


def test_put_and_remove(spark):
    df, m = attrs(spark), F.col("attrs")
    new = df.withColumn("attrs", at.put(m, F.lit("w"), "string", "a"))
    assert one(new, at.get(m, "a")) == [("string", "w")] * 3 and one(new, at.get(m, "a", "c")) == [("string", "1"), None, None]
    deep = df.withColumn("attrs", at.put(m, F.col("n"), "int", "a", "c"))
    assert one(deep, at.get(m, "a", "c")) == [("int", str(k)) for k in (1, 2, 3)] and one(deep, at.get(m, "a", "d")) == [("int", "2"), None, None]
    assert one(deep, at.get(m, "a")) == [("string", "v"), ("container", None), ("container", None)]
    lists = df.withColumn("attrs", at.put(m, F.lit("z"), "string", "l", "f"))
    assert one(lists, at.get(lists["attrs"], "l", "e"))[0] == ("string", "x") and [len(r["x"]) for r in lists.select(at.as_list(F.col("attrs"), "l").alias("x")).limit(1).collect()] == [3]
    gone = df.withColumn("attrs", at.remove(at.remove(m, "a", "c"), "i"))
    assert one(gone, at.get(m, "a", "c")) == [None] * 3 and one(gone, at.get(m, "a", "d"))[0] == ("int", "2") and one(gone, at.get(m, "i")) == [None] * 3 and one(gone, at.get(m, "a"))[0] == ("string", "v")
    last = df.withColumn("attrs", at.remove(at.remove(m, "a", "c"), "a", "d"))
    assert last.select(F.col("attrs")["a"]["children"].alias("x")).first()["x"] is None
    same = df.select(at.remove(m, "a", "nothing").alias("x"), "attrs").collect()
    assert all(r["x"] == r["attrs"] for r in same)
    moved = df.withColumn("attrs", at.rename(m, "a", "l"))
    assert one(moved, at.get(m, "l")) == [("string", "v"), None, None] and one(moved, at.get(m, "a")) == [None] * 3
    with pytest.raises(ValueError):
        at.put(m, F.lit(1), "list", "a")


def test_kinds(spark):
    df, m = attrs(spark), F.col("attrs")
    r = df.select(at.as_uuid(m["i"]).alias("u"), at.as_uuid(m["a"]).alias("no"), at.as_list(m, "l").alias("l"), at.as_list(m, "k").alias("nl"), at.as_container(m, "k").alias("k"), at.as_container(m, "l").alias("nk")).first()
    assert r["u"] == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11" and r["no"] is None and r["nl"] is None and r["nk"] is None
    assert [tuple(x) for x in r["l"]] == [("string", "e", "x"), ("string", "e", "y")] and r["k"] == {"e": "x"}


@pytest.mark.parametrize("name", ["log.json", "log.json.gz", "log.parquet"])
def test_attributes_survive_files(spark, tmp_path, name):
    log = attrs(spark).select(F.col("n").cast("string").alias("case_id"), F.lit("act").alias("activity"), F.timestamp_seconds(F.lit(5)).alias("ts"), F.col("n").cast("long").alias("pos"), "attrs", F.col("attrs").alias("case_attrs"))
    path = str(tmp_path / name)
    xes.write_log(log, path)
    back = xes.read_log(spark, path)
    whole = lambda df: sorted(([(r["case_id"], r["activity"], r["ts"], r["pos"], r["attrs"], r["case_attrs"])] for r in df.collect()), key=repr)
    assert whole(back) == whole(log)
    assert name != "log.json.gz" or list((tmp_path / name).glob("*.gz"))
