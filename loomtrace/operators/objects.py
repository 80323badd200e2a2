"""Relational access to, and statistics of, object-centric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.log import OCLog, ordered
from loomtrace.operators.lives import neighbours

INIT, EXIT = "<init>", "<exit>"


# -- navigation


def events_of_type(log: OCLog, t: str) -> DataFrame:
    return log.ev.filter(F.col("ev_type") == t)


def objects_of_type(log: OCLog, t: str) -> DataFrame:
    return log.ob.filter(F.col("ob_type") == t)


def event_types(log: OCLog) -> DataFrame:
    return log.ev.select("ev_type").distinct()


def object_types(log: OCLog) -> DataFrame:
    return log.ob.select("ob_type").distinct()


def e2o_of(log: OCLog, ev_type: str | None = None, ob_type: str | None = None, qualifier: str | None = None) -> DataFrame:
    """Event-object relations with types, restricted as asked; one row per qualifier."""
    out = log.e2o_raw
    for c, v in (("ev_type", ev_type), ("ob_type", ob_type), ("qualifier", qualifier)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    return out


def o2o_of(log: OCLog, src_type: str | None = None, tgt_type: str | None = None, qualifier: str | None = None) -> DataFrame:
    """Object-object relations with both types, restricted as asked."""
    out = log.o2o_typed
    for c, v in (("src_type", src_type), ("tgt_type", tgt_type), ("qualifier", qualifier)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    return out


def objects_of_event(log: OCLog, ev_id: str) -> DataFrame:
    return log.e2o.filter(F.col("ev_id") == ev_id).select("qualifier", "ob_id")


def events_of_object(log: OCLog, ob_id: str) -> DataFrame:
    return log.e2o.filter(F.col("ob_id") == ob_id).join(log.ev, "ev_id").select("qualifier", "ev_id", "ev_type", "ts")


def full_events(log: OCLog) -> DataFrame:
    """Events with their relations and attributes nested."""
    rel = log.e2o.groupBy("ev_id").agg(F.array_sort(F.collect_list(F.struct("ob_id", "qualifier"))).alias("relationships"))
    attr = log.ev_attr.groupBy("ev_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    return log.ev.join(rel, "ev_id", "left").join(attr, "ev_id", "left")


def full_objects(log: OCLog) -> DataFrame:
    """Objects with their relations and attribute history nested."""
    rel = log.o2o.groupBy(F.col("src_id").alias("ob_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("tgt_id").alias("ob_id"), "qualifier"))).alias("relationships"))
    attr = log.obj_attr.groupBy("ob_id").agg(F.array_sort(F.collect_list(F.struct("ts", "name", "value"))).alias("attributes"))
    return log.ob.join(rel, "ob_id", "left").join(attr, "ob_id", "left")


def entities(log: OCLog) -> DataFrame:
    """Events and objects in one table (kind, id, type, ts)."""
    return log.ev.select(F.lit("event").alias("kind"), F.col("ev_id").alias("id"), F.col("ev_type").alias("type"), "ts").unionByName(
        log.ob.select(F.lit("object").alias("kind"), F.col("ob_id").alias("id"), F.col("ob_type").alias("type"), F.lit(None).cast("timestamp").alias("ts")))


def attribute_changes(log: OCLog, ob_id: str) -> DataFrame:
    """Attribute history of one object; an unknown id is an error."""
    if log.ob.filter(F.col("ob_id") == ob_id).isEmpty():
        raise KeyError(ob_id)
    return log.obj_attr.filter(F.col("ob_id") == ob_id).orderBy("ts", "name")


# -- edits; each returns a new log


def add_events(log: OCLog, ev: DataFrame, e2o: DataFrame | None = None) -> OCLog:
    """New events; ids that exist are skipped."""
    fresh = ev.join(log.ev.select("ev_id"), "ev_id", "left_anti").select("ev_id", "ev_type", "ts")
    return log.with_(ev=log.ev.unionByName(fresh), e2o=log.e2o if e2o is None else add_e2o(log, e2o).e2o)


def add_objects(log: OCLog, ob: DataFrame) -> OCLog:
    return log.with_(ob=log.ob.unionByName(ob.join(log.ob.select("ob_id"), "ob_id", "left_anti").select("ob_id", "ob_type")))


def add_e2o(log: OCLog, e2o: DataFrame) -> OCLog:
    """New relations; triples that exist are skipped."""
    return log.with_(e2o=log.e2o.unionByName(e2o.join(log.e2o, ["ev_id", "ob_id", "qualifier"], "left_anti").select("ev_id", "ob_id", "qualifier")))


def add_o2o(log: OCLog, o2o: DataFrame) -> OCLog:
    return log.with_(o2o=log.o2o.unionByName(o2o.join(log.o2o, ["src_id", "tgt_id", "qualifier"], "left_anti").select("src_id", "tgt_id", "qualifier")))


def delete_e2o(log: OCLog, pairs: DataFrame) -> OCLog:
    return log.with_(e2o=log.e2o.join(pairs, ["ev_id", "ob_id"], "left_anti"))


def delete_o2o(log: OCLog, pairs: DataFrame) -> OCLog:
    return log.with_(o2o=log.o2o.join(pairs, ["src_id", "tgt_id"], "left_anti"))


def delete_events(log: OCLog, ids: DataFrame) -> OCLog:
    gone = ids.select("ev_id")
    return log.with_(ev=log.ev.join(gone, "ev_id", "left_anti"), e2o=log.e2o.join(gone, "ev_id", "left_anti"), ev_attr=log.ev_attr.join(gone, "ev_id", "left_anti"))


def delete_objects(log: OCLog, ids: DataFrame) -> OCLog:
    gone = ids.select("ob_id")
    src, tgt = gone.withColumnRenamed("ob_id", "src_id"), gone.withColumnRenamed("ob_id", "tgt_id")
    return log.with_(ob=log.ob.join(gone, "ob_id", "left_anti"), e2o=log.e2o.join(gone, "ob_id", "left_anti"),
                     o2o=log.o2o.join(src, "src_id", "left_anti").join(tgt, "tgt_id", "left_anti"), obj_attr=log.obj_attr.join(gone, "ob_id", "left_anti"))


def without_orphans(log: OCLog) -> OCLog:
    """Without the objects that no event touches; their relations with events stay as they are."""
    kept = {"pairs": log.pairs, "raw": log.raw, "sizes": log.sizes}
    return log.with_(ob=log.ob.join(log.e2o.select("ob_id"), "ob_id", "left_semi"), **kept)


def linked(log: OCLog) -> OCLog:
    """Integrity on load: first event and object of each id, no relation to unknown ids."""
    ev = log.ev.groupBy("ev_id").agg(F.min(F.struct("ts", "ev_type")).alias("m")).select("ev_id", "m.ev_type", "m.ts")
    ob = log.ob.groupBy("ob_id").agg(F.min("ob_type").alias("ob_type"))
    ids = ob.select("ob_id")
    e2o = log.e2o.join(ev.select("ev_id"), "ev_id", "left_semi").join(ids, "ob_id", "left_semi").select("ev_id", "ob_id", "qualifier")
    o2o = log.o2o.join(ids.withColumnRenamed("ob_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("ob_id", "tgt_id"), "tgt_id", "left_semi")
    return log.with_(ev=ev, ob=ob, e2o=e2o, o2o=o2o.select("src_id", "tgt_id", "qualifier"))


# -- counts


def type_counts(log: OCLog) -> DataFrame:
    """(kind, type, count); declared types without members count 0."""
    got = entities(log).groupBy("kind", "type").agg(F.count("*").alias("count"))
    if log.types is None:
        return got
    known = log.types.select("kind", "type").distinct()
    return known.join(got, ["kind", "type"], "full").select("kind", "type", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def e2o_counts(log: OCLog) -> DataFrame:
    """(ev_type, ob_type, count), one for each qualifier of a pair."""
    return log.e2o_raw.groupBy("ev_type", "ob_type").agg(F.count("*").alias("count"))


def conversion(log: OCLog, activity: str, src_type: str, tgt_type: str) -> DataFrame:
    """(sources, converted): objects of src_type linked by O2O to an object of tgt_type that the
    activity touches."""
    hit = log.e2o_d.filter((F.col("ev_type") == activity) & (F.col("ob_type") == tgt_type)).select(F.col("ob_id").alias("tgt_id"))
    done = log.o2o.join(hit, "tgt_id", "left_semi").select(F.col("src_id").alias("ob_id")).distinct().withColumn("hit", F.lit(1))
    src = objects_of_type(log, src_type).join(done, "ob_id", "left")
    return src.agg(F.count("*").alias("sources"), F.count("hit").alias("converted"))


def per_event_counts(log: OCLog) -> DataFrame:
    """(ev_id, ev_type, ob_type, n): distinct objects of a type in an event that carries it."""
    return log.e2o_d.groupBy("ev_id", "ev_type", "ob_type").agg(F.count("*").alias("n"))


def involvements(log: OCLog) -> DataFrame:
    """(ev_type, ob_type, low, high) over the events that carry the type."""
    return per_event_counts(log).groupBy("ev_type", "ob_type").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def multiplicity(log: OCLog) -> DataFrame:
    """(ev_type, ob_type, events, carrying, converging, high)."""
    n = log.ev.groupBy("ev_type").agg(F.count("*").alias("events"))
    c = per_event_counts(log).groupBy("ev_type", "ob_type").agg(F.count("*").alias("carrying"), F.count_if(F.col("n") >= 2).alias("converging"), F.max("n").alias("high"))
    return c.join(n, "ev_type").select("ev_type", "ob_type", "events", "carrying", "converging", "high")


def associated(log: OCLog, reverse: bool = False) -> DataFrame:
    """(ev_id, ev_type, first, second, ob_id): objects linked by O2O to an event's objects."""
    o = o2o_of(log)
    a, b = ("tgt", "src") if reverse else ("src", "tgt")
    links = o.select(F.col(f"{a}_id").alias("ob_id"), F.col(f"{b}_id").alias("other"), F.col(f"{b}_type").alias("second"))
    # dealt by event, which serves both the distinct rows here and what is counted of an event
    met = log.e2o_d.join(links, "ob_id").select("ev_id", "ev_type", F.col("ob_type").alias("first"), "second", F.col("other").alias("ob_id"))
    return met.repartition("ev_id").distinct()


def association_multiplicity(log: OCLog, reverse: bool = False) -> DataFrame:
    """multiplicity over the objects that events reach by one O2O step."""
    n = log.ev.groupBy("ev_type").agg(F.count("*").alias("events"))
    per = associated(log, reverse).groupBy("ev_id", "ev_type", "first", "second").agg(F.count("*").alias("n"))
    c = per.groupBy("ev_type", "first", "second").agg(F.count("*").alias("carrying"), F.count_if(F.col("n") >= 2).alias("converging"), F.max("n").alias("high"))
    return c.join(n, "ev_type").select("ev_type", "first", "second", "events", "carrying", "converging", "high")


def o2o_involvements(log: OCLog, reverse: bool = False) -> DataFrame:
    """(src_type, tgt_type, low, high) of links per object that has some. Forward, each qualifier
    counts; reverse, distinct sources of a target."""
    o = o2o_of(log)
    if reverse:
        per = o.select("tgt_id", "src_id", "src_type", "tgt_type").distinct().groupBy("tgt_id", "src_type", "tgt_type").agg(F.count("*").alias("n"))
    else:
        per = o.groupBy("src_id", "src_type", "tgt_type").agg(F.count("*").alias("n"))
    return per.groupBy("src_type", "tgt_type").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def profile(log: OCLog) -> DataFrame:
    """(ev_type, ob_type, always_present, at_most_one_event_per_object, low, high): facts and involvements in one."""
    n = log.ev.groupBy("ev_type").agg(F.count("*").alias("events"))
    carry = per_event_counts(log).groupBy("ev_type", "ob_type").agg(F.count("*").alias("carrying"), F.min("n").alias("low"), F.max("n").alias("high"))
    # counted by event id, which is never null, so that both sides read the same columns and share what is dealt
    once = log.e2o_d.groupBy("ev_type", "ob_type", "ob_id").agg(F.count("ev_id").alias("k")).groupBy("ev_type", "ob_type").agg(F.max("k").alias("k"))
    return carry.join(n, "ev_type").join(once, ["ev_type", "ob_type"]).select(
        "ev_type", "ob_type", (F.col("carrying") == F.col("events")).alias("always_present"), (F.col("k") <= 1).alias("at_most_one_event_per_object"), "low", "high")


def facts(log: OCLog) -> DataFrame:
    """(ev_type, ob_type, always_present, at_most_one_event_per_object)."""
    return profile(log).drop("low", "high")


# -- lives of objects


def object_traces(log: OCLog, ob_type: str | None = None) -> DataFrame:
    """(ob_id, ob_type, trace), empty for objects without events."""
    ob = log.ob if ob_type is None else objects_of_type(log, ob_type)
    d = log.e2o_d if ob_type is None else log.e2o_d.filter(F.col("ob_type") == ob_type)
    t = d.groupBy("ob_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ev_id", "ev_type"))), lambda x: x["ev_type"]).alias("trace"))
    return ob.join(t, "ob_id", "left").select("ob_id", "ob_type", F.coalesce("trace", F.array().cast("array<string>")).alias("trace"))


def variants_of_type(log: OCLog, ob_type: str) -> DataFrame:
    return object_traces(log, ob_type).groupBy("trace").agg(F.count("*").alias("freq"))


def _sizes(log: OCLog) -> DataFrame:
    """At most how many rows each object has in the event-object tables."""
    if log.sizes is not None:
        return log.sizes
    return log.e2o.groupBy("ob_id").agg(F.count("*").alias("n"))


def dfg_of_type(log: OCLog, ob_type: str) -> DataFrame:
    """(source, target, count) over the lives of objects of a type, on distinct pairs."""
    return _df_pairs(log.e2o_d.filter(F.col("ob_type") == ob_type), log).drop("ob_type")


def _df_pairs(d: DataFrame, log: OCLog) -> DataFrame:
    lives = d.select("ob_type", "ob_id", "ts", "ev_id", "ev_type")
    return neighbours(lives, ["ob_type", "ob_id"], ["ts", "ev_id"], {"target": "ev_type"}, 1, _sizes(log)).filter("target IS NOT NULL").groupBy(
        "ob_type", F.col("ev_type").alias("source"), "target").agg(F.count("*").alias("count"))


def object_dfg(log: OCLog) -> DataFrame:
    """(ob_type, source, target, count) for every type; an event counts once for each qualifier."""
    return _df_pairs(log.e2o_raw, log)


def object_dfg_nodes(log: OCLog) -> DataFrame:
    """(ob_type, activity, count, starts, ends) for every type; one pass over the relations."""
    at = F.struct(*ordered(), "ev_type")
    per = log.e2o_raw.groupBy("ob_type", "ob_id", F.col("ev_type").alias("activity")).agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    life = W.partitionBy("ob_type", "ob_id")  # a row for each activity
    ends = per.select("ob_type", "activity", "n", (F.col("lo") == F.min("lo").over(life)).alias("first"), (F.col("hi") == F.max("hi").over(life)).alias("last"))
    return ends.groupBy("ob_type", "activity").agg(F.sum("n").alias("count"), F.count_if("first").alias("starts"), F.count_if("last").alias("ends"))


def flatten(log: OCLog, ob_type: str) -> DataFrame:
    """A case log with one case for each object of the type; one event per (event, object, qualifier)."""
    return log.e2o_raw.filter(F.col("ob_type") == ob_type).select(F.col("ob_id").alias("case_id"), F.col("ev_type").alias("activity"), "ts", F.col("ev_id").alias("pos"), "qualifier")


def init_exit_events(log: OCLog) -> DataFrame:
    """(ev_id, ev_type, ts, ob_id): for each object one event at its first and one at its last time,
    at the epoch when it has none."""
    ends = log.ob.join(log.e2o_d.groupBy("ob_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), "ob_id", "left")
    epoch = F.timestamp_seconds(F.lit(0))
    one = lambda mark, at: ends.select(F.concat(F.lit(mark + "_"), "ob_id").alias("ev_id"), F.concat(F.lit(mark + " "), "ob_type").alias("ev_type"), F.coalesce(at, epoch).alias("ts"), "ob_id")
    return one(INIT, "lo").unionByName(one(EXIT, "hi"))


def with_init_exit(log: OCLog) -> OCLog:
    more = init_exit_events(log)
    return log.with_(ev=log.ev.unionByName(more.select("ev_id", "ev_type", "ts")), e2o=log.e2o.unionByName(more.select("ev_id", "ob_id", F.lit("").alias("qualifier"))))


# -- performance


def _predecessors(log: OCLog) -> DataFrame:
    """(ev_id, ob_id, ob_type, ts, prev): time of the object's event before, by (time, id)."""
    return neighbours(log.e2o_d.select("ev_id", "ev_type", "ob_id", "ob_type", "ts"), ["ob_id"], ["ts", "ev_id"], {"prev": "ts"}, -1, _sizes(log)).filter("prev IS NOT NULL")


def _top(df: DataFrame, value: str, top_k: int | None) -> DataFrame:
    return df if top_k is None else df.orderBy(F.desc(value), "ev_id").limit(top_k)


def sync_times(log: OCLog, top_k: int | None = None) -> DataFrame:
    """(ev_id, ev_type, sync_us, delaying): spread of the times at which an event's objects were
    ready, and the object that came last, ties by least id."""
    u = F.unix_micros("prev")
    ready = _predecessors(log).withColumn("u", u).groupBy("ev_id", "ev_type").agg(F.min("u").alias("lo"), F.min(F.struct((-F.col("u")).alias("k"), "ob_id")).alias("m"))
    return _top(ready.select("ev_id", "ev_type", (-F.col("m.k") - F.col("lo")).alias("sync_us"), F.col("m.ob_id").alias("delaying")), "sync_us", top_k)


def waiting_times(log: OCLog) -> DataFrame:
    """(ev_id, ev_type, ts, sojourn_us, sync_us, delaying, delaying_type): sojourn_times and sync_times in one pass."""
    u = F.unix_micros("prev")
    ready = _predecessors(log).groupBy("ev_id", "ev_type", "ts").agg(F.min(u).alias("lo"), F.min(F.struct((-u).alias("k"), "ob_id", "ob_type")).alias("m"))
    hi = -F.col("m.k")
    return ready.select("ev_id", "ev_type", "ts", (F.unix_micros("ts") - hi).alias("sojourn_us"), (hi - F.col("lo")).alias("sync_us"), F.col("m.ob_id").alias("delaying"), F.col("m.ob_type").alias("delaying_type"))


def sojourn_times(log: OCLog, top_k: int | None = None) -> DataFrame:
    """(ev_id, ev_type, sojourn_us): time since the latest predecessor of any of its objects."""
    p = _predecessors(log).groupBy("ev_id", "ev_type").agg((F.max(F.unix_micros("ts")) - F.max(F.unix_micros("prev"))).alias("sojourn_us"))
    return _top(p, "sojourn_us", top_k)


# -- recorded functional maps


def functional_maps(log: OCLog, least: float = 0.95) -> DataFrame:
    """(first, second, orientation, total, covered): O2O type pairs where each object of first has at
    most one partner, and at least the share least of them has one; both orientations. An object has several
    partners if the least and largest 64-bit hash of theirs differ, so links need not be made distinct."""
    o = o2o_of(log)
    n = log.ob.groupBy(F.col("ob_type").alias("first")).agg(F.count("*").alias("total"))

    def one(a: str, b: str, name: str) -> DataFrame:
        per = o.groupBy(F.col(f"{a}_id").alias("x"), F.col(f"{a}_type").alias("first"), F.col(f"{b}_type").alias("second")).agg(F.min(F.xxhash64(f"{b}_id")).alias("lo"), F.max(F.xxhash64(f"{b}_id")).alias("hi"))
        return per.groupBy("first", "second").agg(F.count_if(F.col("lo") != F.col("hi")).alias("several"), F.count("*").alias("covered")).filter("several = 0").select("first", "second", F.lit(name).alias("orientation"), "covered")

    return one("src", "tgt", "forward").unionByName(one("tgt", "src", "reverse")).join(n, "first").filter(F.col("covered") >= least * F.col("total")).select(
        "first", "second", "orientation", "total", "covered")


def coparticipation_maps(log: OCLog) -> DataFrame:
    """(first, second, objects, mapped, conflict, ambiguous): for each object of first, the objects
    of second present in all of its events that carry second. One such object maps it, none is a
    conflict, several are ambiguous."""
    own = log.e2o_d.groupBy("ev_id").agg(F.collect_list(F.struct("ob_type", "ob_id")).alias("own"))
    # of each object of an event a row for each partner, and one without for each type of partners
    met = own.select("own", F.explode("own").alias("o")).select(F.col("o.ob_id").alias("x"), F.col("o.ob_type").alias("first"), F.filter("own", lambda p: p["ob_type"] != F.col("o.ob_type")).alias("own"))
    kinds = F.transform(F.array_distinct(F.transform("own", lambda p: p["ob_type"])), lambda t: F.struct(t.alias("ob_type"), F.lit(None).cast("string").alias("ob_id")))
    met = met.select("x", "first", F.explode(F.concat("own", kinds)).alias("p")).select("x", "first", F.col("p.ob_type").alias("second"), F.col("p.ob_id").alias("y"))
    both = met.groupBy("x", "first", "second", "y").agg(F.count("*").alias("k"))
    # a partner is in as many events as there are at most, so those of the largest count, if it is that, are in all
    same = both.groupBy("x", "first", "second", "k").agg(F.count("y").alias("m"), F.max(F.col("y").isNull()).alias("all"))
    per = same.groupBy("x", "first", "second").agg(F.max(F.when(F.col("all"), F.col("m"))).alias("m"))
    return per.groupBy("first", "second").agg(F.count("*").alias("objects"), F.count_if(F.col("m") == 1).alias("mapped"), F.count_if(F.col("m") == 0).alias("conflict"), F.count_if(F.col("m") > 1).alias("ambiguous"))


# -- attribute frames


def event_table(log: OCLog, ev_type: str, names: list[str] | None = None) -> DataFrame:
    """id, time and one column for each attribute of events of a type."""
    ev = events_of_type(log, ev_type)
    attr = log.ev_attr.join(ev.select("ev_id"), "ev_id", "left_semi")
    if names is None:
        names = [r[0] for r in attr.select("name").distinct().orderBy("name").collect()]
    wide = attr.groupBy("ev_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]) if names else None
    return ev.select("ev_id", "ts") if wide is None else ev.select("ev_id", "ts").join(wide, "ev_id", "left")


def attribute_history(log: OCLog, ob_type: str, names: list[str]) -> DataFrame:
    """Versions of objects of a type: (ob_id, change_id, from_us, to_us, attributes...), the last
    known value carried forward; version 0 knows nothing and begins at no time."""
    ob = objects_of_type(log, ob_type).select("ob_id")
    at = log.obj_attr.join(ob, "ob_id", "left_semi").groupBy("ob_id", "ts").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    w = W.partitionBy("ob_id").orderBy("ts")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = at.select("ob_id", F.row_number().over(w).alias("change_id"), F.unix_micros("ts").alias("from_us"), F.unix_micros(F.lead("ts").over(w)).alias("to_us"), *[F.last(n, ignorenulls=True).over(run).alias(n) for n in names])
    first = at.groupBy("ob_id").agg(F.unix_micros(F.min("ts")).alias("to_us"))
    zero = ob.join(first, "ob_id", "left").select("ob_id", F.lit(0).alias("change_id"), F.lit(None).cast("long").alias("from_us"), "to_us", *[F.lit(None).cast("string").alias(n) for n in names])
    return zero.unionByName(rows)


def trace_string(trace: Column) -> Column:
    return F.array_join(trace, ">")
