"""Operators on case logs (case_id, activity, ts, pos, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.operators import lives

START, END = "__START", "__END"


def _by_case(*order: str):
    return W.partitionBy("case_id").orderBy(*(order or ("ts", "pos")))


def dfg_edges(log: DataFrame) -> DataFrame:
    """(source, target, count) of directly following activities within a case."""
    after = lives.neighbours(log.select("case_id", "activity", "ts", "pos"), ["case_id"], ["ts", "pos"], {"target": "activity"})
    return after.filter("target IS NOT NULL").groupBy(F.col("activity").alias("source"), "target").agg(F.count("*").alias("count"))


def dfg_nodes(log: DataFrame) -> DataFrame:
    """(activity, count, starts, ends): occurrences, and cases that start or end there."""
    ends = log.groupBy("case_id").agg(F.min_by("activity", F.struct("ts", "pos")).alias("s"), F.max_by("activity", F.struct("ts", "pos")).alias("e"))
    marks = log.select("activity", F.lit("n").alias("mark")).unionByName(ends.select(F.explode(F.array(F.struct(F.col("s").alias("activity"), F.lit("s").alias("mark")), F.struct(F.col("e").alias("activity"), F.lit("e").alias("mark")))).alias("m")).select("m.*"))
    total = lambda mark: F.count_if(F.col("mark") == mark)
    return marks.groupBy("activity").agg(total("n").alias("count"), total("s").alias("starts"), total("e").alias("ends"))


def traces(log: DataFrame) -> DataFrame:
    """(case_id, trace) with the activities in order."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "pos", "activity")))
    return log.groupBy("case_id").agg(F.transform(rows, lambda x: x["activity"]).alias("trace"))


def variants(log: DataFrame) -> DataFrame:
    """(trace, freq) of distinct activity sequences."""
    return traces(log).groupBy("trace").agg(F.count("*").alias("freq"))


def variant_share(log: DataFrame) -> DataFrame:
    """variants with their percentage of all cases."""
    v = variants(log)
    return v.withColumn("percent", F.round(F.col("freq") * 100.0 / F.sum("freq").over(W.partitionBy()), 6))


def top_variants(log: DataFrame, n: int) -> DataFrame:
    """The n most frequent variants, ties by trace; a top-k report."""
    return variants(log).orderBy(F.desc("freq"), "trace").limit(n)


def with_start_end(v: DataFrame) -> DataFrame:
    """variants with artificial first and last activities."""
    return v.withColumn("trace", F.concat(F.array(F.lit(START)), "trace", F.array(F.lit(END))))


def variant_dfg(v: DataFrame) -> DataFrame:
    """(source, target, count) of variants weighted by frequency; no pass over the events."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("trace") - 2), lambda i: F.struct(F.get("trace", i).alias("source"), F.get("trace", i + 1).alias("target")))
    return v.filter(F.size("trace") > 1).select(F.explode(pairs).alias("p"), "freq").groupBy("p.source", "p.target").agg(F.sum("freq").alias("count"))


def filter_dfg(edges: DataFrame, absolute: float = 1, relative: float = 0.0) -> DataFrame:
    """Edges of at least absolute and at least relative times the mean of the source's outgoing or
    the target's incoming edges."""
    out, into = F.avg("count").over(W.partitionBy("source")), F.avg("count").over(W.partitionBy("target"))
    return edges.withColumn("o", out).withColumn("i", into).filter(
        (F.col("count") >= absolute) & ((F.col("count") >= relative * F.col("o")) | (F.col("count") >= relative * F.col("i")))).drop("o", "i")


def neighbours(edges: DataFrame, activity: str, least: int = 1, incoming: bool = False) -> DataFrame:
    """Activities before or after one, with at least so many occurrences."""
    a, b = ("target", "source") if incoming else ("source", "target")
    return edges.filter((F.col(a) == activity) & (F.col("count") >= least)).select(F.col(b).alias("activity"), "count")


def without_activity(edges: DataFrame, activity: str) -> DataFrame:
    return edges.filter((F.col("source") != activity) & (F.col("target") != activity))


def without_relation(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.filter(~((F.col("source") == source) & (F.col("target") == target)))


def add_relation(edges: DataFrame, source: str, target: str, count: int) -> DataFrame:
    """edges with count more of one relation."""
    more = edges.sparkSession.createDataFrame([(source, target, count)], "source string, target string, count long")
    return edges.unionByName(more).groupBy("source", "target").agg(F.sum("count").alias("count"))


def class_identity(*keys: str) -> Column:
    """Values of the keys joined by +; missing ones are empty."""
    return F.concat_ws("+", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def histogram(log: DataFrame, bins: int) -> DataFrame:
    """(activity, bin, centre_us, count): equal bins between the first and last time; the last bin
    holds its right edge, and all events are in bin 0 when there is one time."""
    ends = log.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi"))
    t = F.unix_micros("ts")
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(width > 0, F.least(F.floor((t - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    rows = log.filter("ts IS NOT NULL").join(F.broadcast(ends)).select("activity", k.alias("bin"), F.round(F.col("lo") + (k + 0.5) * width).cast("long").alias("centre_us"))
    return rows.groupBy("activity", "bin", "centre_us").agg(F.count("*").alias("count"))


X_AXES = ("time", "since_case_start", "since_log_start", "step")
Y_AXES = ("case", "activity", "case_by_duration", "case_by_length")
COLOURS = ("activity", "case", "hour", "weekday", "none")


def dotted_chart(log: DataFrame, x: str = "time", y: str = "case", colour: str = "activity") -> DataFrame:
    """(case_id, pos, x, y, colour) of every event. Cases are numbered by their first event (or by
    duration or length), activities by their first appearance."""
    if x not in X_AXES or y not in Y_AXES or colour not in COLOURS:
        raise ValueError(f"axes are {X_AXES}, {Y_AXES}, {COLOURS}")
    t = F.unix_micros("ts")
    per = log.groupBy("case_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    rows = log.join(per, "case_id").withColumn("step", F.row_number().over(_by_case()) - 1)
    if x == "since_log_start":
        rows = rows.join(F.broadcast(log.agg(F.min("ts").alias("log_start"))))
    at = {"time": t, "since_case_start": t - F.unix_micros("first"), "step": F.col("step").cast("long")}.get(x)
    at = t - F.unix_micros("log_start") if at is None else at
    key = {"case": ("first", "case_id"), "case_by_duration": ("dur", "case_id"), "case_by_length": ("n", "case_id")}.get(y)
    if key:
        number = numbered(per.withColumn("dur", F.unix_micros("last") - F.unix_micros("first")), list(key), "y").select("case_id", "y")
        rows = rows.join(number, "case_id")
    else:
        number = log.groupBy("activity").agg(F.min(F.struct("ts", "pos")).alias("f")).select("activity", (F.row_number().over(W.orderBy("f", "activity")) - 1).alias("y"))  # a row per activity
        rows = rows.join(F.broadcast(number), "activity")
    c = {"activity": F.col("activity"), "case": F.col("case_id"), "hour": F.hour("ts").cast("string"), "weekday": F.dayofweek("ts").cast("string"), "none": F.lit("")}[colour]
    return rows.select("case_id", "pos", at.alias("x"), F.col("y").cast("long").alias("y"), c.alias("colour"))


#: Ranges that a global order is worked out in.
RANGES = 64


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the rank from 0 of each row in a global order of all rows, without ordering them in
    one task: the first key's quantiles cut ranges, each range is numbered for itself, and the sizes
    of the ranges before it (RANGES rows) are added. order starts with a number or a time."""
    first = F.unix_micros(order[0]) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0]).cast("long")
    keyed = df.withColumn("_k", first)
    cuts = keyed.agg(F.percentile_approx("_k", [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))

    def tree(i: int, j: int) -> Column:
        m = (i + j) // 2
        return F.lit(i) if i == j else F.when(F.col("_k") < cuts[m], tree(i, m)).otherwise(tree(m + 1, j))

    ranged = keyed.withColumn("_r", F.when(F.col("_k").isNull(), -1).otherwise(tree(0, len(cuts))))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_r").orderBy(*order)) - 1
    return ranged.withColumn("_i", own).join(F.broadcast(before), "_r").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_k", "_r", "_i", "_before")


def log_stats(log: DataFrame) -> DataFrame:
    """One row: events, cases, activities, mean events per case."""
    return log.agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.count_distinct("activity").alias("activities")).withColumn(
        "mean_events", F.round(F.col("events") / F.col("cases"), 6))


def split_by_activities(log: DataFrame, parts: list[set[str]]) -> list[DataFrame]:
    """One log per set of activities. Cases without events there are absent from the events of a
    part; split_traces keeps them as empty traces. Every activity must be in a set."""
    known = set().union(*parts)
    missing = log.select("activity").distinct().filter(~F.col("activity").isin(*known)).limit(1).collect()
    if missing:
        raise ValueError(f"activity {missing[0][0]!r} is in no part")
    return [log.filter(F.col("activity").isin(*p)) for p in parts]


def split_traces(log: DataFrame, parts: list[set[str]]) -> DataFrame:
    """(part, case_id, trace): each trace projected on each set, empty ones kept."""
    t = traces(log)
    out = [t.select(F.lit(k).alias("part"), "case_id", _project(p)) for k, p in enumerate(parts)]
    one = out[0]
    for o in out[1:]:
        one = one.unionByName(o)
    return one


def _project(part: set[str]) -> Column:
    names = sorted(part)
    return F.filter("trace", lambda a: a.isin(*names)).alias("trace")


def random_activity_split(activities: list[str], n: int, seed: int) -> list[set[str]]:
    """A random partition of the activities into n sets, some maybe empty."""
    import random

    r = random.Random(seed)
    out: list[set[str]] = [set() for _ in range(n)]
    for a in sorted(activities):
        out[r.randrange(n)].add(a)
    return out


def random_event_split(log: DataFrame, n: int, seed: int) -> DataFrame:
    """log with a column part from 0 to n - 1, drawn from the event's identity and the seed."""
    return log.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "case_id", "pos", "activity"), F.lit(n)).cast("int"))


def eventually_pairs(log: DataFrame) -> DataFrame:
    """(source, target, cases, together) per ordered pair: cases where some source is before some
    target, and cases that hold both; from first and last positions, without pairing events."""
    w = _by_case()
    ends = log.withColumn("n", F.row_number().over(w)).groupBy("case_id", "activity").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a = ends.select("case_id", F.col("activity").alias("source"), F.col("lo").alias("l"))
    b = ends.select("case_id", F.col("activity").alias("target"), F.col("hi").alias("h"))
    return a.join(b, "case_id").filter("source <> target").groupBy("source", "target").agg(F.count_if(F.col("l") < F.col("h")).alias("cases"), F.count("*").alias("together"))


def negative_baseline(log: DataFrame) -> DataFrame:
    """(constraint, source, target): pairs of activities that never share a case (NotCoExistence),
    never follow (NotSuccession: target never after source), or never precede (NotPrecedence)."""
    acts = log.select("activity").distinct()
    pairs = acts.select(F.col("activity").alias("source")).join(F.broadcast(acts.select(F.col("activity").alias("target"))), F.expr("source <> target"))
    seen = pairs.join(eventually_pairs(log), ["source", "target"], "left").join(
        eventually_pairs(log).select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("cases").alias("back")), ["source", "target"], "left")
    kinds = F.array(
        F.when(F.col("together").isNull(), F.lit("NotCoExistence")), F.when(F.coalesce("cases", F.lit(0)) == 0, F.lit("NotSuccession")),
        F.when(F.coalesce("back", F.lit(0)) == 0, F.lit("NotPrecedence")))
    return seen.select(F.explode(F.array_compact(kinds)).alias("constraint"), "source", "target")
