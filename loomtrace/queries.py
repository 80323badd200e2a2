"""The queries over event logs, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import oracles
from loomtrace.operators import abstraction, cases, conformance, declare, lattice, negative, objects, paths, reduction
from loomtrace.plans.declare import Arc, Label
from loomtrace.sources.testdata import TRADE_SQL, dialog_log, trade_log, user_day_log, user_log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, trade: bool = False, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{TRADE_SQL.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}" if trade else sql
        return f

    return register


_USER = "u AS (SELECT user_id::VARCHAR AS case_id, event_type AS activity, ts, event_id AS pos FROM events)"
_DAY = "u AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS activity, ts, event_id AS pos FROM events)"
_DIALOG = "u AS (SELECT conv_id::VARCHAR AS case_id, role AS activity, turn AS pos FROM conversations)"
_TRACES = "t AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, pos) AS trace FROM u GROUP BY case_id)"


# -- case logs


@query(f"WITH {_USER}, n AS (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, pos) AS target FROM u) SELECT source, target, count(*) AS count FROM n WHERE target IS NOT NULL GROUP BY 1, 2")
def case_dfg_edges(spark: SparkSession, d: str) -> DataFrame:
    return cases.dfg_edges(user_log(spark, d))


@query(f"WITH {_USER}, n AS (SELECT activity, row_number() OVER (PARTITION BY case_id ORDER BY ts, pos) AS i, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, pos DESC) AS j FROM u) SELECT activity, count(*) AS count, count(*) FILTER (i = 1) AS starts, count(*) FILTER (j = 1) AS ends FROM n GROUP BY 1")
def case_dfg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return cases.dfg_nodes(user_log(spark, d))


@query(f"WITH {_DAY}, {_TRACES} SELECT trace, count(*) AS freq FROM t GROUP BY trace")
def case_variants(spark: SparkSession, d: str) -> DataFrame:
    return cases.variants(user_day_log(spark, d)).select(objects.trace_string(F.col("trace")).alias("trace"), "freq")


@query(f"WITH {_DIALOG}, t AS (SELECT case_id, string_agg(activity, '>' ORDER BY pos) AS trace FROM u GROUP BY case_id), v AS (SELECT trace, count(*) AS freq FROM t GROUP BY trace) SELECT trace, freq, round(freq * 100.0 / sum(freq) OVER (), 6) AS percent FROM v")
def case_variant_share(spark: SparkSession, d: str) -> DataFrame:
    return cases.variant_share(dialog_log(spark, d)).select(objects.trace_string(F.col("trace")).alias("trace"), "freq", "percent")


@query(f"WITH {_DAY}, {_TRACES} SELECT trace, count(*) AS freq FROM t GROUP BY trace ORDER BY freq DESC, trace LIMIT 10")
def case_top_variants(spark: SparkSession, d: str) -> DataFrame:
    text = cases.variants(user_day_log(spark, d)).select(objects.trace_string(F.col("trace")).alias("trace"), "freq")
    return text.orderBy(F.desc("freq"), "trace").limit(10)


@query(f"""WITH {_DAY}, a AS (SELECT case_id, ts, pos, activity FROM u), n AS (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, pos) AS target, row_number() OVER (PARTITION BY case_id ORDER BY ts, pos) AS i, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, pos DESC) AS j FROM a)
SELECT source, target, count(*)::BIGINT AS count FROM (SELECT source, coalesce(target, '__END') AS target FROM n UNION ALL SELECT '__START', source FROM n WHERE i = 1) GROUP BY 1, 2""")
def case_variant_dfg(spark: SparkSession, d: str) -> DataFrame:
    return cases.variant_dfg(cases.with_start_end(cases.variants(user_day_log(spark, d))))


@query(f"WITH {_USER}, n AS (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, pos) AS target FROM u), e AS (SELECT source, target, count(*) AS count FROM n WHERE target IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, avg(count) OVER (PARTITION BY source) AS o, avg(count) OVER (PARTITION BY target) AS i FROM e) SELECT source, target, count FROM m WHERE count >= 5 AND (count >= 1.0 * o OR count >= 1.0 * i)")
def case_filtered_dfg(spark: SparkSession, d: str) -> DataFrame:
    return cases.filter_dfg(cases.dfg_edges(user_log(spark, d)), 5, 1.0)


@query("""WITH e AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), b AS (SELECT event_type AS activity, lo, (hi - lo)::DOUBLE / 24 AS w, least(floor((epoch_us(ts) - lo) / ((hi - lo)::DOUBLE / 24)), 23)::BIGINT AS bin FROM events, e)
SELECT activity, bin, round(lo + (bin + 0.5::DOUBLE) * w)::BIGINT AS centre_us, count(*) AS count FROM b GROUP BY 1, 2, 3""")
def case_time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cases.histogram(user_log(spark, d), 24)


@query(f"""WITH {_USER}, f AS (SELECT case_id, min(ts) AS first FROM u GROUP BY 1), n AS (SELECT case_id, first, row_number() OVER (ORDER BY first, case_id) - 1 AS y FROM f)
SELECT u.case_id, pos, epoch_us(ts) - epoch_us(first) AS x, y, activity AS colour FROM u JOIN n ON u.case_id = n.case_id""")
def case_dotted_chart(spark: SparkSession, d: str) -> DataFrame:
    return cases.dotted_chart(user_log(spark, d), "since_case_start", "case", "activity")


@query(f"""WITH {_DAY}, f AS (SELECT case_id, count(*) AS n FROM u GROUP BY 1), r AS (SELECT case_id, row_number() OVER (ORDER BY n, case_id) - 1 AS y FROM f)
SELECT u.case_id, pos, row_number() OVER (PARTITION BY u.case_id ORDER BY ts, pos) - 1 AS x, y, extract(hour FROM ts)::VARCHAR AS colour FROM u JOIN r ON u.case_id = r.case_id""")
def case_dotted_chart_steps(spark: SparkSession, d: str) -> DataFrame:
    return cases.dotted_chart(user_day_log(spark, d), "step", "case_by_length", "hour")


@query(f"WITH {_DAY} SELECT count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT activity) AS activities, round(count(*)::DOUBLE / count(DISTINCT case_id), 6) AS mean_events FROM u")
def case_log_stats(spark: SparkSession, d: str) -> DataFrame:
    return cases.log_stats(user_day_log(spark, d))


@query(f"WITH {_DAY} SELECT activity || '+' AS identity, count(*) AS count FROM u GROUP BY 1")
def case_class_identity(spark: SparkSession, d: str) -> DataFrame:
    log = user_day_log(spark, d).withColumn("resource", F.lit(None).cast("string"))
    return log.groupBy(cases.class_identity("activity", "resource").alias("identity")).agg(F.count("*").alias("count"))


@query(f"""WITH {_DAY}, l AS (SELECT case_id, activity, min(n) AS lo, max(n) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, pos) AS n FROM u) GROUP BY 1, 2)
SELECT a.activity AS source, b.activity AS target, count(*) FILTER (a.lo < b.hi) AS cases, count(*) AS together FROM l a JOIN l b USING (case_id) WHERE a.activity <> b.activity GROUP BY 1, 2""")
def case_eventually_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cases.eventually_pairs(user_day_log(spark, d))


@query(f"""WITH {_DIALOG}, l AS (SELECT case_id, activity, min(pos) AS lo, max(pos) AS hi FROM u GROUP BY 1, 2), a AS (SELECT DISTINCT activity FROM u),
p AS (SELECT x.activity AS source, y.activity AS target FROM a x, a y WHERE x.activity <> y.activity),
c AS (SELECT a.activity AS source, b.activity AS target, count(*) FILTER (a.lo < b.hi) AS cases, count(*) AS together FROM l a JOIN l b USING (case_id) WHERE a.activity <> b.activity GROUP BY 1, 2),
j AS (SELECT p.source, p.target, c.together, coalesce(c.cases, 0) AS f, coalesce(r.cases, 0) AS b FROM p LEFT JOIN c USING (source, target) LEFT JOIN c r ON r.source = p.target AND r.target = p.source)
SELECT 'NotCoExistence' AS "constraint", source, target FROM j WHERE together IS NULL UNION ALL SELECT 'NotSuccession', source, target FROM j WHERE f = 0 UNION ALL SELECT 'NotPrecedence', source, target FROM j WHERE b = 0""")
def case_negative_baseline(spark: SparkSession, d: str) -> DataFrame:
    return cases.negative_baseline(dialog_log(spark, d))


@query(f"""WITH {_DAY}, {_TRACES}, x AS (SELECT case_id, activity, ts, pos, CASE WHEN activity IN ('click', 'view') THEN 0 ELSE 1 END AS part FROM u), c AS (SELECT DISTINCT case_id FROM u)
SELECT k.part, c.case_id, coalesce(string_agg(x.activity, '>' ORDER BY ts, pos), '') AS trace FROM c CROSS JOIN (VALUES (0), (1)) k(part) LEFT JOIN x ON x.case_id = c.case_id AND x.part = k.part GROUP BY 1, 2""")
def case_split_by_activities(spark: SparkSession, d: str) -> DataFrame:
    log = user_day_log(spark, d)
    acts = {r[0] for r in log.select("activity").distinct().collect()}
    first = {"click", "view"}
    return cases.split_traces(log, [first, acts - first]).select("part", "case_id", objects.trace_string(F.col("trace")).alias("trace"))


# -- object-centric logs


@query("SELECT 'event' AS kind, ev_type AS type, count(*) AS count FROM ev GROUP BY 2 UNION ALL SELECT 'object', ob_type, count(*) FROM ob GROUP BY 2", True)
def oc_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return objects.type_counts(trade_log(spark, d))


@query("SELECT ev_type, ob_type, count(*) AS count FROM e2o JOIN ev USING (ev_id) JOIN ob USING (ob_id) GROUP BY 1, 2", True)
def oc_e2o_counts(spark: SparkSession, d: str) -> DataFrame:
    return objects.e2o_counts(trade_log(spark, d))


@query("SELECT e.ev_id, e.ob_id, e.qualifier, ev_type, ob_type, epoch_us(ev.ts) AS ts_us FROM e2o e JOIN ev USING (ev_id) JOIN ob USING (ob_id) WHERE ev_type = 'ship_R' AND ob_type = 'part'", True)
def oc_navigate_e2o(spark: SparkSession, d: str) -> DataFrame:
    return objects.e2o_of(trade_log(spark, d), "ship_R", "part").withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("SELECT src_id, tgt_id, qualifier, s.ob_type AS src_type, t.ob_type AS tgt_type FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id WHERE t.ob_type = 'customer'", True)
def oc_navigate_o2o(spark: SparkSession, d: str) -> DataFrame:
    return objects.o2o_of(trade_log(spark, d), tgt_type="customer")


@query("""SELECT (SELECT count(*) FROM ob WHERE ob_type = 'order') AS sources, (SELECT count(DISTINCT src_id) FROM o2o WHERE tgt_id IN (SELECT ob_id FROM d WHERE ev_type = 'ship_A' AND ob_type = 'part') AND src_id IN (SELECT ob_id FROM ob WHERE ob_type = 'order')) AS converted""", True)
def oc_conversion(spark: SparkSession, d: str) -> DataFrame:
    return objects.conversion(trade_log(spark, d), "ship_A", "order", "part")


@query("SELECT ev_type, ob_type, min(n) AS low, max(n) AS high FROM (SELECT ev_id, ev_type, ob_type, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2", True)
def oc_involvements(spark: SparkSession, d: str) -> DataFrame:
    return objects.involvements(trade_log(spark, d))


@query("SELECT ev_type, ob_type, any_value(events) AS events, count(*) AS carrying, count(*) FILTER (n >= 2) AS converging, max(n) AS high FROM (SELECT ev_id, ev_type, ob_type, count(*) AS n FROM d GROUP BY ALL) JOIN (SELECT ev_type, count(*) AS events FROM ev GROUP BY 1) USING (ev_type) GROUP BY 1, 2", True)
def oc_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return objects.multiplicity(trade_log(spark, d))


@query("""SELECT ev_type, first, second, any_value(events) AS events, count(*) AS carrying, count(*) FILTER (n >= 2) AS converging, max(n) AS high FROM (
SELECT ev_id, d.ev_type, d.ob_type AS first, t.ob_type AS second, count(DISTINCT tgt_id) AS n FROM d JOIN o2o ON src_id = d.ob_id JOIN ob t ON t.ob_id = tgt_id GROUP BY ALL) JOIN (SELECT ev_type, count(*) AS events FROM ev GROUP BY 1) USING (ev_type) GROUP BY 1, 2, 3""", True)
def oc_association_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return objects.association_multiplicity(trade_log(spark, d))


@query("SELECT src_type, tgt_type, min(n) AS low, max(n) AS high FROM (SELECT src_id, s.ob_type AS src_type, t.ob_type AS tgt_type, count(*) AS n FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id GROUP BY ALL) GROUP BY 1, 2", True)
def oc_o2o_involvements(spark: SparkSession, d: str) -> DataFrame:
    return objects.o2o_involvements(trade_log(spark, d))


@query("SELECT src_type, tgt_type, min(n) AS low, max(n) AS high FROM (SELECT tgt_id, s.ob_type AS src_type, t.ob_type AS tgt_type, count(DISTINCT src_id) AS n FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id GROUP BY ALL) GROUP BY 1, 2", True)
def oc_o2o_involvements_reversed(spark: SparkSession, d: str) -> DataFrame:
    return objects.o2o_involvements(trade_log(spark, d), True)


@query("""SELECT c.ev_type, c.ob_type, carrying = events AS always_present, k <= 1 AS at_most_one_event_per_object FROM (SELECT ev_type, ob_type, count(DISTINCT ev_id) AS carrying FROM d GROUP BY 1, 2) c
JOIN (SELECT ev_type, count(*) AS events FROM ev GROUP BY 1) USING (ev_type) JOIN (SELECT ev_type, ob_type, max(k) AS k FROM (SELECT ev_type, ob_type, ob_id, count(*) AS k FROM d GROUP BY ALL) GROUP BY 1, 2) o ON o.ev_type = c.ev_type AND o.ob_type = c.ob_type""", True)
def oc_facts(spark: SparkSession, d: str) -> DataFrame:
    return objects.facts(trade_log(spark, d))


@query("SELECT ev_type AS source, target, count(*) AS count FROM (SELECT ev_type, lead(ev_type) OVER (PARTITION BY ob_id ORDER BY ts, ev_id) AS target FROM d WHERE ob_type = 'order') WHERE target IS NOT NULL GROUP BY 1, 2", True)
def oc_dfg_of_type(spark: SparkSession, d: str) -> DataFrame:
    return objects.dfg_of_type(trade_log(spark, d), "order")


@query("SELECT ob_type, ev_type AS source, target, count(*) AS count FROM (SELECT ob_type, ev_type, lead(ev_type) OVER (PARTITION BY ob_id ORDER BY ts, ev_id) AS target FROM d) WHERE target IS NOT NULL GROUP BY 1, 2, 3", True)
def oc_dfg(spark: SparkSession, d: str) -> DataFrame:
    return objects.object_dfg(trade_log(spark, d))


@query("SELECT ob_type, ev_type AS activity, count(*) AS count, count(*) FILTER (i = 1) AS starts, count(*) FILTER (j = 1) AS ends FROM (SELECT ob_type, ev_type, row_number() OVER (PARTITION BY ob_id ORDER BY ts, ev_id) AS i, row_number() OVER (PARTITION BY ob_id ORDER BY ts DESC, ev_id DESC) AS j FROM d) GROUP BY 1, 2", True)
def oc_dfg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return objects.object_dfg_nodes(trade_log(spark, d))


@query("SELECT trace, count(*) AS freq FROM (SELECT ob.ob_id, coalesce(string_agg(ev_type, '>' ORDER BY ts, ev_id), '') AS trace FROM ob LEFT JOIN d ON d.ob_id = ob.ob_id WHERE ob.ob_type = 'order' GROUP BY 1) GROUP BY 1", True)
def oc_variants_of_type(spark: SparkSession, d: str) -> DataFrame:
    return objects.variants_of_type(trade_log(spark, d), "order").select(objects.trace_string(F.col("trace")).alias("trace"), "freq")


@query("SELECT e.ob_id AS case_id, ev_type AS activity, epoch_us(ev.ts) AS ts_us, ev_id AS pos, qualifier FROM e2o e JOIN ev USING (ev_id) JOIN ob USING (ob_id) WHERE ob_type = 'customer'", True)
def oc_flatten(spark: SparkSession, d: str) -> DataFrame:
    return objects.flatten(trade_log(spark, d), "customer").withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("+e AS (SELECT ob.ob_id, ob.ob_type, min(ts) AS lo, max(ts) AS hi FROM ob LEFT JOIN d USING (ob_id) GROUP BY 1, 2) SELECT '<init>_' || ob_id AS ev_id, '<init> ' || ob_type AS ev_type, coalesce(epoch_us(lo), 0) AS ts_us, ob_id FROM e UNION ALL SELECT '<exit>_' || ob_id, '<exit> ' || ob_type, coalesce(epoch_us(hi), 0), ob_id FROM e", True)
def oc_init_exit(spark: SparkSession, d: str) -> DataFrame:
    return objects.init_exit_events(trade_log(spark, d)).withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("SELECT ob_id, ob_type FROM ob WHERE ob_id IN (SELECT ob_id FROM e2o)", True)
def oc_without_orphans(spark: SparkSession, d: str) -> DataFrame:
    return objects.without_orphans(trade_log(spark, d)).ob


_PREV = "+p AS (SELECT * FROM (SELECT ev_id, ev_type, ob_id, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY ob_id ORDER BY ts, ev_id)) AS u FROM d) WHERE u IS NOT NULL) "


@query(_PREV + "SELECT ev_id, ev_type, max(u) - min(u) AS sync_us, arg_min(ob_id, struct_pack(k := -u, o := ob_id)) AS delaying FROM p GROUP BY 1, 2", True)
def oc_sync_times(spark: SparkSession, d: str) -> DataFrame:
    return objects.sync_times(trade_log(spark, d))


@query(_PREV + "SELECT ev_id, ev_type, max(t) - max(u) AS sojourn_us FROM p GROUP BY 1, 2", True)
def oc_sojourn_times(spark: SparkSession, d: str) -> DataFrame:
    return objects.sojourn_times(trade_log(spark, d))


@query(_PREV + "SELECT ev_id, ev_type, max(t) - max(u) AS sojourn_us FROM p GROUP BY 1, 2 ORDER BY sojourn_us DESC, ev_id LIMIT 20", True)
def oc_sojourn_top(spark: SparkSession, d: str) -> DataFrame:
    return objects.sojourn_times(trade_log(spark, d), 20)


@query("SELECT ob_id, name, value, epoch_us(ts) AS ts_us FROM attr WHERE ob_id = 'o7'", True)
def oc_attribute_changes(spark: SparkSession, d: str) -> DataFrame:
    return objects.attribute_changes(trade_log(spark, d), "o7").withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("""+a AS (SELECT ob_id, ts, max(value) FILTER (name = 'status') AS status, max(value) FILTER (name = 'priority') AS priority FROM attr WHERE ob_id LIKE 'o%' GROUP BY 1, 2)
SELECT ob_id, 0 AS change_id, NULL::VARCHAR AS from_us, epoch_us(min(ts))::VARCHAR AS to_us, NULL::VARCHAR AS status, NULL::VARCHAR AS priority FROM (SELECT ob.ob_id, a.ts FROM ob LEFT JOIN a USING (ob_id) WHERE ob_type = 'order') GROUP BY 1
UNION ALL SELECT ob_id, row_number() OVER (PARTITION BY ob_id ORDER BY ts), epoch_us(ts)::VARCHAR, epoch_us(lead(ts) OVER (PARTITION BY ob_id ORDER BY ts))::VARCHAR, last_value(status IGNORE NULLS) OVER (PARTITION BY ob_id ORDER BY ts), last_value(priority IGNORE NULLS) OVER (PARTITION BY ob_id ORDER BY ts) FROM a""", True)
def oc_attribute_history(spark: SparkSession, d: str) -> DataFrame:
    return objects.attribute_history(trade_log(spark, d), "order", ["status", "priority"]).withColumns({"change_id": F.col("change_id").cast("long"), "from_us": F.col("from_us").cast("string"), "to_us": F.col("to_us").cast("string")})


@query("""+o AS (SELECT DISTINCT src_id, tgt_id, s.ob_type AS src_type, t.ob_type AS tgt_type FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id), n AS (SELECT ob_type AS first, count(*) AS total FROM ob GROUP BY 1),
m AS (SELECT src_type AS first, tgt_type AS second, 'forward' AS orientation, count(*) AS covered, max(k) AS k FROM (SELECT src_id, src_type, tgt_type, count(*) AS k FROM o GROUP BY ALL) GROUP BY 1, 2 UNION ALL SELECT tgt_type, src_type, 'reverse', count(*), max(k) FROM (SELECT tgt_id, src_type, tgt_type, count(*) AS k FROM o GROUP BY ALL) GROUP BY 1, 2)
SELECT first, second, orientation, total, covered FROM m JOIN n USING (first) WHERE k = 1 AND covered >= 0.95 * total""", True)
def oc_functional_maps(spark: SparkSession, d: str) -> DataFrame:
    return objects.functional_maps(trade_log(spark, d))


@query("""+p AS (SELECT a.ob_id AS x, a.ob_type AS first, b.ob_type AS second, b.ob_id AS y, a.ev_id FROM d a JOIN d b USING (ev_id) WHERE a.ob_type <> b.ob_type),
m AS (SELECT x, first, second, count(*) FILTER (k = n) AS m FROM (SELECT x, first, second, count(DISTINCT ev_id) AS n FROM p GROUP BY ALL) JOIN (SELECT x, first, second, y, count(*) AS k FROM p GROUP BY ALL) USING (x, first, second) GROUP BY ALL)
SELECT first, second, count(*) AS objects, count(*) FILTER (m = 1) AS mapped, count(*) FILTER (m = 0) AS conflict, count(*) FILTER (m > 1) AS ambiguous FROM m GROUP BY 1, 2""", True)
def oc_coparticipation_maps(spark: SparkSession, d: str) -> DataFrame:
    return objects.coparticipation_maps(trade_log(spark, d))


# -- declarative constraints

ARCS = [
    Arc("place", "ship_A", "EF", Label.of(each=["order"])),
    Arc("place", "ship_R", "AS", Label.of(any=["customer"]), 0, 0),
    Arc("ship_A", "place", "EP", Label.of(each=["order"])),
    Arc("ship_A", "ship_R", "AS", Label.of(all=["part"])),
    Arc("ship_A", "ship_N", "EF", Label.of(any=["part"])),
    Arc("ship_A", "ship_N", "EF", Label.of(each=["part"], any=["supplier"]), 1, 20),
    Arc("ship_R", "ship_N", "AS", Label.of(each=["order"], any=["part"]), 0, 0),
    Arc("place", "ship_N", "DF", Label.of(each=["order"])),
    Arc("ship_N", "ship_N", "EF", Label.of(all=["order", "part"]), 0, 1),
]


def _arc_sql(k: int, a: Arc) -> str:
    """SQL of an arc by its definition: bindings, matches, counts."""
    each, some, every = a.label.at(2), a.label.at(1), a.label.at(3)
    cols = "".join(f", b{i}.ob_id AS o{i}" for i in range(len(each)))
    binds = "".join(f" LEFT JOIN d b{i} ON b{i}.ev_id = e.ev_id AND b{i}.ob_type = '{t}'" for i, t in enumerate(each))
    keys = "".join(f", o{i}" for i in range(len(each)))
    seed = (each or some or every)[0]
    join = f"x JOIN d s ON s.ev_id = x.ev_id AND s.ob_type = '{seed}'" + (" AND s.ob_id = x.o0" if each else "") + " JOIN d f ON f.ob_id = s.ob_id"
    conds = [f"list_contains(objs.os, o{i})" for i in range(1, len(each))]
    conds += [f"(q_{t}.os IS NULL OR list_has_any(objs.os, q_{t}.os))" for t in some] + [f"(q_{t}.os IS NULL OR list_has_all(objs.os, q_{t}.os))" for t in every]
    extra = "".join(f" LEFT JOIN (SELECT ev_id, list(ob_id) AS os FROM d WHERE ob_type = '{t}' GROUP BY 1) q_{t} ON q_{t}.ev_id = x.ev_id" for t in [*some, *every])
    time = {"EF": "f.ts > x.ts", "EP": "f.ts < x.ts", "AS": "true", "DF": "f.ts > x.ts"}[a.arrow]
    bad = f"coalesce(n, 0) < {a.low or 0}" + (f" OR coalesce(n, 0) > {a.high}" if a.high is not None else "")
    if a.arrow == "DF":
        count = f"CASE WHEN arg_min(f.ev_type, struct_pack(t := f.ts, i := f.ev_id)) = '{a.target}' THEN 1 ELSE 0 END"
        kind = "true"
    else:
        count, kind = "count(DISTINCT f.ev_id)", f"f.ev_type = '{a.target}'"
    where = " AND ".join([kind, time, *conds])
    return f"""SELECT {k}::BIGINT AS arc, '{a.text()}' AS text, count(*) AS total, count(*) FILTER (v) AS violating FROM (
SELECT ev_id, bool_or({bad}) AS v FROM (SELECT e.ev_id{cols} FROM ev e{binds} WHERE e.ev_type = '{a.source}') b
LEFT JOIN (SELECT x.ev_id{keys.replace(', o', ', x.o')}, {count} AS n FROM (SELECT e.ev_id, e.ts{cols} FROM ev e{binds} WHERE e.ev_type = '{a.source}') {join} JOIN objs ON objs.ev_id = f.ev_id{extra} WHERE {where} GROUP BY ALL) m USING (ev_id{keys}) GROUP BY 1)"""


def _arcs_sql(arcs: list[Arc]) -> str:
    body = " UNION ALL ".join(_arc_sql(k, a) for k, a in enumerate(arcs))
    return f"+objs AS MATERIALIZED (SELECT ev_id, list(ob_id) AS os FROM d GROUP BY 1) SELECT arc, text, total, violating, round(violating::DOUBLE / total, 6) AS fraction FROM ({body})"


@query(_arcs_sql(ARCS), True)
def declare_check(spark: SparkSession, d: str) -> DataFrame:
    return declare.check(trade_log(spark, d), ARCS)


@query(oracles.DECLARE_DISCOVER, True, True)
def declare_discover(spark: SparkSession, d: str) -> DataFrame:
    arcs = declare.discover(trade_log(spark, d), declare.Options(reduction="lossless"))
    return _arc_rows(spark, arcs)


def _arc_rows(spark: SparkSession, arcs: list[Arc]) -> DataFrame:
    return spark.createDataFrame([(a.source, a.target, a.arrow, a.label.text(), a.text()) for a in arcs], "source string, target string, arrow string, label string, text string")


NEGATIVE = [
    Arc("place", "ship_A", "EP", Label.of(any=["order"]), 0, 0),
    Arc("ship_A", "ship_R", "AS", Label.of(any=["part"]), 0, 0),
    Arc("ship_A", "ship_R", "EF", Label.of(all=["part"]), 0, 0),
    Arc("ship_N", "place", "EF", Label.of(any=["order"]), 0, 0),
    Arc("ship_R", "ship_A", "EF", Label.of(any=["order"], all=["part"]), 0, 0),
]


def _evidence_sql() -> str:
    parts = []
    for k, a in enumerate(NEGATIVE):
        time = {"EF": "f.ts > e.ts", "EP": "f.ts < e.ts", "AS": "true"}[a.arrow]
        hit = " AND ".join([f"f.ev_type = '{a.target}'", time, *(f"list_has_any(os.os, q_{t}.os)" for t in a.label.at(1)), *(f"list_has_all(os.os, q_{t}.os)" for t in a.label.at(3))])
        seed = (a.label.at(1) or a.label.at(3))[0]
        sets = "".join(f" JOIN sets q_{t} ON q_{t}.ev_id = e.ev_id AND q_{t}.ob_type = '{t}'" for t, _ in a.label)
        bad = f"SELECT DISTINCT e.ev_id FROM ev e{sets} JOIN d s ON s.ev_id = e.ev_id AND s.ob_type = '{seed}' JOIN d f ON f.ob_id = s.ob_id JOIN objs os ON os.ev_id = f.ev_id WHERE e.ev_type = '{a.source}' AND {hit}"
        need = " AND ".join(f"coalesce((SELECT max(len(x.os)) FROM sets x JOIN ev f ON f.ev_id = x.ev_id WHERE f.ev_type = '{a.target}' AND x.ob_type = '{t}' AND {time}), 0) >= {f'len(q_{t}.os)' if v == 3 else '1'}" for t, v in a.label)
        ok = f"SELECT e.ev_id FROM ev e{sets} WHERE e.ev_type = '{a.source}' AND {need}"
        parts.append(f"SELECT {k}::BIGINT AS arc, count(*) AS total, count(*) FILTER (ok) AS testable, count(*) FILTER (ok AND NOT bad) AS satisfying, count(*) FILTER (NOT bad) AS satisfying_all FROM (SELECT ev_id, ev_id IN ({bad}) AS bad, ev_id IN ({ok}) AS ok FROM ev WHERE ev_type = '{a.source}')")
    return "+objs AS MATERIALIZED (SELECT ev_id, list(ob_id) AS os FROM d GROUP BY 1), sets AS MATERIALIZED (SELECT ev_id, ob_type, list(ob_id) AS os FROM d GROUP BY 1, 2) " + " UNION ALL ".join(parts)


@query(_evidence_sql(), True)
def negative_evidence(spark: SparkSession, d: str) -> DataFrame:
    return declare.evidence_of(trade_log(spark, d), NEGATIVE)


@query(oracles.NEGATIVE_DISCOVER, True)
def negative_discover(spark: SparkSession, d: str) -> DataFrame:
    return _arc_rows(spark, negative.discover(trade_log(spark, d), declare.Options(noise=0.1)))


@query()
def negative_reduced(spark: SparkSession, d: str) -> DataFrame:
    log = trade_log(spark, d)
    positive = declare.discover(log, declare.Options(noise=0.1, arrows=("AS", "EF", "EP"), all_for_single=True))
    arcs, _ = negative.discover_reduced(log, positive, declare.Options(noise=0.1))
    return _arc_rows(spark, arcs)


@query(oracles.NEGATIVE_TABLE, True)
def negative_candidate_table(spark: SparkSession, d: str) -> DataFrame:
    return declare.candidate_table(trade_log(spark, d), ("AS", "EF", "EP"), True)[1]


@query(oracles.EXISTENCE_TABLE, True)
def existence_candidate_table(spark: SparkSession, d: str) -> DataFrame:
    return declare.candidate_table(trade_log(spark, d), ("AS", "EF", "EP"), False)[1]


NOISES = (0.0, 0.1, 0.2)
#: Every ship is of an order that was placed; and claims that do not hold, to be counted.
PLACED = [Arc(f"ship_{f}", "place", "AS", Label.of(all=["order"])) for f in "ANR"]
CLAIMS = [arc for f in "AR" for arc in (Arc(f"ship_{f}", "place", "AS", Label.of(all=["order"])), Arc("place", f"ship_{f}", "AS", Label.of(all=["order"])))]


def _lattice(spark: SparkSession, d: str):
    log = trade_log(spark, d)
    arcs = lattice.negative_arcs(log)
    table = lattice.candidates(log, arcs)
    return log, arcs, table, lattice.discovered_at(table)


@query(oracles.NEGATIVE_THRESHOLDS, True)
def negative_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """For every candidate how many events it loses, and how many at least are lost right below it."""
    return _lattice(spark, d)[3].select("source", "target", "arrow", "label", "total", "testable", "violating", "until")


@query(oracles.negative_antichain(NOISES), True)
def negative_antichain_check(spark: SparkSession, d: str) -> DataFrame:
    return lattice.comparable(_lattice(spark, d)[3], NOISES)


@query(oracles.negative_upward((0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)), True)
def negative_upward_check(spark: SparkSession, d: str) -> DataFrame:
    return lattice.upward_breaks(_lattice(spark, d)[2], (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3))


@query(oracles.negative_carry(NOISES), True)
def negative_carry_check(spark: SparkSession, d: str) -> DataFrame:
    log, arcs, table, spans = _lattice(spark, d)
    return lattice.derived(table, arcs, spans, negative.knowledge(log, PLACED), NOISES, "target")


@query(oracles.EQUIVALENCE)
def negative_equivalence_check(spark: SparkSession, d: str) -> DataFrame:
    log = trade_log(spark, d)
    return lattice.unpaired(log, negative.knowledge(log, CLAIMS))


# -- path schemas

ORDER, CUSTOMER, PART, PLACE, SHIP_A = ("object", "order"), ("object", "customer"), ("object", "part"), ("event", "place"), ("event", "ship_A")


def _step(a, qualifier: str, b, reverse: bool = False) -> paths.Step:
    return paths.Step(paths.Edge(a, qualifier, b), reverse)


@query("SELECT 'event' AS kind, ev_type AS source, qualifier, ob_type AS target FROM e2o JOIN ev USING (ev_id) JOIN ob USING (ob_id) GROUP BY 2, 3, 4 UNION ALL SELECT 'object', s.ob_type, qualifier, t.ob_type FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id GROUP BY 2, 3, 4", True)
def path_type_graph(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(e.source[0], e.source[1], e.qualifier, e.target[1]) for e in paths.type_graph(trade_log(spark, d))], "kind string, source string, qualifier string, target string")


_FORWARD = paths.Schema(PLACE, (_step(PLACE, "order", ORDER), _step(SHIP_A, "order", ORDER, True)))
_LONG = paths.Schema(CUSTOMER, (_step(ORDER, "placed_by", CUSTOMER, True), _step(ORDER, "contains", PART)))
_CYCLE = paths.Schema(ORDER, (_step(ORDER, "placed_by", CUSTOMER), _step(ORDER, "placed_by", CUSTOMER, True)))


@query("""+e AS MATERIALIZED (SELECT ob_id, ev_id, epoch_us(ts) AS t FROM d WHERE ev_type = 'place' AND ob_type = 'order'), f AS MATERIALIZED (SELECT ob_id, ev_id, epoch_us(ts) AS t FROM d WHERE ev_type = 'ship_A' AND ob_type = 'order')
SELECT e.ev_id AS source, f.ev_id AS target, e.t AS source_t, f.t AS target_t FROM e JOIN f USING (ob_id) WHERE f.t >= e.t""", True)
def path_connections_forward(spark: SparkSession, d: str) -> DataFrame:
    return paths.connections(trade_log(spark, d), _FORWARD, "forward")


@query("SELECT source, target, source_t, target_t FROM (SELECT e.ev_id AS source, f.ev_id AS target, epoch_us(e.ts) AS source_t, epoch_us(f.ts) AS target_t, row_number() OVER (PARTITION BY e.ev_id ORDER BY abs(epoch_us(f.ts) - epoch_us(e.ts)), f.ev_id) AS k FROM d e JOIN d f ON f.ob_id = e.ob_id AND f.ev_type = 'ship_A' AND abs(epoch_us(f.ts) - epoch_us(e.ts)) <= 86400000000 * 60 WHERE e.ev_type = 'place' AND e.ob_type = 'order') WHERE k = 1", True)
def path_connections_closest(spark: SparkSession, d: str) -> DataFrame:
    return paths.connections(trade_log(spark, d), _FORWARD, "bounded", 86400.0 * 60, "closest")


@query("SELECT a.src_id AS source, b.src_id AS target FROM o2o a JOIN o2o b ON a.tgt_id = b.tgt_id AND a.qualifier = 'placed_by' AND b.qualifier = 'placed_by' WHERE a.src_id <> b.src_id", True)
def path_connections_cycle(spark: SparkSession, d: str) -> DataFrame:
    return paths.connections(trade_log(spark, d), _CYCLE).select("source", "target")


@query("+f AS (SELECT DISTINCT e.ev_id AS s, f.ev_id AS t FROM d e JOIN d f ON f.ob_id = e.ob_id AND f.ev_type = 'ship_A' WHERE e.ev_type = 'place' AND e.ob_type = 'order'), l AS (SELECT DISTINCT a.tgt_id AS s, b.tgt_id AS t FROM o2o a JOIN o2o b ON b.src_id = a.src_id AND b.qualifier = 'contains' WHERE a.qualifier = 'placed_by') SELECT 0 AS schema, count(*) AS support, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM f UNION ALL SELECT 1, count(*), count(DISTINCT s), count(DISTINCT t) FROM l", True)
def path_summary(spark: SparkSession, d: str) -> DataFrame:
    return paths.summary(trade_log(spark, d), [_FORWARD, _LONG]).drop("set_hash")


@query("+p AS (SELECT (epoch_ms(f.ts) - epoch_ms(e.ts)) / 1000.0::DOUBLE AS s FROM d e JOIN d f ON f.ob_id = e.ob_id AND f.ev_type = 'ship_A' AND f.ts >= e.ts WHERE e.ev_type = 'place' AND e.ob_type = 'order') SELECT count(*) AS n, min(s) AS low, max(s) AS high, round(avg(s), 6) AS mean, median(s) AS median FROM p", True)
def path_throughput(spark: SparkSession, d: str) -> DataFrame:
    return paths.throughput(paths.connections(trade_log(spark, d), _FORWARD, "forward"))


@query(oracles.PATH_DISCOVER, True)
def path_discover(spark: SparkSession, d: str) -> DataFrame:
    rows = paths.discover(trade_log(spark, d), PLACE, SHIP_A, 3)
    return spark.createDataFrame([(r["text"], r["support"], r["coverage"], r["selectivity"], r["reach"], r["exclusivity"], r["representative"]) for r in rows], "schema string, support long, coverage double, selectivity double, reach double, exclusivity double, representative string")


# -- case-centric conformance


def dialog_net():
    """user and assistant in turn, after an optional system turn."""
    from loomtrace.plans.petri import PetriNet

    net = PetriNet(initial={"start": 1}, finals=[{"idle": 1}])
    for p in ("start", "idle", "asked"):
        net.add_place(p)
    for t, label, a, b in (("skip", None, "start", "idle"), ("system", "system", "start", "idle"), ("user", "user", "idle", "asked"), ("assistant", "assistant", "asked", "idle")):
        net.add_transition(t, label)
        net.add_arc(a, t)
        net.add_arc(t, b)
    return net


def visible_dialog_net():
    net = dialog_net()
    net.remove("skip")
    net.initial = {"idle": 1}
    return net


@query(oracles.TOKEN_REPLAY)
def conformance_token_replay(spark: SparkSession, d: str) -> DataFrame:
    return conformance.replay_summary(conformance.token_replay(cases.variants(dialog_log(spark, d)), visible_dialog_net()))


@query(oracles.ALIGNMENTS)
def conformance_alignments(spark: SparkSession, d: str) -> DataFrame:
    return conformance.alignments(cases.variants(dialog_log(spark, d)), dialog_net()).select(objects.trace_string(F.col("trace")).alias("trace"), "freq", "cost", "worst", "status")


@query()
def conformance_alignment_moves(spark: SparkSession, d: str) -> DataFrame:
    """The moves of an optimal alignment; of several the SQL above can't know which one is found."""
    return conformance.alignments(cases.variants(dialog_log(spark, d)), dialog_net()).select(objects.trace_string(F.col("trace")).alias("trace"), "cost", "moves")


@query(oracles.ALIGNMENT_VALIDITY)
def conformance_alignment_validity(spark: SparkSession, d: str) -> DataFrame:
    """What makes the moves above an alignment: they spell the trace, cost what is said, and run from start to idle."""
    found = conformance.moves_checked(conformance.alignments(cases.variants(dialog_log(spark, d)), dialog_net()), "^(skip|system)( user assistant)*$", ["skip"])
    return found.select(*[objects.trace_string(F.col(c)).alias(c) for c in ("trace", "spelled")], "freq", "cost", "charged", "matched", "runs")


@query(oracles.ALIGNMENT_FITNESS)
def conformance_alignment_fitness(spark: SparkSession, d: str) -> DataFrame:
    return conformance.alignment_fitness(conformance.alignments(cases.variants(dialog_log(spark, d)), dialog_net()))


@query()
def discover_alpha(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans import alpha

    net = alpha.discover(conformance.variant_dict(cases.variants(dialog_log(spark, d))), alpha.Config(absolute=1), conformance.spark_fitness(spark))
    rows = [(p, " ".join(sorted(net.pre(p))), " ".join(sorted(net.post(p))), net.initial.get(p, 0), net.final.get(p, 0)) for p in net.places]
    return spark.createDataFrame(rows, "place string, producers string, consumers string, initial long, final long")


@query("""+ev2 AS (SELECT DISTINCT ev_id, ev_type FROM d), n AS (SELECT ev_type, count(*) AS events FROM ev2 GROUP BY 1),
c AS (SELECT ev_type, ob_type, count(*) AS carrying, max(n) AS high FROM (SELECT ev_id, ev_type, ob_type, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2),
m AS (SELECT ev_type, ob_type, count(DISTINCT ob_id) AS met FROM d GROUP BY 1, 2), t AS (SELECT ob_type, count(*) AS objects FROM ob GROUP BY 1),
k AS (SELECT DISTINCT ev_type, ob_type AS other FROM d), o AS (SELECT ev_id, ob_type AS other, list_sort(list(ob_id)) AS os FROM d GROUP BY 1, 2),
v AS (SELECT DISTINCT ev_type, ob_type FROM (SELECT d.ev_type, d.ob_type, d.ob_id, k.other, count(DISTINCT coalesce(o.os::VARCHAR, '')) AS q FROM d JOIN k ON k.ev_type = d.ev_type AND k.other <> d.ob_type LEFT JOIN o ON o.ev_id = d.ev_id AND o.other = k.other GROUP BY ALL) WHERE q > 1)
SELECT c.ev_type, c.ob_type, true AS related, carrying < events AS deficient, high > 1 AS convergent, v.ev_type IS NOT NULL AS divergent, met < objects AS optional FROM c JOIN n USING (ev_type) JOIN m ON m.ev_type = c.ev_type AND m.ob_type = c.ob_type JOIN t ON t.ob_type = c.ob_type LEFT JOIN v ON v.ev_type = c.ev_type AND v.ob_type = c.ob_type""", True)
def language_relations(spark: SparkSession, d: str) -> DataFrame:
    return abstraction.relations(trade_log(spark, d))


def order_tree():
    """An order is placed, then its parts ship in any order of the flags; what types take part is for the log to say."""
    from loomtrace.plans import tree

    return tree.node(tree.SEQ, tree.leaf("place"), tree.node(tree.AND, *[tree.leaf(f"ship_{f}") for f in "ANR"]))


@query(oracles.LANGUAGE_FITNESS, True)
def language_fitness_precision(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans.octree import annotated

    log = abstraction.facts_of_log(trade_log(spark, d))
    model = annotated(order_tree(), abstraction.leaf_types(log[0]))
    found = abstraction.fitness_precision(log, abstraction.facts_of_tree(spark, model))
    return found.select(*[F.round(c, 6).alias(c) for c in ("fitness", "precision")])


# -- attributes, nested rows, models


@query("""WITH e AS (SELECT event_type AS activity, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT activity, CASE WHEN k >= 50 THEN 'high' ELSE 'low' END AS level, count(*) AS events, count(k) AS numbered, round(sum(value), 4) AS value, 0::BIGINT AS raw FROM e GROUP BY 1, 2""")
def case_attribute_edits(spark: SparkSession, d: str) -> DataFrame:
    """Events get nested attributes, one is moved and one removed; counted by what is read from them again."""
    from loomtrace.functions import attributes as at

    raw = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    m = F.col("attrs")
    log = raw.withColumn("attrs", at.put(at.put(F.lit(None).cast(at.ATTRS), F.col("value"), "float", "value"), F.col("k"), "int", "props", "k"))
    level = F.when(at.get(m, "props", "k")["value"].cast("long") >= 50, "high").otherwise("low")
    log = log.withColumn("attrs", at.put(m, level, "string", "props", "level")).withColumn("attrs", at.remove(at.rename(m, "value", "amount"), "raw"))
    number = lambda e: e["value"].cast("double")
    return log.groupBy(F.col("event_type").alias("activity"), at.get(m, "props", "level")["value"].alias("level")).agg(
        F.count("*").alias("events"), F.count(at.get(m, "props", "k")["value"]).alias("numbered"), F.round(F.sum(number(at.get(m, "amount"))), 4).alias("value"), F.count(at.get(m, "value")).alias("raw"))


@query("SELECT 'p' || o_orderkey AS ev_id, epoch_us(o_orderdate::TIMESTAMP) AS ts_us, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def oc_event_table(spark: SparkSession, d: str) -> DataFrame:
    return objects.event_table(trade_log(spark, d), "place", ["priority", "status"]).withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("SELECT ev_id, ev_type, string_agg(ob_id, '/' ORDER BY ob_id) AS related FROM e2o JOIN ev USING (ev_id) GROUP BY 1, 2", True)
def oc_full_events(spark: SparkSession, d: str) -> DataFrame:
    return objects.full_events(trade_log(spark, d)).select("ev_id", "ev_type", F.array_join(F.transform("relationships", lambda r: r["ob_id"]), "/").alias("related"))


@query("SELECT ob_id, ob_type, coalesce(string_agg(tgt_id, '/' ORDER BY tgt_id), '') AS related FROM ob LEFT JOIN o2o ON src_id = ob_id GROUP BY 1, 2", True)
def oc_full_objects(spark: SparkSession, d: str) -> DataFrame:
    return objects.full_objects(trade_log(spark, d)).select("ob_id", "ob_type", F.coalesce(F.array_join(F.transform("relationships", lambda r: r["ob_id"]), "/"), F.lit("")).alias("related"))


@query("SELECT kind, type, count(*) AS count, count(t) AS timed FROM (SELECT 'event' AS kind, ev_type AS type, epoch_us(ts) AS t FROM ev UNION ALL SELECT 'object', ob_type, NULL FROM ob) GROUP BY 1, 2", True)
def oc_entities(spark: SparkSession, d: str) -> DataFrame:
    return objects.entities(trade_log(spark, d)).groupBy("kind", "type").agg(F.count("*").alias("count"), F.count("ts").alias("timed"))


@query("+g AS (SELECT ob_id FROM ob WHERE ob_type = 'supplier') SELECT ev_type, ob_type, count(*) AS count FROM e2o JOIN ev USING (ev_id) JOIN ob USING (ob_id) WHERE ob_id NOT IN (SELECT ob_id FROM g) GROUP BY 1, 2", True)
def oc_delete_objects(spark: SparkSession, d: str) -> DataFrame:
    log = trade_log(spark, d)
    return objects.e2o_counts(objects.delete_objects(log, objects.objects_of_type(log, "supplier")))


@query("SELECT ev_type, count(*) AS count FROM (SELECT ev_type FROM ev UNION ALL SELECT '<init> ' || ob_type FROM ob UNION ALL SELECT '<exit> ' || ob_type FROM ob) GROUP BY 1", True)
def oc_with_init_exit(spark: SparkSession, d: str) -> DataFrame:
    return objects.with_init_exit(trade_log(spark, d)).ev.groupBy("ev_type").agg(F.count("*").alias("count"))


SYNTHETIC = [Arc("<init> order", "place", "EF", Label.of(each=["order"])), Arc("place", "<exit> customer", "EF", Label.of(any=["customer"])), Arc("ship_A", "ship_R", "AS", Label.of(any=["order>part"]))]


@query("""+l AS (SELECT ob_id, min(ts) AS lo, max(ts) AS hi FROM d GROUP BY 1),
a AS (SELECT ob.ob_id, bool_or(d.ev_id IS NOT NULL) AS ok FROM ob LEFT JOIN l USING (ob_id) LEFT JOIN d ON d.ob_id = ob.ob_id AND d.ev_type = 'place' AND epoch_us(d.ts) > epoch_us(l.lo) - 1000 WHERE ob.ob_type = 'order' GROUP BY 1),
p AS (SELECT e.ev_id, bool_or(l.hi IS NOT NULL) AS ok FROM ev e LEFT JOIN d ON d.ev_id = e.ev_id AND d.ob_type = 'customer' LEFT JOIN l ON l.ob_id = d.ob_id WHERE e.ev_type = 'place' GROUP BY 1),
s AS (SELECT e.ev_id, bool_or(f.ev_id IS NOT NULL) AS ok FROM ev e LEFT JOIN d ON d.ev_id = e.ev_id AND d.ob_type = 'order' LEFT JOIN o2o ON src_id = d.ob_id AND tgt_id LIKE 'a%' LEFT JOIN d f ON f.ob_id = tgt_id AND f.ev_type = 'ship_R' WHERE e.ev_type = 'ship_A' GROUP BY 1)
SELECT 0::BIGINT AS arc, count(*) AS total, count(*) FILTER (NOT ok) AS violating FROM a UNION ALL SELECT 1, count(*), count(*) FILTER (NOT ok) FROM p UNION ALL SELECT 2, count(*), count(*) FILTER (NOT ok) FROM s""", True)
def declare_check_synthetic(spark: SparkSession, d: str) -> DataFrame:
    return declare.check(trade_log(spark, d), SYNTHETIC).select("arc", "total", "violating")


@query(oracles.DECLARE_PROJECTED, True, True)
def declare_projected(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans.declare import project_arcs

    arcs = declare.discover(trade_log(spark, d), declare.Options(arrows=("AS", "EF", "EP")))
    return _arc_rows(spark, project_arcs(arcs, {"place", "ship_R"}, "lossless"))


@query()
def negative_precision(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans import negative as rules

    log = trade_log(spark, d)
    arcs, rows = declare.candidate_table(log, ("AS", "EF", "EP"), True)
    table = [(arcs[r["arc"]], r.asDict()) for r in rows.collect()]
    table = [(a, r) for a, r in rules.minimal_rows(table, 0.1)]
    k = negative.knowledge(log, [])
    model, _ = rules.reduce_negative([a for a, _ in table], k)
    known = rules.closure(model, arcs, k)
    return spark.createDataFrame([(w, round(rules.precision(table, known.__contains__, w), 6), len(model)) for w in rules.WEIGHTS], "weight string, precision double, arcs long")


@query(oracles.PATH_ENUMERATE, True)
def path_enumerate(spark: SparkSession, d: str) -> DataFrame:
    found = paths.enumerate_schemas(paths.type_graph(trade_log(spark, d)), PLACE, SHIP_A, 3)
    return spark.createDataFrame([(s.text(), len(s.steps)) for s in found], "schema string, length long")


@query(oracles.TREE_ALIGNMENTS)
def conformance_tree_alignments(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans import tree

    talk = tree.node(tree.SEQ, tree.node(tree.XOR, tree.leaf("system"), tree.leaf()), tree.node(tree.LOOP, tree.node(tree.SEQ, tree.leaf("user"), tree.leaf("assistant")), tree.leaf()))
    return conformance.alignment_fitness(conformance.alignments(cases.variants(dialog_log(spark, d)), tree.to_petri_net(talk)))


@query(oracles.MAP_CLOSURE, True)
def oc_map_closure(spark: SparkSession, d: str) -> DataFrame:
    from loomtrace.plans import maps

    log = trade_log(spark, d)
    found = [(r["first"], r["second"], r["orientation"]) for r in objects.functional_maps(log).collect()]
    kept = maps.least_kept({r[0] for r in objects.object_types(log).collect()}, found)
    return spark.createDataFrame([(a, b, len(c)) for (a, b), c in sorted(maps.compositions(found).items())] + [(t, "kept", 0) for t in sorted(kept)], "source string, target string, chains long")


@query(oracles.STRUCTURE, True, True)
def oc_structure_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Cells that the recorded relations rebuild are cut; the SQL takes it that none of them rebuilds another in turn."""
    log = trade_log(spark, d)
    return reduction.report(log, reduction.reduce_log(log))
