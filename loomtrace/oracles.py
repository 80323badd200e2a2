"""DuckDB SQL for the queries that judge all candidate constraints of the trade log.

The SQL shares no step with the operators. A pair of events (e, f) has a state: for each type that
both activities carry, 0 (no object shared), 1 (some) or 2 (all of e's). A label asks for a level
per type, so an arc is violated or satisfied by comparing states with it, whatever the label. Events
of the trade log carry every type of their activity, one order each.
"""

from __future__ import annotations

#: Objects per event, times, and the states of all pairs that share an order, a part, or two suppliers;
#: what shares one supplier alone is told by the first and last time of each supplier and activity.
STATES = """+
o AS MATERIALIZED (SELECT ev_id, any_value(ev_type) AS a, any_value(ts) AS ts, any_value(ob_id) FILTER (ob_type = 'order') AS o,
  list_sort(list(ob_id) FILTER (ob_type = 'part')) AS ps, list_sort(list(ob_id) FILTER (ob_type = 'supplier')) AS ss FROM d GROUP BY 1),
two AS MATERIALIZED (SELECT ev_id, ss[1] || '+' || ss[2] AS s FROM o WHERE len(ss) > 1),
twos AS MATERIALIZED (SELECT ev_id, x || '+' || y AS s FROM (SELECT ev_id, unnest(ss) AS x, ss FROM o), LATERAL (SELECT unnest(ss) AS y) WHERE x < y),
r AS MATERIALIZED (SELECT DISTINCT e.ev_id AS e, f.ev_id AS f FROM o e JOIN o f ON e.o = f.o AND e.ev_id <> f.ev_id
  UNION SELECT e.ev_id, f.ev_id FROM d e JOIN d f ON e.ob_id = f.ob_id AND e.ev_id <> f.ev_id WHERE e.ob_type = 'part'
  UNION SELECT e.ev_id, f.ev_id FROM two e JOIN twos f ON e.s = f.s AND e.ev_id <> f.ev_id),
p AS MATERIALIZED (SELECT r.e, r.f, e.a, f.a AS b, sign(epoch_us(f.ts) - epoch_us(e.ts))::INT AS w, CASE WHEN e.o = f.o THEN 2 ELSE 0 END AS xo,
  CASE WHEN e.ps IS NULL OR f.ps IS NULL THEN 0 WHEN list_has_all(f.ps, e.ps) THEN 2 WHEN list_has_any(f.ps, e.ps) THEN 1 ELSE 0 END AS xp,
  CASE WHEN e.ss IS NULL OR f.ss IS NULL THEN 0 WHEN list_has_all(f.ss, e.ss) THEN 2 WHEN list_has_any(f.ss, e.ss) THEN 1 ELSE 0 END AS xs
  FROM r LEFT JOIN o e ON e.ev_id = r.e LEFT JOIN o f ON f.ev_id = r.f),
arrow AS (SELECT * FROM (VALUES ('AS', 0, -1), ('AS', 0, 0), ('AS', 0, 1), ('EF', 1, 1), ('EP', 2, -1)) t(arrow, rank, w)),
span AS (SELECT ev_type AS b, min(ts) AS lo, max(ts) AS hi FROM ev GROUP BY 1),
lone AS MATERIALIZED (SELECT ob_id AS s, ev_type AS b, min(ts) AS lo, max(ts) AS hi FROM d WHERE ob_type = 'supplier' GROUP BY 1, 2),
-- what each source event meets: (event, target, arrow, states as bits 9 order + 3 part + supplier)
hit AS (SELECT e, a, b, arrow, 9 * xo + 3 * xp + xs AS x FROM p JOIN arrow USING (w) WHERE a IS DISTINCT FROM b
  UNION ALL SELECT o.ev_id, a, b, k.arrow, CASE WHEN len(ss) = 1 THEN 2 ELSE 1 END FROM (SELECT ev_id, a, ts, ss, unnest(ss) AS s FROM o WHERE ss IS NOT NULL) o JOIN lone USING (s), (SELECT DISTINCT arrow FROM arrow) k
    WHERE a <> b AND CASE k.arrow WHEN 'AS' THEN true WHEN 'EF' THEN hi > ts ELSE lo < ts END
  UNION ALL SELECT o.ev_id, a, b, k.arrow, 0 FROM o, span, (SELECT DISTINCT arrow FROM arrow) k WHERE a <> b AND CASE k.arrow WHEN 'AS' THEN true WHEN 'EF' THEN hi > ts ELSE lo < ts END),
met AS MATERIALIZED (SELECT e, b, arrow, bit_or(1::BIGINT << x::INT) AS mask FROM hit GROUP BY 1, 2, 3),
-- the most objects of each type that a target event before, after or at any time has
n AS (SELECT ev_type AS b, ob_type AS t, ts, max(n) AS n FROM (SELECT ev_id, ev_type, ob_type, ts, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2, 3),
grid AS (SELECT b, t, ts, n FROM (SELECT DISTINCT b, t FROM n) CROSS JOIN (SELECT DISTINCT ts FROM ev) LEFT JOIN n USING (b, t, ts)),
most AS MATERIALIZED (SELECT b, t, ts, max(n) OVER (PARTITION BY b, t) AS m0, max(n) OVER (PARTITION BY b, t ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m1,
  max(n) OVER (PARTITION BY b, t ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m2 FROM grid),
able AS MATERIALIZED (SELECT o.ev_id AS e, o.a, q.b, k.arrow,
    max(CASE WHEN q.t = 'order' THEN CASE WHEN coalesce(m, 0) >= 1 THEN 2 ELSE 0 END END) AS yo,
    max(CASE WHEN q.t = 'part' THEN CASE WHEN coalesce(m, 0) >= len(ps) THEN 2 WHEN m >= 1 THEN 1 ELSE 0 END END) AS yp,
    max(CASE WHEN q.t = 'supplier' THEN CASE WHEN coalesce(m, 0) >= len(ss) THEN 2 WHEN m >= 1 THEN 1 ELSE 0 END END) AS ys
  FROM o JOIN (SELECT b, t, ts, arrow, CASE arrow WHEN 'AS' THEN m0 WHEN 'EF' THEN m1 ELSE m2 END AS m FROM most, (SELECT DISTINCT arrow FROM arrow) k) q ON q.ts = o.ts AND q.b <> o.a
  JOIN (SELECT DISTINCT arrow FROM arrow) k ON k.arrow = q.arrow GROUP BY 1, 2, 3, 4),
kind AS (SELECT DISTINCT ev_type AS a, ob_type AS t FROM d),
pair AS MATERIALIZED (SELECT x.a, y.a AS b, list_sort(list(x.t)) AS ts FROM kind x JOIN kind y ON x.t = y.t AND x.a <> y.a GROUP BY 1, 2),
"""

#: Text of a label from its levels 1 (any), 2 (each), 3 (all) per type.
_PART = "CASE WHEN {c} THEN '{n}(' || array_to_string(list_filter([CASE WHEN vo = {v} THEN 'order' END, CASE WHEN vp = {v} THEN 'part' END, CASE WHEN vs = {v} THEN 'supplier' END], lambda x: x IS NOT NULL), ',') || ')' END"
LABEL = "array_to_string(list_filter([" + ", ".join(_PART.format(c=f"vo = {v} OR vp = {v} OR vs = {v}", n=n, v=v) for v, n in ((2, "Each"), (3, "All"), (1, "Any"))) + "], lambda x: x IS NOT NULL), ', ')"


def _levels(levels: str, single: str) -> str:
    """All labels of every pair: (a, b, vo, vp, vs), the empty one included."""
    pick = lambda t, c, some: f"(SELECT unnest({some}) AS {c}) {c}_ ON {c} = 0 OR list_contains(ts, '{t}')"
    return f"label AS (SELECT a, b, vo, vp, vs FROM pair JOIN {pick('order', 'vo', single)} JOIN {pick('part', 'vp', levels)} JOIN {pick('supplier', 'vs', levels)})"


#: Negative arcs: an event violates one if it meets a state at or above the label.
NEGATIVE_ROWS = STATES + _levels("[0, 1, 3]", "[0, 1, 3]") + """,
need AS (SELECT *, CASE vo WHEN 3 THEN 2 ELSE vo END AS lo, CASE vp WHEN 3 THEN 2 ELSE vp END AS lp, CASE vs WHEN 3 THEN 2 ELSE vs END AS ls FROM label),
up AS MATERIALIZED (SELECT a, b, vo, vp, vs, lo, lp, ls, bit_or(1::BIGINT << (9 * x.i + 3 * y.i + z.i)::INT) AS above FROM need, (SELECT unnest([0, 1, 2]) AS i) x, (SELECT unnest([0, 1, 2]) AS i) y, (SELECT unnest([0, 1, 2]) AS i) z
  WHERE x.i >= lo AND y.i >= lp AND z.i >= ls GROUP BY ALL),
one AS MATERIALIZED (SELECT able.a, able.b, able.arrow, coalesce(mask, 0) AS mask, yo, yp, ys, count(*) AS n FROM able LEFT JOIN met ON met.e = able.e AND met.b = able.b AND met.arrow = able.arrow GROUP BY ALL),
rows_ AS MATERIALIZED (SELECT up.a, up.b, one.arrow, vo, vp, vs, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS testable, coalesce(sum(n) FILTER (ok AND NOT bad), 0)::BIGINT AS satisfying, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS satisfying_all
  FROM up JOIN (SELECT * FROM one) one USING (a, b), LATERAL (SELECT (mask & above) <> 0 AS bad, coalesce(yo, 0) >= lo AND coalesce(yp, 0) >= lp AND coalesce(ys, 0) >= ls AS ok) GROUP BY 1, 2, 3, 4, 5, 6)
"""

_TABLE = f"""SELECT row_number() OVER (ORDER BY a, b, vo, vp, vs, arrow) - 1 AS arc, a AS source, b AS target, arrow, {LABEL} AS label, total, testable, satisfying, satisfying_all,
round(satisfying_all::DOUBLE / total, 6) AS support, CASE WHEN testable > 0 THEN round(satisfying::DOUBLE / testable, 6) END AS conditional_support FROM rows_ WHERE vo + vp + vs > 0"""

NEGATIVE_TABLE = NEGATIVE_ROWS + _TABLE

_TEXT = "arrow || '(' || a || ', ' || b || CASE WHEN label = '' THEN '' ELSE ', ' || label END || ',{low},{high})'"


def negative_minimal(noise: float) -> str:
    """Common table expressions up to least(a, b, arrow, vo, vp, vs): arcs that hold, while none right below them does."""
    down = "CASE {c} WHEN 3 THEN 1 ELSE 0 END"
    steps = " OR ".join(
        f"(m.arrow = h.arrow AND h.{c} > 0 AND m.{c} = {down.format(c='h.' + c)} AND " + " AND ".join(f"m.{x} = h.{x}" for x in ("vo", "vp", "vs") if x != c) + ")" for c in ("vo", "vp", "vs"))
    return NEGATIVE_ROWS + f""", good AS MATERIALIZED (SELECT * FROM rows_ WHERE satisfying_all >= (1 - {noise}::DOUBLE) * total),
least_ AS (SELECT h.* FROM good h WHERE NOT EXISTS (SELECT 1 FROM good m WHERE m.a = h.a AND m.b = h.b AND ({steps} OR (h.arrow <> 'AS' AND m.arrow = 'AS' AND m.vo = h.vo AND m.vp = h.vp AND m.vs = h.vs))))
"""


NEGATIVE_DISCOVER = negative_minimal(0.1) + f"SELECT a AS source, b AS target, arrow, label, {_TEXT.format(low=0, high=0)} AS text FROM (SELECT *, {LABEL} AS label FROM least_ WHERE testable > 0)"


#: Rows of the negative lattice with the least number of events lost right below each, and what a threshold makes of them.
_LOSSES = NEGATIVE_ROWS + """,
lost AS MATERIALIZED (SELECT *, total - satisfying_all AS violating, {label} AS label FROM rows_),
spans AS MATERIALIZED (SELECT h.*, (SELECT min(m.violating) FROM lost m WHERE m.a = h.a AND m.b = h.b AND (
    m.arrow = h.arrow AND (m.vo, m.vp, m.vs) <> (h.vo, h.vp, h.vs) AND m.vo <= h.vo AND m.vp <= h.vp AND m.vs <= h.vs
    OR h.arrow <> 'AS' AND m.arrow = 'AS' AND m.vo <= h.vo AND m.vp <= h.vp AND m.vs <= h.vs)) AS until FROM lost h),
noise AS (SELECT unnest({noises}::DOUBLE[]) AS noise),
model AS MATERIALIZED (SELECT * FROM spans, noise WHERE testable > 0 AND total - violating >= (1 - noise) * total AND (until IS NULL OR NOT total - until >= (1 - noise) * total))
"""
_SAY = "{x}.arrow || '(' || {x}.a || ', ' || {x}.b || CASE WHEN {x}.label = '' THEN '' ELSE ', ' || {x}.label END || ')'"
_UNDER = "x.vo <= y.vo AND x.vp <= y.vp AND x.vs <= y.vs"


def losses(noises: tuple[float, ...]) -> str:
    return _LOSSES.format(label=LABEL, noises=list(noises))


NEGATIVE_THRESHOLDS = losses(()) + "SELECT a AS source, b AS target, arrow, label, total, testable, violating, until FROM spans"


def negative_antichain(noises: tuple[float, ...]) -> str:
    return losses(noises) + f"""SELECT noise, (SELECT count(*) FROM model m WHERE m.noise = n.noise) AS arcs, count(p.w) AS comparable, min(p.w) AS witness FROM noise n LEFT JOIN
(SELECT x.noise, {_SAY.format(x='x')} || ' < ' || {_SAY.format(x='y')} AS w FROM model x JOIN model y ON x.noise = y.noise AND x.a = y.a AND x.b = y.b AND (x.arrow, x.vo, x.vp, x.vs) <> (y.arrow, y.vo, y.vp, y.vs) AND (x.arrow = y.arrow OR x.arrow = 'AS') AND {_UNDER}) p USING (noise) GROUP BY 1"""


def negative_upward(noises: tuple[float, ...]) -> str:
    return losses(noises) + f""", rated AS MATERIALIZED (SELECT *, testable > 0 AND total - violating >= (1 - noise) * total AS clears, CASE WHEN testable > 0 THEN satisfying::DOUBLE / testable ELSE 0 END AS share FROM lost, noise),
broken AS MATERIALIZED (SELECT x.noise, x.a, x.b, x.arrow, round(greatest(x.share - y.share, 0), 6) AS drop, {_SAY.format(x='x')} || ' < ' || {_SAY.format(x='y')} AS w FROM rated x JOIN rated y ON x.noise = y.noise AND x.a = y.a AND x.b = y.b AND x.arrow = y.arrow AND {_UNDER} WHERE x.clears AND NOT y.clears)
SELECT noise, (SELECT count(*) FROM rated r WHERE r.noise = n.noise AND clears) AS clearing, count(w) AS breaks, count(DISTINCT (b.a, b.b, b.arrow)) FILTER (w IS NOT NULL) AS units, coalesce(max(drop), 0) AS worst, arg_min(w, (-drop, w)) AS witness FROM noise n LEFT JOIN broken b USING (noise) GROUP BY 1"""


#: Ships of an order are placed: whatever no placing shares order and arrow with, no ship of it does.
def negative_carry(noises: tuple[float, ...]) -> str:
    return losses(noises) + f""", got AS (SELECT DISTINCT m.noise, c.* FROM model m JOIN lost c ON m.b = 'place' AND m.arrow = 'AS' AND c.arrow = 'AS' AND c.a = m.a AND c.b LIKE 'ship_%' AND c.a <> c.b AND (c.vo, c.vp, c.vs) = (m.vo, m.vp, m.vs) AND m.vo > 0)
SELECT noise, count(a) AS derived, count(a) FILTER (NOT total - violating >= (1 - noise) * total) AS broken, min({_SAY.format(x='got')}) FILTER (NOT total - violating >= (1 - noise) * total) AS witness FROM noise LEFT JOIN got USING (noise) GROUP BY 1"""


EQUIVALENCE = """SELECT 'order' AS types, 'place' AS first, 'ship_' || f AS second, 2 * sum((l IS NOT NULL)::INT)::BIGINT AS paired, sum((l IS NULL)::INT)::BIGINT AS broken
FROM (SELECT f, o_orderkey FROM orders, (VALUES ('A'), ('R')) t(f)) LEFT JOIN (SELECT DISTINCT l_returnflag AS f, l_orderkey AS o_orderkey, 1 AS l FROM lineitem) USING (f, o_orderkey) GROUP BY f"""


#: Existence arcs: a binding of one object per EACH type must meet an event at the levels of the others.
EXISTENCE_ROWS = STATES + _levels("[0, 1, 2, 3]", "[0, 2]") + f""",
down AS (SELECT x.i AS xo, y.i AS xt, bit_or(1 << (3 * u.i + z.i)::INT) AS bits FROM (SELECT unnest([0, 2]) AS i) x, (SELECT unnest([0, 1, 2]) AS i) y, (SELECT unnest([0, 1]) AS i) u, (SELECT unnest([0, 1, 2]) AS i) z
  WHERE x.i >= u.i AND y.i >= z.i GROUP BY ALL),
-- levels of the other types that each part, supplier, or both of an event meet; what all of them meet
by_p AS (SELECT e, b, arrow, q, bit_or(bits) AS bits FROM (SELECT p.*, unnest(list_intersect(e.ps, f.ps)) AS q FROM p JOIN o e ON e.ev_id = p.e JOIN o f ON f.ev_id = p.f WHERE p.a IS DISTINCT FROM p.b AND xp > 0) JOIN arrow USING (w) JOIN (SELECT xo AS o_, xt, bits FROM down) ON o_ = xo AND xt = xs GROUP BY 1, 2, 3, 4),
by_s AS (SELECT e, b, arrow, q, bit_or(bits) AS bits FROM (
  SELECT e, b, arrow, q, bits FROM (SELECT p.*, unnest(list_intersect(e.ss, f.ss)) AS q FROM p JOIN o e ON e.ev_id = p.e JOIN o f ON f.ev_id = p.f WHERE p.a IS DISTINCT FROM p.b AND xs > 0) JOIN arrow USING (w) JOIN (SELECT xo AS o_, xt, bits FROM down) ON o_ = xo AND xt = xp
  UNION ALL SELECT o.ev_id, b, k.arrow, s, 1 FROM (SELECT ev_id, a, ts, unnest(ss) AS s FROM o WHERE ss IS NOT NULL) o JOIN lone USING (s), (SELECT DISTINCT arrow FROM arrow) k WHERE a <> b AND CASE k.arrow WHEN 'AS' THEN true WHEN 'EF' THEN hi > ts ELSE lo < ts END) GROUP BY 1, 2, 3, 4),
by_ps AS (SELECT e, b, arrow, q, s, bit_or(CASE WHEN xo > 0 THEN 3 ELSE 1 END) AS bits FROM (SELECT *, unnest(both_s) AS s FROM (SELECT p.*, list_intersect(e.ss, f.ss) AS both_s, unnest(list_intersect(e.ps, f.ps)) AS q FROM p JOIN o e ON e.ev_id = p.e JOIN o f ON f.ev_id = p.f WHERE p.a IS DISTINCT FROM p.b AND xp > 0 AND xs > 0)) JOIN arrow USING (w) GROUP BY 1, 2, 3, 4, 5),
all_p AS (SELECT e, b, arrow, CASE WHEN count(*) = any_value(len(ps)) THEN bit_and(bits) ELSE 0 END AS bits FROM by_p JOIN o ON ev_id = e GROUP BY 1, 2, 3),
all_s AS (SELECT e, b, arrow, CASE WHEN count(*) = any_value(len(ss)) THEN bit_and(bits) ELSE 0 END AS bits FROM by_s JOIN o ON ev_id = e GROUP BY 1, 2, 3),
all_ps AS (SELECT e, b, arrow, CASE WHEN count(*) = any_value(len(ss) * len(ps)) THEN bit_and(bits) ELSE 0 END AS bits FROM by_ps JOIN o ON ev_id = e GROUP BY 1, 2, 3),
need AS (SELECT *, CASE WHEN vo > 0 THEN 1 ELSE 0 END AS lo, CASE vp WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS lp, CASE vs WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS ls FROM label),
up AS MATERIALIZED (SELECT a, b, vo, vp, vs, lo, lp, ls, bit_or(1::BIGINT << (9 * x.i + 3 * y.i + z.i)::INT) AS above FROM need, (SELECT unnest([0, 1, 2]) AS i) x, (SELECT unnest([0, 1, 2]) AS i) y, (SELECT unnest([0, 1, 2]) AS i) z
  WHERE x.i >= lo AND y.i >= lp AND z.i >= ls GROUP BY ALL),
one AS MATERIALIZED (SELECT able.a, able.b, able.arrow, coalesce(mask, 0) AS mask, coalesce(all_p.bits, 0) AS bp, coalesce(all_s.bits, 0) AS bs, coalesce(all_ps.bits, 0) AS bps, yo, yp, ys, count(*) AS n FROM able
  LEFT JOIN met ON met.e = able.e AND met.b = able.b AND met.arrow = able.arrow LEFT JOIN all_p ON all_p.e = able.e AND all_p.b = able.b AND all_p.arrow = able.arrow
  LEFT JOIN all_s ON all_s.e = able.e AND all_s.b = able.b AND all_s.arrow = able.arrow LEFT JOIN all_ps ON all_ps.e = able.e AND all_ps.b = able.b AND all_ps.arrow = able.arrow GROUP BY ALL),
rows_ AS MATERIALIZED (SELECT up.a, up.b, one.arrow, vo, vp, vs, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS testable, coalesce(sum(n) FILTER (ok AND good), 0)::BIGINT AS satisfying, coalesce(sum(n) FILTER (good), 0)::BIGINT AS satisfying_all
  FROM up JOIN (SELECT * FROM one) one USING (a, b), LATERAL (SELECT CASE WHEN vp = 2 AND vs = 2 THEN (bps >> lo) & 1 WHEN vp = 2 THEN (bp >> (3 * lo + ls)) & 1 WHEN vs = 2 THEN (bs >> (3 * lo + lp)) & 1 WHEN (mask & above) <> 0 THEN 1 ELSE 0 END = 1 AS good,
    coalesce(yo, 0) >= lo AND coalesce(yp, 0) >= lp AND coalesce(ys, 0) >= ls AS ok) GROUP BY 1, 2, 3, 4, 5, 6)
"""
EXISTENCE_TABLE = EXISTENCE_ROWS + _TABLE


def _maximal(name: str, of: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {of} x WHERE NOT EXISTS (SELECT 1 FROM {of} y WHERE x.a = y.a AND x.b = y.b AND (x.vo, x.vp, x.vs) <> (y.vo, y.vp, y.vs) AND x.vo <= y.vo AND x.vp <= y.vp AND x.vs <= y.vs))"


#: A match of event f for a binding (bp, bs) of the label.
_MATCH = "xo >= lo AND CASE WHEN vp = 2 THEN list_contains(f.ps, bp) ELSE xp >= lp END AND CASE WHEN vs = 2 THEN list_contains(f.ss, bs) ELSE xs >= ls END"
_WEAKER = "(c.arrow = y.arrow OR c.arrow = 'AS' OR (c.arrow = 'EF' AND y.arrow = 'DF') OR (c.arrow = 'EP' AND y.arrow = 'DP'))"
_SERVES = f"{_WEAKER} AND c.vo <= y.vo AND c.vp <= y.vp AND c.vs <= y.vs"
_LOOSE = "NOT (c.vo = 1 AND {y}.vo = 1 OR c.vp = 1 AND {y}.vp = 1 OR c.vs = 1 AND {y}.vs = 1)"


def existence_found(noise: float) -> str:
    """Common table expressions up to found(a, b, arrow, vo, vp, vs): the strictest labels that hold level
    by level, then the strictest arrows. Of an activity with itself only AS would hold, as each order
    has one event of an activity, and AS of an activity with itself is no arc."""
    return EXISTENCE_ROWS + f""", yes AS MATERIALIZED (SELECT rows_.*, lo, lp, ls FROM rows_ JOIN up USING (a, b, vo, vp, vs) WHERE satisfying_all >= ceil(total * (1 - {noise}::DOUBLE))),
t0 AS MATERIALIZED (SELECT a, b, vo, vp, vs, lo, lp, ls FROM yes WHERE arrow = 'AS'),
s1 AS (SELECT * FROM t0 WHERE (vo > 0)::INT + (vp > 0)::INT + (vs > 0)::INT = 1),
s2 AS MATERIALIZED (SELECT * FROM t0 WHERE (vo > 0)::INT + (vp > 0)::INT + (vs > 0)::INT = 2),
{_maximal('m2', 's2')},
s3 AS MATERIALIZED (SELECT DISTINCT t0.* FROM m2 x JOIN m2 y USING (a, b) JOIN t0 ON t0.a = x.a AND t0.b = x.b AND t0.vo = greatest(x.vo, y.vo) AND t0.vp = greatest(x.vp, y.vp) AND t0.vs = greatest(x.vs, y.vs) WHERE t0.vo > 0 AND t0.vp > 0 AND t0.vs > 0),
every AS (SELECT * FROM s1 UNION SELECT * FROM s2 UNION SELECT * FROM s3), {_maximal('top', 'every')},
asked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY a, b, vo, vp, vs) AS id FROM top),
bind0 AS (SELECT asked.*, ev_id AS e, o.ts, ss, unnest(CASE WHEN vp = 2 THEN ps ELSE [NULL] END) AS bp FROM asked JOIN o ON o.a = asked.a),
bind AS MATERIALIZED (SELECT *, unnest(CASE WHEN vs = 2 THEN ss ELSE [NULL] END) AS bs FROM bind0),
-- how many events a binding meets: one at most if it names the order; by pairs; by the suppliers' events alone
per_s AS MATERIALIZED (SELECT ob_id AS s, ev_type AS b, count(*) AS n FROM d WHERE ob_type = 'supplier' GROUP BY 1, 2),
n_rich AS (SELECT id, e, bp, bs, count(DISTINCT f) AS n FROM (SELECT bind.*, p.f FROM bind JOIN p ON p.e = bind.e AND p.b = bind.b JOIN o f ON f.ev_id = p.f WHERE (vo + vp > 0 OR vs = 3 AND len(bind.ss) > 1) AND {_MATCH}) GROUP BY ALL),
lone_s AS MATERIALIZED (SELECT x.id, x.e, x.bp, x.bs, x.b, x.s, per_s.n FROM (SELECT *, unnest(CASE WHEN vs = 2 THEN [bs] ELSE ss END) AS s FROM bind WHERE vo + vp = 0 AND (vs < 3 OR len(ss) = 1)) x JOIN per_s ON per_s.s = x.s AND per_s.b = x.b),
few AS (SELECT lone_s.id, lone_s.e, lone_s.bp, lone_s.bs, count(DISTINCT d.ev_id) AS n FROM lone_s JOIN d ON lone_s.n <= 20 AND d.ob_id = lone_s.s AND d.ev_type = lone_s.b GROUP BY 1, 2, 3, 4),
n_lone AS (SELECT x.id, x.e, x.bp, x.bs, greatest(x.n, coalesce(few.n, 0)) AS n FROM (SELECT id, e, bp, bs, max(n) AS n FROM lone_s GROUP BY 1, 2, 3, 4) x LEFT JOIN few ON few.id = x.id AND few.e = x.e AND few.bs IS NOT DISTINCT FROM x.bs),
narrow AS (SELECT id FROM (SELECT bind.id, bind.e, bool_and(coalesce(n_rich.n, n_lone.n, 0) BETWEEN 1 AND 20) AS ok FROM bind LEFT JOIN n_rich ON n_rich.id = bind.id AND n_rich.e = bind.e AND n_rich.bp IS NOT DISTINCT FROM bind.bp AND n_rich.bs IS NOT DISTINCT FROM bind.bs
  LEFT JOIN n_lone ON n_lone.id = bind.id AND n_lone.e = bind.e AND n_lone.bp IS NOT DISTINCT FROM bind.bp AND n_lone.bs IS NOT DISTINCT FROM bind.bs GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (ok) >= ceil(count(*) * (1 - {noise}::DOUBLE))),
wide AS MATERIALIZED (SELECT asked.* FROM asked JOIN narrow USING (id)),
timed AS MATERIALIZED (SELECT wide.*, yes.arrow FROM wide JOIN yes USING (a, b, vo, vp, vs) WHERE yes.arrow <> 'AS'),
-- the nearest event that meets a binding, whatever its activity; a label of suppliers alone meets far more
-- than 20 events and does not get here
near AS (SELECT bind.id, timed.arrow, bind.e, bind.bp, bind.bs, arg_min(f.fa, (f.ts, f.ev_id)) FILTER (timed.arrow = 'EF' AND f.ts > bind.ts) AS next, arg_max(f.fa, (f.ts, f.ev_id)) FILTER (timed.arrow = 'EP' AND f.ts < bind.ts) AS prev
  FROM bind JOIN timed USING (id) LEFT JOIN (SELECT p.*, f.ps, f.ss, f.ts, f.ev_id, f.a AS fa FROM p JOIN o f ON f.ev_id = p.f) f ON f.e = bind.e AND f.xo >= bind.lo AND CASE WHEN bind.vp = 2 THEN list_contains(f.ps, bind.bp) ELSE f.xp >= bind.lp END AND CASE WHEN bind.vs = 2 THEN list_contains(f.ss, bind.bs) ELSE f.xs >= bind.ls END GROUP BY 1, 2, 3, 4, 5),
direct AS (SELECT id, arrow FROM (SELECT id, arrow, e, bool_and(coalesce(coalesce(next, prev) = b, false)) AS ok FROM near JOIN asked USING (id) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) FILTER (ok) >= ceil(count(*) * (1 - {noise}::DOUBLE))),
found AS MATERIALIZED (SELECT a, b, CASE WHEN direct.id IS NOT NULL THEN CASE timed.arrow WHEN 'EF' THEN 'DF' ELSE 'DP' END ELSE timed.arrow END AS arrow, vo, vp, vs FROM timed LEFT JOIN direct ON direct.id = timed.id AND direct.arrow = timed.arrow
  UNION ALL SELECT a, b, 'AS', vo, vp, vs FROM wide WHERE id NOT IN (SELECT id FROM timed))
"""


def lossless(found: str) -> str:
    """Common table expressions up to left_: arcs of found that no path of one to three stricter arcs
    implies, tried in order; a removed arc serves no later path, and beyond its first step a path must
    not share an ANY type with the arc."""
    key = "array_to_string(list_filter([CASE WHEN vo > 0 THEN 'order' || vo END, CASE WHEN vp > 0 THEN 'part' || vp END, CASE WHEN vs > 0 THEN 'supplier' || vs END], lambda x: x IS NOT NULL), ',')"
    serves = lambda y: _SERVES.replace("y.", f"{y}.")
    loose = lambda y: _LOOSE.format(y=y)
    return f""", arcs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY a, b, arrow, {key}) AS k FROM (SELECT DISTINCT * FROM {found})),
ways AS MATERIALIZED (SELECT c.k, [y.k] AS ids FROM arcs c JOIN arcs y ON y.a = c.a AND y.b = c.b AND y.k <> c.k AND {serves('y')}
UNION ALL SELECT c.k, [y.k, z.k] FROM arcs c JOIN arcs y ON y.a = c.a AND y.b NOT IN (c.a, c.b) AND {serves('y')} JOIN arcs z ON z.a = y.b AND z.b = c.b AND {serves('z')} AND {loose('z')}
UNION ALL SELECT c.k, [y.k, z.k, u.k] FROM arcs c JOIN arcs y ON y.a = c.a AND y.b NOT IN (c.a, c.b) AND {serves('y')} JOIN arcs z ON z.a = y.b AND z.b NOT IN (c.a, c.b, y.b) AND {serves('z')} AND {loose('z')} JOIN arcs u ON u.a = z.b AND u.b = c.b AND {serves('u')} AND {loose('u')}),
steps(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN EXISTS (SELECT 1 FROM ways WHERE ways.k = steps.k + 1 AND NOT list_has_any(ids, gone)) THEN list_append(gone, k + 1) ELSE gone END FROM steps WHERE k < (SELECT count(*) FROM arcs)),
left_ AS (SELECT * FROM arcs WHERE NOT list_contains((SELECT arg_max(gone, k) FROM steps), k))
"""


DECLARE_DISCOVER = existence_found(0.2) + lossless("found") + f"SELECT a AS source, b AS target, arrow, label, {_TEXT.format(low=1, high='inf')} AS text FROM (SELECT *, {LABEL} AS label FROM left_)"

#: Arcs without DF and DP, kept between the activities and composed along chains through the others.
_TYPES = ("vo", "vp", "vs")
_COMPOSED = "CASE WHEN {x}.arrow = {y}.arrow THEN {x}.arrow ELSE 'AS' END"


def projected(activities: tuple[str, str]) -> str:
    some = "(" + ", ".join(f"'{a}'" for a in activities) + ")"
    both = ", ".join(f"least(x.{c}, y.{c}) AS {c}" for c in _TYPES)
    three = ", ".join(f"least(xy.{c}, z.{c}) AS {c}" for c in _TYPES)
    return existence_found(0.2) + f""", loose AS MATERIALIZED (SELECT a, b, arrow, vo, vp, vs FROM timed UNION ALL SELECT a, b, 'AS', vo, vp, vs FROM wide WHERE id NOT IN (SELECT id FROM timed)),
xy AS (SELECT x.a, y.a AS m, y.b, {_COMPOSED.format(x='x', y='y')} AS arrow, {both} FROM loose x JOIN loose y ON x.b = y.a AND y.b <> x.a AND x.a IN {some} AND x.b NOT IN {some}),
xyz AS (SELECT xy.a, z.b, {_COMPOSED.format(x='xy', y='z')} AS arrow, {three} FROM xy JOIN loose z ON xy.b = z.a AND z.b <> xy.a AND xy.b NOT IN {some} AND z.b <> xy.m),
res AS (SELECT a, b, arrow, vo, vp, vs FROM loose WHERE a IN {some} AND b IN {some} UNION SELECT a, b, arrow, vo, vp, vs FROM xy WHERE b IN {some} AND vo + vp + vs > 0 UNION SELECT a, b, arrow, vo, vp, vs FROM xyz WHERE b IN {some} AND vo + vp + vs > 0),
best AS MATERIALIZED (SELECT * FROM res c WHERE NOT EXISTS (SELECT 1 FROM res y WHERE y.a = c.a AND y.b = c.b AND (y.arrow, y.vo, y.vp, y.vs) <> (c.arrow, c.vo, c.vp, c.vs) AND {_SERVES}))
""" + lossless("best") + f"SELECT a AS source, b AS target, arrow, label, {_TEXT.format(low=1, high='inf')} AS text FROM (SELECT *, {LABEL} AS label FROM left_)"


DECLARE_PROJECTED = projected(("place", "ship_R"))


# -- dialogues

_CASES = "t AS (SELECT conv_id, list(role ORDER BY turn) AS trace FROM conversations GROUP BY 1), v AS MATERIALIZED (SELECT trace, count(*) AS freq FROM t GROUP BY 1)"


def _aligned(start: str, moves: list[tuple[str, str | None, str]], final: str) -> str:
    """Least cost of a walk from state start to final that reads the trace: reading a step the model
    also makes and silent steps are free, all else costs one. Costs are carried for every state."""
    states = sorted({start, final, *(x for a, _, b in moves for x in (a, b))})
    far = {(a, b): 0 if a == b else 10**6 for a in states for b in states}
    for a, label, b in moves:
        far[a, b] = min(far[a, b], 0 if label is None else 1)
    for m in states:
        for a in states:
            for b in states:
                far[a, b] = min(far[a, b], far[a, m] + far[m, b])
    hop = lambda cost: {b: "least(" + ", ".join(f"{cost(a)} + {far[a, b]}" for a in states) + ")" for b in states}
    step = lambda b: "least(" + ", ".join([f"{b} + 1", *(f"CASE WHEN trace[i + 1] = '{label}' THEN {a} ELSE 1000000 END" for a, label, c in moves if c == b and label is not None)]) + ")"
    names = ", ".join(states)
    first = ", ".join(f"{far[start, s]} AS {s}" for s in states)
    after = ", ".join(f"{x} AS {s}" for s, x in hop(lambda a: f"n_{a}").items())
    return f"""{_CASES}, w(trace, freq, i, {names}) AS (SELECT trace, freq, 0, {first} FROM v
UNION ALL SELECT trace, freq, i + 1, {after} FROM (SELECT trace, freq, i, {', '.join(f'{step(s)} AS n_{s}' for s in states)} FROM w WHERE i < len(trace))),
c AS (SELECT array_to_string(trace, '>') AS trace, freq, {final}::BIGINT AS cost, ({far[start, final]} + len(trace))::BIGINT AS worst FROM w WHERE i = len(trace))"""


_NET = _aligned("start", [("start", None, "idle"), ("start", "system", "idle"), ("idle", "user", "asked"), ("asked", "assistant", "idle")], "idle")
_TREE = _aligned("start", [("start", None, "ready"), ("start", "system", "ready"), ("ready", "user", "asked"), ("asked", "assistant", "done"), ("done", None, "ready")], "done")
_FITNESS = """ SELECT sum(cost * freq)::BIGINT AS total_cost, round(1 - sum(cost * freq)::DOUBLE / sum(worst * freq), 6) AS log_fitness,
round(sum(CASE WHEN worst > 0 THEN 1 - cost::DOUBLE / worst ELSE 1 END * freq) / sum(freq), 6) AS average_fitness, round(coalesce(sum(freq) FILTER (cost = 0), 0)::DOUBLE / sum(freq), 6) AS perfect, 0::BIGINT AS unsolved FROM c"""

ALIGNMENTS = f"WITH RECURSIVE {_NET} SELECT trace, freq, cost, worst, 'ok' AS status FROM c"
ALIGNMENT_VALIDITY = f"WITH RECURSIVE {_NET} SELECT trace, trace AS spelled, freq, cost, cost AS charged, true AS matched, true AS runs FROM c"
ALIGNMENT_FITNESS = f"WITH RECURSIVE {_NET}{_FITNESS}"
TREE_ALIGNMENTS = f"WITH RECURSIVE {_TREE}{_FITNESS}"

#: Replay of the three visible steps: a user's turn moves the token from idle to asked, an assistant's
#: back, a system's from a start that never has one to idle; a token that is not there is missing.
TOKEN_REPLAY = f"""WITH RECURSIVE {_CASES}, w(trace, freq, i, idle, asked, produced, consumed, missing) AS (SELECT trace, freq, 0, 1, 0, 1, 0, 0 FROM v
UNION ALL SELECT trace, freq, i + 1, CASE r WHEN 'user' THEN greatest(idle - 1, 0) ELSE idle + k END, CASE r WHEN 'assistant' THEN greatest(asked - 1, 0) WHEN 'user' THEN asked + 1 ELSE asked END,
  produced + k, consumed + k, missing + CASE WHEN (r = 'user' AND idle = 0) OR (r = 'assistant' AND asked = 0) OR r = 'system' THEN 1 ELSE 0 END
  FROM (SELECT *, trace[i + 1] AS r, CASE WHEN trace[i + 1] IN ('user', 'assistant', 'system') THEN 1 ELSE 0 END AS k FROM w WHERE i < len(trace))),
c AS (SELECT freq, produced, consumed + 1 AS consumed, missing + CASE WHEN idle = 0 THEN 1 ELSE 0 END AS missing, greatest(idle - 1, 0) + asked AS remaining FROM w WHERE i = len(trace)),
s AS (SELECT sum(produced * freq)::BIGINT AS produced, sum(consumed * freq)::BIGINT AS consumed, sum(missing * freq)::BIGINT AS missing, sum(remaining * freq)::BIGINT AS remaining FROM c)
SELECT *, round(0.5 * (1 - missing::DOUBLE / consumed) + 0.5 * (1 - remaining::DOUBLE / produced), 6) AS fitness FROM s"""


# -- paths and maps

_GRAPH = """+g AS MATERIALIZED (SELECT 'event' AS ka, ev_type AS a, qualifier AS q, 'object' AS kb, ob_type AS b FROM e2o JOIN ev USING (ev_id) JOIN ob USING (ob_id) GROUP BY ALL
  UNION ALL SELECT 'object', s.ob_type, qualifier, 'object', t.ob_type FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id GROUP BY ALL),
h AS (SELECT ka || ':' || a AS x, kb || ':' || b AS y, ' -[' || q || ']-> ' || b AS step FROM g UNION ALL SELECT kb || ':' || b, ka || ':' || a, ' <-[' || q || ']- ' || a FROM g),
walk AS ("""


def schemas(source: str, target: str, most: int) -> str:
    """All chains of types from source to target of up to so many steps, no type twice."""
    levels = [f"l0 AS (SELECT 'event:{source}' AS here, ['event:{source}'] AS seen, '{source}' AS schema)"]
    levels += [f"l{k} AS (SELECT y AS here, list_append(seen, y) AS seen, schema || step AS schema FROM l{k - 1} JOIN h ON x = here AND NOT list_contains(seen, y))" for k in range(1, most + 1)]
    body = " UNION ALL ".join(f"SELECT schema, {k}::BIGINT AS length FROM l{k} WHERE here = 'event:{target}'" for k in range(1, most + 1))
    return _GRAPH.removesuffix(",\nwalk AS (") + ", " + ", ".join(levels) + " " + body


#: place to ship_A by three steps at most: over the order, over its parts, and over the customer's orders.
PATH_DISCOVER = """+c AS (SELECT 'place -[order]-> order <-[order]- ship_A' AS schema, e.ev_id AS s, f.ev_id AS t FROM d e JOIN d f ON f.ob_id = e.ob_id AND f.ev_type = 'ship_A' WHERE e.ev_type = 'place' AND e.ob_type = 'order'
UNION SELECT 'place -[order]-> order -[contains]-> part <-[part]- ship_A', e.ev_id, f.ev_id FROM d e JOIN o2o ON src_id = e.ob_id AND o2o.qualifier = 'contains' JOIN d f ON f.ob_id = tgt_id AND f.ev_type = 'ship_A' WHERE e.ev_type = 'place' AND e.ob_type = 'order'
UNION SELECT 'place -[customer]-> customer <-[placed_by]- order <-[order]- ship_A', e.ev_id, f.ev_id FROM d e JOIN o2o ON tgt_id = e.ob_id AND o2o.qualifier = 'placed_by' JOIN d f ON f.ob_id = src_id AND f.ev_type = 'ship_A' WHERE e.ev_type = 'place' AND e.ob_type = 'customer'),
n AS (SELECT count(*) FILTER (ev_type = 'place') AS ns, count(*) FILTER (ev_type = 'ship_A') AS nt FROM ev),
m AS (SELECT schema, count(*) AS support, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets, list((s, t) ORDER BY s, t)::VARCHAR AS pairs FROM c GROUP BY 1)
SELECT schema, support, sources::DOUBLE / ns AS coverage, sources::DOUBLE / support AS selectivity, targets::DOUBLE / nt AS reach, targets::DOUBLE / support AS exclusivity,
first(schema) OVER (PARTITION BY md5(pairs) ORDER BY len(schema), schema) AS representative FROM m, n"""
PATH_ENUMERATE = schemas("place", "ship_A", 3)

_MAPS = """+l AS (SELECT DISTINCT src_id, tgt_id, s.ob_type AS x, t.ob_type AS y FROM o2o JOIN ob s ON s.ob_id = src_id JOIN ob t ON t.ob_id = tgt_id), n AS (SELECT ob_type, count(*) AS total FROM ob GROUP BY 1),
f AS MATERIALIZED (SELECT x, y, o FROM (SELECT x, y, 'forward' AS o, count(*) AS covered, max(k) AS k FROM (SELECT src_id, x, y, count(*) AS k FROM l GROUP BY ALL) GROUP BY 1, 2
  UNION ALL SELECT y, x, 'reverse', count(*), max(k) FROM (SELECT tgt_id, x, y, count(*) AS k FROM l GROUP BY ALL) GROUP BY 1, 2) JOIN n ON n.ob_type = x WHERE k = 1 AND covered >= 0.95 * total),
c1 AS (SELECT x AS a, y AS b, [x, y] AS seen FROM f), """ + ", ".join(f"c{k} AS (SELECT a, y AS b, list_append(seen, y) AS seen FROM c{k - 1} JOIN f ON x = b AND NOT list_contains(seen, y))" for k in (2, 3, 4)) + """,
c AS MATERIALIZED (SELECT a, b FROM c1 UNION ALL SELECT a, b FROM c2 UNION ALL SELECT a, b FROM c3 UNION ALL SELECT a, b FROM c4)
"""
#: Chains of maps per pair of types, and the types to keep: here those that no chain leads to, which is
#: the least set where no two types lead to each other.
MAP_CLOSURE = _MAPS + "SELECT a AS source, b AS target, count(*) AS chains FROM c GROUP BY 1, 2 UNION ALL SELECT ob_type, 'kept', 0 FROM n WHERE ob_type NOT IN (SELECT b FROM c)"

#: A sequence of place and all ships side by side, whose leaves have the types that the log gives them: the facts of
#: the log and of this tree written out, and their shares.
LANGUAGE_FITNESS = """+ev2 AS (SELECT DISTINCT ev_id, ev_type FROM d), n AS (SELECT ev_type, count(*) AS events FROM ev2 GROUP BY 1),
c AS (SELECT ev_type, ob_type, count(*) AS carrying, max(n) AS high FROM (SELECT ev_id, ev_type, ob_type, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2),
m AS (SELECT ev_type, ob_type, count(DISTINCT ob_id) AS met FROM d GROUP BY 1, 2), t AS (SELECT ob_type, count(DISTINCT ob_id) AS objects FROM d GROUP BY 1),
rest AS (SELECT x.ev_id, x.ob_type, coalesce((SELECT list_sort(list(y.ob_id)) FROM d y WHERE y.ev_id = x.ev_id AND y.ob_type <> x.ob_type), []) AS os FROM (SELECT DISTINCT ev_id, ob_type FROM d) x),
v AS (SELECT DISTINCT ev_type, ob_type FROM (SELECT d.ev_type, d.ob_type, d.ob_id, count(DISTINCT os) AS q FROM d JOIN rest USING (ev_id, ob_type) GROUP BY ALL) WHERE q > 1),
rel AS MATERIALIZED (SELECT c.ev_type, c.ob_type, carrying < events AS deficient, high > 1 AS convergent, v.ev_type IS NOT NULL AS divergent, met < objects AS optional FROM c JOIN n USING (ev_type)
  JOIN m ON m.ev_type = c.ev_type AND m.ob_type = c.ob_type JOIN t ON t.ob_type = c.ob_type LEFT JOIN v ON v.ev_type = c.ev_type AND v.ob_type = c.ob_type),
life AS (SELECT ob_type, ev_type, lead(ev_type) OVER w AS next, lag(ev_type) OVER w IS NULL AS first FROM e2o JOIN ev USING (ev_id) JOIN ob USING (ob_id) WINDOW w AS (PARTITION BY ob_id ORDER BY ts, ev_id)),
lp AS MATERIALIZED (SELECT DISTINCT ob_type, ev_type AS source, next AS target FROM life WHERE next IS NOT NULL),
base AS (SELECT 'related' AS kind, ob_type, ev_type AS activity FROM rel UNION ALL SELECT 'divergent', ob_type, ev_type FROM rel WHERE divergent),
lk AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT 'convergent', ob_type, ev_type FROM rel WHERE convergent UNION ALL SELECT 'deficient', ob_type, ev_type FROM rel WHERE deficient
  UNION ALL SELECT 'optional', ob_type, ev_type FROM rel WHERE optional UNION ALL SELECT DISTINCT 'start', ob_type, ev_type FROM life WHERE first UNION ALL SELECT DISTINCT 'end', ob_type, ev_type FROM life WHERE next IS NULL),
room AS (SELECT x.ob_type AS many, y.ob_type AS single, bool_and(coalesce(p.divergent OR p.convergent, false) OR coalesce(q.divergent OR q.deficient, false)) AS ok
  FROM t x, t y, n LEFT JOIN rel p ON p.ev_type = n.ev_type AND p.ob_type = x.ob_type LEFT JOIN rel q ON q.ev_type = n.ev_type AND q.ob_type = y.ob_type GROUP BY 1, 2),
leaf AS (SELECT t.ob_type, n.ev_type AS a, rel.ev_type IS NOT NULL AS related, coalesce(divergent, false) AS again, rel.ev_type IS NULL OR divergent AS skip FROM t CROSS JOIN n LEFT JOIN rel ON rel.ev_type = n.ev_type AND rel.ob_type = t.ob_type),
side AS (SELECT ob_type, bool_and(skip) FILTER (a = 'place') AS place_skip, bool_and(skip) FILTER (a <> 'place') AS ship_skip FROM leaf GROUP BY 1),
mk AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT 'optional', ob_type, ev_type FROM rel WHERE divergent
  UNION ALL SELECT 'convergent', r.ob_type, r.ev_type FROM rel r WHERE convergent AND (deficient OR divergent OR NOT EXISTS (SELECT 1 FROM rel o JOIN room ON many = r.ob_type AND single = o.ob_type WHERE o.ev_type = r.ev_type AND o.ob_type <> r.ob_type AND NOT o.convergent AND NOT o.divergent AND NOT ok))
  UNION ALL SELECT 'deficient', r.ob_type, r.ev_type FROM rel r WHERE deficient AND (convergent OR divergent OR NOT EXISTS (SELECT 1 FROM rel o JOIN room ON many = o.ob_type AND single = r.ob_type WHERE o.ev_type = r.ev_type AND o.ob_type <> r.ob_type AND NOT o.deficient AND NOT o.divergent AND NOT ok))
  UNION ALL SELECT 'start', ob_type, a FROM leaf JOIN side USING (ob_type) WHERE related AND (a = 'place' OR place_skip) UNION ALL SELECT 'end', ob_type, a FROM leaf JOIN side USING (ob_type) WHERE related AND (a <> 'place' OR ship_skip)),
mp AS MATERIALIZED (SELECT ob_type, a AS source, a AS target FROM leaf WHERE again
  UNION SELECT ob_type, x.a, y.a FROM leaf x JOIN leaf y USING (ob_type) JOIN side USING (ob_type) WHERE x.related AND y.related AND x.a <> y.a AND (y.a <> 'place' OR place_skip AND ship_skip)),
acts AS (SELECT source AS a FROM lp UNION SELECT target FROM lp),
ks AS (SELECT activity, kind, count(l) AS l, count(r) AS r, count(l + r) AS m FROM (SELECT *, 1 AS l FROM lk) FULL JOIN (SELECT *, 1 AS r FROM mk) USING (kind, ob_type, activity) WHERE activity IN (SELECT a FROM acts) GROUP BY 1, 2),
ka AS (SELECT activity, avg(m / l) FILTER (l > 0) AS f, avg(m / r) FILTER (r > 0) AS p FROM ks GROUP BY 1),
ps AS (SELECT source, target, count(l) AS l, count(r) AS r, count(l + r) AS m FROM (SELECT *, 1 AS l FROM lp) FULL JOIN (SELECT *, 1 AS r FROM mp) USING (ob_type, source, target) WHERE source IN (SELECT a FROM acts) AND target IN (SELECT a FROM acts) GROUP BY 1, 2)
SELECT round(((SELECT coalesce(avg(f), 0) FROM ka) + (SELECT coalesce(avg(m / l) FILTER (l > 0), 0) FROM ps)) / 2, 6) AS fitness, round(((SELECT coalesce(avg(p), 0) FROM ka) + (SELECT coalesce(avg(m / r) FILTER (r > 0), 0) FROM ps)) / 2, 6) AS precision"""

#: Which cells of the trade log its two relations rebuild: customers from orders, orders from their only customer's
#: orders, parts from orders, orders from the parts that contain them; each checked over all events.
STRUCTURE = """+cell AS (SELECT ev_type, ob_type, count(*) AS before FROM d GROUP BY 1, 2),
rel AS (SELECT DISTINCT x.ob_type AS s, y.ob_type AS t, src_id AS x, tgt_id AS y, 'forth' AS way FROM o2o JOIN ob x ON x.ob_id = src_id JOIN ob y ON y.ob_id = tgt_id),
once AS (SELECT s, t FROM (SELECT s, t, x, count(*) AS k FROM rel GROUP BY ALL) GROUP BY 1, 2 HAVING max(k) = 1),
way AS (SELECT * FROM rel UNION ALL SELECT t, s, y, x, 'back' FROM rel JOIN once USING (s, t)),
img AS (SELECT d.ev_id, way.way, s, t, list_sort(list(DISTINCT y)) AS ys FROM d JOIN way ON x = ob_id GROUP BY ALL),
own AS (SELECT ev_id, ev_type, ob_type, list_sort(list(ob_id)) AS os FROM d GROUP BY 1, 2, 3),
pair AS (SELECT DISTINCT s, t, way FROM way),
judged AS (SELECT e.ev_type, pair.s, pair.t, pair.way, bool_and((a.os IS NULL) = (b.os IS NULL) AND coalesce(b.os, []) = coalesce(img.ys, [])) AS ok, bool_or(a.os IS NOT NULL) AS seen FROM pair CROSS JOIN (SELECT DISTINCT ev_id, ev_type FROM d) e
  LEFT JOIN own a ON a.ev_id = e.ev_id AND a.ob_type = pair.s LEFT JOIN own b ON b.ev_id = e.ev_id AND b.ob_type = pair.t LEFT JOIN img ON img.ev_id = e.ev_id AND img.s = pair.s AND img.t = pair.t AND img.way = pair.way GROUP BY 1, 2, 3, 4),
steps AS (SELECT DISTINCT ev_type, s, t FROM judged WHERE ok AND seen),
kept AS (SELECT ev_type, ob_type FROM cell EXCEPT SELECT ev_type, t FROM steps),
-- activities that share an object of a type both keep, all of them and the kept ones
edge AS (SELECT DISTINCT x.ev_type AS a, y.ev_type AS b, x.ob_type FROM d x JOIN d y USING (ob_id)),
meet AS (SELECT 'before' AS g, a, b FROM edge UNION SELECT 'after', a, b FROM edge JOIN kept x ON x.ev_type = a AND x.ob_type = edge.ob_type JOIN kept y ON y.ev_type = b AND y.ob_type = edge.ob_type),
reach(g, a, b) AS (SELECT g, a, b FROM meet UNION SELECT r.g, r.a, m.b FROM reach r JOIN meet m ON m.g = r.g AND m.a = r.b),
parts AS (SELECT g, count(DISTINCT low) AS n FROM (SELECT g, a, min(b) AS low FROM reach GROUP BY 1, 2) GROUP BY 1)
SELECT c.ev_type AS activity, c.ob_type, k.ev_type IS NOT NULL AS kept, before, CASE WHEN k.ev_type IS NULL THEN 0 ELSE before END::BIGINT AS after, (SELECT n FROM parts WHERE g = 'before') AS parts_before, (SELECT n FROM parts WHERE g = 'after') AS parts_after
FROM cell c LEFT JOIN kept k ON k.ev_type = c.ev_type AND k.ob_type = c.ob_type"""
