"""Constraints against a plain statement of their meaning, on random micro-logs."""

import datetime as dt
import itertools
import random
import re

import pytest

from loomtrace import queries
from loomtrace.log import OCLog
from loomtrace.operators import declare, negative, objects
from loomtrace.plans.declare import ALL, ANY, EACH, Arc, Label, project_arcs, reduce_arcs
from loomtrace.plans.negative import Knowledge, closure, condense, edges, entailed_positive, precision, reduce_negative, structural, too_few

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def micro(spark, events, extra_objects=(), o2o=()):
    """events: [(type, day, [objects])]; an object's type is its first letter."""
    ev = [(f"e{k}", t, T0 + dt.timedelta(days=day)) for k, (t, day, _) in enumerate(events)]
    obs = sorted({o for _, _, os in events for o in os} | set(extra_objects))
    return OCLog.of(spark, ev, [(o, o[0]) for o in obs], [(f"e{k}", o, "q") for k, (_, _, os) in enumerate(events) for o in os], [(a, b, "r") for a, b in o2o])


def brute(events, arc, o2o=()):
    """(total, violating) by the definition."""
    def own(os, key):
        if ">" in key:
            a, b = key.split(">")
            return sorted({y for x, y in o2o if x in os and x[0] == a and y[0] == b})
        if "<" in key:
            a, b = key.split("<")
            return sorted({x for x, y in o2o if y in os and y[0] == a and x[0] == b})
        return sorted({o for o in os if o[0] == key})

    total = bad = 0
    for k, (t, day, os) in enumerate(events):
        if t != arc.source:
            continue
        total += 1
        need = [(v, own(os, key)) for key, v in arc.label]
        need = [(v, s) for v, s in need if s]
        each = [s for v, s in need if v == EACH]
        worst = False
        for pick in itertools.product(*each):
            hits = []
            for j, (u, d2, fs) in enumerate(events):
                if not (set(pick) <= set(fs) and all(set(s) <= set(fs) for v, s in need if v == ALL) and all(set(s) & set(fs) for v, s in need if v == ANY)):
                    continue
                if arc.arrow in ("EF", "DF") and d2 <= day or arc.arrow in ("EP", "DP") and d2 >= day:
                    continue
                hits.append((d2, f"e{j}", u))
            if arc.arrow in ("DF", "DP"):
                n = int(bool(hits) and (min(hits) if arc.arrow == "DF" else max(hits))[2] == arc.target)
            else:
                n = sum(u == arc.target for _, _, u in hits)
            worst |= n < (arc.low or 0) or arc.high is not None and n > arc.high
        bad += worst
    return total, bad


def random_log(seed):
    r = random.Random(seed)
    pool = ["o1", "o2", "i1", "i2", "i3", "c1"]
    return [(r.choice("abc"), r.randint(0, 6), sorted(r.sample(pool, r.randint(0, 4)))) for _ in range(16)], [(r.choice(["o1", "o2"]), r.choice(["i1", "i2", "i3"])) for _ in range(4)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_check_equals_definition(spark, seed):
    events, o2o = random_log(seed)
    labels = [Label(), Label.of(any=["o"]), Label.of(each=["o"]), Label.of(all=["i"]), Label.of(each=["i"]), Label.of(any=["i"], each=["o"]), Label.of(all=["i"], any=["o"]), Label.of(each=["i", "o"]), Label.of(any=["o>i"]), Label.of(each=["i<o"]), Label.of(each=["i"], all=["o"], any=["c"])]
    bounds = [(1, None), (0, 0), (1, 2), (2, None)]
    r = random.Random(seed)
    arcs = [Arc(a, b, arrow, label, *r.choice(bounds)) for label in labels for arrow in ("AS", "EF", "EP", "DF", "DP") for a, b in (("a", "b"), ("b", "a"), ("c", "c"))]
    log = micro(spark, events, ["o1", "o2", "i1", "i2", "i3", "c1"], o2o)
    got = {x["arc"]: (x["total"], x["violating"]) for x in declare.check(log, arcs).collect()}
    wrong = [(arcs[k].text(), got[k], brute(events, a, set(o2o))) for k, a in enumerate(arcs) if got[k] != brute(events, a, set(o2o))]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("paired", [32, 1])
def test_all_of_several_and_counts_of_each(spark, monkeypatch, paired):
    """ALL of two objects or more is met by pairs of them, or, of events with many, by one of them."""
    monkeypatch.setattr(declare, "PAIRED", paired)
    events, o2o = random_log(7)
    events += [("a", 2, ["i1", "i2"]), ("b", 3, ["i1", "i2", "i3"]), ("b", 3, ["i1", "i3"]), ("c", 1, ["i1", "i2", "i3", "o1"]), ("a", 4, [])]
    turns = [("a", "b"), ("b", "a"), ("c", "c")]
    arcs = [Arc(*t, arrow, Label.of(all=[key]), low, high) for t in turns for key in ("i", "o>i") for arrow in ("AS", "EF", "EP") for low, high in ((1, None), (0, 0))]
    arcs += [Arc(*t, "AS", Label.of(each=[key]), low, high) for t in turns for key in ("i", "o", "i<o") for low, high in ((1, 2), (2, None), (None, 1))]
    log = micro(spark, events, ["o1", "o2", "i1", "i2", "i3", "c1"], o2o)
    got = {x["arc"]: (x["total"], x["violating"]) for x in declare.check(log, arcs).collect()}
    wrong = [(arcs[k].text(), got[k], brute(events, a, set(o2o))) for k, a in enumerate(arcs) if got[k] != brute(events, a, set(o2o))]
    assert not wrong, wrong[:5]


FIXTURE = [("place", 0, ["o1", "i1"]), ("place", 1, ["o2", "i2"]), ("pay", 2, ["o1"]), ("ship", 3, ["o1", "i1"]), ("pay", 4, ["o2"]), ("place", 5, ["o1", "i2"]), ("ship", 6, ["o2", "i2"])]


def test_synthetic_events(spark):
    log = micro(spark, FIXTURE, ["i9"])
    arcs = [Arc("<init> o", "place", "DF", Label.of(each=["o"])), Arc("ship", "<exit> i", "EF", Label.of(any=["i"])), Arc("<init> i", "place", "EF", Label.of(each=["i"]))]
    got = {r["arc"]: (r["total"], r["violating"]) for r in declare.check(log, arcs).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (3, 1)}


def test_discovery_holds_and_is_maximal(spark):
    log = micro(spark, FIXTURE)
    arcs = declare.discover(log, declare.Options(noise=0.2))
    assert arcs and all(r["violating"] <= 0.2 * r["total"] for r in declare.check(log, arcs).collect())
    assert not any(a != b and a.below(b) for a in arcs for b in arcs)
    reduced = declare.discover(log, declare.Options(noise=0.2, reduction="lossless"))
    assert set(reduced) <= set(arcs)
    refined = declare.discover(log, declare.Options(noise=0.2, refinement=True))
    assert refined


def test_labels_and_arrows():
    a, b = Label.of(any=["x"], each=["y"]), Label.of(each=["x"], all=["z"])
    assert a.joined(b) == Label.of(each=["x", "y"], all=["z"]) and a.common(b) == Label.of(any=["x"])
    assert a.below(a.joined(b)) and not a.below(b)
    assert Arc("a", "b", "EF", Label.of(each=["x"], all=["y"])).text() == "EF(a, b, Each(x), All(y),1,inf)"


def test_reduction_and_projection():
    arc = lambda a, b, arrow="EF", label=Label.of(each=["x"]): Arc(a, b, arrow, label)
    assert reduce_arcs([arc("a", "b"), arc("b", "c"), arc("a", "c")]) == [arc("a", "b"), arc("b", "c")]
    loose = Label.of(any=["x"])
    some = [arc("a", "b", label=loose), arc("b", "c", label=loose), arc("a", "c", label=loose)]
    assert len(reduce_arcs(some, True)) == 3 and len(reduce_arcs(some, False)) == 2
    ring = [arc("a", "b"), arc("b", "a"), arc("b", "c"), arc("c", "b"), arc("a", "c"), arc("c", "a")]
    assert 3 <= len(reduce_arcs(ring)) < 6
    got = project_arcs([arc("a", "m", "DF"), arc("m", "c", "EF", Label.of(all=["x", "y"]))], {"a", "c"})
    assert got == [arc("a", "c")]


def test_negative_discovery_matches_enumeration(spark):
    """Minimal satisfied nodes of the whole lattice, by brute force."""
    events, _ = random_log(11)
    log = micro(spark, events)
    got = negative.discover(log, declare.Options(noise=0.1))
    types = lambda x: {o[0] for t, _, os in events if t == x for o in os}
    want = set()
    for a, b in itertools.permutations("abc", 2):
        shared = sorted(types(a) & types(b))
        good = []
        for arrow in ("AS", "EF", "EP"):
            for vec in itertools.product((0, ANY, ALL), repeat=len(shared)):
                arc = Arc(a, b, arrow, Label((t, v) for t, v in zip(shared, vec, strict=True) if v), 0, 0)
                n, bad = brute(events, arc)
                if n - bad >= 0.9 * n:
                    good.append(arc)
        want |= {x for x in good if not any(y != x and y.below(x) for y in good)}
    assert set(got) <= want
    index = declare.index_for(log, sorted(want))
    rows = {r["arc"]: r["testable"] for r in declare.evidence(index, sorted(want)).collect()}
    assert {x for k, x in enumerate(sorted(want)) if rows[k] > 0} == set(got)


def test_testability(spark):
    log = micro(spark, [("a", 0, ["i1", "i2"]), ("a", 1, ["i3"]), ("b", 2, ["i1"])])
    arcs = [Arc("a", "b", "AS", Label.of(all=["i"]), 0, 0)]
    got = {r["ev_id"]: r["testable"] for r in declare.testable(declare.index_for(log, arcs), arcs).collect()}
    assert got == {"e0": False, "e1": True}
    r = declare.evidence(declare.index_for(log, arcs), arcs).first()
    assert (r["total"], r["testable"], r["satisfying"], r["satisfying_all"]) == (2, 1, 1, 2)


def test_facts(spark):
    log = micro(spark, [("place", 0, ["o1"]), ("place", 1, ["o1"]), ("pay", 2, ["o1"]), ("pay", 3, ["c1"])])
    got = {(r["ev_type"], r["ob_type"]): (r["always_present"], r["at_most_one_event_per_object"]) for r in objects.facts(log).collect()}
    assert got == {("place", "o"): (True, False), ("pay", "o"): (False, True), ("pay", "c"): (False, True)}


def neg(a, b, arrow="AS", label=Label.of(any=["x"])):
    return Arc(a, b, arrow, label, 0, 0)


def test_negative_rules():
    pos = lambda a, b, arrow="AS", v=EACH: Arc(a, b, arrow, Label([("x", v)]))
    always = {(s, "x"): (True, True) for s in "abc"}
    k = Knowledge([pos("a", "b")], {(s, "x"): (True, False) for s in "abc"}, {("a", "x"): (2, 2), ("b", "x"): (1, 1)})
    assert too_few(neg("a", "b", label=Label.of(all=["x"])), k) and not too_few(neg("b", "a", label=Label.of(all=["x"])), k)
    arcs = [neg("b", "c"), neg("a", "c")]
    assert edges(arcs, k) == {neg("b", "c"): {neg("a", "c")}} and condense(arcs, edges(arcs, k)) == [neg("b", "c")]
    out, t = reduce_negative([*arcs, neg("a", "c", "EF")], k)
    assert out == [neg("b", "c")] and (t.input, t.dominated, t.condensed, t.output) == (3, 1, 1, 1)
    assert t.input - t.cardinality - t.dominated - t.condensed - t.structural - t.orientation == t.output
    assert set(closure(out, [*arcs, neg("a", "c", "EF")], k)) >= {*arcs, neg("a", "c", "EF")}
    ring = Knowledge([pos("a", "b", v=ALL), pos("b", "a", "EP", ALL)], always, {})
    both = [neg("a", "c"), neg("b", "c")]
    assert condense(both, edges(both, ring, ["equivalence"])) == [neg("a", "c")]
    assert edges([neg("a", "c", "EF", Label.of(all=["x"])), neg("b", "c", "EF", Label.of(all=["x"]))], ring, ["equivalence"])
    order = Knowledge([pos("a", "b", "EF")], always, {})
    assert structural(neg("a", "b", "EP"), order) and not structural(neg("a", "b", "EF"), order)
    twins = [neg("a", "b", "EF"), neg("b", "a", "EP")]
    assert len(reduce_negative(twins, Knowledge([], always, {}))[0]) == 1
    assert entailed_positive(pos("a", "c"), [pos("a", "b"), pos("b", "c")]) and not entailed_positive(pos("c", "a"), [pos("a", "b"), pos("b", "c")])


def test_precision():
    rows = [(neg("a", "b"), {"satisfying": 2, "testable": 4}), (neg("a", "b", label=Label.of(all=["x"])), {"satisfying": 4, "testable": 4}), (neg("b", "a"), {"satisfying": 1, "testable": 1})]
    yes = lambda a: a.label.at(ALL) != []
    assert precision(rows, yes) == 0.25 and precision(rows, yes, "support") == pytest.approx((1 / 1.5) / 2) and precision(rows, lambda a: True) == 1.0


KEYS = {"order": "o", "customer": "c", "part": "a", "supplier": "u"}
LINES = [(1, "A", 3, 1, 1), (1, "N", 5, 2, 1), (2, "R", 4, 1, 2), (2, "N", 4, 1, 1), (3, "A", 6, 2, 2), (3, "R", 2, 3, 1), (3, "N", 7, 1, 2), (4, "N", 9, 3, 2), (4, "N", 9, 2, 2)]


@pytest.fixture(scope="module")
def trade(spark, tmp_path_factory):
    """(folder of tables with all four activities, the events of their trade log)."""
    d = tmp_path_factory.mktemp("trade")
    day = lambda k: T0 + dt.timedelta(days=k)
    orders = [(k, day(k), 1 + k % 2, "O", "1") for k in (1, 2, 3, 4)]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_orderdate timestamp, o_custkey long, o_orderstatus string, o_orderpriority string"),
        ("lineitem", [(o, f, day(t), p, s) for o, f, t, p, s in LINES], "l_orderkey long, l_returnflag string, l_shipdate timestamp, l_partkey long, l_suppkey long"),
        ("customer", [(1, "a"), (2, "b")], "c_custkey long, c_mktsegment string"), ("part", [(1,), (2,), (3,)], "p_partkey long"), ("supplier", [(1,), (2,)], "s_suppkey long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(d / f"{name}.parquet"))
    ships = {}
    for o, f, t, p, s in LINES:
        ships.setdefault((o, f), (t, {f"o{o}"}))[1].update([f"a{p}", f"u{s}"])
    return str(d), [("place", k, [f"o{k}", f"c{1 + k % 2}"]) for k in (1, 2, 3, 4)] + [(f"ship_{f}", t, sorted(os)) for (_, f), (t, os) in ships.items()]


def lettered(label):
    """A label's text with the types as the first letters of their objects."""
    level = {"Any": ANY, "Each": EACH, "All": ALL}
    return Label((KEYS[t], level[v]) for v, ts in re.findall(r"(Any|Each|All)\(([^)]*)\)", label) for t in ts.split(","))


@pytest.mark.parametrize("name", ["negative_candidate_table", "existence_candidate_table"])
def test_candidate_tables_hold_all_activities(spark, trade, name):
    d, events = trade
    got = {(r["source"], r["target"], r["arrow"], lettered(r["label"])): (r["total"], r["satisfying_all"]) for r in queries.QUERIES[name](spark, d).collect()}
    types = lambda x: {o[0] for t, _, os in events if t == x for o in os}
    want = {}
    for a, b in itertools.permutations(("place", "ship_A", "ship_N", "ship_R"), 2):
        shared = sorted(types(a) & types(b))
        most = {t: max(sum(o[0] == t for o in os) for u, _, os in events if u == a) for t in shared}
        levels = [(0, ANY, ALL) if name[0] == "n" else (0, EACH) if most[t] <= 1 else (0, ANY, EACH, ALL) for t in shared]
        for arrow in ("AS", "EF", "EP"):
            for vec in itertools.product(*levels):
                if any(vec):
                    arc = Arc(a, b, arrow, Label((t, v) for t, v in zip(shared, vec, strict=True) if v), *((0, 0) if name[0] == "n" else (1, None)))
                    n, bad = brute(events, arc)
                    want[a, b, arrow, arc.label] = (n, n - bad)
    assert got == want


def test_discovery_queries_use_all_activities(spark, trade):
    d, events = trade
    acts = ("place", "ship_A", "ship_N", "ship_R")
    rows = queries.QUERIES["negative_discover"](spark, d).collect()
    got = {(r["source"], r["target"], r["arrow"], lettered(r["label"])) for r in rows}
    types = lambda x: {o[0] for t, _, os in events if t == x for o in os}
    want = set()
    for a, b in itertools.permutations(acts, 2):
        shared, good = sorted(types(a) & types(b)), []
        for arrow in ("AS", "EF", "EP"):
            for vec in itertools.product((0, ANY, ALL), repeat=len(shared)):
                arc = Arc(a, b, arrow, Label((t, v) for t, v in zip(shared, vec, strict=True) if v), 0, 0)
                n, bad = brute(events, arc)
                if n - bad >= 0.9 * n:
                    good.append(arc)
        want |= {(x.source, x.target, x.arrow, x.label) for x in good if not any(y != x and y.below(x) for y in good)}
    assert got <= want and any(a == "ship_N" for a, *_ in got) and any(b == "ship_N" for _, b, *_ in got)
    found = queries.QUERIES["declare_discover"](spark, d).collect()
    assert "ship_N" in {r["source"] for r in found} and "ship_N" in {r["target"] for r in found}
    for r in found:
        n, bad = brute(events, Arc(r["source"], r["target"], r["arrow"], lettered(r["label"]), 1, None))
        assert bad <= 0.2 * n, r["text"]


def test_discovery_queries_set_no_activities(spark, trade, monkeypatch):
    """declare_projected, negative_reduced and negative_precision, by the options they pass on."""
    d, _ = trade
    seen = []
    log = lambda f: lambda *a, **k: (seen.append((*a[1:], *k.values())), f(*a, **k))[1]
    monkeypatch.setattr(declare, "discover", log(declare.discover))
    monkeypatch.setattr(negative, "discover_reduced", log(negative.discover_reduced))
    monkeypatch.setattr(declare, "candidate_table", log(declare.candidate_table))
    for name in ("declare_projected", "negative_reduced", "negative_precision"):
        assert queries.QUERIES[name](spark, d).columns
    options = [x for args in seen for x in args if isinstance(x, declare.Options)]
    assert len(seen) == 4 and len(options) == 3 and all(o.activities is None for o in options)
    assert seen[-1] == (("AS", "EF", "EP"), True)


def _nodes(plan):
    """Names of a plan's nodes, down to what is kept."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = plan.children()
    return [plan.nodeName(), *(x for k in range(below.size()) for x in _nodes(below.apply(k)))]


def test_kept_pairs_are_not_dealt_again(spark):
    """Counts and joins by object and activity take the kept pairs as they lie; before, each dealt them anew."""
    with declare.Index(micro(spark, FIXTURE)) as index:
        assert index.degree  # fills what is kept
        seen = index.pairs.groupBy("ob_id", "ev_type").count()
        asked = index.events.selectExpr("concat('e', length(ev_id)) AS ev_id", "concat('o', length(ev_id)) AS ob_id", "concat('s', length(ev_id)) AS ev_type")
        for df, sides in ((seen, 0), (asked.join(index.pairs.hint("merge"), ["ob_id", "ev_type"]), 1), (asked.select("ev_id").join(index.events.hint("merge"), "ev_id"), 1)):
            assert _nodes(df._jdf.queryExecution().executedPlan()).count("Exchange") <= sides


def test_an_index_of_arcs_deals_what_they_look_at(spark):
    """Relations and objects by steps that no arc asks for stay out; with DF any event may be the nearest."""
    log = micro(spark, FIXTURE, ["c1"], [("o1", "i1"), ("o2", "i2")])
    arcs = [Arc("place", "ship", "EF", Label.of(any=["o>i"])), Arc("pay", "ship", "AS", Label.of(each=["o"]))]
    with declare.index_for(log, arcs) as index:
        rows = {r["ev_id"]: (len(r["rel"]), len(r["via"])) for r in index.events.collect()}
        kinds = {(r["ev_type"], r["ob_type"]) for r in index.pairs.collect()}
    assert rows == {"e0": (0, 1), "e1": (0, 1), "e2": (1, 0), "e3": (2, 0), "e4": (1, 0), "e5": (0, 1), "e6": (2, 0)}
    assert kinds == {("ship", "i"), ("ship", "o")}
    got = {r["arc"]: (r["total"], r["violating"]) for r in declare.check(log, [*arcs, Arc("place", "pay", "DF", Label.of(each=["o"]))]).collect()}
    assert got == {k: brute(FIXTURE, a, {("o1", "i1"), ("o2", "i2")}) for k, a in enumerate([*arcs, Arc("place", "pay", "DF", Label.of(each=["o"]))])}
