import itertools
import random

import pytest

from loomtrace.operators import conformance
from loomtrace.plans import alpha, tree
from loomtrace.plans.petri import PetriNet, align, replay, replay_fitness


def fixture_net():
    net = PetriNet(initial={"p1": 1}, finals=[{"p3": 1}])
    for p in ("p1", "p2", "p3"):
        net.add_place(p)
    for t, a, b in (("a", "p1", "p2"), ("b", "p1", "p2"), ("c", "p2", "p3"), ("d", "p2", "p2")):
        net.add_transition(t)
        net.add_arc(a, t)
        net.add_arc(t, b)
    return net


def test_token_replay(spark):
    net = fixture_net()
    assert replay(net, "abccd") == (6, 6, 2, 2)
    v = spark.createDataFrame([(list("abccd"), 1), (list("bbdb"), 1)], "trace array<string>, freq long")
    r = conformance.replay_summary(conformance.token_replay(v, net)).first()
    assert (r["produced"], r["consumed"], r["missing"], r["remaining"]) == (11, 11, 5, 5)
    assert r["fitness"] == round(replay_fitness(11, 11, 5, 5), 6)
    net.add_transition("tau", None)
    with pytest.raises(ValueError):
        replay(net, "a")


def test_pnml_and_json():
    net = fixture_net()
    net.add_transition("tau", None)
    net.add_arc("p3", "tau", 2)
    net.finals.append({"p1": 1, "p2": 2})
    for again in (PetriNet.from_pnml(net.to_pnml()), PetriNet.from_json(net.to_json())):
        assert again.to_json() == net.to_json()
    ps, ts, m = net.incidence()
    assert m[ps.index("p3")][ts.index("tau")] == -2 and "digraph" in net.to_dot()


def brute_cost(net, trace):
    """Cheapest alignment by relaxing all states; for small nets."""
    ps = sorted(net.places)
    flow = net.flow()
    start = (0, tuple(net.initial.get(p, 0) for p in ps))
    best, todo = {start: 0}, [start]
    while todo:
        s = todo.pop(0)
        i, m = s
        moves = [(1, (i + 1, m))] if i < len(trace) else []
        for t, (need, give) in flow.items():
            if all(m[k] >= need[p] for k, p in enumerate(ps)):
                n = tuple(m[k] - need[p] + give[p] for k, p in enumerate(ps))
                if max(n) > 3:
                    continue
                moves.append((0 if net.transitions[t] is None else 1, (i, n)))
                if i < len(trace) and net.transitions[t] == trace[i]:
                    moves.append((0, (i + 1, n)))
        for c, n in moves:
            if best[s] + c < best.get(n, 99):
                best[n] = best[s] + c
                todo.append(n)
    ends = [best[len(trace), tuple(f.get(p, 0) for p in ps)] for f in net.finals if (len(trace), tuple(f.get(p, 0) for p in ps)) in best]
    return min(ends) if ends else None


TREE = tree.node(tree.SEQ, tree.leaf("a"), tree.node(tree.LOOP, tree.node(tree.AND, tree.leaf("b"), tree.node(tree.XOR, tree.leaf("c"), tree.leaf())), tree.leaf("r")), tree.leaf("d"))


def test_alignments_are_optimal():
    r = random.Random(4)
    nets = [fixture_net(), tree.to_petri_net(TREE)]
    for net, _ in itertools.product(nets, range(25)):
        t = [r.choice("abcdr") for _ in range(r.randint(0, 5))]
        got = align(net, t)
        assert got[0] == brute_cost(net, t)
        assert [a for a, _ in got[1] if a is not None] == t
    assert align(tree.to_petri_net(TREE), list("abcrbd"))[0] == 0


def test_alignment_summary(spark):
    v = spark.createDataFrame([(list("ac"), 3), (list("c"), 1)], "trace array<string>, freq long")
    r = conformance.alignment_fitness(conformance.alignments(v, fixture_net())).first()
    assert (r["total_cost"], r["perfect"], r["unsolved"]) == (1, 0.75, 0) and r["log_fitness"] == round(1 - 1 / (3 * 4 + 3), 6)
    assert conformance.alignments(v, fixture_net(), limit=1).filter("status = 'limit'").count() == 2


def test_alpha(spark):
    log = {tuple("abcd"): 20, tuple("acbd"): 20}
    net = alpha.discover(log, alpha.Config(absolute=1))
    assert {(frozenset(net.pre(p)), frozenset(net.post(p))) for p in net.places} == {(frozenset("a"), frozenset("b")), (frozenset("a"), frozenset("c")), (frozenset("b"), frozenset("d")), (frozenset("c"), frozenset("d")), (frozenset(), frozenset("a")), (frozenset("d"), frozenset())}
    assert all(align(net, list(t))[0] == 0 for t in log) and align(net, list("abd"))[0] > 0
    far = alpha.discover(log, alpha.Config(absolute=1), conformance.spark_fitness(spark))
    assert far.to_json() == net.to_json()
    auto, _ = alpha.discover_auto(log)
    assert auto.places


def test_trees():
    assert TREE.valid() and not tree.node(tree.LOOP, tree.leaf("a")).valid() and not tree.leaf("a", ["o"], ["x"]).valid()
    assert len([x for x in TREE.leaves() if x.activity]) == 5 and "digraph" in TREE.to_dot()
    f = tree.footprint(tree.node(tree.SEQ, tree.leaf("a"), tree.node(tree.XOR, tree.leaf("b"), tree.leaf()), tree.leaf("c")))
    assert f.pairs == {("a", "b"), ("b", "c"), ("a", "c")} and f.starts == {"a"} and f.ends == {"c"} and not f.skip
    g = tree.footprint(TREE)
    assert {("a", "b"), ("b", "c"), ("c", "b"), ("b", "r"), ("r", "c"), ("c", "d")} <= g.pairs and ("a", "d") not in g.pairs


def test_moves_are_checked(spark):
    rows = [(["user"], 1, 2, "user|>> >>|skip >>|user"), (["user", "assistant"], 1, 0, ">>|skip user|user assistant|assistant"), (["user"], 1, 1, ">>|skip user|system"), ([], 1, 0, "")]
    df = spark.createDataFrame(rows, "trace array<string>, freq long, cost long, moves string")
    got = [tuple(r)[3:] for r in conformance.moves_checked(df, "^(skip|system)( user assistant)*$", ["skip"]).collect()]
    assert got == [(["user"], 2, True, False), (["user", "assistant"], 0, True, True), (["user"], 0, False, False), ([], 0, True, False)]
