"""Petri nets: structure, PNML, matrices, token replay and optimal alignments of one trace."""

from __future__ import annotations

import heapq
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import count
from xml.sax.saxutils import escape, quoteattr

Marking = dict[str, int]


@dataclass
class PetriNet:
    """places; transitions id -> label (None: silent); arcs (from, to) -> weight; markings."""

    places: list[str] = field(default_factory=list)
    transitions: dict[str, str | None] = field(default_factory=dict)
    arcs: dict[tuple[str, str], int] = field(default_factory=dict)
    initial: Marking = field(default_factory=dict)
    finals: list[Marking] = field(default_factory=list)

    def add_place(self, name: str) -> str:
        if name not in self.places:
            self.places.append(name)
        return name

    def add_transition(self, name: str, label: str | None = "") -> str:
        self.transitions[name] = name if label == "" else label
        return name

    def add_arc(self, a: str, b: str, weight: int = 1) -> None:
        if (a in self.transitions) == (b in self.transitions):
            raise ValueError("an arc joins a place and a transition")
        self.arcs[a, b] = self.arcs.get((a, b), 0) + weight

    def remove(self, node: str) -> None:
        self.places = [p for p in self.places if p != node]
        self.transitions.pop(node, None)
        self.arcs = {k: w for k, w in self.arcs.items() if node not in k}
        for m in (self.initial, *self.finals):
            m.pop(node, None)

    def pre(self, node: str) -> Counter:
        return Counter({a: w for (a, b), w in self.arcs.items() if b == node})

    def post(self, node: str) -> Counter:
        return Counter({b: w for (a, b), w in self.arcs.items() if a == node})

    def flow(self) -> dict[str, tuple[Counter, Counter]]:
        """transition -> (consumed, produced)."""
        out = {t: (Counter(), Counter()) for t in self.transitions}
        for (a, b), w in self.arcs.items():
            if b in out:
                out[b][0][a] += w
            if a in out:
                out[a][1][b] += w
        return out

    def incidence(self) -> tuple[list[str], list[str], list[list[int]]]:
        """(places, transitions, matrix of produced minus consumed tokens)."""
        ps, ts, f = sorted(self.places), sorted(self.transitions), self.flow()
        return ps, ts, [[f[t][1][p] - f[t][0][p] for t in ts] for p in ps]

    @property
    def final(self) -> Marking:
        return self.finals[0] if self.finals else {}

    def to_json(self) -> dict:
        return {"places": self.places, "transitions": self.transitions, "arcs": [[a, b, w] for (a, b), w in sorted(self.arcs.items())], "initial": self.initial, "finals": self.finals}

    @classmethod
    def from_json(cls, d: dict) -> PetriNet:
        return cls(list(d["places"]), dict(d["transitions"]), {(a, b): w for a, b, w in d["arcs"]}, dict(d["initial"]), [dict(m) for m in d["finals"]])

    def to_dot(self) -> str:
        q = lambda s: '"' + s.replace('"', '\\"') + '"'
        lines = ["digraph {", "rankdir=LR;"]
        lines += [f"{q('p_' + p)} [shape=circle,label={q('*' * self.initial.get(p, 0))}];" for p in self.places]
        lines += [f"{q('t_' + t)} [shape=box,label={q(label or '')}{',style=filled,fillcolor=black' if label is None else ''}];" for t, label in self.transitions.items()]
        name = lambda n: q(("t_" if n in self.transitions else "p_") + n)
        lines += [f"{name(a)} -> {name(b)}{f' [label={w}]' if w != 1 else ''};" for (a, b), w in self.arcs.items()]
        return "\n".join([*lines, "}"])

    # -- PNML

    def to_pnml(self) -> str:
        tag = lambda k, v: f"<{k}><text>{escape(str(v))}</text></{k}>"
        out = ['<?xml version="1.0" encoding="UTF-8"?>', "<pnml>", '<net id="net1" type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel">', tag("name", "net"), '<page id="page1">']
        for p in self.places:
            start = tag("initialMarking", self.initial[p]) if self.initial.get(p) else ""
            out.append(f"<place id={quoteattr(p)}>{tag('name', p)}{start}</place>")
        for t, label in self.transitions.items():
            silent = "" if label is not None else '<toolspecific tool="ProM" version="6.4" activity="$invisible$" localNodeID="tau"/>'
            out.append(f"<transition id={quoteattr(t)}>{tag('name', label if label is not None else t)}{silent}</transition>")
        for k, ((a, b), w) in enumerate(self.arcs.items()):
            out.append(f'<arc id="arc{k}" source={quoteattr(a)} target={quoteattr(b)}>{tag("inscription", w)}</arc>')
        out.append("</page><finalmarkings>")
        for m in self.finals:
            out.append("<marking>" + "".join(f"<place idref={quoteattr(p)}><text>{n}</text></place>" for p, n in m.items()) + "</marking>")
        return "\n".join([*out, "</finalmarkings></net></pnml>"])

    @classmethod
    def from_pnml(cls, text: str) -> PetriNet:
        local = lambda e: e.tag.rpartition("}")[2]
        net = cls()

        def under(e, name: str) -> str | None:
            for c in e:
                if local(c) == name:
                    for x in c:
                        if local(x) == "text":
                            return (x.text or "").strip()
            return None

        arcs = []
        for e in ET.fromstring(text).iter():
            kind = local(e)
            if kind == "place" and "id" in e.attrib:
                net.add_place(e.attrib["id"])
                if n := int(under(e, "initialMarking") or 0):
                    net.initial[e.attrib["id"]] = n
            elif kind == "transition":
                silent = any(local(x) == "toolspecific" and x.attrib.get("activity") == "$invisible$" for x in e)
                net.transitions[e.attrib["id"]] = None if silent else under(e, "name") or e.attrib["id"]
            elif kind == "arc":
                arcs.append((e.attrib["source"], e.attrib["target"], int(under(e, "inscription") or 1)))
            elif kind == "marking":
                m = {p.attrib["idref"]: int(next((x.text for x in p if local(x) == "text"), "0") or 0) for p in e if local(p) == "place"}
                net.finals.append({p: n for p, n in m.items() if n})
        for a, b, w in arcs:
            net.add_arc(a, b, w)
        return net


# -- token replay


def replayable(net: PetriNet) -> dict[str, str]:
    """label -> transition; silent transitions and repeated labels are refused."""
    out: dict[str, str] = {}
    for t, label in net.transitions.items():
        if label is None or label in out:
            raise ValueError("token replay needs a net without silent transitions or repeated labels")
        out[label] = t
    return out


def replay(net: PetriNet, trace: Iterable[str]) -> tuple[int, int, int, int]:
    """(produced, consumed, missing, remaining) of one trace; activities not in the net are passed over."""
    by_label, flow = replayable(net), net.flow()
    tokens = Counter(net.initial)
    produced, consumed, missing = sum(net.initial.values()), 0, 0

    def take(need: dict[str, int]) -> None:
        nonlocal consumed, missing
        for p, n in need.items():
            missing += max(0, n - tokens[p])
            tokens[p] = max(0, tokens[p] - n)
            consumed += n

    for a in trace:
        if a in by_label:
            need, give = flow[by_label[a]]
            take(need)
            tokens.update(give)
            produced += sum(give.values())
    take(net.final)
    return produced, consumed, missing, sum(tokens.values())


def replay_fitness(produced: int, consumed: int, missing: int, remaining: int) -> float:
    return 0.5 * (1 - missing / consumed if consumed else 1.0) + 0.5 * (1 - remaining / produced if produced else 1.0)


# -- alignments

#: Costs of a move in the log alone, in the model alone, of both, and of a silent transition.
COSTS = {"log": 1, "model": 1, "sync": 0, "silent": 0}
STATE_LIMIT = 100_000


class LimitReached(Exception):
    """The search met more states than allowed."""


def align(net: PetriNet, trace: list[str], costs: dict[str, int] = COSTS, limit: int = STATE_LIMIT) -> tuple[int, list[tuple[str | None, str | None]]] | None:
    """(cost, moves) of a cheapest alignment, or None if no final marking can be reached; a move is
    (activity or None, transition or None). Dijkstra over (position, marking). A log move right
    before a model move could be swapped with it, so model moves are not tried after log moves."""
    ps = sorted(net.places)
    at = {p: i for i, p in enumerate(ps)}
    pack = lambda m: tuple(m.get(p, 0) for p in ps)
    flow = [(t, net.transitions[t], [(at[p], n) for p, n in need.items()], [(at[p], n) for p, n in give.items()]) for t, (need, give) in sorted(net.flow().items())]
    goals = {pack(m) for m in net.finals}
    start = (0, pack(net.initial), False)
    order = count()
    heap = [(0, next(order), start)]
    best, came = {start: 0}, {start: None}
    done: set = set()
    while heap:
        cost, _, state = heapq.heappop(heap)
        if state in done:
            continue
        done.add(state)
        if len(done) > limit:
            raise LimitReached
        i, marking, after_log = state
        if i == len(trace) and marking in goals:
            moves = []
            while came[state] is not None:
                state, move = came[state]
                moves.append(move)
            return cost, moves[::-1]
        nexts = []
        if i < len(trace):
            nexts.append((costs["log"], (i + 1, marking, True), (trace[i], None)))
        for t, label, need, give in flow:
            sync = i < len(trace) and label is not None and label == trace[i]
            if after_log and not sync:
                continue
            if any(marking[p] < n for p, n in need):
                continue
            m = list(marking)
            for p, n in need:
                m[p] -= n
            for p, n in give:
                m[p] += n
            m = tuple(m)
            if sync:
                nexts.append((costs["sync"], (i + 1, m, False), (trace[i], t)))
            if not after_log:
                nexts.append((costs["silent"] if label is None else costs["model"], (i, m, False), (None, t)))
        for c, s, move in nexts:
            if cost + c < best.get(s, 1 << 60):
                best[s] = cost + c
                came[s] = (state, move)
                heapq.heappush(heap, (cost + c, next(order), s))
    return None


def worst_cost(net: PetriNet, trace: list[str], costs: dict[str, int] = COSTS) -> int | None:
    """Cost of all log moves and the cheapest way through the model."""
    empty = align(net, [], costs)
    return None if empty is None else empty[0] + costs["log"] * len(trace)


def reachable_labels(net: PetriNet) -> dict[str, set[str]]:
    """place -> labels of transitions that put tokens there."""
    out: dict[str, set[str]] = defaultdict(set)
    for (a, b) in net.arcs:
        if a in net.transitions and net.transitions[a] is not None:
            out[b].add(net.transitions[a])
    return out
