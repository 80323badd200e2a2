"""Alpha+++ discovery of a Petri net from variants.

Repairs of the log, the filtered directly-follows graph and the candidate places are model-sized;
how well each candidate replays is counted over all variants by a function the caller passes, so
it can be a Spark job.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product
from math import ceil

from loomtrace.operators.cases import END, START
from loomtrace.plans.petri import PetriNet

SILENT = "__SILENT_"
Trace = tuple[str, ...]
Variants = dict[Trace, int]
#: A candidate place: activities that put a token and those that take it.
Place = tuple[frozenset[str], frozenset[str]]
#: (relevant cases, fitting cases, least share of fitting cases over activities)
Fitness = tuple[int, int, float]


@dataclass(frozen=True)
class Config:
    balance: float = 0.2
    fitness: float = 0.75
    replay: float = 0.0
    skip_repair: float = 2.0
    loop_repair: float = 2.0
    absolute: int = 10
    relative: float = 0.1


def follows(variants: Variants) -> Counter:
    out: Counter = Counter()
    for t, n in variants.items():
        for pair in zip(t, t[1:], strict=False):
            out[pair] += n
    return out


def _rewritten(variants: Variants, between: Callable[[str, str], str | None]) -> Variants:
    """Variants with an activity put between neighbours where the function names one."""
    out: Variants = defaultdict(int)
    for t, n in variants.items():
        new = list(t[:1])
        for a, b in zip(t, t[1:], strict=False):
            if (x := between(a, b)) is not None:
                new.append(x)
            new.append(b)
        out[tuple(new)] += n
    return dict(out)


def repair_loops(variants: Variants, least: int) -> Variants:
    """A silent step on every edge that closes a loop of frequent edges on a simple path from the start."""
    after: dict[str, list[str]] = defaultdict(list)
    for (a, b), n in follows(variants).items():
        if n >= least:
            after[a].append(b)
    back: set[tuple[str, str]] = set()
    todo: list[Trace] = [(START,)]
    while todo:
        path = todo.pop()
        for b in after[path[-1]]:
            if b not in path:
                todo.append((*path, b))
            elif b not in (path[-1], END):
                back.add((path[-1], b))
    return _rewritten(variants, lambda a, b: f"{SILENT}loop_{a}_{b}" if (a, b) in back else None)


def repair_skips(variants: Variants, least: int) -> Variants:
    """A silent step after an activity that may be followed by an optional one and is not."""
    df = follows(variants)
    acts = {x for t in variants for x in t}
    after = {a: {b for b in acts if df[a, b] >= least} for a in acts}
    optional: dict[str, set[str]] = {}
    for a in acts - {START}:
        if df[a, a] == 0 and after[a]:
            some = {b for b in acts - {END} if df[a, b] > 0 and df[b, b] < least and df[b, a] < least and after[b] <= after[a]}
            if some:
                optional[a] = some
    return _rewritten(variants, lambda a, b: f"{SILENT}skip_{a}" if a in optional and b not in optional[a] else None)


def filtered(df: Counter, absolute: int, relative: float) -> set[tuple[str, str]]:
    out, into = defaultdict(list), defaultdict(list)
    for (a, b), n in df.items():
        out[a].append(n)
        into[b].append(n)
    mean = lambda xs: sum(xs) / len(xs)
    return {(a, b) for (a, b), n in df.items() if n >= absolute and (n >= relative * mean(out[a]) or n >= relative * mean(into[b]))}


def _coherent(df: set[tuple[str, str]], a: frozenset[str], b: frozenset[str]) -> bool:
    joined = lambda x, y: all(p in df for p in product(x, y))
    apart = lambda x, y: not any(p in df for p in product(x, y))
    return apart(a, a - b) and apart(b - a, b) and joined(a, b) and not joined(b - a, a - b)


def places(df: set[tuple[str, str]], activities: Iterable[str]) -> set[Place]:
    """Candidate places, grown from pairs of activities by unions that stay coherent."""
    acts = sorted(activities)
    known: set[Place] = {(frozenset([a]), frozenset([b])) for a in acts for b in acts}
    found = {(x, y) for x, y in known for a in x for b in y if (a, b) in df and (b, a) not in df and (a, a) not in df and (b, b) not in df}
    joined = lambda x, y: all(p in df for p in product(x, y))
    fresh = known
    while fresh:
        grown: set[Place] = set()
        for (a1, b1), (a2, b2) in product(fresh, known):
            if not (joined(a1, b2) and joined(a2, b1)):
                continue
            p = a, b = a1 | a2, b1 | b2
            if a != b and p not in known and p not in grown and not joined(b, a) and _coherent(df, a, b):
                grown.add(p)
        found |= grown
        known = known | grown
        fresh = grown
    return found


def token_game(trace: Iterable[str], place: Place, strict: bool) -> bool:
    """Whether a place is never short of a token and is empty at the end. strict: an activity on both
    sides needs a token; else it moves none in passing."""
    a, b = place
    n = 0
    for x in trace:
        if x in a and x in b:
            if strict and n <= 0:
                return False
            continue
        n += (x in a) - (x in b)
        if n < 0:
            return False
    return n == 0


def place_counts(variants: Iterable[tuple[Iterable[str], int]], candidates: list[Place], strict: bool) -> dict[int, list]:
    """Candidate -> [relevant, fitting, {activity: (cases, fitting)}] over some variants; sums add up
    over parts of the log."""
    out: dict[int, list] = {k: [0, 0, defaultdict(lambda: [0, 0])] for k in range(len(candidates))}
    for t, n in variants:
        t = list(t)
        for k, (a, b) in enumerate(candidates):
            seen = {x for x in t if x in a or x in b}
            if not seen:
                continue
            fits = token_game(t, candidates[k], strict)
            row = out[k]
            row[0] += n
            row[1] += n * fits
            for x in seen:
                row[2][x][0] += n
                row[2][x][1] += n * fits
    return out


def local_fitness(variants: Variants, candidates: list[Place], strict: bool) -> list[Fitness]:
    got = place_counts(variants.items(), candidates, strict)
    return [(r[0], r[1], min((f / n for n, f in r[2].values()), default=0.0)) for _, r in sorted(got.items())]


def prune(candidates: set[Place], counts: Counter, config: Config, fitness: Callable[[list[Place], bool], list[Fitness]]) -> list[Place]:
    """Balanced, fitting, maximal candidates that replay strictly."""
    def balance(p: Place) -> float:
        x, y = (sum(counts[a] for a in side) for side in p)
        return abs(x - y) / max(x, y) if max(x, y) else 0.0

    order = sorted((p for p in candidates if balance(p) <= config.balance), key=lambda p: (sorted(p[0]), sorted(p[1])))
    good = [p for p, (n, f, low) in zip(order, fitness(order, False), strict=True) if n and f / n >= config.fitness and low >= config.fitness]
    top = [p for p in good if not any(q != p and p[0] <= q[0] and p[1] <= q[1] for q in good)]
    out = []
    for p, (n, f, low) in zip(top, fitness(top, True), strict=True):
        share = f / n if n else 0.0
        if share > config.replay or (share == config.replay and low > -1 and n):
            out.append(p)
    return out


def net_of(chosen: list[Place], activities: Iterable[str]) -> PetriNet:
    """One place for each candidate, one transition for each activity; silent ones that lead nowhere go."""
    net = PetriNet(finals=[{}])
    for a in sorted(set(activities) - {START, END}):
        net.add_transition(a, None if a.startswith(SILENT) else a)
    for k, (a, b) in enumerate(chosen):
        p = net.add_place(f"p{k}")
        for x in sorted(a):
            if x == START:
                net.initial[p] = net.initial.get(p, 0) + 1
            else:
                net.add_arc(x, p)
        for x in sorted(b):
            if x == END:
                net.finals[0][p] = net.finals[0].get(p, 0) + 1
            else:
                net.add_arc(p, x)
    for t in [t for t, label in net.transitions.items() if label is None and not net.pre(t) and not net.post(t)]:
        net.remove(t)
    return net


def discover(variants: Variants, config: Config = Config(), fitness: Callable[[Variants, list[Place], bool], list[Fitness]] = local_fitness) -> PetriNet:  # noqa: B008
    log = {(START, *t, END): n for t, n in variants.items()}
    df = follows(log)
    mean = sum(df.values()) / max(1, len(df))
    log = repair_loops(log, ceil(config.loop_repair * mean))
    log = repair_skips(log, ceil(config.skip_repair * mean))
    counts: Counter = Counter()
    for t, n in log.items():
        for x in t:
            counts[x] += n
    found = places(filtered(follows(log), config.absolute, config.relative), counts)
    return net_of(prune(found, counts, config, lambda ps, strict: fitness(log, ps, strict)), counts)


#: Settings tried in turn by the automatic choice.
SETTINGS = [Config(b, f, r, s, s, 1, c) for b, f, r, s, c in (
    (0.1, 0.9, 0.0, 2.0, 0.0), (0.1, 0.9, 0.1, 4.0, 0.01), (0.2, 0.8, 0.0, 2.0, 0.05), (0.2, 0.8, 0.1, 4.0, 0.05), (0.3, 0.7, 0.0, 2.0, 0.1), (0.3, 0.7, 0.1, 4.0, 0.1),
    (0.4, 0.6, 0.0, 2.0, 0.1), (0.5, 0.5, 0.0, 4.0, 0.1), (0.5, 0.5, 0.1, 8.0, 0.2), (0.3, 0.8, 0.3, 2.0, 0.1), (0.2, 0.9, 0.5, 2.0, 0.05))]


def score(net: PetriNet, fitness: list[Fitness]) -> float:
    """Mean replay of the places times the share of visible transitions that are connected."""
    visible = [t for t, label in net.transitions.items() if label is not None]
    tied = [t for t in visible if net.pre(t) and net.post(t)]
    fit = [f / n for n, f, _ in fitness if n]
    return (sum(fit) / len(fit) if fit else 0.0) * (len(tied) / len(visible) if visible else 0.0)


def discover_auto(variants: Variants, settings: Iterable[Config] = SETTINGS, fitness=local_fitness) -> tuple[PetriNet, Config]:
    """The best-scored net of several settings."""
    best = None
    log = {(START, *t, END): n for t, n in variants.items()}
    for c in settings:
        net = discover(variants, c, fitness)
        spots = [(frozenset(net.pre(p)) | ({START} if net.initial.get(p) else set()), frozenset(net.post(p)) | ({END} if net.final.get(p) else set())) for p in net.places]
        got = (score(net, fitness(log, spots, True)) if spots else 0.0, net, c)
        if best is None or got[0] > best[0]:
            best = got
    return best[1], best[2]
