"""Functional maps between object types: compositions, and the least set that rebuilds the rest."""

from __future__ import annotations

from itertools import combinations

#: A map: (from type, to type, name).
Map = tuple[str, str, str]


def compositions(maps: list[Map], depth: int = 4) -> dict[tuple[str, str], list[tuple[Map, ...]]]:
    """(from, to) -> chains of up to depth maps that lead there, no type twice; shortest first."""
    out: dict[tuple[str, str], list[tuple[Map, ...]]] = {}
    level = [(m,) for m in sorted(maps)]
    for _ in range(depth):
        for chain in level:
            out.setdefault((chain[0][0], chain[-1][1]), []).append(chain)
        level = [(*c, m) for c in level for m in sorted(maps) if m[0] == c[-1][1] and m[1] not in {c[0][0], *(x[1] for x in c)}]
    return out


def rebuilt(kept: set[str], maps: list[Map], depth: int = 4) -> set[str]:
    """Types whose objects follow from those of the kept types by maps."""
    got = set(kept)
    for (a, b), _ in compositions(maps, depth).items():
        if a in kept:
            got.add(b)
    return got


def least_kept(types: set[str], maps: list[Map], exact: int = 20) -> set[str]:
    """A smallest set of types that rebuilds all; exact up to so many types, else by greed."""
    reach = {t: rebuilt({t}, maps) for t in types}
    forced = {t for t in types if not any(t in r for o, r in reach.items() if o != t)}
    rest = sorted(types - forced)
    done = set().union(*(reach[t] for t in forced)) if forced else set()
    if len(rest) <= exact:
        for n in range(len(rest) + 1):
            for more in combinations(rest, n):
                if done.union(*(reach[t] for t in more)) >= types:
                    return forced | set(more)
    kept = set(forced)
    while not done >= types:
        best = max(rest, key=lambda t: (len(reach[t] - done), t))
        kept.add(best)
        done |= reach[best]
    return kept
