"""Traces whose events are ordered in part."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import permutations


@dataclass
class PartialTrace:
    """events: id -> activity; relations: (earlier, later)."""

    events: dict[str, str] = field(default_factory=dict)
    relations: set[tuple[str, str]] = field(default_factory=set)

    @classmethod
    def of_sequence(cls, activities: list[str]) -> PartialTrace:
        ids = [f"e{k}" for k in range(len(activities))]
        return cls(dict(zip(ids, activities, strict=True)), set(zip(ids, ids[1:], strict=False)))

    def add(self, event: str, activity: str) -> None:
        self.events[event] = activity

    def relate(self, a: str, b: str) -> None:
        if a not in self.events or b not in self.events:
            raise KeyError(a if a not in self.events else b)
        self.relations.add((a, b))

    def remove(self, event: str) -> None:
        self.events.pop(event)
        self.relations = {r for r in self.relations if event not in r}

    def unrelate(self, a: str, b: str) -> None:
        self.relations.discard((a, b))

    def starts(self) -> set[str]:
        return set(self.events) - {b for _, b in self.relations}

    def ends(self) -> set[str]:
        return set(self.events) - {a for a, _ in self.relations}

    def before(self, event: str) -> set[str]:
        return {a for a, b in self.relations if b == event}

    def after(self, event: str) -> set[str]:
        return {b for a, b in self.relations if a == event}

    def _kinds(self) -> dict[tuple, list[str]]:
        """Events by activity and by the activities around them; equal traces have equal kinds."""
        out: dict[tuple, list[str]] = {}
        for e, a in self.events.items():
            near = tuple(tuple(sorted(self.events[x] for x in side(e))) for side in (self.before, self.after))
            out.setdefault((a, *near), []).append(e)
        return out

    def same_as(self, other: PartialTrace) -> bool:
        """Whether a renaming of events makes the two equal."""
        mine, theirs = self._kinds(), other._kinds()
        if len(self.relations) != len(other.relations) or {k: len(v) for k, v in mine.items()} != {k: len(v) for k, v in theirs.items()}:
            return False
        kinds = sorted(mine)

        def extend(k: int, names: dict[str, str]) -> bool:
            if k == len(kinds):
                return {(names[a], names[b]) for a, b in self.relations} == other.relations
            for p in permutations(theirs[kinds[k]]):
                grown = names | dict(zip(mine[kinds[k]], p, strict=True))
                if all((grown[a], grown[b]) in other.relations for a, b in self.relations if a in grown and b in grown) and extend(k + 1, grown):
                    return True
            return False

        return extend(0, {})

    def to_dot(self) -> str:
        return "\n".join(["digraph {", *(f'"{e}" [label="{a}"];' for e, a in self.events.items()), *(f'"{a}" -> "{b}";' for a, b in sorted(self.relations)), "}"])
