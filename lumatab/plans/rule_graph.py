"""Orders inequality rules: cycles of <= become equalities, cycles with < lose their weakest edge, the rest is ranked."""

from __future__ import annotations

from dataclasses import replace

from lumatab.plans.model import Rule, RuleKind

_STRICT = {RuleKind.LESS, RuleKind.GREATER}
_LARGER = {RuleKind.GREATER, RuleKind.GREATER_EQUAL}
EDGES = {RuleKind.LESS, RuleKind.LESS_EQUAL, RuleKind.GREATER, RuleKind.GREATER_EQUAL, RuleKind.DATE_ORDER}


def edge(rule: Rule) -> tuple[str, str]:
    """(smaller, larger) column."""
    a, b = rule.columns[:2]
    return (b, a) if rule.kind in _LARGER else (a, b)


def components(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components: two walks, the second over reversed edges in falling finishing order."""
    out, back = {n: [] for n in nodes}, {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    seen: set[str] = set()
    finished: list[str] = []
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        work = [(root, iter(out[root]))]
        while work:
            node, rest = work[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                finished.append(node)
                work.pop()
            else:
                seen.add(step)
                work.append((step, iter(out[step])))
    found, taken = [], set()
    for root in reversed(finished):
        if root in taken:
            continue
        group, work = [], [root]
        taken.add(root)
        while work:
            node = work.pop()
            group.append(node)
            for n in back[node]:
                if n not in taken:
                    taken.add(n)
                    work.append(n)
        found.append(sorted(group))
    return found


def resolve(rules: list[Rule], min_confidence: float = 0.995, min_support: float = 0.05) -> tuple[list[Rule], list[Rule]]:
    """(rules in an order that settles, rules set aside). Rules that are no inequality keep their place at the end."""
    good = [r for r in rules if r.confidence >= min_confidence and r.support >= min_support]
    aside = [r for r in rules if r not in good]
    order = [r for r in good if r.kind in EDGES]
    others = [r for r in good if r.kind not in EDGES]
    made: list[Rule] = []
    while True:
        nodes = sorted({c for r in order for c in r.columns[:2]})
        groups = components(nodes, [edge(r) for r in order])
        at = {c: i for i, g in enumerate(groups) for c in g}
        loops = [g for g in groups if len(g) > 1]
        if not loops:
            break
        for g in loops:
            inside = [r for r in order if at[r.columns[0]] == at[r.columns[1]] == at[g[0]]]
            if any(r.kind in _STRICT for r in inside):
                weakest = min(inside, key=lambda r: (r.confidence, r.support, r.name))
                order.remove(weakest)
                aside.append(weakest)
            else:
                made.append(Rule("equal_" + "_".join(g), RuleKind.EQUALITY, tuple(g), confidence=min(r.confidence for r in inside)))
                order = [r for r in order if r not in inside]
                # rules at the group's border now speak of its first column
                order = [replace(r, columns=tuple(g[0] if c in g else c for c in r.columns)) for r in order]
    rank: dict[str, int] = {}
    left = list(dict.fromkeys(c for r in order for c in edge(r)))
    while left:
        free = [c for c in left if all(a in rank for a, b in map(edge, order) if b == c)]
        for c in free:
            rank[c] = max((rank[a] + 1 for a, b in map(edge, order) if b == c), default=0)
        left = [c for c in left if c not in rank]
    order.sort(key=lambda r: (-rank[edge(r)[0]] if r.kind != RuleKind.DATE_ORDER else rank[edge(r)[1]], r.name))
    return [*made, *order, *others], aside
