"""Small graphs with values computed by brute force, and brute-force counterparts of the operators."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations

G1 = "0-1 0-2 1-2 1-3 3-4 2-4 5-6 5-7 6-7 6-8 7-9 8-9 0-5 1-6 2-7 3-8 4-9 9-10 10-11 11-12 10-13 12-13 11-13 10-12"
G2 = "0-1 1-2 1-3 2-4 3-5 4-5 4-6 5-7 6-7 6-8 6-9 7-8 7-9 8-9"
G3 = "0-1 0-2 0-3 1-2 1-3 2-3 2-4 3-4 3-5 4-5 5-6 5-7 6-7 7-8 7-9 8-9"


def edges_of(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, e.split("-"))) for e in text.split()]


def ids_of(edges) -> list[int]:
    return sorted({v for e in edges for v in e})


def cliques(edges, k: int) -> list[tuple[int, ...]]:
    have = {frozenset(e) for e in edges}
    return [c for c in combinations(ids_of(edges), k) if all(frozenset(p) in have for p in combinations(c, 2))]


def pattern_instances(edges, size: int, pattern_edges) -> dict[tuple[int, ...], int]:
    have = {frozenset(e) for e in edges}
    found = {}
    for group in combinations(ids_of(edges), size):
        images = {frozenset(frozenset((p[a], p[b])) for a, b in pattern_edges) for p in permutations(group)}
        if n := sum(all(e in have for e in image) for image in images):
            found[group] = n
    return found


def core_numbers(instances: dict[tuple[int, ...], int], ids) -> dict[int, int]:
    alive, left, level, out = dict(instances), set(ids), 0, {}
    while left:
        degree = {v: sum(m for g, m in alive.items() if v in g) for v in left}
        v = min(left, key=lambda x: (degree[x], x))
        level = max(level, degree[v])
        out[v] = level
        left.discard(v)
        alive = {g: m for g, m in alive.items() if v not in g}
    return out


def densest(instances: dict[tuple[int, ...], int], ids) -> tuple[Fraction, list[int]]:
    """The best density and the union of all sets that reach it."""
    ids, best, union = list(ids), Fraction(0), set()
    for size in range(1, len(ids) + 1):
        for group in combinations(ids, size):
            inside = set(group)
            density = Fraction(sum(m for g, m in instances.items() if inside.issuperset(g)), size)
            if density > best:
                best, union = density, set(group)
            elif density == best and density > 0:
                union |= inside
    return best, sorted(union)
