"""Exact densest sets of small components by Dinkelbach's iteration over integer minimum cuts, many components side by side.

A component is searched in one task, so its instances have to fit there; ``balance`` finds the densest sets of larger ones.
For a density p / q the best gain q * t(S) - p * |S| is a minimum cut: source to instance (q * mult), instance to its members
(unbounded), vertex to sink (p). As long as the gain is positive, the set found is denser. At the optimum the
largest set without loss is the union of all densest sets, so the answer does not depend on the order of anything.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from corelith.operators.prune import with_component
from corelith.plans.session import BATCH_ROWS, cut, ship, width

SOLVED = "component bigint, id bigint, numer bigint, denom bigint, exact boolean"


class Cut:
    """Maximum flow by blocking flows on the network of instances and vertices; no recursion, whole numbers only."""

    def __init__(self, members: list[list[int]], mults: list[int], n: int):
        self.members, self.mults, self.n = members, mults, n
        self.source, self.sink = 0, 1
        self.head: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(2 + n + len(members))]
        for i in range(len(members)):
            self._arc(self.source, 2 + n + i)
        for v in range(n):
            self._arc(2 + v, self.sink)
        for i, group in enumerate(members):
            for v in group:
                self._arc(2 + n + i, 2 + v)
        self.room: list[int] = []

    def _arc(self, a: int, b: int) -> None:
        self.arcs[a].append(len(self.head))
        self.head.append(b)
        self.arcs[b].append(len(self.head))
        self.head.append(a)

    def largest_set(self, p: int, q: int) -> list[int]:
        """The largest vertex set that maximises q * t(S) - p * |S|."""
        endless = q * sum(self.mults) + 1
        self.room = []
        for mult in self.mults:
            self.room += [q * mult, 0]
        self.room += [p, 0] * self.n
        for group in self.members:
            self.room += [endless, 0] * len(group)
        while self._push():
            pass
        # Whatever still reaches the sink is outside; everything else may be inside.
        outside, queue = {self.sink}, deque([self.sink])
        while queue:
            x = queue.popleft()
            for arc in self.arcs[x]:
                y = self.head[arc]
                if y not in outside and self.room[arc ^ 1] > 0:
                    outside.add(y)
                    queue.append(y)
        return [v for v in range(self.n) if 2 + v not in outside]

    def _push(self) -> bool:
        level = [-1] * len(self.arcs)
        level[self.source], queue = 0, deque([self.source])
        while queue:
            x = queue.popleft()
            for arc in self.arcs[x]:
                y = self.head[arc]
                if level[y] < 0 and self.room[arc] > 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        if level[self.sink] < 0:
            return False
        at, path, x = [0] * len(self.arcs), [], self.source
        while True:
            if x == self.sink:
                least = min(self.room[arc] for arc in path)
                back = 0
                for place, arc in enumerate(path):
                    self.room[arc] -= least
                    self.room[arc ^ 1] += least
                    if not self.room[arc] and not back:
                        back = place + 1
                del path[back - 1 :]
                x = self.head[path[-1]] if path else self.source
                continue
            while at[x] < len(self.arcs[x]):
                arc = self.arcs[x][at[x]]
                if self.room[arc] > 0 and level[self.head[arc]] == level[x] + 1:
                    path.append(arc)
                    x = self.head[arc]
                    break
                at[x] += 1
            else:
                if x == self.source:
                    return True
                level[x] = -1
                path.pop()
                x = self.head[path[-1]] if path else self.source


def densest_set(
    members: list[list[int]], mults: list[int], start: Fraction = Fraction(0), most_cuts: int | None = None
) -> tuple[list[int], Fraction, bool]:
    """The union of all densest sets, its density, and whether that is certain; nothing if no set reaches ``start``.

    ``most_cuts`` ends the search early with the densest set seen so far.
    """
    ids = sorted({v for group in members for v in group})
    place = {v: i for i, v in enumerate(ids)}
    groups = [[place[v] for v in group] for group in members]
    if not ids:
        return [], Fraction(0), True
    network, whole, cuts = Cut(groups, mults, len(ids)), Fraction(sum(mults), len(ids)), 0
    density, seen = max(start, whole), ids if whole >= start else []
    while True:
        if cuts == most_cuts:
            return seen, density if seen else Fraction(0), False
        chosen, cuts = network.largest_set(density.numerator, density.denominator), cuts + 1
        if not chosen:
            return [], Fraction(0), True
        inside = set(chosen)
        held = sum(m for m, group in zip(mults, groups, strict=True) if inside.issuperset(group))
        found = Fraction(held, len(chosen))
        if found <= density:
            return ([ids[v] for v in chosen], found, True) if found == density else ([], Fraction(0), True)
        density, seen = found, [ids[v] for v in chosen]


def solve_components(instances: DataFrame, components: DataFrame, start: tuple[int, int] = (0, 0), most_cuts: int | None = None) -> DataFrame:
    """Rows of ``SOLVED``: the members of each component's densest set that reaches the density ``start``.

    Components are dealt to tasks by the number of instances and come to a worker one after another: there may be very many tiny ones, which
    adaptive execution would merge into a task or two, as their rows take few bytes.
    """
    spark = instances.sparkSession
    ship(spark)
    held = cut(with_component(instances, components).select("component", "members", "mult"))
    dealt = held.repartition(max(spark.sparkContext.defaultParallelism, width(held.count(), spark)), "component").sortWithinPartitions("component")
    floor = Fraction(*start) if start[1] else Fraction(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        done: list[tuple[int, int, int, int, bool]] = []
        for component, group in groupby(rows, key=itemgetter(0)):
            _, members, mults = zip(*group, strict=True)
            chosen, density, certain = densest_set(list(members), list(mults), floor, most_cuts)
            done += [(component, v, int(density * len(chosen)), len(chosen), certain) for v in chosen]
            if len(done) >= BATCH_ROWS:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return dealt.mapInArrow(run, SOLVED)


def _batch(done: list[tuple[int, int, int, int, bool]]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SOLVED.split(", ")])
