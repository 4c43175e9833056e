"""Densest sets of components that fit into a task, by prices in NumPy, many components side by side.

The rounds are those of ``balance``, where prices and the two parts of the proof are described: an instance gives its units to the members of lowest
prices, prices follow the loads, and shares rounded to whole numbers prove the answer. What ``balance`` does in a pass over all
executors is done here for one component of up to ``ONE_WORKER`` instances in a Python worker, so rounds cost no jobs, and nothing
but the answer leaves the task. Columns of instances are read in chunks; beside them a worker holds a few numbers for each vertex.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.balance import DEPTH, FEW_VERTICES, LEAST_LIVE, PRICED_ATTEMPT, UNIT_BITS, numbered
from corelith.operators.exact import SOLVED, densest_set
from corelith.plans.session import cut, ship, width

#: Components of more instances than this are not given to one task.
ONE_WORKER = 4_000_000
#: Instances that are looked at together.
CHUNK = 200_000
#: Rounds at most, and up to how many instances minimum cuts follow where they prove nothing.
ROUNDS, CUT_INSTANCES = 100, 50_000
HALF_BITS = 26


@dataclass(frozen=True)
class Found:
    """Places of the densest prefix, its figures, whether it is proved to be the maximal densest set, and the largest load of any vertex."""

    places: np.ndarray
    numer: int
    denom: int
    proved: bool
    largest: Fraction


class Component:
    """Instances as columns of vertex places, with how often each counts."""

    def __init__(self, members: np.ndarray, mults: np.ndarray):
        self.ids, places = np.unique(members, return_inverse=True)
        places = places.reshape(members.shape).astype(np.int32)
        self.at = [np.ascontiguousarray(places[:, j]) for j in range(members.shape[1])]
        self.mults, self.k, self.n = mults.astype(np.int64), members.shape[1], len(self.ids)
        self.total = sum(map(int, np.add.reduceat(self.mults, np.arange(0, len(mults), CHUNK))))
        self.weight = self._summed(lambda part: [self.mults[part]] * self.k)
        self.bits = min(UNIT_BITS, 61 - int(self.weight.max()).bit_length())

    def parts(self) -> Iterator[slice]:
        return (slice(i, i + CHUNK) for i in range(0, len(self.mults), CHUNK))

    def _summed(self, given: Callable) -> np.ndarray:
        sums = np.zeros(self.n, dtype=np.int64)
        for part in self.parts():
            self._add(sums, part, given(part))
        return sums

    def _add(self, sums: np.ndarray, part: slice, given: list[np.ndarray]) -> None:
        """Adds whole numbers by vertex; doubles hold the sums of either half exactly."""
        for at, x in zip(self.at, given, strict=True):
            low = np.bincount(at[part], x & ((1 << HALF_BITS) - 1), self.n)
            high = np.bincount(at[part], x >> HALF_BITS, self.n)
            sums += low.astype(np.int64) + (high.astype(np.int64) << HALF_BITS)

    def shares(self, price: np.ndarray, part: slice) -> list[np.ndarray]:
        """Each member's part of one unit at these prices."""
        cheap = [-price[at[part]] for at in self.at]
        if self.k == 1:
            return [np.ones(len(cheap[0]))]
        if self.k == 2:
            high = np.maximum(*cheap)
            level = np.maximum(high - 1, (cheap[0] + cheap[1] - 1) / 2)
        elif self.k == 3:
            high, low = np.maximum(np.maximum(*cheap[:2]), cheap[2]), np.minimum(np.minimum(*cheap[:2]), cheap[2])
            whole = cheap[0] + cheap[1] + cheap[2]
            level = np.maximum(np.maximum(high - 1, (whole - low - 1) / 2), (whole - 1) / 3)
        else:
            down = np.sort(np.stack(cheap), axis=0)[::-1]
            level = ((np.cumsum(down, axis=0) - 1) / np.arange(1, self.k + 1)[:, None]).max(axis=0)
        return [np.maximum(0.0, c - level) for c in cheap]

    def loads(self, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vertex's load, and by how much it would change with the vertex's price, all other prices staying."""
        load, live = np.zeros(self.n), np.zeros(self.n)
        for part in self.parts():
            given, mult = self.shares(price, part), self.mults[part]
            takers = sum((x > 0).astype(np.int8) for x in given)
            react = mult * (1.0 - 1.0 / takers) * (self.k / max(self.k - 1, 1))
            for at, x in zip(self.at, given, strict=True):
                load += np.bincount(at[part], x * mult, self.n)
                live += np.bincount(at[part], np.where(x > 0, react, 0.0), self.n)
        return load, live

    def _whole(self, price: np.ndarray, part: slice) -> list[np.ndarray]:
        """Shares as whole numbers that add up to mult * 2^bits; what rounding leaves goes to the largest."""
        mult = self.mults[part]
        whole = np.stack([np.floor(x * mult * float(1 << self.bits)).astype(np.int64) for x in self.shares(price, part)])
        whole[whole.argmax(axis=0), np.arange(whole.shape[1])] += (mult << self.bits) - whole.sum(axis=0)
        return list(whole)

    def attempt(self, price: np.ndarray, load: np.ndarray) -> Found:
        """The densest prefix by loads, and whether the shares, in whole numbers, prove it."""
        order = np.lexsort((np.arange(self.n), -load))
        rank = np.empty(self.n, dtype=np.int32)
        rank[order] = np.arange(self.n, dtype=np.int32)
        ends = np.zeros(self.n, dtype=np.int64)
        for part in self.parts():
            last = np.max([rank[at[part]] for at in self.at], axis=0)
            mult = self.mults[part]
            low, high = (np.bincount(last, m, self.n).astype(np.int64) for m in (mult & ((1 << HALF_BITS) - 1), mult >> HALF_BITS))
            ends += low + (high << HALF_BITS)
        t, s = longest_densest(np.cumsum(ends))
        given, before = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        for part in self.parts():
            b, held = self._whole(price, part), [rank[at[part]] < s for at in self.at]
            self._add(before, part, b)
            inside = sum(h.astype(np.int64) for h in held)
            crossing = (inside > 0) & (inside < self.k)
            moved = sum(np.where(h, x, 0) for h, x in zip(held, b, strict=True))
            takers = np.maximum(self.k - inside, 1)
            each, rest = moved // takers, moved % takers
            after = []
            for h, x in zip(held, b, strict=True):
                after.append(np.where(crossing, np.where(h, 0, x + each + rest), x))
                rest = np.where(h, rest, 0)  # the first member outside has taken it
            self._add(given, part, after)
        in_prefix = rank < s
        top = lambda some: int(given[some].max()) if some.any() else 0
        inside, outside, unit, density = top(in_prefix), top(~in_prefix), 1 << self.bits, Fraction(t, s)
        proved = (inside * density.denominator - density.numerator * unit) * s < unit and outside * s < t * unit
        return Found(order[:s], t, s, proved, Fraction(min(int(before.max()), max(inside, outside)), unit))


def longest_densest(t: np.ndarray) -> tuple[int, int]:
    """(t, s): the densest prefix by running sums, the longest of equals. Doubles propose it, whole numbers decide."""
    s = np.arange(1, len(t) + 1)
    if int(t[-1]).bit_length() + len(t).bit_length() > 62:
        t, s = t.astype(object), s.astype(object)
    i = int(np.argmax((t / s).astype(float)))
    while len(denser := np.flatnonzero(t * s[i] > s * t[i])):
        i = int(denser[np.argmax((t[denser] / s[denser]).astype(float))])
    i = int(np.flatnonzero(t * s[i] == s * t[i]).max())
    return int(t[i]), int(s[i])


def _taken_back(moves: list, turns: list, gap: np.ndarray, scale: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the last changes of prices and of loads are to be corrected by, so that the gaps left are least."""
    if not moves:
        return np.zeros(len(gap)), np.zeros(len(gap))
    root = np.sqrt(scale[live])
    rows = np.stack([t[live] / root for t in turns])
    products, aims = rows @ rows.T, rows @ (gap[live] / root)
    size = np.sqrt(np.diag(products))
    size[size == 0] = 1.0
    back = np.linalg.lstsq(products / np.outer(size, size), aims / size, rcond=1e-13)[0] / size
    return back @ np.stack(moves), back @ np.stack(turns)


def densest_by_price(members: np.ndarray, mults: np.ndarray, start: Fraction = Fraction(0), rounds: int = ROUNDS) -> tuple[np.ndarray, int, int, bool]:
    """(ids, numer, denom, exact) of the maximal densest set; no ids, and exact, where no set reaches the density ``start``."""
    own = Component(members, mults)
    weight = own.weight.astype(float)
    price, before, was = np.zeros(own.n), None, None
    moves: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    aim, least, best = own.total / own.n, math.inf, None
    for done in range(1, rounds + 1):
        load, live = own.loads(price)
        gap, scale, reacts = load - aim, np.maximum(live, weight * LEAST_LIVE), live > 0
        if was is not None:
            moves, turns = [*moves, price - before][-DEPTH:], [*turns, load - was][-DEPTH:]
        squares = float((gap * gap / scale)[reacts].sum())
        widest = float(np.abs(gap[reacts]).max()) if reacts.any() else 0.0
        if widest * own.n * own.n < 0.5 or done % PRICED_ATTEMPT == 0 or done == rounds or load.max() * (1 + 1e-9) < start:
            found = own.attempt(price, load)
            if found.largest < start:
                return np.zeros(0, dtype=np.int64), 0, 0, True
            if found.proved:
                return (own.ids[found.places], found.numer, found.denom, True) if Fraction(found.numer, found.denom) >= start else (np.zeros(0, dtype=np.int64), 0, 0, True)
            if best is None or found.numer * best.denom >= best.numer * found.denom:
                best = found
            aim = max(aim, best.numer / best.denom)
        # Gaps that have grown much ask for a plain step, which never widens them, and a new start.
        anew = squares > 4 * least
        least = squares if anew else min(least, squares)
        plain = gap / weight
        if anew:
            step, moves, turns = plain, [], []
        else:
            moved, turned = _taken_back(moves, turns, gap, scale, reacts)
            step = np.where(reacts, (gap - turned) / scale - moved, plain)
        # Shares do not react beyond a difference of 1.
        before, was, price = price, None if anew else load, price + np.clip(step, -1.0, 1.0)
    return own.ids[best.places], best.numer, best.denom, False


def _solved(component: int, members: np.ndarray, mults: np.ndarray, start: Fraction) -> pa.RecordBatch:
    ids, numer, denom, exact = densest_by_price(members, mults, start)
    if not exact and len(mults) <= CUT_INSTANCES:
        chosen, density, exact = densest_set(members.tolist(), mults.tolist(), start)
        ids, numer, denom = np.array(chosen, dtype=np.int64), int(density * len(chosen)), len(chosen)
    same = lambda value, kind: pa.array(np.full(len(ids), value, dtype=kind))
    return pa.RecordBatch.from_arrays(
        [same(component, np.int64), pa.array(ids), same(numer, np.int64), same(denom, np.int64), same(exact, bool)], names=["component", "id", "numer", "denom", "exact"]
    )


def solve_by_price(wide: DataFrame, sizes: DataFrame, start: Fraction) -> DataFrame:
    """Rows of ``exact.SOLVED``, as ``solve_components`` gives them, for the components of ``sizes`` (component, rows: how many instances each has).

    Instances (v0, v1, ..., mult, component) are columns. Components are dealt to tasks in the order of their sizes, and come to a worker one
    after another.
    """
    spark = wide.sparkSession
    ship(spark)
    ids = [c for c in wide.columns if c not in ("mult", "component")]
    k = len(ids)
    tasks = width(sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], spark)
    dealt = numbered(sizes.select("component", "rows"), [F.col("rows").desc(), F.col("component")])
    dealt = cut(dealt.select("component", (F.col("rank") % tasks).cast("int").alias("task")))
    held = wide.join(F.broadcast(dealt) if dealt.count() <= FEW_VERTICES else dealt, "component")
    held = held.repartitionById(tasks, F.col("task")).sortWithinPartitions("component").select("component", *ids, "mult")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            own = batch.column("component").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            table = np.stack([batch.column(j + 1).to_numpy() for j in range(k + 1)], axis=1) if len(own) else None
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if rows and own[a] != now:
                    whole, rows = np.concatenate(rows), []
                    yield _solved(now, whole[:, :k], whole[:, k], start)
                now = int(own[a])
                rows.append(table[a:b])
        if rows:
            whole, rows = np.concatenate(rows), []
            yield _solved(now, whole[:, :k], whole[:, k], start)

    return cut(held.mapInArrow(run, SOLVED))
