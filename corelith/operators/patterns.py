"""Small patterns: a registry, a matcher compiled to joins, and closed forms for counts and degrees.

Matches are not induced: only a pattern's edges are asked for. Each instance is found once, as conditions between
interchangeable pattern vertices break its symmetries, and instances on the same vertices are counted together as ``mult``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.functions import binomial
from corelith.operators.cliques import codegree_table, list_cliques
from corelith.operators.graph import ball, degrees, induced, sorted_adjacency, symmetric
from corelith.plans.session import cut


@dataclass(frozen=True)
class Pattern:
    """A connected pattern on vertices 0..size-1."""

    size: int
    edges: frozenset[tuple[int, int]]

    @staticmethod
    def of(size: int, edges: list[tuple[int, int]]) -> Pattern:
        pattern = Pattern(size, frozenset((min(e), max(e)) for e in edges if e[0] != e[1]))
        reached = {0}
        while grown := {y for x in reached for y in pattern.around(x)} - reached:
            reached |= grown
        if reached != set(range(size)):
            raise ValueError("a pattern has to be connected and to use all its vertices")
        return pattern

    def around(self, x: int) -> set[int]:
        return {b if a == x else a for a, b in self.edges if x in (a, b)}

    def automorphisms(self) -> list[tuple[int, ...]]:
        return [p for p in permutations(range(self.size)) if {tuple(sorted((p[a], p[b]))) for a, b in self.edges} == self.edges]

    def order_conditions(self) -> list[tuple[int, int]]:
        """(a, b) pairs to require image(a) < image(b), which leave one of all symmetric matches."""
        group, out = self.automorphisms(), []
        while len(group) > 1:
            moved = next(x for x in range(self.size) if len({p[x] for p in group}) > 1)
            out += [(moved, y) for y in sorted({p[moved] for p in group}) if y != moved]
            group = [p for p in group if p[moved] == moved]
        return out

    def diameter(self) -> int:
        far = 0
        for start in range(self.size):
            seen, ring, steps = {start}, {start}, 0
            while ring := {y for x in ring for y in self.around(x)} - seen:
                seen |= ring
                steps += 1
            far = max(far, steps)
        return far


def clique(k: int) -> Pattern:
    return Pattern.of(k, [(a, b) for a in range(k) for b in range(a)])


def star(s: int) -> Pattern:
    """A centre with s leaves."""
    return Pattern.of(s + 1, [(0, i) for i in range(1, s + 1)])


PATTERNS: dict[str, Pattern] = {
    "edge": clique(2),
    "triangle": clique(3),
    "4-clique": clique(4),
    "5-clique": clique(5),
    "2-star": star(2),
    "3-star": star(3),
    "4-cycle": Pattern.of(4, [(0, 1), (1, 2), (2, 3), (3, 0)]),
    "tailed-triangle": Pattern.of(4, [(0, 1), (1, 2), (0, 2), (2, 3)]),
    "2-triangle": Pattern.of(4, [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3)]),
    "3-triangle": Pattern.of(5, [(0, 1), *[(x, y) for x in (0, 1) for y in (2, 3, 4)]]),
    "basket": Pattern.of(5, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (0, 4), (1, 4)]),
    "4-path": Pattern.of(4, [(0, 1), (1, 2), (2, 3)]),
}


def _visit_order(pattern: Pattern) -> list[int]:
    """Each vertex after a neighbour, those with the most earlier neighbours first."""
    order = [max(range(pattern.size), key=lambda x: len(pattern.around(x)))]
    while len(order) < pattern.size:
        rest = [x for x in range(pattern.size) if x not in order]
        order.append(max(rest, key=lambda x: (len(pattern.around(x) & set(order)), len(pattern.around(x)))))
    return order


def _grown(edges: DataFrame, pattern: Pattern, order: list[int]) -> DataFrame:
    """One row of columns v{x} for each way to place the pattern's vertices ``order``, symmetries broken as far as they go.

    Where the first three make a triangle, the graph's triangles are placed in all ways; open paths of two edges are not built.
    """
    adj = symmetric(edges)
    conditions = pattern.order_conditions()
    deg = degrees(edges)
    fit = lambda x: deg.filter(F.col("degree") >= len(pattern.around(x))).select(F.col("id").alias(f"v{x}"))
    if len(order) >= 3 and all(b in pattern.around(a) for a, b in combinations(order[:3], 2)):
        done, found = 3, _placed_triangles(edges, order[:3], conditions)
    else:
        done, found = 1, fit(order[0])
    for place, x in enumerate(order[done:], done):
        before = order[:place]
        anchors = [a for a in before if a in pattern.around(x)]
        step = adj.select(F.col("u").alias("a0"), F.col("v").alias(f"v{x}")).join(fit(x), f"v{x}", "left_semi")
        found = found.join(step, found[f"v{anchors[0]}"] == F.col("a0")).drop("a0")
        for anchor in anchors[1:]:
            other = adj.select(F.col("u").alias("a1"), F.col("v").alias("b1"))
            found = found.join(other, (F.col(f"v{anchor}") == F.col("a1")) & (F.col(f"v{x}") == F.col("b1")), "left_semi")
        for a in before:
            if a not in anchors:
                found = found.filter(F.col(f"v{a}") != F.col(f"v{x}"))
        for a, b in conditions:
            if x in (a, b) and {a, b} - {x} <= set(before):
                found = found.filter(F.col(f"v{a}") < F.col(f"v{b}"))
    return found


def _placed_triangles(edges: DataFrame, at: list[int], conditions: list[tuple[int, int]]) -> DataFrame:
    """One row of columns v{x} for each way to place the pattern vertices ``at`` on a triangle."""
    m = F.col("members")
    within = [(at.index(a), at.index(b)) for a, b in conditions if a in at and b in at]
    ways = [p for p in permutations(range(3)) if all(p[a] < p[b] for a, b in within)]
    rows = F.array(*[F.struct(*[m[p[i]].alias(f"v{x}") for i, x in enumerate(at)]) for p in ways])
    return list_cliques(edges, 3).select(F.explode(rows).alias("w")).select("w.*")


def matches(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """One row of columns v0..v{size-1} for each instance; vertices of too small a degree are left out first."""
    return _grown(edges, pattern, _visit_order(pattern)).select(*[f"v{x}" for x in range(pattern.size)])


def count_matches(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """One row (n_instances): all vertices but the last are placed, and the last one's candidates are only counted.

    They are the common neighbours of what it hangs on, less what is taken; no instance is built and none is grouped. What hangs on one vertex
    alone, whose neighbours include all that is taken, is counted by that vertex's degree.
    """
    *order, last = _visit_order(pattern)
    found = _grown(edges, pattern, order)
    anchors = [a for a in order if a in pattern.around(last)]
    ordered = any(last in c for c in pattern.order_conditions())
    if len(anchors) == 1 and not ordered and set(order) - {anchors[0]} <= pattern.around(anchors[0]):
        at = found.groupBy(F.col(f"v{anchors[0]}").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return at.join(degrees(edges), "id").agg(*_total(F.col("n") * (F.col("degree") - (len(order) - 1))))
    lists = cut(sorted_adjacency(edges))
    for a in anchors:
        found = found.join(lists.select(F.col("u").alias(f"v{a}"), F.col("neighbours").alias(f"n{a}")), f"v{a}")
    both = F.col(f"n{anchors[0]}")
    for a in anchors[1:]:
        both = F.array_intersect(both, F.col(f"n{a}"))
    below = [F.col(f"v{b}") for a, b in pattern.order_conditions() if a == last]
    above = [F.col(f"v{a}") for a, b in pattern.order_conditions() if b == last]
    taken = [F.col(f"v{x}") for x in order if x not in anchors]

    def free(candidate):
        fits = F.lit(True)
        for other in taken:
            fits = fits & (candidate != other)
        for other in below:
            fits = fits & (candidate < other)
        for other in above:
            fits = fits & (candidate > other)
        return fits

    # No anchor is its own neighbour, so none is in the common list.
    return found.select(F.size(F.filter(both, free)).cast("bigint").alias("n")).agg(*_total(F.col("n")))


def instances(edges: DataFrame, pattern: Pattern) -> DataFrame:
    """(members, mult): ascending vertex sets and how many instances each carries."""
    size = pattern.size
    if len(pattern.edges) == size * (size - 1) // 2:
        return list_cliques(edges, size).withColumn("mult", F.lit(1).cast("bigint"))
    members = F.sort_array(F.array(*[f"v{x}" for x in range(size)]))
    return matches(edges, pattern).select(members.alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("mult"))


def pattern_degrees(found: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, pattern_degree) from instances (members, mult)."""
    deg = found.select(F.explode("members").alias("id"), "mult").groupBy("id").agg(F.sum("mult").alias("pattern_degree"))
    if vertices is None:
        return deg
    return vertices.join(deg, "id", "left").select("id", F.coalesce("pattern_degree", F.lit(0).cast("bigint")).alias("pattern_degree"))


def instances_at(edges: DataFrame, pattern: Pattern, vertex: int) -> DataFrame:
    """The instances that hold ``vertex``, matched in what lies within the pattern's diameter of it only."""
    edges = cut(edges)
    start = edges.sparkSession.createDataFrame([(vertex,)], "id bigint")
    near = cut(induced(edges, ball(edges, start, pattern.diameter())))
    return instances(near, pattern).filter(F.array_contains("members", vertex))


def degrees_at(found: DataFrame, vertex: int) -> DataFrame:
    """(id, pattern_degree) of the instances that contain ``vertex``: what leaves with it."""
    return pattern_degrees(found.filter(F.array_contains("members", vertex)))


# Closed forms. None of them builds instances.


def codegrees(edges: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """(src, dst, codegree): common neighbours of the ends of every edge; ``triangles`` where they are listed already."""
    if triangles is None:
        return codegree_table(edges)
    m = F.col("members")
    sides = F.array(*[F.struct(m[a].alias("src"), m[b].alias("dst")) for a, b in ((0, 1), (0, 2), (1, 2))])
    counted = triangles.select(F.explode(sides).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(counted, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0).cast("bigint")).alias("codegree"))


def _total(column) -> list:
    return [F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias("n_instances")]


def tailed_triangle_count(edges: DataFrame) -> DataFrame:
    """Sum over triangles of (degree - 2) of their vertices."""
    corners = list_cliques(edges, 3).select(F.explode("members").alias("id"))
    return corners.join(degrees(edges), "id").agg(*_total(F.col("degree") - 2))


def tailed_triangle_degrees(edges: DataFrame) -> DataFrame:
    """(id, pattern_degree): the tails of each triangle at its corners, and at the end of a tail the triangles that it hangs on."""
    deg = degrees(edges)
    listed = cut(list_cliques(edges, 3).select(F.monotonically_increasing_id().alias("t"), "members"))
    cornered = listed.select("t", F.explode("members").alias("id"))
    open_ends = cornered.join(deg, "id").groupBy("t").agg(F.sum(F.col("degree") - 2).alias("n"))
    at_corners = cornered.join(open_ends, "t").select("id", "n")
    held = cornered.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("id", "u")
    at_ends = symmetric(edges).join(held, "u").select(F.col("v").alias("id"), "n")
    shared = codegrees(edges, listed).select(F.explode(F.array("src", "dst")).alias("id"), (-F.col("codegree")).alias("n"))
    parts = at_corners.unionByName(at_ends).unionByName(shared)
    return parts.groupBy("id").agg(F.sum("n").alias("pattern_degree")).filter("pattern_degree > 0")


def common_edge_triangles_count(edges: DataFrame, triangles: int) -> DataFrame:
    """Sum over edges of C(codegree, triangles): the 2-triangle and the 3-triangle."""
    return codegrees(edges).agg(*_total(binomial(F.col("codegree"), triangles)))


def common_edge_triangles_degrees(edges: DataFrame, triangles: int) -> DataFrame:
    """(id, pattern_degree): C(c, s) for the ends of an edge of codegree c, C(c - 1, s - 1) for each apex of it."""
    m = F.col("members")
    listed = cut(list_cliques(edges, 3))
    co = codegrees(edges, listed)
    ends = co.select(F.explode(F.array("src", "dst")).alias("id"), binomial(F.col("codegree"), triangles).alias("n"))
    sides = F.array(*[F.struct(m[a].alias("src"), m[b].alias("dst"), m[c].alias("id")) for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 2, 0))])
    apexes = (
        listed.select(F.explode(sides).alias("e"))
        .select("e.*")
        .join(co, ["src", "dst"])
        .select("id", binomial(F.col("codegree") - 1, triangles - 1).alias("n"))
    )
    return ends.unionByName(apexes).groupBy("id").agg(F.sum("n").alias("pattern_degree")).filter("pattern_degree > 0")


def basket_count(edges: DataFrame) -> DataFrame:
    """Sum over 4-cliques of (codegree - 2) of their six edges."""
    m = F.col("members")
    sides = F.array(*[F.struct(m[a].alias("src"), m[b].alias("dst")) for b in range(4) for a in range(b)])
    return list_cliques(edges, 4).select(F.explode(sides).alias("e")).select("e.*").join(codegrees(edges), ["src", "dst"]).agg(*_total(F.col("codegree") - 2))


def basket_degrees(edges: DataFrame) -> DataFrame:
    """(id, pattern_degree): a 4-clique's members have all its baskets; an apex over an edge has the 4-cliques of the edge without itself."""
    m, e = F.col("members"), ["src", "dst"]
    four = cut(list_cliques(edges, 4).select(F.monotonically_increasing_id().alias("q"), "members"))
    pair = lambda a, b: F.struct(m[a].alias("src"), m[b].alias("dst"))
    sides = four.select("q", F.explode(F.array(*[pair(a, b) for b in range(4) for a in range(b)])).alias("e")).select("q", "e.*")
    baskets = sides.join(codegrees(edges), e).groupBy("q").agg(F.sum(F.col("codegree") - 2).alias("n"))
    inside = four.join(baskets, "q").select(F.explode("members").alias("id"), "n")
    on_edge = sides.groupBy(*e).agg(F.count(F.lit(1)).alias("n"))
    triple = lambda x, y, z: F.struct(m[x].alias("a"), m[y].alias("b"), m[z].alias("c"))
    triples = four.select(F.explode(F.array(*[triple(*[i for i in range(4) if i != left]) for left in range(4)])).alias("t")).select("t.*")
    within = triples.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    apex = lambda a, b, c: F.struct(m[a].alias("src"), m[b].alias("dst"), m[c].alias("id"))
    over = list_cliques(edges, 3).select(F.explode(F.array(apex(0, 1, 2), apex(0, 2, 1), apex(1, 2, 0))).alias("e")).select("e.*")
    outside = over.join(on_edge, e).select("id", "n")
    again = within.select(F.explode(F.array("a", "b", "c")).alias("id"), (-F.col("n")).alias("n"))
    parts = inside.unionByName(outside).unionByName(again)
    return parts.groupBy("id").agg(F.sum("n").alias("pattern_degree")).filter("pattern_degree > 0")


def star_degrees(edges: DataFrame, s: int) -> DataFrame:
    """(id, pattern_degree): C(d, s) as the centre and C(d(u) - 1, s - 1) as a leaf of each neighbour u."""
    deg = degrees(edges)
    centre = deg.select("id", binomial(F.col("degree"), s).alias("n"))
    leaf = symmetric(edges).join(deg.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), binomial(F.col("degree") - 1, s - 1).alias("n"))
    return centre.unionByName(leaf).groupBy("id").agg(F.sum("n").alias("pattern_degree"))


def star_count(edges: DataFrame, s: int) -> DataFrame:
    return degrees(edges).agg(*_total(binomial(F.col("degree"), s)))


def ranked_wedges(edges: DataFrame) -> DataFrame:
    """(x, u, y): paths x - u - y whose end x ranks above u and y by (degree, id).

    A 4-cycle has one vertex of highest rank and is seen from there only. A middle vertex has few neighbours above it, so
    hubs do not square their degree.
    """
    ranks = degrees(edges).select("id", F.struct(F.col("degree"), F.col("id").alias("own")).alias("rank"))
    adj = symmetric(edges).join(ranks.select(F.col("id").alias("v"), F.col("rank").alias("rank_v")), "v")
    own = ranks.select(F.col("id").alias("u"), F.col("rank").alias("rank_u"))
    tops = adj.join(own, "u").filter(F.col("rank_v") > F.col("rank_u")).select("u", F.col("v").alias("x"), F.col("rank_v").alias("rank_x"))
    ends = adj.select("u", F.col("v").alias("y"), F.col("rank_v").alias("rank_y"))
    return tops.join(ends, "u").filter(F.col("rank_y") < F.col("rank_x")).select("x", "u", "y")


def four_cycle_degrees(edges: DataFrame) -> DataFrame:
    """(id, pattern_degree): with n paths between x and y, C(n, 2) cycles at x and y, n - 1 of them at each middle."""
    paths = ranked_wedges(edges)
    between = paths.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ends = between.select(F.explode(F.array("x", "y")).alias("id"), binomial(F.col("n"), 2).alias("c"))
    middles = paths.join(between, ["x", "y"]).select(F.col("u").alias("id"), (F.col("n") - 1).alias("c"))
    return ends.unionByName(middles).groupBy("id").agg(F.sum("c").alias("pattern_degree"))


def four_cycle_count(edges: DataFrame) -> DataFrame:
    return ranked_wedges(edges).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).agg(*_total(binomial(F.col("n"), 2)))
