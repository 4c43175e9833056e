"""The densest-subgraph query: from edges and a pattern to the maximal densest vertex set.

list instances -> core numbers -> keep the core that holds every optimum -> split into components and raise the
threshold by their densities -> solve small components side by side, balance loads over the large ones -> union of all that
reach the best density.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.approx import max_core, members_within, peel_by_level
from corelith.operators.balance import PRICED, balanced_densest
from corelith.operators.cliques import as_columns, as_members, clique_columns, identified, incidence, list_cliques
from corelith.operators.cores import instance_core_numbers
from corelith.operators.exact import solve_components
from corelith.operators.patterns import PATTERNS, Pattern, instances
from corelith.operators.priced import ONE_WORKER, solve_by_price
from corelith.operators.prune import dense_columns, densest_core, densest_row, instance_components, placed, prune_by_components
from corelith.plans.session import cut, stored

MEMBERS = "id bigint"
#: Components of more instances than this are solved by rounds over all executors instead of in one task.
ONE_TASK = 50_000
#: More instances than this are first searched by prices, without core numbers.
MANY = 1_000_000


@dataclass(frozen=True)
class Densest:
    """``members`` (id) and the density numer / denom.

    ``exact`` says that this is proved to be the maximal densest set, ``upper`` bounds any set's density (None where no bound was
    asked for), ``core`` holds the densest core's figures where cores were made.
    """

    members: DataFrame
    numer: int
    denom: int
    exact: bool
    upper: float | None = None
    core: dict = field(default_factory=dict)

    @property
    def density(self) -> float:
        return self.numer / self.denom if self.denom else 0.0

    @property
    def gap(self) -> float | None:
        """How much denser some set might be: 0 where the answer is exact."""
        if self.exact:
            return 0.0
        return None if self.upper is None else max(0.0, self.upper - self.density)


def find_instances(edges: DataFrame, pattern: int | str | Pattern) -> DataFrame:
    """Identified instances (clique_id, members, mult); a number k stands for the k-clique."""
    if isinstance(pattern, int):
        return identified(list_cliques(edges, pattern))
    return identified(instances(edges, PATTERNS[pattern] if isinstance(pattern, str) else pattern))


def densest_subgraph(edges: DataFrame, pattern: int | str | Pattern = 3, method: str = "exact", **options) -> Densest:
    """The maximal set of vertices with the most pattern instances for each vertex; see ``densest_of``."""
    if not isinstance(pattern, int) or method != "exact" or not options.get("prune", True) or options.get("many", MANY) is None:
        return densest_of(find_instances(edges, pattern), method, **options)
    # Cliques are written as columns, so that very many of them need no other form.
    wide = stored(clique_columns(edges, pattern))
    if wide.count() > options.get("many", MANY):
        best, wide = _priced(wide, **{name: options[name] for name in ("many", "max_rounds", "tolerance", "stage") if name in options})
        if best is not None:
            return best
    return densest_of(identified(as_members(wide)), method, **options | {"many": None})


def densest_of(
    found: DataFrame,
    method: str = "exact",
    prune: bool = True,
    most_instances: int = ONE_TASK,
    most_cuts: int | None = None,
    max_rounds: int = 400,
    tolerance: float = 0.0,
    many: int | None = MANY,
    stage: Callable = lambda name, work: work(),
) -> Densest:
    """The maximal densest set of identified instances (clique_id, members, mult).

    ``method``: "exact"; "peel" for the densest core; "max_core" for the core of highest number. Both approximations reach at
    least 1 / k of the best density. Components of up to ``most_instances`` instances are solved in a task each, larger ones by
    rounds of load balancing, with the same answer. ``most_cuts``, ``max_rounds`` and ``tolerance`` end the search of a small
    or a large component early; ``exact`` is then false unless the answer is proved all the same. ``prune`` false skips cores and
    thresholds and searches all components. More than ``many`` instances that are left by ``dense_part`` are first searched by prices, whose proof
    needs no cores: components of up to ``ONE_WORKER`` instances in a task each, larger ones over all executors. Where that proves nothing, cores are made after all. A graph without instances has density 0 and no members. ``stage`` is called with
    the name and the work of each stage.
    """
    spark = found.sparkSession
    if found.isEmpty():
        return Densest(spark.createDataFrame([], MEMBERS), 0, 0, True, 0.0)
    if method == "peel":
        row = peel_by_level(found).first()
        cores = instance_core_numbers(incidence(found))
        return Densest(cores.filter(F.col("core") >= row["level"]).select("id"), row["n_instances"], row["n_vertices"], False)
    if method == "max_core":
        ids, stats = max_core(found)
        row = stats.first()
        return Densest(ids, row["n_instances"], row["n_vertices"], False)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    core: dict = {}
    start = Fraction(0)
    if prune and many is not None and found.count() > many:
        best, wide = _priced(stored(as_columns(found, found.select(F.size("members")).first()[0])), many, max_rounds, tolerance, stage)
        if best is not None:
            return best
        found = identified(as_members(wide))
    if prune:
        kept, cores, core = stage("cores", lambda: densest_core(found))
        kept, components, densest_component = stage("components", lambda: prune_by_components(cut(kept), cores, core["threshold"]))
        start = max(Fraction(*f) for f in (densest_component, (core["numer"], core["denom"]), (0, 1)) if f[1])
    else:
        kept, components = found, stage("components", lambda: cut(instance_components(found)))
    best = stage("search", lambda: _search(kept, components, start, most_instances, most_cuts, max_rounds, tolerance))
    return Densest(best.members, best.numer, best.denom, best.exact, best.upper, core)


def _priced(
    wide: DataFrame, many: int = MANY, max_rounds: int = 400, tolerance: float = 0.0, stage: Callable = lambda name, work: work()
) -> tuple[Densest | None, DataFrame]:
    """The answer for instances as columns (v0, v1, ..., mult), if prices prove one, and what ``dense_columns`` leaves of them."""
    wide = stage("dense part", lambda: dense_columns(wide))
    if wide.count() <= many:
        return None, wide
    best = stage("prices", lambda: _by_price(wide, min(PRICED, max_rounds), tolerance))
    return (best if best.exact else None), wide


def _by_price(wide: DataFrame, max_rounds: int, tolerance: float) -> Densest:
    held, sizes = placed(wide)
    start = densest_row(sizes, "n_instances", "n_vertices")

    def of(large: DataFrame) -> DataFrame:
        return as_members(held.join(F.broadcast(large), "component", "left_semi").drop("component"))

    def solve(large: DataFrame | None, start: Fraction) -> DataFrame:
        return solve_by_price(held, sizes.filter(F.col("rows") <= ONE_WORKER), start)

    return _parts(sizes, of, start, ONE_WORKER, solve, max_rounds, tolerance)


def _search(kept: DataFrame, components: DataFrame, start: Fraction, most_instances: int, most_cuts: int | None, max_rounds: int, tolerance: float) -> Densest:
    sizes = cut(kept.withColumn("id", F.col("members")[0]).join(components, "id").groupBy("component").agg(F.count(F.lit(1)).alias("rows")))

    def of(large: DataFrame) -> DataFrame:
        mine = components.join(large, "component", "left_semi").select("id")
        return kept.withColumn("id", F.col("members")[0]).join(mine, "id", "left_semi").drop("id")

    def solve(large: DataFrame | None, start: Fraction) -> DataFrame:
        small = components if large is None else components.join(large, "component", "left_anti")
        return cut(solve_components(kept, small, (start.numerator, start.denominator), most_cuts))

    return _parts(sizes, of, start, most_instances, solve, max_rounds, tolerance)


def _parts(sizes: DataFrame, of: Callable, start: Fraction, most_instances: int, solve: Callable, max_rounds: int, tolerance: float) -> Densest:
    """The best of all components: those of up to ``most_instances`` instances by ``solve``, larger ones, whose instances are given by ``of``, by balancing.

    ``sizes``: (component, rows).
    """
    large = sizes.filter(F.col("rows") > most_instances).select("component")
    found: list[tuple[Fraction, int, DataFrame, bool, float]] = []  # density, members, ids, exact, upper
    if large.isEmpty():
        large = None
    else:
        balanced = balanced_densest(of(large), max_rounds, tolerance)
        found.append((Fraction(balanced.numer, balanced.denom), balanced.denom, balanced.members, balanced.proved, balanced.upper))
        start = max(start, found[0][0])
    solved = solve(large, start)
    top = densest_row(solved)
    if top is not None:
        same = solved.filter(F.col("numer").cast("decimal(38,0)") * top.denominator == F.col("denom").cast("decimal(38,0)") * top.numerator)
        certain = solved.filter("not exact").isEmpty()
        found.append((top, same.count(), same.select("id"), certain, float(top) if certain else float("inf")))
    best = max(density for density, *_ in found)
    ids, n = None, 0
    for density, size, own, *_ in found:
        if density == best:
            ids, n = own if ids is None else ids.unionByName(own), n + size
    # A part that was not solved to its end matters only as far as it might still be denser.
    open_ends = [upper for density, _, _, exact, upper in found if not exact and (density == best or upper >= best)]
    upper = max([float(best), *open_ends])
    return Densest(ids, int(best * n), n, not open_ends, None if upper == float("inf") else upper)


def report(edges: DataFrame, pattern: int | str | Pattern = 3, **options) -> DataFrame:
    """One row of figures: instances, cores, the densest core, the optimum and whether it is proved; all from one run."""
    spark = edges.sparkSession
    found = find_instances(edges, pattern)
    best = densest_of(found, many=None, **options)
    core = best.core or {"numer": 0, "denom": 0, "threshold": 0, "k_max": 0}
    total = members_within(found, incidence(found)).first()
    return spark.createDataFrame(
        [(total["n_instances"], core["k_max"], core["threshold"], core["numer"], core["denom"], best.numer, best.denom, best.exact, best.gap)],
        "n_instances bigint, k_max bigint, threshold bigint, core_numer bigint, core_denom bigint, numer bigint, denom bigint, exact boolean, gap double",
    )
