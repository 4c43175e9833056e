"""``python -m corelith FILE``: the densest subgraph of a graph file, with the figures and the seconds of each stage as JSON."""

from __future__ import annotations

import argparse
import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from corelith.operators.approx import members_within
from corelith.operators.cliques import incidence
from corelith.operators.graph import graph_counts
from corelith.plans.densest import densest_of, find_instances
from corelith.plans.session import cut, ship
from corelith.sources import text

log = logging.getLogger("corelith")
READERS = {"adjacency": text.read_adjacency, "edges": text.read_edge_list, "matrix": text.read_matrix}


def run(spark: SparkSession, path: str, form: str = "adjacency", pattern: int | str = 3, method: str = "exact", out: str | None = None) -> dict:
    """The figures of a run; the members' ids go to ``out`` where it is given, one a line."""
    ship(spark)
    seconds: dict[str, float] = {}

    def timed(stage: str, work: Callable):
        began = time.time()
        made = work()
        seconds[stage] = round(time.time() - began, 3)
        log.info("%s: %s s", stage, seconds[stage])
        return made

    began = time.time()
    edges, vertices = timed("read", lambda: tuple(map(cut, READERS[form](spark, path))))
    counts = timed("counts", lambda: graph_counts(edges, vertices).first().asDict())
    found = timed("instances", lambda: find_instances(edges, pattern))
    best = densest_of(found, method, stage=timed)
    members = timed("members", lambda: best.members.count())
    if out is not None:
        timed("write", lambda: best.members.orderBy("id").selectExpr("cast(id as string) as value").write.text(out))
    seconds["total"] = round(time.time() - began, 3)
    answer = {"density": best.density, "numer": best.numer, "denom": best.denom, "members": members, "exact": best.exact, "gap": best.gap}
    figures = {"n_instances": members_within(found, incidence(found)).first()["n_instances"], **best.core}
    return {"graph": counts, "figures": figures, "answer": answer, "seconds": seconds}


def main() -> None:
    parser = argparse.ArgumentParser(prog="corelith", description=__doc__)
    parser.add_argument("path")
    parser.add_argument("--format", choices=sorted(READERS), default="adjacency")
    parser.add_argument("--pattern", default="3", help="a number k for the k-clique, or a pattern's name")
    parser.add_argument("--method", choices=("exact", "peel", "max_core"), default="exact")
    parser.add_argument("--out", help="a folder for the members' ids")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("corelith").getOrCreate()
    pattern = int(given.pattern) if given.pattern.isdigit() else given.pattern
    print(json.dumps(run(spark, given.path, given.format, pattern, given.method, given.out)))
    spark.stop()


if __name__ == "__main__":
    main()
