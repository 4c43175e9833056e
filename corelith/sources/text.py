"""Graph text files: adjacency lists, edge lists, adjacency matrices, and pattern files.

Adjacency list: a header "n" or "n m", then lines "v n1 n2 ...". Vertices 0..n-1 exist whether or not they have a
line. Edge list: "u v" lines, "#" starts a comment. Separators are any white space; CRLF and trailing blanks are fine.
Self-loops go, repeated and one-directional edges become one edge.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelith.operators.graph import canonical_edges, dense_ids, side_by_side, sorted_adjacency, symmetric, vertices_of
from corelith.operators.patterns import Pattern
from corelith.plans.session import cut, partitions, stored, width

log = logging.getLogger(__name__)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines that are not blank, with single blanks between their fields."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).filter("line <> ''")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of an adjacency-list file, or of a folder whose files in the order of their names make up one.

    The header is the first line of the first file, wherever Spark reads it: splits are compared by file and offset, as
    large files and splits are read first. That line alone is left out, even if a body line has the same text.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", place.alias("place")).filter(F.col("value").rlike(r"\S"))
    first = lines.agg(F.min_by(F.struct("place", "value"), "place").alias("first")).first()["first"]
    if first is None:
        empty = spark.createDataFrame([], "src bigint, dst bigint")
        return empty, vertices_of(empty)
    head, at = first["value"].split(), first["place"]
    n = int(head[0])
    numbers = F.transform(F.array_remove(F.split("value", r"\s+"), ""), lambda x: x.cast("bigint"))
    own = (F.col("place.file") == at["file"]) & (F.col("place.start") == at["start"]) & (F.col("place.at") == at["at"])
    body = lines.filter(~own).select(numbers.alias("f"))
    raw = body.select(F.col("f")[0].alias("src"), F.explode(F.slice("f", 2, 2_000_000_000)).alias("dst"))
    edges = canonical_edges(raw)
    if len(head) > 1:
        edges = stored(edges)  # they are counted here and read again by the caller
    vertices = vertices_of(edges, spark.range(n).unionByName(body.select(F.col("f")[0].alias("id"))))
    if len(head) > 1 and (found := edges.count()) != int(head[1]):
        log.warning("%s declares %s edges and has %s", path, head[1], found)
    return edges, vertices


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of an edge-list file; vertices with self-loops only are kept as isolated ones."""
    pairs = _fields(spark, path).filter(~F.col("line").startswith("#")).select(F.split("line", " ").alias("f"))
    raw = pairs.select(F.col("f")[0].cast("bigint").alias("src"), F.col("f")[1].cast("bigint").alias("dst"))
    edges = canonical_edges(raw)
    return edges, vertices_of(edges, raw.select(F.explode(F.array("src", "dst")).alias("id")))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of a file with one row of 0 and 1 a line; rows count from 0 in the order of the file.

    Lines are numbered within each split of the file; one row for each split says where it starts.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    bare = F.btrim(F.regexp_replace("value", r"[\[\],\s]+", " "))
    lines = cut(spark.read.text(path).select(bare.alias("line"), *split, F.monotonically_increasing_id().alias("at")).filter("line <> ''"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("file", "start").orderBy("at")
    rows = lines.withColumn("nth", F.row_number().over(inside) - 1).join(starts.drop("n"), ["file", "start"])
    rows = rows.select((F.col("first") + F.col("nth")).cast("bigint").alias("src"), "line")
    cells = rows.select("src", F.posexplode(F.split("line", " ")).alias("dst", "bit"))
    edges = canonical_edges(cells.filter("bit <> '0'").select("src", F.col("dst").cast("bigint").alias("dst")))
    return edges, vertices_of(edges, rows.select(F.col("src").alias("id")))


def read_pattern(lines: str) -> Pattern:
    """A pattern from the text of its file: "size type count", then "x y" lines. Type and count follow from the edges."""
    rows = [list(map(int, line.split())) for line in lines.splitlines() if line.strip()]
    return Pattern.of(rows[0][0], [(r[0], r[1]) for r in rows[1:]])


def densified(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over ids 0..n-1 in the order of the old ids, and the mapping (id, dense_id)."""
    mapping = dense_ids(vertices)
    by = lambda end: mapping.select(F.col("id").alias(end), F.col("dense_id").alias(f"new_{end}"))
    moved = edges.join(by("src"), "src").join(by("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return canonical_edges(moved), mapping


def adjacency_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, value): the body of an adjacency-list file, neighbours ascending."""
    lists = sorted_adjacency(edges, vertices)
    text = F.concat_ws(" ", F.col("u").cast("string"), F.transform("neighbours", lambda x: x.cast("string")))
    return lists.select(F.col("u").alias("id"), F.trim(text).alias("value"))


def write_adjacency(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """Sorted lines in range-partitioned files, the header as the first line of the first.

    The pairs are dealt by ranges, and each range makes its own lists: lists are neither shuffled nor built a second time to find the ranges.
    """
    spark = edges.sparkSession
    head = side_by_side(vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))).first()
    none = F.lit(None).cast("bigint")
    alone = vertices.select(F.col("id").cast("bigint").alias("u"), none.alias("v"))
    header = spark.range(1).select(F.lit(-1).cast("bigint").alias("u"), none.alias("v"))
    rows, wide = symmetric(edges).unionByName(alone).unionByName(header), width(2 * head["m"], spark)
    dealt = rows.repartitionByRange(wide, "u") if wide > partitions(spark) else rows.repartitionByRange("u")
    lists = dealt.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))
    line = F.concat_ws(" ", F.col("u").cast("string"), F.transform("neighbours", lambda x: x.cast("string")))
    value = F.when(F.col("u") == -1, F.lit(f"{head['n']} {head['m']}")).otherwise(line)
    lists.sortWithinPartitions("u").select(value.alias("value")).write.text(path)
