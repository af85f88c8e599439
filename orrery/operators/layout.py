"""A map of vectors: points in the plane by their two principal components, links to their nearest neighbours, and a legend of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from . import vectors as V

#: Folders of a legend; above so many points each has two neighbours instead of three (fixed values).
LEGEND, MANY = 12, 2000


def placed(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``x``, ``y`` from 0 to 1: the first two principal components of the centred vectors, scaled; 0.5 where all are equal. Centring moves all points
    alike, so scaling takes it away. Vectors that are null, hold a null or have another length than the longest are left out."""
    rows = V.pca(vectors, id_col, vector)
    for axis in ("x", "y"):
        rows = V.min_max(rows, axis).drop(axis).withColumnRenamed("scaled", axis)
    return rows.select(F.col(id_col).alias("id"), "x", "y")


def colour(place: Column, of: Column) -> Column:
    """The colour of the ``place``-th of so many hues around the circle, as ``#rrggbb``: full, and a little dimmed where two channels meet."""
    hue = F.pmod(place * 6.0 / F.greatest(of, F.lit(1)), F.lit(6.0))
    # Each channel is full on a third of the circle and fades over a sixth on either side.
    channel = lambda at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 - F.least(F.abs(hue - at), 6.0 - F.abs(hue - at))))
    two = lambda c: F.lower(F.lpad(F.hex(F.round(channel(c) * 255).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), two(0.0), two(2.0), two(4.0))


def legend(points: DataFrame, most: int = LEGEND) -> DataFrame:
    """points: ``path``. ``name``, ``count``, ``colour`` of the folders that hold the most points; ties go to the lesser name."""
    sums = points.groupBy(C.folder(F.translate("path", "\\", "/")).alias("name")).agg(F.count("*").alias("count"))
    total = sums.agg(F.count("*").alias("_total"))
    first = sums.orderBy(F.desc("count"), "name").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("count"), "name")) - 1  # ``most`` rows
    return first.withColumn("_place", place).join(F.broadcast(total)).select("name", "count", colour(F.col("_place"), F.col("_total")).alias("colour"))  # one row


def vector_map(points: DataFrame, neighbours: int | None = None, id_col: str = "id", vector: str = "vector") -> tuple[DataFrame, DataFrame, DataFrame]:
    """points: an id, ``path``, ``kind``, ``symbol``, ``start_line``, ``end_line`` and a vector. Nodes (with ``x``, ``y``, ``folder``), edges (``a``, ``b``, each once) and the legend."""
    at = placed(points, id_col, vector)
    nodes = points.select(F.col(id_col).alias("id"), "path", C.folder(F.translate("path", "\\", "/")).alias("folder"), "kind", "symbol", "start_line", "end_line").join(at, "id")
    if neighbours is None:
        neighbours = 2 if nodes.limit(MANY + 1).count() > MANY else 3
    edges = V.knn_edges(points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), neighbours, "id", "v")
    return nodes, edges, legend(nodes)


def map_payload(nodes: DataFrame, edges: DataFrame, folders: DataFrame, vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """A map as rows of JSON, one a node and one an edge, behind one that says how many there are, the vectors' length and the legend: ``kind``, ``json``."""
    size = vectors.agg(F.max(F.size(vector)).alias("dimension"))
    counts = nodes.agg(F.count("*").alias("count")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(size)).join(F.broadcast(folders.agg(F.sort_array(F.collect_list(F.struct(F.negative("count").alias("n"), "name", "count", "colour"))).alias("l"))))  # one row each
    head = counts.select(F.lit("map").alias("kind"), F.to_json(F.struct("count", "edges", F.coalesce("dimension", F.lit(0)).alias("dimension"), F.transform("l", lambda f: f.dropFields("n")).alias("folders"))).alias("json"))
    return head.unionByName(nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.array("a", "b")).alias("json")))
