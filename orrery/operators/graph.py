"""Property-graph operators over edge tables; iterations are cut by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names. Only a local session may go without that setting; it gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/orrery-{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder that ``spark.checkpoint.dir`` names and reads it again: lineage is cut, the rows outlive lost executors, and sizes are
    those of the files (a checkpoint keeps the estimates of its plan, which grow with every round of an iteration)."""
    path = scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Bundles:
    """Edges by shared keys: from each row of ``sources`` (``a``, ``key``) to each row of ``targets`` (``key``, ``b``) of its key, but for loops. Both are distinct and grow with the nodes' keys,
    where the edges grow with the square of a key's rows; so degrees, hops and components are found without them, and :func:`expanded` puts them out."""

    sources: DataFrame
    targets: DataFrame


def classes(rows: DataFrame, node: str) -> DataFrame:
    """rows: ``node``, ``key``. ``node``, ``class``: nodes of the same set of keys share a class, named by the least of them."""
    sets = rows.groupBy(F.col(node).alias("node")).agg(F.sort_array(F.collect_set("key")).alias("_keys"))
    named = sets.groupBy("_keys").agg(F.min("node").alias("class"))
    return sets.join(named, "_keys").select("node", "class")


def class_links(bundles: Bundles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of sources and of targets, and which of them (``c``, ``d``) an edge links, each pair once. Keys of one side only are left out."""
    source = checkpoint(bundles.sources.join(bundles.targets.select("key").distinct(), "key", "left_semi"))
    target = checkpoint(bundles.targets.join(bundles.sources.select("key").distinct(), "key", "left_semi"))
    left, right = checkpoint(classes(source, "a")), checkpoint(classes(target, "b"))
    keys = lambda rows, node, class_, name: rows.join(class_.filter("node = class").select(F.col("node").alias(node)), node).select("key", F.col(node).alias(name))  # noqa: E731 - a class has its first node's keys
    return left, right, checkpoint(keys(source, "a", left, "c").join(keys(target, "b", right, "d"), "key").select("c", "d").distinct())


def expanded(bundles: Bundles, block: int = 4096) -> DataFrame:
    """``a``, ``b``: every edge once. Classes meet by pairs, so that no edge comes twice and none is shuffled; the members of a class are dealt in blocks, and each pair of blocks is a
    task's group."""
    left, right, links = class_links(bundles)
    # A node is in one class of either side, so (a, b) belongs to one pair of classes.
    dealt = lambda rows, node, name: rows.select(F.col("node").alias(node), F.col("class").alias(name))
    sizes = lambda rows, name, n: rows.groupBy(F.col("class").alias(name)).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    pairs = checkpoint(links.join(sizes(left, "c", "_m"), "c").join(sizes(right, "d", "_n"), "d"))
    return crossed(dealt(left, "a", "c").join(pairs, "c"), dealt(right, "b", "d").join(pairs, "d"), ["c", "d"]).filter("a <> b").select("a", "b")


def crossed(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Joins ``a`` of left and ``b`` of right on keys that many rows share. Both have ``_m`` and ``_n``, the blocks of their key's left and right rows: a row goes to all cells of its block."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # An explicit number of partitions, since cells are small beside what they put out and would be put together by their size.
    left = left.withColumn("_i", F.pmod(F.xxhash64("a"), F.col("_m")).cast("int")).withColumn("_j", every("_n")).drop("_m", "_n").repartition(parts, *on, "_i", "_j")
    right = right.withColumn("_j", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int")).withColumn("_i", every("_m")).drop("_m", "_n").repartition(parts, *on, "_i", "_j")
    return left.hint("merge").join(right, [*on, "_i", "_j"])


def both_ways(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: each undirected edge in both directions, without loops."""
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def degree(edges: DataFrame | Bundles) -> DataFrame:
    """Edges at either end of each node."""
    if isinstance(edges, Bundles):
        left, right, links = class_links(edges)
        sized = lambda rows, name: rows.groupBy(F.col("class").alias(name)).agg(F.count("*").alias("n"))
        out = links.join(sized(right, "d"), "d").groupBy(F.col("c").alias("class")).agg(F.sum("n").alias("n"))
        into = links.join(sized(left, "c"), "c").groupBy(F.col("d").alias("class")).agg(F.sum("n").alias("n"))
        # A node that meets itself by a key was counted as its own neighbour, at both ends.
        loops = edges.sources.join(edges.targets.withColumnRenamed("b", "a"), ["a", "key"]).select(F.col("a").alias("node")).distinct().withColumn("n", F.lit(-2).cast("long"))
        ends = left.join(out, "class").select("node", "n").union(right.join(into, "class").select("node", "n")).union(loops)
        return ends.groupBy("node").agg(F.sum("n").alias("degree")).filter("degree > 0")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, files: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """files: ``node``, ``path``. The node of the highest degree of each path, the best ``most`` of them."""
    found = degree(edges).filter(F.col("degree") >= least).join(files, "node")
    first = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("degree"), "node"))
    return found.withColumn("rn", first).filter("rn = 1").drop("rn").orderBy(F.desc("degree"), "path").limit(most)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: ``node``. Nodes outside the seeds with an edge to one."""
    near = both_ways(edges).join(seeds.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
    return near.join(seeds.select("node"), "node", "left_anti")


def beside(edges: DataFrame | Bundles) -> Callable[[DataFrame], DataFrame]:
    """A function from ``node`` to ``node``: the other ends of the nodes' edges, each once; of bundles also a node itself, if it meets itself by a key."""
    if isinstance(edges, Bundles):
        source, target = checkpoint(edges.sources), checkpoint(edges.targets)

        def step(front: DataFrame) -> DataFrame:
            asked = source.join(front.select(F.col("node").alias("a")), "a", "left_semi").select("key").distinct()
            given = target.join(front.select(F.col("node").alias("b")), "b", "left_semi").select("key").distinct()
            there, back = target.join(asked, "key", "left_semi"), source.join(given, "key", "left_semi")
            return there.select(F.col("b").alias("node")).union(back.select(F.col("a").alias("node"))).distinct()

        return step
    near = checkpoint(both_ways(edges))
    return lambda front: near.join(front.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()


def hops(edges: DataFrame | Bundles, seeds: DataFrame, most: int) -> DataFrame:
    """``node``, ``hop``: the least number of edges from a seed, ``most`` at most; seeds are left out."""
    near = beside(edges)
    seen = checkpoint(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, most + 1):
        front = near(front).join(seen, "node", "left_anti")
        front = checkpoint(front.withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
    return seen.filter("hop > 0")


def traverse(edges: DataFrame | Bundles, seeds: DataFrame, most_hops: int = 3, most: int | None = 18) -> DataFrame:
    """``node``, ``hop``, ``score``: breadth first, max(.55, .92 - .12 hop), the nearest ``most`` nodes by hop and node."""
    found = hops(edges, seeds, most_hops).withColumn("score", F.greatest(F.lit(0.55), F.lit(0.92) - F.lit(0.12) * F.col("hop")))
    return found if most is None else found.orderBy("hop", "node").limit(most)


def spanning(bundles: Bundles) -> DataFrame:
    """``a``, ``b``: edges that connect what the bundles connect, one a row: where a key has both sources and targets, all of them are connected (each source to each target), here through the
    least of them."""
    sides = bundles.sources.select("key", F.col("a").alias("node"), F.lit(1).alias("s")).union(bundles.targets.select("key", F.col("b").alias("node"), F.lit(2).alias("s")))
    first = sides.groupBy("key").agg(F.min("node").alias("b"), F.min("s").alias("low"), F.max("s").alias("high")).filter("low < high").select("key", "b")
    return sides.join(first, "key").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def components(edges: DataFrame | Bundles, nodes: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least node). Labels spread along edges, a label's own node takes the least that any node of that label has met, and all jump twice towards their
    root's label, until nothing changes: groups that touch merge at once, so rounds grow with the logarithm of a chain's length."""
    near = checkpoint(both_ways(spanning(edges) if isinstance(edges, Bundles) else edges))
    state = checkpoint(near.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        seen = near.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = checkpoint(state.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component")))
        met = step.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("met"))
        step = checkpoint(step.join(met, "node", "left").select("node", "old", F.least("component", "met").alias("component")))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        far = step.select(F.col("node").alias("root"), F.col("component").alias("top"))
        new = checkpoint(step.join(up, "component").join(far, "root").select("node", "old", F.least("component", "root", "top").alias("component")))
        state = new.select("node", "component")
        if not new.filter("old <> component").limit(1).count():
            break
    return nodes.select("node").distinct().join(state, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def communities(edges: DataFrame, nodes: DataFrame, layer: Column, most: int = 24) -> DataFrame:
    """nodes: ``node`` and what ``layer`` reads. The largest components with their size and most frequent layer."""
    member = components(edges, nodes).join(nodes.select("node", layer.alias("layer")), "node")
    counts = member.groupBy("component", "layer").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "layer"))
    top = counts.withColumn("rn", first)
    out = top.groupBy("component").agg(F.sum("n").alias("size"), F.max(F.when(F.col("rn") == 1, F.col("layer"))).alias("dominant"))
    return out.orderBy(F.desc("size"), "component").limit(most)


def subgraph(edges: DataFrame, most: int = 800) -> DataFrame:
    """Edges between the ``most`` nodes of the highest degree."""
    top = degree(edges).orderBy(F.desc("degree"), "node").limit(most).select("node")
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """rows: ``seq``, ``id``, ``type``, ``label``, ``path``. Of each id the first type and label, and the last path that isn't blank."""
    path = F.max_by("path", F.when(F.trim(F.coalesce("path", F.lit(""))) != "", F.col("seq")))
    return rows.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min_by("label", "seq").alias("label"), path.alias("path"))


def add_edges(rows: DataFrame) -> DataFrame:
    """rows: ``a``, ``b``, ``type``. Without loops, blank ends and repeats."""
    return rows.filter("a is not null and b is not null and a <> b").dropDuplicates(["a", "b", "type"])


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points: ``file``, ``line``; spans: ``file``, ``symbol``, ``start_line``, ``end_line``. The narrowest span around each point."""
    joined = points.join(spans, "file").filter("line between start_line and end_line")
    narrow = F.row_number().over(Window.partitionBy("file", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "symbol"))
    return joined.withColumn("rn", narrow).filter("rn = 1").select("file", "line", "symbol")
