"""Vector operators: exact top-k, nearest-neighbour edges, means and projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .graph import checkpoint


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of the highest positive cosine with one query vector; the limit is merged from each task's first k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(F.col(id_col), cosine(F.col(vector), q).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), id_col).limit(max(1, k))


def first_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, the highest first, ties to the smaller place. Rows are partitioned; only those with ties at the k-th score are sorted."""
    if scores.shape[1] <= 2 * k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    at = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    best = np.take_along_axis(scores, at, 1)
    tied = np.flatnonzero((scores >= best.min(axis=1)[:, None]).sum(axis=1) > k)
    at = np.take_along_axis(at, np.argsort(-best, axis=1, kind="stable"), 1)
    at[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return at


def joined_places(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists a row of scores and ids, the highest score first, ties to the smaller id."""
    score, to = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    at = np.lexsort((to, -score), axis=1)[:, :k]
    return np.take_along_axis(score, at, 1), np.take_along_axis(to, at, 1)


def knn_edges(vectors: DataFrame, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """``a`` < ``b``: an undirected edge between each row and the k rows of the highest dot product, ties to the smaller id. Rows
    without an id, and vectors that are null or hold a null, take no part; where lengths differ, a missing component counts as 0. Exact: all blocks of rows meet all others, so its work
    grows with the square of the rows. Blocks are written once, as a row each, and a Cartesian product reads them again for every partition of the other side, so vectors are not copied to the
    cells; a task keeps the k best rows of the block that it is at, and puts them out when the next one comes."""
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block))
    # Floats stay floats on disk and in Arrow: half the bytes, and the same numbers once they are doubles.
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    padded = F.concat(F.col(vector).cast(f"array<{kind}>"), F.array_repeat(F.lit(0.0).cast(kind), F.lit(width) - F.size(vector)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), padded.alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("own"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        v = np.array(rows["v"].tolist(), dtype="f4" if kind == "float" else "f8")
        return pd.DataFrame({"own": [rows["own"].iloc[0]], "ids": [rows["id"].to_numpy("i8").tobytes()], "vs": [v.tobytes()]})

    packed = checkpoint(rows.groupBy("own").applyInPandas(pack, "own int, ids binary, vs binary"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, x, best = None, None, None
        read = lambda ids, vs: (np.frombuffer(ids, "i8"), np.frombuffer(vs, "f4" if kind == "float" else "f8").reshape(len(ids) // 8, width).astype("f8"))

        def found(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            seen = best[0] > -np.inf
            own = np.repeat(ids, best[0].shape[1]).reshape(best[0].shape)
            return pa.RecordBatch.from_arrays([pa.array(own[seen]), pa.array(best[1][seen]), pa.array(best[0][seen])], names=["id", "to", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, a, b, c, d = (batch.column(name)[i].as_py() for name in ("own", "ids", "vs", "other_ids", "other_vs"))
                if own != place:
                    if place is not None:
                        yield found(ids, best)
                    place, (ids, x), best = own, read(a, b), None
                to, y = read(c, d)
                parts = []
                for low in range(0, len(x), 512):
                    s = x[low : low + 512] @ y.T
                    s[ids[low : low + 512, None] == to[None, :]] = -np.inf
                    at = first_places(s, k)
                    parts.append((np.take_along_axis(s, at, 1), to[at]))
                new = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                best = new if best is None else joined_places(best, new, k)
        if place is not None:
            yield found(ids, best)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row holds two blocks
    other = packed.select(F.col("ids").alias("other_ids"), F.col("vs").alias("other_vs"))
    met = packed.hint("shuffle_replicate_nl").crossJoin(other).mapInArrow(near, "id long, to long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "to"))
    kept = met.withColumn("rn", rank).filter(F.col("rn") <= k)
    return kept.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def mean(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``dim`` from 0, ``mean``."""
    return vectors.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def min_max(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``scaled``: 0 to 1 over all rows; 0.5 where all are equal. The bounds are one row, which is broadcast."""
    bounds = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.5)
    return rows.join(F.broadcast(bounds)).withColumn("scaled", scaled).drop("_low", "_high")


def pca(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``x``, ``y``: the two first principal components, each turned so that its largest weight is positive. Vectors that are null or hold a null, and those of another
    length than the longest, have none and are left out."""
    longest = vectors.agg(F.max(F.size(vector))).first()[0]
    vectors = vectors.filter((F.size(vector) == longest) & ~F.exists(vector, lambda x: x.isNull()))
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    weights = model.pc.toArray()
    sign = [float(np.sign(weights[np.abs(weights[:, i]).argmax(), i])) for i in range(2)]
    p = vector_to_array("p")
    return model.transform(rows).select(id_col, (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))
