"""Cluster vectors around centroids with sort-means, in exact integers.

Each round orders, for every centroid, the other centroids by their distance
from it. A vector is compared with its centroid of the round before, then with
the others in that order; the scan stops strictly beyond twice the current
distance, since no farther centroid can be as near (strictly, so that ties
still go to the smaller number). Distances are squared and integer, so "twice"
is a factor of four and nothing is rounded.

The vectors stay where they are. A round is a map over them that carries the
assignment along, and a sum by centroid and component, of which each task
ships one row for each pair at most. A round's table is cached and the one
before is let go; if an executor is lost, Spark maps its part again from the
written vectors. The driver holds the centroids only.

Edge cases: vectors that are null, have another number of components or hold
null or non-finite ones are left out; a null id counts as empty text where the
first centroids are chosen, and ids may repeat: of equal hashes the smaller
vector comes first, and each row is a vector of its own. With fewer vectors
than centroids there are fewer centroids. Scaled components beyond 2^26 are
reckoned with Python's integers, beyond 1e27 they are an error, and a distance
or sum beyond a long is given as the largest long. Columns of vectors may have
any names; without vectors the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from quire.llm.common import checkpointed

#: Integers up to SMALL are reckoned in 64 bits, where squared distances of some hundred components fit.
SMALL, LARGEST, LONG = 1 << 26, 1e27, (1 << 63) - 1


def rounded_down(x: Column) -> Column:
    """A double's floor as a double; from 2^52 on all are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def scaled_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the sound vectors: their components times scale, rounded down, as doubles."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return named.filter((F.size("v") == dim) & sound).select("vec_id", F.transform("v", lambda c: rounded_down(c * F.lit(float(scale)))).alias("v"))


def integers(flat: np.ndarray, dim: int) -> np.ndarray:
    """Whole doubles as a row for each vector: 64-bit integers, or Python's where these are too small."""
    x = flat.reshape(-1, dim)
    most = np.abs(x).max(initial=0)
    if most > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST:g}")
    return x.astype(np.int64) if most <= SMALL else np.array([[int(c) for c in row] for row in x], object).reshape(-1, dim)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, of equals the smaller number, and its squared distance; before: where its scan begins."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    current = ((x - centroids[before]) ** 2).sum(axis=1)
    best, distance = before.copy(), current.copy()
    for a in np.unique(before):
        live = np.flatnonzero(before == a)
        for j in sorted((j for j in range(len(centroids)) if j != a), key=lambda j: between[a, j]):
            live = live[(between[a, j] <= 4 * current[live]).astype(bool)]
            if not len(live):
                break
            other = ((x[live] - centroids[j]) ** 2).sum(axis=1)
            nearer = ((other < distance[live]) | ((other == distance[live]) & (j < best[live]))).astype(bool)
            best[live[nearer]], distance[live[nearer]] = j, other[nearer]
    return best, distance


def _arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return integers(batch.column(1).flatten().to_numpy(zero_copy_only=False), dim), batch.column(2).to_numpy(zero_copy_only=False)


def assigned(state: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """state (vec_id, v, cluster) with each vector's cluster renewed, and its distance."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, before = _arrays(batch, dim)
            wide = x.dtype == object or max(abs(c) for row in centroids for c in row) > SMALL
            cluster, distance = nearest(x.astype(object) if wide else x, before, np.array(centroids, object if wide else np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array([min(d, LONG) for d in distance] if wide else distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    fields = [state.schema["vec_id"], StructField("v", ArrayType(DoubleType())), StructField("cluster", IntegerType()), StructField("distance", LongType())]
    return state.select("vec_id", "v", "cluster").mapInArrow(scan, StructType(fields))


def component_sums(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, pos, total) summed over all vectors; pos dim is the number of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            x, cluster = _arrays(batch, dim)
            for k in np.unique(cluster).tolist():
                own = x[cluster == k]
                row = [*map(int, own.sum(axis=0)), len(own)]
                held[k] = [a + b for a, b in zip(held[k], row, strict=True)] if k in held else row
        rows = [(k, i, Decimal(t)) for k, sums in held.items() for i, t in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))], ["cluster", "pos", "total"])

    kinds = StructType([StructField("cluster", IntegerType()), StructField("pos", IntegerType()), StructField("total", DecimalType(38, 0))])
    return state.select("vec_id", "v", "cluster").mapInArrow(partial, kinds).groupBy("cluster", "pos").agg(F.sum("total").alias("total"))


def moved(centroids: list[list[int]], sums: DataFrame, dim: int) -> list[list[int]]:
    """The centroids at the floor of their vectors' means; those without vectors stay. Collects a row for each centroid and component."""
    total = {(r.cluster, r.pos): int(r.total) for r in sums.collect()}
    return [[total[k, i] // total[k, dim] for i in range(dim)] if (k, dim) in total else c for k, c in enumerate(centroids)]


def sort_means(
    vectors: DataFrame, n_clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per sound vector: its cluster, squared distance, the sums of these over its cluster and over all, and a digest of the final centroid."""
    spark = vectors.sparkSession
    held = checkpointed(scaled_vectors(vectors, dim, scale, id_col, vector_col).withColumn("cluster", F.lit(0)))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = held.select("v", hashed.alias("hash")).orderBy("hash", "v").limit(n_clusters).collect()
    centroids = [list(map(int, integers(np.array(r.v, np.float64), dim)[0])) for r in first]
    state = held
    for _ in range(rounds if centroids else 0):
        fresh = assigned(state, centroids, dim).persist()
        after = moved(centroids, component_sums(fresh, dim), dim)
        if state is not held:
            state.unpersist()
        state, settled, centroids = fresh, after == centroids, after
        if settled:
            # further rounds would change nothing
            break
    last = checkpointed(assigned(state, centroids, dim).select("vec_id", "cluster", "distance")) if centroids else held.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"))
    if state is not held:
        state.unpersist()
    inertia = {r.cluster: int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    known = [(k, min(inertia.get(k, 0), LONG), min(sum(inertia.values()), LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each centroid
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
