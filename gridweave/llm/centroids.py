"""Operator 13: clusters around moving centroids, in exact whole numbers, scanning only vectors whose cluster is in doubt.

Each vector keeps its cluster and a lower bound of its distance to every other centroid. When centroids move, the
members of cluster i lie in a sphere around its former centroid, whose radius one aggregation gives. In the plane through
the sphere's centre and the two places of another centroid, d apart, a point seen from their midpoint under the angle
phi to the drift comes nearer by at most d cos(phi) (it lies inside the asymptotes of a hyperbola with the two places as
foci), so the least angle of the sphere's circle bounds the loss of all members: less than d, and nothing for a
centroid that moves away. Vectors whose exact distance to their own centroid stays below the loosened bound keep their
cluster; all others are scanned exactly. Bounds have a margin for rounding; distances are exact.

A round writes the vectors with their state to the shared folder and aggregates them to a row a cluster, which is all
that comes to the driver.

Defined results: vectors of another length, with a null or a component that is not finite, or with one of LARGEST or
more after scaling (its squared distance would not fit a long) are left out; repeated rows are vectors each; null ids
are started from last; fewer vectors than centroids start as many centroids as there are; an empty table gives no row; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.shared import stored

LARGEST = 1 << 27
FLOAT_EXACT = 1 << 22  #: below this, products and sums of 64 components are exact in doubles
MARGIN = 1e-9


def whole_vectors(rows: DataFrame, dims: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v array<int>: floor(scale * x) of every component."""
    v = F.transform(vector, lambda x: F.lit(scale) * x.cast("double"))
    d = rows.select(F.col(key).alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return d.where((F.size("v") == dims) & ~bad).select("vec_id", F.transform("v", lambda x: F.floor(x).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The vectors with the k smallest hashes of seed:vec_id; equal ids by their components."""
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    first = vectors.orderBy(F.sha2(text, 256).asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in first.collect()]  # k rows


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < FLOAT_EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster (the smallest number of equals), its squared distance, and the distance to the nearest other centroid."""
    d = squared(x, c)
    own = d.argmin(axis=1)
    at = np.arange(len(d))
    best = d[at, own]
    d[at, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if c.shape[0] > 1 else np.full(len(d), np.inf)
    return own.astype(np.int32), best, second


def assigned(state: DataFrame, centroids: list[list[int]], loosened: list[float] | None = None) -> DataFrame:
    """vec_id, v, cluster, distance, lower, scanned. ``loosened``: by how much bounds of each cluster's members fall;
    without it ``state`` has only vec_id and v and all are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, c.shape[1])
            if loosened is None:
                cluster, distance, lower = scan(x, c)
                doubt = np.ones(n, bool)
            else:
                cluster = batch.column("cluster").to_numpy().copy()
                lower = batch.column("lower").to_numpy() - np.array(loosened)[cluster]
                distance = ((x.astype(np.int64) - c[cluster]) ** 2).sum(1)
                far = np.sqrt(distance.astype(np.float64))
                doubt = far + MARGIN * (far + np.abs(np.where(np.isinf(lower), 0, lower)) + 1) >= lower
                if doubt.any():
                    cluster[doubt], distance[doubt], lower[doubt] = scan(x[doubt], c)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(distance), pa.array(lower), pa.array(doubt)], names)

    names = ["vec_id", "v", "cluster", "distance", "lower", "scanned"]
    schema = T.StructType([state.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType())), *(T.StructField(n, t) for n, t in zip(names[2:], (T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return state.select("vec_id", "v", *(["cluster", "lower"] if loosened is not None else [])).mapInArrow(run, schema)


def loosening(old: list[list[int]], new: list[list[int]], radius: list[float]) -> list[float]:
    """For each cluster the most that another centroid can have come nearer to any of its members."""
    a, b = np.array(old, np.float64), np.array(new, np.float64)
    out = []
    for i, r in enumerate(radius):
        most = 0.0
        for j in range(len(a)):
            drift = b[j] - a[j]
            d = float(np.linalg.norm(drift))
            if j == i or d == 0:
                continue
            off = a[i] - (a[j] + b[j]) / 2
            away = float(np.linalg.norm(off))
            r_ = r * (1 + MARGIN) + MARGIN
            near = 0.0 if away <= r_ else math.acos(max(-1.0, min(1.0, float(off @ drift) / (away * d)))) - math.asin(r_ / away)
            most = max(most, d * math.cos(max(0.0, near)) if near < math.pi / 2 else 0.0)
        out.append(most * (1 + MARGIN) + MARGIN if most else 0.0)
    return out


def moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[float]]:
    """The centroids' new places, floor(sum / count) of their members, and the radii around the former ones."""
    dims = len(centroids[0])
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(dims))).alias("sums"))
    new, radius = [list(c) for c in centroids], [0.0] * len(centroids)
    for r in sums.collect():  # a row a cluster
        new[r.cluster] = [s // r.n for s in r.sums]
        radius[r.cluster] = math.sqrt(r.far)
    return new, radius


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, v, cluster, distance, lower, scanned after ``rounds`` moves of the centroids, and these."""
    centroids = starts(vectors, k, seed)
    if not centroids:
        return assigned(vectors, [[0]]), []
    state = stored(assigned(vectors, centroids), "clusters")
    for _ in range(rounds):
        new, radius = moved(state, centroids)
        state, centroids = stored(assigned(state, new, loosening(centroids, new, radius)), "clusters"), new
    return state, centroids


def described(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    sums = {r.cluster: r.t for r in state.groupBy("cluster").agg(F.sum("distance").alias("t")).collect()} if centroids else {}  # a row a cluster
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    squares = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    ctes = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM kept QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS (SELECT vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, v, k, {squares} AS d FROM kept, c{i}) GROUP BY vec_id)")
        mean = f"(SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i)"
        ctes.append(f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS c FROM {mean} GROUP BY k)")
        ctes.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"""WITH {", ".join(ctes[:-2])}, t AS (SELECT k, sum(d)::BIGINT AS t FROM a{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM t) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN t USING (k) JOIN c{rounds} USING (k)"""


ORACLE = _oracle()
