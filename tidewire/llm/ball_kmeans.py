"""Centroid clustering by ball k-means (11).

A cluster is a ball: its centroid, and a radius that no member lies beyond.  After a round the radius known from it grows
by the way the centroid has moved.  Only centroids within twice the radius are neighbours of a ball; a member that is nearer to its
centroid than half the way to the nearest neighbour lies in the stable core and stays; any other lies in an annulus, and
is compared exactly with the neighbours within twice its own distance, no others.  A centroid further away cannot be as
near, ties included, so the result is that of exhaustive comparison.

Vectors are integers, floor(256 x); all arithmetic on them is exact.  The first round compares all centroids.  Rounds are
written as Parquet in the shared folder, and what a round leaves behind is removed once the next one is written; sums are
combined before the shuffle, so a cluster of most rows costs no more than others.  The driver holds the centroids only.

Odd input: vectors that are null, of another length than ``size``, or with a null or non-finite component are left out;
components beyond ±2^27 (x beyond ±524,288) count as that, as squared distances would not fit a long; repeated rows are
clustered each; ties among starting vectors of one id go to the least vector; fewer vectors than ``k`` give as many
clusters as there are vectors; an empty table gives no row.  A sum that does not fit a long is null.  Columns other than vec_id and
embedding do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, map_rows, remove_dir, table

SIZE, K, ROUNDS, SCALE, LARGEST = 64, 40, 5, 256, 1 << 27
_STATE = "vec_id long, v array<int>, cluster int, distance long"


def kept_vectors(embeddings: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v): vectors of the wanted size without null or non-finite components, as integers."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == size)
    finite = own.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.lit(-1.0 * LARGEST), F.least(F.lit(1.0 * LARGEST), x * SCALE))).cast("int"))
    return finite.select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (vectors * vectors).sum(1)[:, None] - 2 * (vectors @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and the squared distance; all are compared."""
    found, best = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for start in range(0, len(vectors), 4096):
        d = _distances(vectors[start : start + 4096], centroids)
        found[start : start + 4096] = d.argmin(1)
        best[start : start + 4096] = d.min(1)
    return found, best


def neighbours(centroids: np.ndarray, radii: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball, the numbers of the centroids within twice its radius and their squared distances, nearest first."""
    between = _distances(centroids, centroids)
    out = []
    for i, radius in enumerate(radii):
        near = [j for j in range(len(centroids)) if j != i and math.sqrt(float(between[i, j])) <= 2 * radius * (1 + 1e-9) + 1]
        near = np.array(sorted(near, key=lambda j: (between[i, j], j)), np.int64)
        out.append((near, between[i, near]))
    return out


def reassigned(vectors: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """nearest() through the balls that ``cluster`` names: the core stays, annuli are compared with the neighbours in reach."""
    own = vectors - centroids[cluster]
    found, best = cluster.copy(), (own * own).sum(1)
    for i in np.unique(cluster):
        others, between = near[i]
        members = np.flatnonzero(cluster == i)
        # a centroid at most twice as far from this one as the member can be as near to the member
        reach = np.searchsorted(between, 4 * best[members], side="right")
        for annulus in np.unique(reach[reach > 0]):
            ring = members[reach == annulus]
            compared = np.sort(np.append(others[:annulus], i))
            f, d = nearest(vectors[ring], centroids[compared])
            found[ring], best[ring] = compared[f], d
    return found, best


def _assigned(rows: DataFrame, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    size = centroids.shape[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch["v"], size)
        cluster, distance = nearest(vectors, centroids) if near is None else reassigned(vectors, batch["cluster"].to_numpy().astype(np.int64), centroids, near)
        return pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return map_rows(rows, run, _STATE)


def ball_kmeans(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every kept vector after so many rounds, and the centroids they were assigned to."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, size)
    start = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, size)
    if not len(centroids):
        return spark.createDataFrame([], _STATE), centroids
    rows, near, before = vectors, None, None
    for done in range(rounds + 1):
        path = fresh_dir(spark, "balls")
        _assigned(rows, centroids, near).write.parquet(path)
        if before:
            remove_dir(spark, before)
        rows, before = spark.read.schema(_STATE).parquet(path), path
        if done == rounds:
            break
        measures = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)]
        balls = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *measures).collect()
        moved, radii = centroids.copy(), [0.0] * len(centroids)
        for ball in balls:
            i = ball["cluster"]
            moved[i] = [ball[f"s{j}"] // ball["n"] for j in range(size)]
            way = moved[i] - centroids[i]
            radii[i] = math.sqrt(float(ball["far"])) + math.sqrt(float((way * way).sum()))
        centroids, near = moved, neighbours(moved, radii)
    return rows, centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = ball_kmeans(table(spark, sf_dir, "embeddings"))
    own = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = own.agg(F.try_sum("cluster_inertia").alias("inertia"))
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per_cluster = own.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(total))  # as many rows as centroids, and one
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """Assignment n and the centroids after it."""
    return f"""a{n} AS (SELECT id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, v, c, list_dot_product(v, v) - 2 * list_dot_product(v, cv) + list_dot_product(cv, cv) AS d FROM e, c{n}) GROUP BY id, v),
m{n} AS (SELECT c, list(f ORDER BY i) AS cv FROM (SELECT c, i, floor(sum(x) / count(*)) AS f FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m.cv, p.cv) AS cv FROM c{n} p LEFT JOIN m{n} m USING (c)),"""


#: Exact while components stay small, as doubles hold their sums of squares.
OP11_SQL = f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || id)) - 1 AS c, v AS cv FROM e ORDER BY sha256('2:' || id) LIMIT {K}),
{"".join(_round_sql(n) for n in range(ROUNDS))}
z AS (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, c, list_dot_product(v, v) - 2 * list_dot_product(v, cv) + list_dot_product(cv, cv) AS d FROM e, c{ROUNDS}) GROUP BY id)
SELECT id AS vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(cv, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} USING (c)"""
