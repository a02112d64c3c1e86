"""Ball k-means: exact clustering of whole-number vectors.

A cluster is a ball round its centroid that reaches its farthest member. Another centroid can only win members where half
its distance is below the ball's radius: only such neighbours count. Members nearer than half the distance of the nearest
neighbour are the stable core and stay; the others lie in annuli between the half distances of successive neighbours, and
are compared with the neighbours up to their annulus alone, exactly, in whole numbers. A round is one pass over a written
table of vectors with their cluster. Balls are those of a batch's members, so that no pass for radii is needed and a radius
is the least that the batch allows. Only sums and counts by cluster leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors beyond this in any whole-number component take no part: four squared distances of 64 components stay below 2**63.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, id: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of vectors with `width` finite components."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / scale))
    rows = vectors.where(F.size(vector) == width).select(F.col(id).alias("id"), x.alias("x"))
    return rows.where(fine).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one vector, or to rows of as many."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """Centroids, and of each the other centroids by squared distance (ties by number), with these distances."""

    def __init__(self, centroids: np.ndarray):
        self.at = centroids
        between = np.array([squared(centroids, c) for c in centroids])
        self.order = np.array([[j for j in np.lexsort((np.arange(len(centroids)), row)) if j != i] for i, row in enumerate(between)], np.int64).reshape(len(centroids), -1)
        self.apart = np.take_along_axis(between, self.order, 1) if len(centroids) > 1 else np.zeros((len(centroids), 0), np.int64)

    def nearest(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances worked out) of vectors whose clusters were old; ties to the smaller number.

        A member at distance d of its centroid c stays unless some centroid e has |c - e| <= 2 d, by the triangle
        inequality; so those with |c - e|**2 > 4 d**2 are no neighbours of the ball, or of the annulus.
        """
        new, best, work = old.copy(), squared(x, self.at[old]), len(x)
        for c in np.unique(old).tolist():
            mine = np.flatnonzero(old == c)
            own = best[mine]
            neighbours = int(np.searchsorted(self.apart[c], 4 * own.max(), "right"))
            # Annulus k of a member: its first k neighbours can win it. The core is annulus 0.
            annulus = np.searchsorted(self.apart[c, :neighbours], 4 * own, "right")
            by = np.argsort(-annulus, kind="stable")
            far = np.searchsorted(-annulus[by], -np.arange(neighbours), "left")
            for k in range(neighbours):
                who = mine[by[: far[k]]]
                if not len(who):
                    break
                e = self.order[c, k]
                d = squared(x[who], self.at[e])
                work += len(who)
                won = (d < best[who]) | ((d == best[who]) & (e < new[who]))
                best[who[won]], new[who[won]] = d[won], e
        return new, best, work


def _blobs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, v, cluster, distance): vectors as bytes of 32-bit numbers, in cluster 0 before any round."""
    for batch in batches:
        lists = batch.column("v")
        v = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int32)
        n = len(lists)
        blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width * 4).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), blob, pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], names=["id", "v", "cluster", "distance", "sums"])


def _round(batches: Iterator[pa.RecordBatch], balls: Balls, width: int) -> Iterator[pa.RecordBatch]:
    """Assigns the vectors again; the task's sums, counts and inertia by cluster ride along as one row."""
    k = len(balls.at)
    total, kind = np.zeros((k, width + 2), np.int64), None
    for batch in batches:
        kind = batch.column("id").type
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            blob = part.column("v")
            x = np.frombuffer(b"".join(blob.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
            new, distance, _ = balls.nearest(x, part.column("cluster").to_numpy().astype(np.int64))
            order = np.argsort(new, kind="stable")
            present, first = np.unique(new[order], return_index=True)
            total[present, :width] += np.add.reduceat(x[order], first)
            total[:, width] += np.bincount(new, minlength=k)
            total[present, width + 1] += np.add.reduceat(distance[order], first)
            yield pa.RecordBatch.from_arrays([part.column("id"), blob, pa.array(new.astype(np.int32)), pa.array(distance), pa.nulls(len(new), pa.binary())], names=["id", "v", "cluster", "distance", "sums"])
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["id", "v", "cluster", "distance", "sums"])


def _cells(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """(cluster, cell, s) of the tasks' rows of sums."""
    for batch in batches:
        for row in batch.column("sums"):
            total = np.frombuffer(row.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), width + 2)), pa.array(np.tile(np.arange(width + 2), k)), pa.array(total)], names=["cluster", "cell", "s"])


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """((id, v, cluster, distance) of every vector that takes part, and centroid, count and inertia of each cluster).

    Vectors that are null, have other than `width` components, or null or non-finite ones, take no part, nor do those with a
    component of LARGEST / scale or more in size, whose squared distances could leave 64 bits. Centroids start as the vectors
    of the smallest SHA-256 of `seed:id` (null ids last), of equal ids by their components; repeated rows are vectors each,
    also as first centroids. Ties go to the smaller cluster; empty clusters stay where they are. With fewer vectors than
    clusters there are as many clusters as vectors; an empty table gives no rows and no clusters.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "balls")
    rows = quantised(vectors, id, vector, width, scale)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), []
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    schema = T.StructType([rows.schema["id"], T.StructField("v", T.BinaryType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("sums", T.BinaryType())])
    schema["id"].nullable = True
    now = rows.mapInArrow(lambda b: _blobs(b, width), schema)
    for r in range(rounds + 1):
        balls = Balls(centroids)
        now = scratch.put(now.where("v is not null").mapInArrow(lambda b, balls=balls: _round(b, balls, width), schema), f"round{r}")
        scratch.drop(f"round{r - 1}")
        # Sums of 64 bits in a task; of all tasks in decimals.
        cells = now.where("sums is not null").select("sums").mapInArrow(lambda b: _cells(b, k, width), "cluster long, cell long, s long")
        total = np.zeros((k, width + 2), object)
        for c in cells.groupBy("cluster", "cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # one row per cluster and component
            total[c.cluster, c.cell] = int(c.s)
        if r < rounds:
            centroids = np.array([[int(x) // int(t[width]) for x in t[:width]] if t[width] else c for t, c in zip(total, centroids.tolist())], np.int64)
    facts = [{"centroid": c, "count": int(t[width]), "inertia": int(t[width + 1])} for c, t in zip(centroids.tolist(), total)]
    return now.where("v is not null").drop("sums"), facts


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_balls: the contract's columns for every vector that takes part."""
    found, facts = cluster(table(spark, sf_dir, "embeddings"))
    inertia = sum(f["inertia"] for f in facts)

    def pick(values: list, kind: str):
        out = F.lit(None).cast(kind)
        for c, v in enumerate(values):
            out = F.when(F.col("cluster") == c, F.lit(v).cast(kind)).otherwise(out)
        return out

    digest = [hashlib.sha256(",".join(map(str, f["centroid"])).encode()).hexdigest() for f in facts]
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", pick([f["inertia"] for f in facts], "long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), pick(digest, "string").alias("centroid_sha256"))


def _sql() -> str:
    rounds = [
        f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c.cluster, struct_pack(d := d, n := c.cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.*, c.cluster, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i]))) AS d FROM k, c{r} c) c GROUP BY vec_id, v, place),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(q ORDER BY i) AS m FROM
  (SELECT cluster, i, CAST(floor_div(s, n) AS BIGINT) AS q FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i)) GROUP BY cluster) USING (cluster)),
"""
        for r in range(ROUNDS)
    ]
    last = f"""a{ROUNDS} AS MATERIALIZED (SELECT vec_id, arg_min(c.cluster, struct_pack(d := d, n := c.cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.*, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i]))) AS d FROM k, c{ROUNDS} c) c GROUP BY vec_id, v, place)
"""
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS place FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v AS c FROM k QUALIFY cluster < {CLUSTERS}),
{"".join(rounds).replace("floor_div(s, n)", "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END")}{last}SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""


OP13_SQL = _sql()
