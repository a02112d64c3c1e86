"""Exact top-k by inner product.

Vectors are packed into chunks by descending length. Their second-moment matrix gives a rotation that puts most of
the length into the leading coordinates (the right singular vectors of all vectors). A chunk meets the queries with
the partial sums of those coordinates; Cauchy-Schwarz bounds the rest by the product of the residual lengths. Only
pairs whose bound reaches the query's k-th best score so far are computed in full, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Scratch, parts, table

SCALE, EVERY, K = 256, 50, 5
#: Vectors of a chunk, queries that one pass broadcasts, leading coordinates of the partial sums.
CHUNK, QUERIES, LEAD = 4096, 65536, 16
#: Bytes of queries that one pass broadcasts at most, which a worker holds three times.
QUERY_BYTES = 32 << 20
#: Below any score.
NONE = -(2**62)
RESULT = "query bigint, query_id bigint, id bigint, score bigint"


def quantise(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows that are null or hold null or non-finite ones are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), x.alias("x"), good.alias("good"))
    return rows.where("good").select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, filled up with zeros to one width."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(offsets)
    if len(column) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] : offsets[-1]]
    return out


def _blobs(batches, width: int, size: int):
    """Packs rows, in their order, into chunks of `size`: ids and vectors as bytes."""
    for batch in batches:
        v, ids = _matrix(batch.column("v"), width), batch.column("id")
        for i in range(0, len(v), size):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + size].to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([v[i : i + size].tobytes()], pa.binary())], names=["ids", "vs"])


def _second_moments(batches, width: int):
    total = np.zeros((width, width))
    for batch in batches:
        for vs in batch.column("vs"):
            x = np.frombuffer(vs.as_py(), np.int64).reshape(-1, width).astype(float)
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "s"])


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        rows = np.unique(q)
        old = np.repeat(rows, self.k)
        q, ids, scores = np.concatenate([old, q]), np.concatenate([self.id[rows].ravel(), ids]), np.concatenate([self.score[rows].ravel(), scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[q[top], rank[top]], self.id[q[top], rank[top]] = scores[top], ids[top]


def _scan(batches, shared, floors, rotation: np.ndarray, width: int, k: int, lead: int):
    """Each query's k best of this partition's chunks, which come by descending length."""
    (qid, q), floor = shared.value, floors.value
    rotated = q @ rotation
    q_rest = np.sqrt(np.maximum(0, (rotated[:, lead:] ** 2).sum(1)))
    q_len = np.sqrt((q.astype(float) ** 2).sum(1))
    best, qf = Best(len(q), k), q.astype(float)
    for batch in batches:
        for ids, vs in zip(batch.column("ids"), batch.column("vs"), strict=True):
            ids, x = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vs.as_py(), np.int64).reshape(-1, width)
            xf = x.astype(float)
            xr = xf @ rotation
            x_rest, longest = np.sqrt(np.maximum(0, (xr[:, lead:] ** 2).sum(1))), np.sqrt((xf**2).sum(1).max())
            any_alive = False
            exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * width < 2**53
            for i in range(0, len(q), 1024):
                at = slice(i, i + 1024)
                need = np.maximum(best.score[at, -1], floor[at]).astype(float)
                slack = 1e-6 * (1 + longest * q_len[at])
                alive = np.flatnonzero(longest * q_len[at] + slack >= need)
                if not len(alive):
                    continue
                any_alive = True
                part = rotated[at][alive, :lead] @ xr[:, :lead].T
                part += q_rest[at][alive, None] * x_rest[None, :]
                a, b = np.nonzero(part + slack[alive, None] >= need[alive, None])
                a = alive[a] + i
                if exact and len(a) > part.size // 8:
                    s = (qf[at] @ xf.T)[a - i, b].astype(np.int64)
                else:
                    s = np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 65536]], x[b[j : j + 65536]]) for j in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
                ok = (ids[b] != qid[a]) & (s >= np.maximum(best.score[a, -1], floor[a]))
                best.add(a[ok], ids[b][ok], s[ok])
            if not any_alive and len(q):  # chunks come by descending length, so no later one can reach any query
                return (yield _found(best, qid))
    yield _found(best, qid)


def _found(best: Best, qid: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(best.id != np.iinfo(np.int64).max)
    return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(qid[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], names=["query", "query_id", "id", "score"])


def _first_look(batches, shared, width: int, k: int):
    """A score that each query's k-th best reaches at least, from the chunk of the longest vectors."""
    qid, q = shared.value
    floor = np.full(len(q), NONE)
    for batch in batches:
        for ids, vs in zip(batch.column("ids"), batch.column("vs"), strict=True):
            ids, x = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vs.as_py(), np.int64).reshape(-1, width)
            for i in range(0, len(q) if len(x) >= k else 0, 256):
                s = q[i : i + 256] @ x.T
                s[ids[None, :] == qid[i : i + 256, None]] = NONE
                floor[i : i + 256] = np.partition(s, -k, axis=1)[:, -k]
    yield pa.RecordBatch.from_arrays([pa.array([floor.tobytes()], pa.binary())], names=["floor"])


def top_k(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, chunk: int = CHUNK, block: int = QUERIES, lead: int = LEAD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for each one whose id is divisible by `every`.

    Vectors that are null or hold null or non-finite components take no part; shorter ones count as filled up with
    zeros. A query doesn't meet rows of its own id. Repeated rows are candidates each; repeated queries with equal
    vectors count once. Null ids are no queries and, as candidates, come last in ties. An empty table gives no rows.
    Components beyond 2**55 / scale, where a double is no whole number's equal any more, saturate at 64 bits. Queries are
    broadcast in blocks of at most `block`, and of QUERY_BYTES, one after the other, each of which scans all chunks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = quantise(vectors, id, vector, scale)
    rows = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    facts = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    width, n = max(1, facts[0]), max(1, min(parts(vectors), -(-facts[1] // chunk)))
    ordered = rows.repartitionByRange(n, F.col("sq").desc(), "id").sortWithinPartitions(F.col("sq").desc(), "id")
    ordered = ordered.select(F.coalesce("id", F.lit(2**63 - 2)).alias("id"), "v")
    chunks = scratch.put(ordered.mapInArrow(lambda b: _blobs(b, width, chunk), "ids binary, vs binary"), "chunks")
    cells = chunks.mapInArrow(lambda b: _second_moments(b, width), "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros(width * width)
    for c in cells:
        moments[c.cell] = c.s
    rotation = np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1].copy()
    queries = scratch.put(rows.where(F.col("id") % every == 0).select("id", "v").distinct(), "queries")
    blocks = max(1, -(-queries.count() // max(1, min(block, QUERY_BYTES // (8 * width)))))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    schema = "query_id long, rank int, vec_id long, score long"
    for b in range(blocks):
        # One block at a time: its rows are written, and its broadcasts destroyed, before the next one's queries are read.
        got = queries.where(F.col("block") == b).select("id", "v").toArrow()
        if not len(got):
            continue
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy().astype(np.int64), _matrix(got.column("v").combine_chunks(), width)))
        looked = chunks.limit(1).mapInArrow(lambda x, shared=shared: _first_look(x, shared, width, k), "floor binary").collect()
        floors = spark.sparkContext.broadcast(np.frombuffer(looked[0].floor, np.int64) if looked else np.full(len(got), NONE))
        found = chunks.mapInArrow(lambda x, shared=shared, floors=floors: _scan(x, shared, floors, rotation, width, k, lead), RESULT)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        scratch.add(best.select("query_id", "rank", F.when(F.col("id") != 2**63 - 2, F.col("id")).alias("vec_id"), "score"), "best")
        shared.destroy()
        floors.destroy()
    return scratch.read("best", T._parse_datatype_string(schema))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_topk: the contract's columns."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
