"""Vector search: exact kNN in blocks, thresholds, weighted multi-vector and two-stage binary search.

A search takes queries in blocks of at most QUERY_BLOCK vectors (a proven size), sends each block to the
tasks that scan the candidates once, and keeps k rows a query in each task, so that what meets in the final
window is tasks x k rows a query at most, however many candidates there are. A task scores TILE queries of the
block against CANDIDATES rows at a time, so that its arrays do not grow with the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.registry import query, table

QUERY_BLOCK = 2_000
#: A task's arrays of scores have half a million numbers at most.
TILE, CANDIDATES = 256, 2_048


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; packed signs (binary) as whole 64-bit words."""
    if pa.types.is_binary(column.type):
        raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
        return _words(raw)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dims:
        raise ValueError("vectors of unequal length, or null")
    return flat.reshape(-1, dims)


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, zeros behind."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _bits(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.uint64 else _words(np.packbits(x > 0, axis=1))


def _scores(q: np.ndarray, x: np.ndarray, metric: str, dims: int) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0)
    if metric == "euclid":
        d2 = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
        return 1 / (1 + np.sqrt(np.maximum(d2, 0)))
    if metric == "binary":
        a, b = _bits(q), _bits(x)
        apart = sum(np.bitwise_count(a[:, w, None] ^ b[None, :, w]).astype(np.int64) for w in range(a.shape[1]))
        return 1 - apart / dims
    raise ValueError(metric)


def _best(s: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores, ties by id; only those that reach the k-th are sorted."""
    if s.shape[1] <= k:
        order = np.lexsort((c, -s), axis=1)
        return np.take_along_axis(s, order, axis=1), np.take_along_axis(c, order, axis=1)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    scores, ids = np.empty((len(s), k)), np.empty((len(s), k), dtype=np.int64)
    for r in range(len(s)):
        at = np.flatnonzero(s[r] >= least[r])
        at = at[np.lexsort((c[r, at], -s[r, at]))[:k]]
        scores[r], ids[r] = s[r, at], c[r, at]
    return scores, ids


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, metric: str, dims: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of batches (id, vector) the k best of each query, in one pass over them; a batch for each TILE queries."""
    q = _bits(q) if metric == "binary" else q
    tiles = [slice(i, i + TILE) for i in range(0, len(ids), TILE)]
    held = [(np.zeros((len(ids[t]), 0)), np.zeros((len(ids[t]), 0), dtype=np.int64)) for t in tiles]
    for b in batches:
        for i in range(0, b.num_rows, CANDIDATES):
            part = b.slice(i, CANDIDATES)
            other, x = part.column(0).to_numpy(), _matrix(part.column(1), dims)
            x = _bits(x) if metric == "binary" else x
            for j, t in enumerate(tiles):
                best, best_ids = held[j]
                s = np.concatenate([best, np.round(_scores(q[t], x, metric, dims), 9)], axis=1)
                c = np.concatenate([best_ids, np.tile(other, (len(best), 1))], axis=1)
                held[j] = _best(s, c, k)
    for t, (best, best_ids) in zip(tiles, held, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[t], best.shape[1])), pa.array(best_ids.reshape(-1)), pa.array(best.reshape(-1))], names=names)


def knn(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, id_col: str = "vec_id", vec: str = "embedding", dims: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best candidates of each query; ties by id.

    metric: cosine, euclid (as 1 / (1 + distance)), dot or binary (share of equal signs). A threshold drops
    lower scores. No candidates, no queries or k = 0 give no rows; null vectors are no queries and no candidates. For
    binary the column may hold packed signs (V.packed_bits, `dims` bits), of which a row is 1 / 32 of its floats.
    """
    queries, candidates = queries.filter(F.col(vec).isNotNull()), candidates.filter(F.col(vec).isNotNull())
    parts = []
    rows: list = []

    def search(block: list) -> DataFrame:
        packed = isinstance(block[0][1], bytes | bytearray)
        n = dims or len(block[0][1]) * (8 if packed else 1)
        q = _words(np.array([np.frombuffer(bytes(r[1]), dtype=np.uint8) for r in block])) if packed else np.array([r[1] for r in block], dtype=np.float64)
        sent = candidates.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _nearest(batches, *sent.value, k, metric, n, ["query_id", id_col, "score"])

        return candidates.select(id_col, vec).mapInArrow(run, f"query_id long, {id_col} long, score double")

    if k > 0:
        for r in queries.select(id_col, vec).toLocalIterator():
            rows.append((r[0], r[1]))
            if len(rows) == QUERY_BLOCK:
                parts.append(search(rows))
                rows = []
        if rows:
            parts.append(search(rows))
    if not parts:
        return candidates.sparkSession.createDataFrame([], f"query_id long, {id_col} long, score double, rank int")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _queries(emb: DataFrame) -> DataFrame:
    return emb.filter("vec_id % 20 = 0")


_KNN_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round({score}, 9) AS score FROM e q, e c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= {least})
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""
_BITS = "1 - list_sum(list_transform(list_zip(q.v, c.v), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) / 64.0"


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_KNN_SQL.format(score="list_cosine_similarity(q.v, c.v)", least=-2, k=5))
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(knn(_queries(emb), emb, 5))


@query(_KNN_SQL.format(score="1 / (1 + list_distance(q.v, c.v))", least=-2, k=5))
def vector_knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(knn(_queries(emb), emb, 5, "euclid"))


@query(_KNN_SQL.format(score="list_inner_product(q.v, c.v)", least=-2, k=5))
def vector_knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(knn(_queries(emb), emb, 5, "dot"))


@query(_KNN_SQL.format(score="list_cosine_similarity(q.v, c.v)", least=0.3, k=50))
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(knn(_queries(emb), emb, 50, threshold=0.3))


@query(_KNN_SQL.format(score=_BITS, least=-2, k=10))
def binary_similarity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(knn(_queries(emb), emb, 10, "binary"))


def two_stage(queries: DataFrame, candidates: DataFrame, k: int, oversample: float = 3.0) -> DataFrame:
    """Binary search for oversample x k candidates, then exact cosine on those. A column `bits` of candidates (packed
    signs, as a stored index has them) serves the search; without it signs are made from the vectors."""
    if "bits" in candidates.columns:
        asked = queries.select("vec_id", V.packed_bits("embedding").alias("bits"), F.size("embedding").alias("n"))
        dims = (asked.select("n").first() or [None])[0]
        first = knn(asked, candidates, int(k * oversample), "binary", vec="bits", dims=dims).select("query_id", "vec_id")
    else:
        first = knn(queries, candidates, int(k * oversample), "binary").select("query_id", "vec_id")
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    scored = first.join(candidates.select("vec_id", "embedding"), "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(V.cosine("qv", "embedding"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round({_BITS}, 9) AS b, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM e q, e c WHERE q.vec_id % 20 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS r FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f WHERE r <= 15)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 5""")
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return _six(two_stage(_queries(emb), emb, 5))


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round({_BITS}, 9) AS b, round(list_cosine_similarity(q.v, c.v), 9) AS x FROM e q, e c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS rb, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS rx FROM s)
SELECT query_id, count(*) FILTER (WHERE rb <= 10) / 10.0 AS recall FROM r WHERE rx <= 10 GROUP BY query_id""")
def quantization_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of binary search against exact search, by query."""
    emb = table(spark, sf_dir, "embeddings")
    exact, rough = knn(_queries(emb), emb, 10), knn(_queries(emb), emb, 10, "binary")
    hit = exact.join(rough.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))


def weighted(named: list[tuple[DataFrame, DataFrame, float]], limit: int, per_vector: int) -> DataFrame:
    """Hits of several named vectors: scores times weight, summed by id; a vector that misses an id adds 0."""
    parts = [knn(q, c, per_vector).select("vec_id", (F.col("score") * w).alias("part")) for q, c, w in named]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    total = union.groupBy("vec_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return total.orderBy(F.col("score").desc(), "vec_id").limit(limit)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM e q, e c WHERE q.vec_id IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
t AS (SELECT vec_id, round(sum(score * CASE query_id WHEN 0 THEN 0.3 ELSE 0.7 END), 6) AS score FROM r WHERE rank <= 20 GROUP BY vec_id)
SELECT vec_id, score FROM t ORDER BY score DESC, vec_id LIMIT 10""")
def multi_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return weighted([(emb.filter("vec_id = 0"), emb, 0.3), (emb.filter("vec_id = 1"), emb, 0.7)], 10, 20)


def _all_scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, summed: bool) -> Iterator[pa.RecordBatch]:
    """Of batches (id, vector) the scores of each query against each row, or the sums of these; TILE queries at a time."""
    n, nearest, total = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -np.inf), np.zeros(len(ids))
    for b in batches:
        for i in range(0, b.num_rows, CANDIDATES):
            part = b.slice(i, CANDIDATES)
            other, x = part.column(0).to_numpy(), _matrix(part.column(1), q.shape[1])
            n += len(other)
            for t in (slice(r, r + TILE) for r in range(0, len(ids), TILE)):
                own = ids[t, None] == other[None, :]
                s = np.where(own, 1.0, _scores(q[t], x, "cosine", q.shape[1]))
                total[t] += s.sum(axis=1)
                nearest[t] = np.maximum(nearest[t], np.where(own, -np.inf, s).max(axis=1))
                if not summed:
                    for r in range(0, len(s), 64):
                        a = ids[t][r : r + 64]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, len(other))), pa.array(np.tile(other, len(a))), pa.array(s[r : r + 64].reshape(-1))], names=["a", "b", "score"])
    if summed and n.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(nearest), pa.array(total)], names=["a", "n", "nearest", "total"])


def similarity_matrix(queries: DataFrame, candidates: DataFrame, summed: bool = False) -> DataFrame:
    """(a, b, score) of a stated set of rows against all others, in blocks; 1 for a row with itself. summed: instead
    (a, n, nearest, mean) of each row: how many, the greatest but for itself, and the mean."""
    rows, parts = [], []
    kind = "a long, n long, nearest double, total double" if summed else "a long, b long, score double"

    def block(held: list) -> DataFrame:
        sent = candidates.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _all_scores(batches, *sent.value, summed)

        return candidates.select("vec_id", "embedding").mapInArrow(run, kind)

    candidates = candidates.filter("embedding IS NOT NULL")
    for r in queries.filter("embedding IS NOT NULL").select("vec_id", "embedding").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == QUERY_BLOCK:
            parts.append(block(rows))
            rows = []
    if rows:
        parts.append(block(rows))
    out = parts[0] if parts else candidates.sparkSession.createDataFrame([], kind)
    for p in parts[1:]:
        out = out.unionByName(p)
    if not summed:
        return out
    nearest = F.max("nearest")
    return out.groupBy("a").agg(F.sum("n").alias("n"), F.when(nearest > float("-inf"), nearest).alias("nearest"), (F.sum("total") / F.sum("n")).alias("mean"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, count(*) AS n, round(max(CASE WHEN a.vec_id <> b.vec_id THEN list_cosine_similarity(a.v, b.v) END), 6) AS nearest,
       round(avg(CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE list_cosine_similarity(a.v, b.v) END), 6) + 0.0 AS mean
FROM e a, e b WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id""")
def similarity_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of ids divisible by 20 in the full matrix: how many, nearest and mean."""
    emb = table(spark, sf_dir, "embeddings")
    return similarity_matrix(_queries(emb), emb, summed=True).select("a", "n", F.round("nearest", 6).alias("nearest"), (F.round("mean", 6) + 0.0).alias("mean"))


def _exploded(df: DataFrame, value: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("pos", "val")).select("vec_id", (F.col("pos") + 1).alias("pos"), (F.round("val", 6) + 0.0).alias("val"))


_NORM_SQL = """
WITH u AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
n AS (SELECT vec_id, greatest({norm}, 1e-12) AS norm FROM u GROUP BY vec_id)
SELECT u.vec_id, CAST(u.pos AS INTEGER) AS pos, round(u.x / n.norm, 6) + 0.0 AS val FROM u JOIN n USING (vec_id)"""


@query(_NORM_SQL.format(norm="sqrt(sum(x * x))"))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(table(spark, sf_dir, "embeddings").withColumn("out", V.normalized("embedding")), "out")


@query(_NORM_SQL.format(norm="sum(abs(x))"))
def l1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(table(spark, sf_dir, "embeddings").withColumn("out", V.normalized("embedding", 1)), "out")


@query(_NORM_SQL.format(norm="pow(sum(pow(abs(x), 3)), 1 / 3.0)"))
def lp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(table(spark, sf_dir, "embeddings").withColumn("out", V.normalized("embedding", 3)), "out")


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits, CAST(8 AS INTEGER) AS packed_bytes, CAST(32.0 AS DOUBLE) AS ratio FROM embeddings")
def binary_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits, the bytes they take packed, and how many times less that is than 4 bytes a component."""
    emb = table(spark, sf_dir, "embeddings").withColumn("packed", V.packed_bits("embedding"))
    return emb.select("vec_id", V.sign_bits("embedding").alias("bits"), F.length("packed").alias("packed_bytes"), (4.0 * F.size("embedding") / F.length("packed")).alias("ratio"))


def int8(df: DataFrame, vec: str = "embedding") -> tuple[DataFrame, float, float]:
    """df with array column q (0 to 255), and scale and zero point of the whole column; equal values have scale 1."""
    span = df.select(F.array_min(vec).alias("lo"), F.array_max(vec).alias("hi")).agg(F.min("lo").cast("double"), F.max("hi").cast("double")).first()
    lo, hi = span[0] or 0.0, span[1] or 0.0
    scale = (hi - lo) / 255 or 1.0
    zero = -lo / scale
    return df.withColumn("q", F.transform(F.col(vec).cast("array<double>"), lambda x: F.round(x / scale + zero).cast("int"))), scale, zero


@query("""
WITH u AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT min(x) AS lo, (max(x) - min(x)) / 255 AS scale FROM u)
SELECT vec_id, CAST(sum(CAST(round(x / scale + (-lo / scale)) AS INTEGER)) AS BIGINT) AS total, CAST(max(CAST(round(x / scale + (-lo / scale)) AS INTEGER)) AS INTEGER) AS highest,
       round(max(abs(x - (CAST(round(x / scale + (-lo / scale)) AS INTEGER) - (-lo / scale)) * scale)), 6) AS worst
FROM u, m GROUP BY vec_id""")
def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By vector: sum and maximum of the codes, and the largest error after decoding."""
    out, scale, zero = int8(table(spark, sf_dir, "embeddings"))
    off = F.transform(F.arrays_zip("embedding", "q"), lambda p: F.abs(p["embedding"].cast("double") - (p["q"] - F.lit(zero)) * F.lit(scale)))
    return out.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("q").alias("highest"), F.round(F.array_max(off), 6).alias("worst"))


def centroids(rows: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(label, pos, val): means by label, then of length 1 (a zero mean stays)."""
    mean = rows.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(label)))
    return mean.select(label, (F.col("pos") + 1).alias("pos"), F.when(size > 0, F.col("x") / F.nullif(size, F.lit(0.0))).otherwise(F.col("x")).alias("val"))


@query("""
WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY label, pos)
SELECT label, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0.0 AS val FROM m""")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(table(spark, sf_dir, "embeddings"), "label").withColumn("val", F.round("val", 6) + 0.0)
