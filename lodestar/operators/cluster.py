"""k-means with deterministic seeding, product quantisation and PCA whitening.

Loops run on the driver over a few numbers (k centroids); each step is one pass over the vectors in Spark,
in which every task adds up sums and counts by cluster, so that what comes back is k x dims numbers a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.gather import add_up
from lodestar.registry import query, table


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _away(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to each centroid: 1 - cosine (1 for zero vectors), or squared Euclidean."""
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        return 1 - np.divide(x @ c.T, size, out=np.zeros((len(x), len(c))), where=size > 0)
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def seeds(rows: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """First the vector of the least id, then again and again the first one, in id order, at which the running sum of
    squared distances to the nearest seed reaches half of its total; fewer if no distance is left.

    The running sum goes over at most 4,096 equal ranges of ids, then over such parts of the range that holds the half,
    down to one id: each level is one aggregation of a bounded number of rows. Rows without id are no seeds.
    """
    rows = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), vec)
    first = rows.orderBy(id_col).select(vec).first()
    if first is None or k <= 0:
        return np.zeros((0, 0))
    found = np.array([first[0]], dtype=np.float64)
    span = rows.agg(F.min(id_col), F.max(id_col)).first()
    while len(found) < k:
        sent = found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _away(_matrix(b.column(1)), sent, "euclid").min(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d)], names=["id", "d"])

        low, size, total, before = span[0], span[1] - span[0] + 1, None, 0.0
        while size > 1 or total is None:
            width = -(-size // 4096)
            inside = rows.filter((F.col(id_col) >= low) & (F.col(id_col) < low + size)).mapInArrow(run, "id long, d double")
            cells = sorted(inside.groupBy(F.expr(f"(id - {low}L) div {width}L").alias("cell")).agg(F.sum("d").alias("d")).collect())  # at most 4,096 rows
            if total is None:
                total = sum(c.d for c in cells)
                if total <= 1e-12:
                    return found
            at = cells[-1].cell
            for c in cells:
                if before + c.d >= total / 2 - 1e-12:
                    at = c.cell
                    break
                before += c.d
            low, size = low + at * width, width
        found = np.vstack([found, np.array(rows.filter(F.col(id_col) == low).select(vec).first()[0], dtype=np.float64)])
    return found


def assign(rows: DataFrame, c: np.ndarray, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, cluster): the nearest centroid, of equals the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.round(_away(_matrix(b.column(1)), c, metric), 9).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32))], names=[id_col, "cluster"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), vec).mapInArrow(run, f"{id_col} long, cluster int")


def kmeans(rows: DataFrame, k: int, steps: int = 100, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding", start: np.ndarray | None = None) -> np.ndarray:
    """Centroids (k x dims). Means are scaled to length 1 for cosine; an empty cluster keeps its centroid; the loop ends
    when no centroid moves or after `steps`. k = 0 or no rows give none."""
    c = seeds(rows, k, id_col, vec) if start is None else start
    for _ in range(steps if len(c) else 0):
        sent = c

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(sent), np.zeros(len(sent))
            for b in batches:
                x = _matrix(b.column(0))
                near = np.round(_away(x, sent, metric), 9).argmin(axis=1)
                np.add.at(sums, near, x)
                counts += np.bincount(near, minlength=len(sent))
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([sums, counts]).tobytes()], pa.binary())], names=["sums"])

        total = add_up(rows.select(vec).mapInArrow(run, "sums binary")).reshape(len(c), -1)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), c)
        if metric == "cosine":
            new = np.where(total[:, -1:] > 0, new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12), new)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT e.vec_id, c.vec_id AS cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(1 - list_cosine_similarity(e.v, c.v), 9), c.vec_id) AS r FROM e, e c WHERE c.vec_id < 8)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM s WHERE r = 1""")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step: the first eight vectors as centroids."""
    emb = table(spark, sf_dir, "embeddings")
    start = np.array([r[0] for r in emb.filter("vec_id < 8").orderBy("vec_id").select("embedding").collect()], dtype=np.float64)
    return assign(emb, start)


# The seeds one after another, then steps until no centroid moves.
_SEEDS = ", ".join(f"""s{i} AS MATERIALIZED (SELECT vec_id, v FROM (SELECT vec_id, v, sum(d) OVER (ORDER BY vec_id) AS run, sum(d) OVER () AS total FROM d{i - 1}) WHERE total > 1e-12 AND run >= total / 2 - 1e-12 ORDER BY vec_id LIMIT 1),
d{i} AS MATERIALIZED (SELECT a.vec_id, a.v, least(a.d, pow(list_distance(a.v, s{i}.v), 2)) AS d FROM d{i - 1} a, s{i})""" for i in range(2, 11))
_KMEANS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s1 AS MATERIALIZED (SELECT vec_id, v FROM e ORDER BY vec_id LIMIT 1),
d1 AS MATERIALIZED (SELECT e.vec_id, e.v, pow(list_distance(e.v, s1.v), 2) AS d FROM e, s1),
{_SEEDS},
first AS ({' UNION ALL '.join(f'SELECT {i} AS n, v FROM s{i}' for i in range(1, 11))}),
c(step, cs, done) AS (
SELECT 0, list(v ORDER BY n), false FROM first
UNION ALL SELECT step + 1, CASE WHEN still THEN cs ELSE made END, still FROM (
SELECT *, list_sum(list_transform(list_zip(flatten(made), flatten(cs)), lambda p: CASE WHEN abs(p[1] - p[2]) <= 1e-9 + 1e-5 * abs(p[2]) THEN 0 ELSE 1 END)) = 0 AS still FROM (
SELECT step, cs, list_transform(range(1, len(cs) + 1), lambda j: coalesce(list_filter(means, lambda x: x.near = j)[1].unit, cs[j])) AS made FROM (
SELECT any_value(step) AS step, any_value(cs) AS cs, list({{'near': near, 'unit': list_transform(m, lambda y: y / greatest(sqrt(list_sum(list_transform(m, lambda z: z * z))), 1e-12))}}) AS means FROM (
SELECT any_value(step) AS step, any_value(cs) AS cs, near, list(m ORDER BY i) AS m FROM (
SELECT any_value(step) AS step, any_value(cs) AS cs, near, i, avg(y) AS m FROM (
SELECT step, cs, list_position(ds, list_min(ds)) AS near, unnest(v) AS y, unnest(range(len(v))) AS i FROM (
SELECT step, cs, v, list_transform(cs, lambda k: round(1 - list_cosine_similarity(v, k), 9)) AS ds FROM c, e WHERE NOT done AND step < 100))
GROUP BY near, i) GROUP BY near) HAVING count(*) > 0)))),
l AS (SELECT cs FROM c ORDER BY step DESC LIMIT 1)
SELECT vec_id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM (SELECT vec_id, list_transform(cs, lambda k: round(1 - list_cosine_similarity(v, k), 9)) AS ds FROM e, l)"""


@query(_KMEANS)
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors."""
    emb = table(spark, sf_dir, "embeddings")
    return assign(emb, kmeans(emb, 10))


def codebook(x: np.ndarray, codes: int, steps: int = 100) -> np.ndarray:
    """Euclidean k-means of a bounded sample in memory, seeded as `seeds` does."""
    found = x[:1]
    while len(found) < min(codes, len(x)):
        run = np.cumsum(_away(x, found, "euclid").min(axis=1))
        if run[-1] <= 1e-12:
            break
        found = np.vstack([found, x[np.searchsorted(run, run[-1] / 2)]])
    for _ in range(steps):
        near = _away(x, found, "euclid").argmin(axis=1)
        sums, counts = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
        if np.allclose(new, found, atol=1e-9):
            break
        found = new
    return found


def product_codes(rows: DataFrame, parts: int, codes: int, sample: int = 20_000, id_col: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, codes array<smallint>) of every row, and a codebook (codes x dims / parts) for each part; at most 256 codes.

    Codebooks are fitted on at most `sample` rows, the first by a hash of the id.
    """
    if not 0 < codes <= 256:
        raise ValueError("a code has 8 bits: 1 to 256 codes")
    held = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec).collect()
    x = np.array([r[0] for r in held], dtype=np.float64).reshape(len(held), -1)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions can't be cut into {parts} equal parts")
    step = x.shape[1] // parts
    books = [codebook(x[:, p * step : (p + 1) * step], codes) for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b.column(1))
            found = np.stack([np.round(_away(y[:, p * step : (p + 1) * step], book, "euclid"), 9).argmin(axis=1) for p, book in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.astype(np.int16).tolist(), pa.list_(pa.int16()))], names=[id_col, "codes"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), vec).mapInArrow(run, f"{id_col} long, codes array<smallint>"), books


@query()
def pq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight codes of 64 for each vector, and the ratio of bytes before and after."""
    emb = table(spark, sf_dir, "embeddings")
    out, _ = product_codes(emb, 8, 64)
    return out.withColumn("ratio", F.lit(64 * 4 / 8))


def whitening(rows: DataFrame, dims: int, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix W, so that (x - mean) W has the `dims` leading components with variance 1.

    Tasks add up n, sums and the Gram matrix; the eigenvectors' signs are fixed by their largest component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                n, s, g = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[float(n)], s, g.reshape(-1)]).tobytes()], pa.binary())], names=["sums"])

    total = add_up(rows.select(vec).mapInArrow(run, "sums binary"))
    if total is None or total[0] < 2:
        raise ValueError("whitening needs two vectors at least")
    k = int((4 * len(total) - 3) ** 0.5 - 1) // 2  # 1 + k + k * k numbers
    n, s, g = total[0], total[1 : k + 1], total[k + 1 :].reshape(k, k)
    mean = s / n
    values, axes = np.linalg.eigh((g - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(-values)[:dims]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return mean, axes / np.sqrt(np.maximum(values[order], 1e-12))


@query()
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of each vector."""
    emb = table(spark, sf_dir, "embeddings")
    mean, w = whitening(emb, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = (_matrix(b.column(1)) - mean) @ w
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(y, 6).tolist(), pa.list_(pa.float64()))], names=["vec_id", "components"])

    return emb.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, components array<double>")
