"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are hashed byte trigrams (TERMS buckets) and graded shape terms: how large the shares
of upper case, symbols, repeated words and so on are. Document frequencies come from all documents. The
labelled sample (at most `sample` training rows, the documented bound; chosen by a hash of the id, so
that it is the same on every run) gives a tf-idf matrix whose truncated SVD spans the latent space.
Its vectors, labels and basis have a proven size (sample x rank + terms x rank floats), are broadcast with
the task, and every document is scored against all of them: exact cosine products in blocks, the
`neighbours` nearest vote with a power of their similarity as weight. Weights, basis and vectors are whole numbers (GRID to the
unit), whose products and sums doubles hold exactly: a score doesn't depend on a row's block, and ties are true ties.

Defined results: a null or empty text (or one under three bytes) has no terms and gets the prior, the
share of label 1 among the sample; without any labelled training row every score is 0.5. Repeated rows
get equal scores. Of neighbours that are equally near, those of the least ids vote. Null labels and ids are left out of training, and
so are ids with both labels; of an id's several texts the least one trains. Extra columns are kept; the score takes a free
name if the input has one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._spark import bounded, free_name, slices, text_buffers
from lodestar.llm.features import SHAPES, shape_of, words

TERMS = 4096
#: Each shape's share falls into one of so many grades, each a term.
GRADES = 8
WIDTH = TERMS + SHAPES * GRADES
SAMPLE, RANK, NEIGHBOURS, POWER = 3000, 48, 7, 4
#: Weight of a shape term against a document's trigrams, which have length 1.
SHAPE_WEIGHT = 0.5
#: Whole numbers to the unit: weights and basis, then vectors. Sums stay under 2^53.
GRID, UNIT = 1 << 14, 1 << 16
#: Bounds of the grades of each shape, in order: upper case, digits, symbols, bars, lines, distinct words, commonest word, repeats.
CUTS = np.array(
    [
        [0.01, 0.03, 0.06, 0.12, 0.25, 0.4, 0.6],
        [0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
        [0.004, 0.01, 0.02, 0.05, 0.1, 0.15, 0.25],
        [0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3],
        [0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16],
        [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95],
        [0.02, 0.05, 0.08, 0.12, 0.2, 0.35, 0.6],
        [0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.8],
    ]
)


def term_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams of a text's bytes."""
    if len(data) < 3:
        return np.zeros(TERMS, dtype=np.int64)
    x = data.astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return np.bincount((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - TERMS.bit_length() + 1), minlength=TERMS)


def vectors(view, offsets: list[int], dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 1 + log(count) for trigrams and 1 for the grades that hold; and the lengths in bytes."""
    data = np.frombuffer(view, dtype=np.uint8)
    hashes, bounds = words(view, offsets, lower=False)
    out = np.zeros((len(offsets) - 1, WIDTH), dtype=dtype)
    for r, (i, j) in enumerate(zip(offsets, offsets[1:], strict=False)):
        if j - i < 3:
            continue
        c = term_counts(data[i:j])
        at = np.flatnonzero(c)
        out[r, at] = 1 + np.log(c[at])
        grade = (shape_of(data[i:j], hashes[bounds[r] : bounds[r + 1]])[:, None] >= CUTS).sum(axis=1)
        out[r, TERMS + np.arange(SHAPES) * GRADES + grade] = 1
    return out, np.diff(offsets)


def _document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many documents there are; WIDTH + 1 sums, made by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, dtype=np.int64), 0
        for b in slices(batches):
            view, offsets = text_buffers(b.column(0))
            data = np.frombuffer(view, dtype=np.uint8)
            n += len(offsets) - 1
            for i, j in zip(offsets, offsets[1:], strict=False):
                df[:TERMS] += term_counts(data[i:j]) > 0
        yield pa.RecordBatch.from_arrays([pa.array([df.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, dtype=np.int64), 0
        for b in parts:
            for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df += np.frombuffer(raw, dtype="<i8")
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([df.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    by_task = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, "df binary, n long")
    some = by_task.withColumn("__g", F.spark_partition_id() % 32).repartition(32, "__g").select("df", "n").mapInArrow(merge, "df binary, n long")
    rows = some.collect()  # 32 rows of fixed size
    return sum((np.frombuffer(r.df, dtype="<i8") for r in rows), np.zeros(WIDTH, dtype=np.int64)), sum(r.n for r in rows)


class Model:
    """Basis, labelled vectors and labels; what a task needs to score."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, points: np.ndarray, labels: np.ndarray, neighbours: int, power: float):
        self.idf, self.basis, self.points, self.labels = idf, np.rint(basis * GRID), points, labels
        self.neighbours, self.power = min(neighbours, len(labels)), power
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, x: np.ndarray) -> np.ndarray:
        """Latent vectors of length UNIT, in whole numbers."""
        y = np.rint((np.rint(weigh(x, self.idf) * GRID) @ self.basis) / GRID)
        return np.rint(y * (UNIT / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the neighbours of each row, the nearest first, of equals the first."""
        n = len(self.labels)
        sims = self.project(x) @ self.points.T
        ranked = sims * n - np.arange(n)
        near = np.argpartition(-ranked, self.neighbours - 1, axis=1)[:, : self.neighbours]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(ranked, near, axis=1), axis=1), axis=1)
        return near, np.take_along_axis(sims, near, axis=1) / (UNIT * UNIT)

    def score(self, x: np.ndarray, sizes: np.ndarray, block: int = 1000) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; x in blocks of rows."""
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        for i in range(0, len(x), block):
            near, sims = self.nearest(x[i : i + block])
            weight = np.maximum(sims, 0) ** self.power
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[i : i + block] = np.where((total > 1e-9) & (sizes[i : i + block] >= 3), votes, self.prior)
        return np.clip(out, 0.0, 1.0)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf with trigrams of length 1 and shape terms of their own weight."""
    y = np.rint(x * idf * 1024.0)
    y[:, :TERMS] /= np.maximum(np.sqrt((y[:, :TERMS] * y[:, :TERMS]).sum(axis=1, keepdims=True)), 1e-12)
    y[:, TERMS:] = x[:, TERMS:] * SHAPE_WEIGHT
    return y


def latent_basis(x: np.ndarray, rank: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 12, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER) -> Model:
    """Document frequencies from all of docs; basis and neighbours from at most `sample` rows of labels (key, label)."""
    chosen = labels.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).filter("__label = __most").drop("__most")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    held = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            view, offsets = text_buffers(b.column(2))
            x, _ = vectors(view, offsets)
            at = [np.flatnonzero(r) for r in x]
            columns = [b.column(0), b.column(1), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f8").tobytes() for r, a in zip(x, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "at", "value"])

    picked = bounded(held).join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])
    rows = sorted(picked.mapInArrow(run, schema).collect(), key=lambda r: r.id)  # at most `sample` rows
    df, n = _document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    x = np.zeros((len(rows), WIDTH))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, dtype="<u2")] = np.frombuffer(r.value, dtype="<f8")
    y = np.array([r.label for r in rows], dtype=float)
    if not len(rows):
        return Model(idf, np.zeros((WIDTH, 1)), np.zeros((0, 1)), y, neighbours, power)
    basis = latent_basis(weigh(x, idf).astype(np.float32), rank)
    model = Model(idf, basis, np.zeros((0, basis.shape[1])), y, neighbours, power)
    model.points = model.project(x)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a double column, 0 to 1, higher where label 1 is likelier; its name gets underscores if docs has it."""
    column = free_name(docs.columns, column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches):
            view, offsets = text_buffers(b.column(at))
            x, sizes = vectors(view, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(x, sizes), pa.float64())], names=schema.names)

    return bounded(docs).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit(docs, train_labels(spark, sf_dir)))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they were."""
    name = free_name(docs.columns, "__score")
    return score(docs, fit(docs, labels), column=name).filter(F.col(name) >= threshold).drop(name)
