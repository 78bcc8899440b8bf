"""Mixing sources to target weights by soft membership.

A table of labelled documents (key, domain) trains a multinomial naive Bayes classifier on hashed byte
bigrams; it predicts each document's posterior over domains. Documents get nonnegative rates r that
minimise || E(r) - T ||^2, where E_d(r) = sum over documents of r_i tokens_i P(d | i) are the expected tokens of each domain
and T the targets. The minimum is found by projected gradient: every step adds up E over all documents in
Spark and moves each rate against the gradient, clipped to [low, high]. A document's rate after n steps
follows from the n residuals (a few numbers each), so a step passes only those and nothing about documents
is kept between steps but the table of tokens and posteriors, written once.

A weighted step: the gradient of a rate is tokens_i P_i . residual; the step divides it by tokens_i (a diagonal
metric, in which clipping is still the projection), and its length is one over the largest eigenvalue of
sum tokens_i P_i P_i^T, so that the objective never rises; Nesterov's momentum, dropped whenever the objective would
rise, shortens the way. The fit ends when the residual is under `tolerance` of the targets, or when a step no longer
shortens it (bounds that bind leave a rest); Fit.ended says which. After `most_steps` it ends too, with a warning.

`apply` realises rates: floor(rate) copies and one more with the odds of the rest, decided by a hash of the
id, so that a second run makes the same choice.

Defined results: null and empty texts and those of white space have no tokens and keep rate 1 within [low, high]; texts under
two bytes have the domains' prior as posterior; target weights are scaled to sum 1; of a row's several labels the least counts; a domain without labelled rows has the smoothed prior; without labelled rows posteriors
are even. Repeated rows each have a rate. Rows with a null id are realised as if the id were 0. Extra columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.gather import add_up
from lodestar.llm._spark import bounded, materialize, shuffle_partitions, slices, text_buffers
from lodestar.llm.features import words

#: Buckets of hashed bigrams; n bigrams count as n EVIDENCE / (n + EVIDENCE), as neighbours depend on each other, and in
#: training as n TRAINING / (n + TRAINING), so that no long text outweighs the others.
BUCKETS, EVIDENCE, TRAINING = 4096, 200.0, 2000.0
SMOOTH = 0.5
#: Labelled rows that train the classifier at most (the first by a hash of the id).
SAMPLE = 20_000
MOST_STEPS, TOLERANCE = 500, 1e-5


def bigram_counts(data: np.ndarray) -> np.ndarray:
    if len(data) < 2:
        return np.zeros(BUCKETS, dtype=np.int64)
    x = data.astype(np.uint32)
    return np.bincount((((x[:-1] << np.uint32(8)) | x[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)


class Classifier:
    """Log odds of buckets by domain, and the domains' prior."""

    def __init__(self, domains: list[str], prior: np.ndarray, weights: np.ndarray):
        self.domains, self.prior, self.weights = domains, prior, weights

    def posteriors(self, view, offsets: list[int]) -> np.ndarray:
        data = np.frombuffer(view, dtype=np.uint8)
        out = np.tile(self.prior, (len(offsets) - 1, 1))
        for r, (i, j) in enumerate(zip(offsets, offsets[1:], strict=False)):
            if j - i < 2:
                continue
            score = self.weights @ bigram_counts(data[i:j]) * EVIDENCE / (EVIDENCE + j - i - 1) + np.log(self.prior)
            p = np.exp(score - score.max())
            out[r] = p / p.sum()
        return out


def fit_classifier(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE, domains: list[str] | None = None) -> Classifier:
    """Counts by domain over the labelled rows, at most `sample` of them (the documented bound)."""
    rows = labelled.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{domain}`").cast("string").alias("__domain")).na.drop().groupBy("__id").agg(F.min("__domain").alias("__domain"))
    rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    held = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in slices(batches):
            view, offsets = text_buffers(b.column(1))
            data = np.frombuffer(view, dtype=np.uint8)
            for d, i, j in zip(b.column(0).to_pylist(), offsets, offsets[1:], strict=False):
                c = bigram_counts(data[i:j])
                counts[d] = counts.get(d, 0) + c * (TRAINING / (TRAINING + j - i - 1))
                rows[d] = rows.get(d, 0) + 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows[d] for d in names], pa.int64()), pa.array([counts[d].astype("<f8").tobytes() for d in names], pa.binary())], names=["domain", "rows", "counts"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[int, np.ndarray]] = {}
        for b in parts:
            for d, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                old = counts.get(d, (0, 0))
                counts[d] = (old[0] + n, old[1] + np.frombuffer(raw, dtype="<f8"))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1].tobytes() for v in counts.values()], pa.binary())], names=["domain", "rows", "counts"])

    schema = "domain string, rows long, counts binary"
    # Text-side rows stay where they are: the labelled ids are at most `sample`, so they are broadcast.
    by_task = bounded(held).join(F.broadcast(rows), "__id").select("__domain", "__text").mapInArrow(run, schema)
    found = {r.domain: (r.rows, np.frombuffer(r.counts, dtype="<f8")) for r in by_task.repartition(min(32, shuffle_partitions(docs.sparkSession)), "domain").mapInArrow(merge, schema).collect()}  # a row for each domain
    domains = domains or sorted(found)
    if not domains:
        raise ValueError("no domains are named and no row is labelled")
    rows_of = np.array([found.get(d, (0, None))[0] for d in domains], dtype=float)
    counts = np.stack([found[d][1] if d in found else np.zeros(BUCKETS) for d in domains]) + SMOOTH
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Classifier(domains, (rows_of + 1) / (rows_of + 1).sum(), logs - logs.mean(axis=0))


def with_membership(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """docs with tokens (words, long) and posterior (array of doubles, in the order of classifier.domains)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches):
            view, offsets = text_buffers(b.column(at))
            _, bounds = words(view, offsets)
            p = own.posteriors(view, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(bounds), pa.int64()), flat], names=schema.names)

    return bounded(docs).mapInArrow(run, schema)


class Fit:
    """The steps that lead to the rates; what a task needs to compute a document's rate."""

    def __init__(self, targets: np.ndarray, low: float, high: float):
        self.targets, self.low, self.high = targets, low, high
        self.step = 0.0
        self.moves: list[tuple[np.ndarray, float]] = []  # (residual, momentum) of each step
        self.totals = np.zeros_like(targets)
        self.ended = "most_steps"  # or tolerance, or bounds

    def off(self) -> float:
        """How far the totals are from the targets, as a share of these."""
        return float(np.linalg.norm(self.totals - self.targets)) / max(1e-9, float(np.linalg.norm(self.targets)))

    def at_rest(self) -> float:
        """The rate before any move, which rows without tokens keep."""
        return min(max(1.0, self.low), self.high)

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all moves, and the point from which the next gradient is taken."""
        now = np.full(len(p), self.at_rest())
        point = now
        for residual, momentum in self.moves:
            new = np.clip(point - self.step * (p @ residual), self.low, self.high)
            point = new + momentum * (new - now)
            now = new
        return now, point


def fit_rates(members: DataFrame, targets: np.ndarray, *, low: float = 0.0, high: float = 100.0, most_steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Projected gradient over all rows of members (tokens, posterior); targets in tokens."""
    spark = members.sparkSession
    k = len(targets)
    fit = Fit(np.asarray(targets, dtype=float), low, high)

    def over(batches: Iterator[pa.RecordBatch], own: Fit) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 + k, k))
        for b in batches:
            t = b.column(0).to_numpy().astype(float)
            p = b.column(1).flatten().to_numpy().reshape(-1, k)
            now, point = own.rates(p)
            sums[0] += (now * t) @ p
            sums[1] += (point * t) @ p
            if not own.moves:
                sums[2:] += (p * t[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<f8").tobytes()], pa.binary())], names=["sums"])

    def measure() -> np.ndarray:
        sent = spark.sparkContext.broadcast(fit)
        parts = members.select("tokens", "posterior").mapInArrow(lambda batches: over(batches, sent.value), "sums binary")
        total = add_up(parts)
        sent.unpersist()
        return np.zeros((2 + k, k)) if total is None else total.reshape(2 + k, k)

    first = measure()
    largest = float(np.linalg.eigvalsh(first[2:]).max())
    fit.step = 1 / largest if largest > 0 else 0.0
    fit.totals, at = first[0], first[1]
    scale, t = max(1e-9, float(np.linalg.norm(fit.targets))), 1.0
    best = float(np.linalg.norm(fit.totals - fit.targets))
    while len(fit.moves) < most_steps and best > tolerance * scale and fit.step:
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        fit.moves.append((at - fit.targets, (t - 1) / after))
        sums = measure()
        off = float(np.linalg.norm(sums[0] - fit.targets))
        if off > best * (1 + 1e-12):
            fit.moves[-1] = (fit.moves[-1][0], 0.0)  # drop the momentum and go on from here
            after = 1.0
            sums[1] = sums[0]
        elif best - off < 1e-7 * scale and after > 1 and len(fit.moves) > 5:
            fit.totals, best, fit.ended = sums[0], off, "bounds"
            break
        best, t = off, after
        fit.totals, at = sums[0], sums[1]
    if best <= tolerance * scale:
        fit.ended = "tolerance"
    elif not fit.step:
        fit.ended = "bounds"  # no row has tokens
    elif fit.ended == "most_steps":
        warnings.warn(f"rates are {fit.off():.2g} of the targets away after {most_steps} steps", stacklevel=2)
    return fit


def with_rate(members: DataFrame, fit: Fit) -> DataFrame:
    """members with a double column rate."""
    sent = members.sparkSession.sparkContext.broadcast(fit)
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])
    at, by, k = members.columns.index("posterior"), members.columns.index("tokens"), len(fit.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            now, _ = own.rates(b.column(at).flatten().to_numpy().reshape(-1, k))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(b.column(by).to_numpy() > 0, now, own.at_rest()))], names=schema.names)

    return members.mapInArrow(run, schema)


def copies(rate: str, key: str) -> F.Column:
    """floor(rate), and one more with the odds of the rest, by a hash of the id."""
    odds = F.pmod(F.xxhash64(F.lit("mixing"), F.coalesce(F.col(key).cast("long"), F.lit(0))), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(F.col(rate) + odds).cast("int")


def targets_for(totals: np.ndarray, weights: np.ndarray, grow_only: bool) -> np.ndarray:
    """Token targets of the given weights: of today's sum, or of the least sum at which no domain shrinks."""
    weights = np.asarray(weights, dtype=float) / float(np.sum(weights))
    if grow_only:
        return weights * float(np.max(totals[weights > 0] / weights[weights > 0], initial=0.0))
    return weights * float(totals.sum())


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, key: str = "doc_id", text: str = "text", domain: str = "domain", low: float = 0.0, high: float = 100.0, grow_only: bool = False) -> tuple[DataFrame, Fit, Classifier]:
    """(key, tokens, posterior, rate) of every document; the fit and the classifier behind them."""
    domains = sorted(weights)
    classifier = fit_classifier(docs, labelled, key=key, text=text, domain=domain, domains=domains)
    members = materialize(with_membership(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), classifier, text).drop(text), "mixing-members")
    k = len(domains)
    totals = np.array(members.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(k))).first(), dtype=float)
    fit = fit_rates(members, targets_for(totals, np.array([weights[d] for d in domains]), grow_only), low=low, high=high)
    return with_rate(members, fit), fit, classifier


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents that the labels table has; the domain is the language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").dropDuplicates(), "doc_id", "left_semi")


#: Target shares of tokens by domain.
WEIGHTS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated, _, classifier = mix(docs, labelled_domains(docs, labels), WEIGHTS)
    shares = [F.round(F.col("posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(classifier.domains)]
    return rated.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), copies("rate", "doc_id").alias("copies"))


def apply(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, key: str = "doc_id", text: str = "text", domain: str = "domain", low: float = 0.0, high: float = 100.0, grow_only: bool = False) -> DataFrame:
    """docs with each row as often as its rate says, columns as they were."""
    domains = sorted(weights)
    classifier = fit_classifier(docs, labelled, key=key, text=text, domain=domain, domains=domains)
    members = materialize(with_membership(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), classifier, text).drop(text, key), "mixing-members")
    totals = np.array(members.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(domains)))).first(), dtype=float)
    fit = fit_rates(members, targets_for(totals, np.array([weights[d] for d in domains]), grow_only), low=low, high=high)
    # Rates are computed again beside the texts rather than joined to them: a pass over texts instead of a shuffle of them.
    sent = docs.sparkSession.sparkContext.broadcast((classifier, fit))
    name = "__rate"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = sent.value
        for b in slices(batches):
            view, offsets = text_buffers(b.column(at))
            now, _ = found.rates(own.posteriors(view, offsets))
            some = np.diff(words(view, offsets)[1]) > 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(some, now, found.at_rest()))], names=schema.names)

    rated = bounded(docs).mapInArrow(run, schema)
    times = rated.withColumn(name, F.explode(F.array_repeat(F.lit(0), copies(name, key))))
    return times.drop(name)
