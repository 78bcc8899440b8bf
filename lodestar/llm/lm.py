"""LM scoring with an interpolated modified Kneser-Ney model of any order from 2.

Words are counted in Spark; the table of their 63-bit hashes, cut by hash range into shards, is written as
sorted arrays, and a word's rank in it is its number. Bigrams are counted by the pair of numbers and
written as sorted arrays as well, cut at split points over (context, word) that give shards of like
weight; a context that many tokens follow is cut inside. An n-gram's context is the (n-1)-gram that ends a
token earlier, so each further order is counted alike by the pair of its context's rank and the last word's
number, with one more pass over the texts. From those shards come, the highest order first, by ranges of word
numbers (or ranks), dense arrays of each word's (or shorter n-gram's) continuation count and, as a context,
its total and numbers of followers seen once, twice and more often. Workers memory-map the arrays (from the shared
folder, or a copy of it where that is no local mount) and look up a batch's distinct words and n-grams in sorted order.

p(w|u) = max(c(u,w) - D(c), 0) / c(u) + g(u) p(w), with g(u) the discounted mass over c(u);
p(w) = max(a(w) - D'(a), 0) / A + g / (V + 1), a(w) the number of distinct words before w, A their sum; what is
left falls evenly on the V known words and one unknown word. Higher orders go on alike: below the highest, c is the
number of distinct words before the n-gram (those at the start of a text have none and keep their count). Discounts
D1, D2, D3+ of an order come from its counts of counts (Chen and Goodman); where those are zero, 0.5, 1 and 1.5. After a
context that training has not, the shorter one's probability holds.

Equal words have equal hashes; two distinct words of a corpus of a billion words share one with odds of
about one in twenty. Every token of every text counts, whatever the size. Words have two shards for each of the session's shuffle
partitions, n-grams one for each PER_SHARD tokens, at least four for each partition. A key has 63 bits: with 2^26 words, 2^37
distinct n-grams can be contexts of longer ones; beyond, fit raises ValueError.

Defined results: a null or empty text is one end token; repeated rows count each time and score alike;
without training rows every word is unknown; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._spark import bounded, free_name, fs_of, hold, scratch, shuffle_partitions, slices, text_buffers
from lodestar.llm.features import words

#: Numbers of what is no word: the place before a text, the end of a text, a word that training has not.
BOS, END, UNKNOWN, FIRST = 0, 1, 2, 3
#: Tokens that a worker holds before it adds up and passes on.
HELD = 2_000_000
#: Word numbers or ranks in a range of the dense arrays, at most and at least.
RANGE, LEAST_RANGE = 500_000, 1024
#: Tokens that a shard of n-grams stands for, at most but for rounding.
PER_SHARD = 4_000_000
#: The commonest words that each shard of the word table reports, to find contexts that need a cut inside.
TOP = 32


def word_hashes(view, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    h, bounds = words(view, offsets)
    return h >> np.uint64(1), bounds


def with_ends(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and their contexts with an end after each row's words, and where each row's tokens start."""
    rows = len(bounds) - 1
    starts = bounds[:-1] + np.arange(rows)
    tokens = np.full(len(ids) + rows, END, dtype=np.int64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[bounds[1:] + np.arange(rows)] = False
    tokens[inner] = ids
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[starts] = BOS
    return tokens, contexts, starts


def _local(folder: str, name: str) -> str:
    """A path that can be mapped: the shared file itself, or a local copy where the folder is no mount."""
    from pyarrow.fs import LocalFileSystem

    fs, root = fs_of(folder)
    if isinstance(fs, LocalFileSystem):
        return f"{root}/{name}"
    copy = os.path.join(tempfile.gettempdir(), f"lodestar-lm-{os.path.basename(root)}")
    path = os.path.join(copy, name)
    if not os.path.exists(path):
        os.makedirs(copy, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_input_file(f"{root}/{name}") as source, open(part, "wb") as out:
            while data := source.read(1 << 24):
                out.write(data)
        os.replace(part, path)
    return path


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    path = _local(folder, name)
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)


def _save(folder: str, name: str, data: np.ndarray) -> None:
    """Written under another name first; a task that runs again puts the same bytes in their place."""
    fs, root = fs_of(folder)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data.tobytes())
    fs.move(part, f"{root}/{name}")


class Sorted:
    """Sorted keys in shards that follow one another, with a count each."""

    def __init__(self, folder: str, name: str, sizes: list[int], splits: np.ndarray):
        self.folder, self.name, self.splits = folder, name, splits
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if p not in self.maps:
            keys = _map(self.folder, f"{self.name}-{p:06d}.keys", "<u8")
            counts = _map(self.folder, f"{self.name}-{p:06d}.counts", "u1")
            self.maps[p] = (keys, counts.view("<u4" if len(counts) == 4 * len(keys) else "<u8"))
        return self.maps[p]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: absent) and counts of sorted distinct keys."""
        at, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        ends = np.searchsorted(keys, self.splits) if len(self.splits) else np.empty(0, dtype=np.int64)
        for p, (i, j) in enumerate(zip([0, *ends.tolist()], [*ends.tolist(), len(keys)], strict=True)):
            if i == j or not self.sizes[p]:
                continue
            have, c = self._shard(p)
            pos = np.minimum(np.searchsorted(have, keys[i:j]), len(have) - 1)
            hit = have[pos] == keys[i:j]
            at[i:j] = np.where(hit, pos + self.starts[p], -1)
            counts[i:j] = np.where(hit, c[pos], 0)
        return at, counts

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() for keys in any order, with repeats."""
        have, back = np.unique(keys, return_inverse=True)
        at, counts = self.find(have)
        return at[back], counts[back]

    def keys_at(self, ranks: np.ndarray) -> np.ndarray:
        """The keys at positions."""
        have, back = np.unique(ranks, return_inverse=True)
        out = np.empty(len(have), dtype=np.uint64)
        for p in np.unique(np.searchsorted(self.starts, have, side="right") - 1).tolist():
            i, j = np.searchsorted(have, self.starts[p : p + 2])
            out[i:j] = self._shard(p)[0][have[i:j] - self.starts[p]]
        return out[back]


def _write_shards(pairs: DataFrame, folder: str, name: str, shards: int) -> dict[int, tuple[int, int, bytes]]:
    """Adds up (p, key, c), writes each p's sorted keys and counts; by p the rows, the sum and the commonest."""
    spark = pairs.sparkSession
    summed = pairs.repartition(shuffle_partitions(spark), "p").groupBy("p", "key").agg(F.sum("c").alias("c")).sortWithinPartitions("p", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = fs_of(folder)
        fs.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, out = -1, []

        def close() -> None:
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            _save(folder, f"{name}-{now:06d}.keys", keys.astype("<u8"))
            _save(folder, f"{name}-{now:06d}.counts", counts.astype("<u4" if counts.max() < 1 << 32 else "<u8"))
            top = np.argsort(-counts, kind="stable")[:TOP]
            out.append((now, len(keys), int(counts.sum()), np.stack([top, counts[top]]).astype("<i8").tobytes()))
            held.clear()

        for b in batches:
            p, keys, counts = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.diff(p)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(p)], strict=True):
                if i == j:
                    continue
                if held and p[i] != now:
                    close()
                now = int(p[i])
                held.append((keys[i:j], counts[i:j]))
        if held:
            close()
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["p", "rows", "mass", "top"])

    done = summed.mapInArrow(run, "p int, rows long, mass long, top binary").collect()  # a row of bounded size for each shard
    return {r.p: (r.rows, r.mass, r.top) for r in done}


def _added(batches: Iterator[pa.RecordBatch], keys_of, shard_of, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(p, key, c) of what a task has read, added up over HELD tokens at a time."""
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        p = shard_of(keys)
        for i in range(0, len(keys), rows):
            yield pa.RecordBatch.from_arrays([pa.array(p[i : i + rows].astype(np.int32)), pa.array(keys[i : i + rows].astype(np.int64)), pa.array(counts[i : i + rows].astype(np.int64))], names=["p", "key", "c"])

    for b in slices(batches, holds=True):
        keys = keys_of(*text_buffers(b.column(0)))
        held.append(keys)
        n += len(keys)
        if n > HELD:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _splits(masses: list[int], sizes: list[int], tops: list[np.ndarray], total: int, ends: int, shards: int, first: int = FIRST, shift: int = 32, span: int | None = None) -> np.ndarray:
    """Keys (context << shift | word) that cut all n-grams into about `shards` parts of like weight. Contexts are numbered
    from `first` along their shards, of which are given the tokens, contexts and commonest; ends: the texts, which weigh on
    BOS; span: word numbers."""
    target, span = max(1, total // shards), span or sum(sizes) + FIRST
    hot = [(BOS, ends)] if ends else []
    parts: list[tuple[int, int, int]] = []  # first number, contexts, tokens
    for mass, size, top in zip(masses, sizes, tops, strict=True):
        big = top[1] > target // 2
        hot += [(first + int(i), int(c)) for i, c in zip(top[0][big], top[1][big], strict=True)]
        parts.append((first, size, mass - int(top[1][big].sum())))
        first += size
    marks: list[tuple[int, int]] = []  # key, weight from the mark before
    for start, size, mass in parts:
        steps = max(1, min(size, -(-8 * mass // target)))
        marks += [((start + (i + 1) * size // steps) << shift, mass // steps) for i in range(steps) if size]
    for context, count in hot:
        steps = max(1, -(-8 * count // target))
        marks += [((context << shift) + (i + 1) * span // steps, count // steps) for i in range(steps)]
    cuts, weight = [], 0
    for key, w in sorted(marks):
        weight += w
        if weight >= target:
            cuts.append(key)
            weight = 0
    return np.array(sorted(set(cuts)), dtype=np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of things seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (int(x) for x in n[:4])
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.01, 0.02, 0.03], [0, 1, 2, 3])


def few(counts: np.ndarray) -> np.ndarray:
    """1 to 4: how many are 1, 2, 3, 4; and as last how many are 3 or more."""
    c = np.bincount(np.minimum(counts, 5), minlength=6)
    return np.array([c[1], c[2], c[3], c[4], c[3:].sum()], dtype=np.int64)


class Model:
    """Where the arrays are and the totals; small, sent to every task. Arrays are mapped on first use.

    By order: sizes and cuts of the shards of n-grams, `few` counts of counts; widths: how many words or n-grams a range
    of dense arrays has. `stage` tells apart what workers hold while the model grows.
    """

    def __init__(self, folder: str, word_sizes: list[int], word_bits: int, order: int = 2):
        self.folder, self.word_sizes, self.word_bits, self.order = folder, word_sizes, word_bits, order
        self.vocabulary = sum(word_sizes)
        self.tokens = self.texts = self.stage = 0
        self.sizes: dict[int, list[int]] = {}
        self.cuts: dict[int, np.ndarray] = {}
        self.widths: dict[int, int] = {}
        self.few: dict[int, np.ndarray] = {n: np.zeros(5, dtype=np.int64) for n in range(1, order + 1)}

    def rows(self, n: int) -> int:
        """How many n-grams there are; for words with the numbers of what is no word."""
        return sum(self.sizes.get(n, [])) if n > 1 else self.vocabulary + FIRST

    def shift(self, n: int) -> int:
        """Bits of the word in an n-gram's key."""
        return 32 if n == 2 else (self.vocabulary + FIRST).bit_length()

    def word_table(self) -> Sorted:
        cuts = (np.arange(1, len(self.word_sizes), dtype=np.uint64)) << np.uint64(63 - self.word_bits)
        return Sorted(self.folder, "words", self.word_sizes, cuts)

    def table(self, n: int) -> Sorted:
        return Sorted(self.folder, f"grams{n}", self.sizes[n], self.cuts[n])


class Scorer:
    def __init__(self, model: Model):
        self.m, self.words = model, model.word_table()
        self.tables = {n: model.table(n) for n in model.sizes}
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.d = {n: discounts(few) for n, few in model.few.items()}
        b = model.few[1]
        self.left = float(self.d[1][1] * b[0] + self.d[1][2] * b[1] + self.d[1][3] * b[4]) / max(1, model.rows(2))

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and counts in training."""
        at, counts = self.words.lookup(hashes)
        return np.where(at < 0, UNKNOWN, at + FIRST), counts

    def stats(self, n: int, ids: np.ndarray) -> np.ndarray:
        """For words (n = 1) by number or n-grams by rank the rows: distinct words before, tokens after, followers seen once,
        twice, more. All 0 for -1."""
        keys, back = np.unique(ids, return_inverse=True)
        out = np.zeros((5, len(keys)), dtype=np.int64)
        if self.m.rows(n + 1):
            width = self.m.widths[n]
            for r in np.unique(keys[keys >= 0] // width).tolist():
                i, j = np.searchsorted(keys, [r * width, (r + 1) * width])
                if (n, r) not in self.dense:
                    self.dense[n, r] = _map(self.m.folder, f"stats{n}-{r:06d}", "<i8").reshape(5, -1)
                out[:, i:j] = self.dense[n, r][:, keys[i:j] - r * width]
        return out[:, back]

    def key(self, n: int, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return contexts.astype(np.uint64) << np.uint64(self.m.shift(n)) | tokens.astype(np.uint64)

    def parts(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and words of n-grams' keys."""
        shift = self.m.shift(n)
        return (keys >> np.uint64(shift)).astype(np.int64), (keys & np.uint64((1 << shift) - 1)).astype(np.int64)

    def adjusted(self, n: int, ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What stands for the counts of n-grams at ranks: below the highest order the distinct words before them, if any."""
        if n == self.m.order:
            return counts
        before = self.stats(n, ranks)[0]
        return np.where(before > 0, before, counts)

    def shorter(self, n: int, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The number or rank of what n-grams are without their first word."""
        if n == 2:
            return tokens
        inner = self.shorter(n - 1, *self.parts(n - 1, self.tables[n - 1].keys_at(contexts)))
        return self.tables[n - 1].lookup(self.key(n - 1, inner, tokens))[0]

    def contexts(self, order: int, tokens: np.ndarray, before: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each n from 2: n, the number or rank of each token's context (-1: none), its n-gram's rank (-1: none) and count.
        The last, for `order`, has no ranks and counts if that order is not counted yet."""
        context = before
        for n in range(2, order + 1):
            at, counts = np.full(len(tokens), -1, dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
            some = context >= 0
            if n in self.tables:
                at[some], counts[some] = self.tables[n].lookup(self.key(n, context[some], tokens[some]))
            yield n, context, at, counts
            context = np.empty_like(at)
            context[1:] = at[:-1]
            context[starts] = -1

    def log10(self, tokens: np.ndarray, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
        m, pairs = self.m, self.m.rows(2)
        a = self.stats(1, tokens)[0]
        p = np.maximum(a - self.d[1][np.minimum(a, 3)], 0) / max(1, pairs) + (self.left if pairs else 1.0) / (m.vocabulary + 2)
        for n, context, at, counts in self.contexts(m.order, tokens, before, starts):
            d, c, after = self.d[n], self.adjusted(n, at, counts), self.stats(n - 1, context)[1:]
            total = np.maximum(after[0], 1)
            spare = (d[1] * after[1] + d[2] * after[2] + d[3] * after[3]) / total
            p = np.where(after[0] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + spare * p, p)
        return np.log10(p)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return bounded(docs.select(F.col(f"`{text}`").cast("string").alias("__text")))


def fit(docs: DataFrame, text: str = "text", folder: str | None = None, order: int = 2) -> Model:
    """Counts all texts of docs and writes the model's arrays to a folder in the shared one."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    folder = folder or scratch(spark, "lm")
    n = shuffle_partitions(spark)
    bits = max(0, (2 * n - 1).bit_length())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added(batches, lambda view, offsets: word_hashes(view, offsets)[0], lambda keys: keys >> np.uint64(63 - bits))

    done = _write_shards(_texts(docs, text).mapInArrow(count_words, "p int, key long, c long"), folder, "words", 1 << bits)
    nothing = (0, 0, np.zeros((2, 0), dtype="<i8").tobytes())
    shards = [done.get(p, nothing) for p in range(1 << bits)]
    model = Model(folder, [s[0] for s in shards], bits, order)
    model.texts = docs.count()
    model.tokens = sum(s[1] for s in shards) + model.texts
    for level in range(2, order + 1):
        shards = _count(docs, text, model, level, shards)
    for level in range(order, 1, -1):
        _gather(spark, model, level)
    model.stage += 1
    return model


def _count(docs: DataFrame, text: str, model: Model, level: int, below: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Counts and writes the n-grams of one order; below and the result: rows, tokens and the commonest of each shard."""
    n, shift = shuffle_partitions(docs.sparkSession), model.shift(level)
    if model.rows(level - 1).bit_length() + shift > 63:
        raise ValueError(f"{model.rows(level - 1)} contexts of order {level} and {shift} bits of a word do not fit into a key")
    tops = [np.frombuffer(s[2], dtype="<i8").reshape(2, -1) for s in below]
    ends = model.texts if level == 2 else 0
    model.cuts[level] = _splits([s[1] for s in below], [s[0] for s in below], tops, model.tokens, ends, max(4 * n, -(-model.tokens // PER_SHARD)), FIRST if level == 2 else 0, shift, model.rows(1))
    model.stage += 1
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)

        def keys(view, offsets) -> np.ndarray:
            hashes, bounds = word_hashes(view, offsets)
            tokens, before, starts = with_ends(own.numbers(hashes)[0], bounds)
            *_, (_, context, _, _) = own.contexts(level, tokens, before, starts)
            some = context >= 0
            return own.key(level, context[some], tokens[some])

        return _added(batches, keys, lambda keys: np.searchsorted(own.m.cuts[level], keys, side="right"))

    parts = len(model.cuts[level]) + 1
    done = _write_shards(_texts(docs, text).mapInArrow(count, "p int, key long, c long"), model.folder, f"grams{level}", parts)
    shards = [done.get(p, (0, 0, np.zeros((2, 0), dtype="<i8").tobytes())) for p in range(parts)]
    model.sizes[level] = [s[0] for s in shards]
    return shards


def _gather(spark: SparkSession, model: Model, level: int) -> None:
    """From the n-grams of one order the dense arrays of what is one word shorter, and counts of counts."""
    n, folder, space, parts = shuffle_partitions(spark), model.folder, model.rows(level - 1), len(model.sizes[level])
    width = model.widths[level - 1] = min(RANGE, max(LEAST_RANGE, -(-space // n)))
    ranges = -(-space // width)
    model.stage += 1
    sent = spark.sparkContext.broadcast(model)

    def cut(rows: np.ndarray) -> dict[int, bytes]:
        """Bytes of columns by range; the first row is sorted."""
        found = np.unique(rows[0] // width)
        edges = [*np.searchsorted(rows[0], found * width).tolist(), rows.shape[1]]
        return {r: rows[:, i:j].astype("<i8").tobytes() for r, i, j in zip(found.tolist(), edges, edges[1:], strict=False)}

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)
        table = own.tables[level]
        for b in batches:
            for p in b.column(0).to_pylist():
                keys, counts = table._shard(p) if table.sizes[p] else (np.empty(0, "<u8"), np.empty(0, "<u4"))
                counts = own.adjusted(level, np.arange(table.starts[p], table.starts[p + 1]), counts.astype(np.int64))
                context, tokens = own.parts(level, keys)
                seen = cut(np.stack(np.unique(own.shorter(level, context, tokens), return_counts=True)))
                heads = np.flatnonzero(np.diff(context, prepend=-1))
                after = [np.add.reduceat(x, heads) if len(heads) else x for x in (counts, *((counts == k).astype(np.int64) for k in (1, 2)), (counts > 2).astype(np.int64))]
                followed = cut(np.stack([context[heads], *after]))
                # each range is named by one shard at least, so that none lacks its arrays
                rows = [(r, seen.get(r, b""), followed.get(r, b"")) for r in sorted({*seen, *followed, *range(p, ranges, parts)})]
                rows.append((-1 - p % 16, few(counts).astype("<i8").tobytes(), b""))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["r", "seen", "heads"])

    def gather(blobs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come sorted by range."""
        fs, root = fs_of(folder)
        fs.create_dir(root, recursive=True)
        now, dense, tally = None, None, np.zeros(5, dtype=np.int64)
        befores = np.zeros(5, dtype=np.int64)

        def close() -> None:
            nonlocal befores
            if now is not None:
                _save(folder, f"stats{level - 1}-{now:06d}", dense.astype("<i8"))
                befores = befores + few(dense[0])

        for b in blobs:
            for r, seen, heads in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if r < 0:
                    tally = tally + np.frombuffer(seen, dtype="<i8")
                    continue
                if r != now:
                    close()
                    now, dense = r, np.zeros((5, min(width, space - r * width)), dtype=np.int64)
                x = np.frombuffer(seen, dtype="<i8").reshape(2, -1)
                dense[0, x[0] - r * width] += x[1]
                x = np.frombuffer(heads, dtype="<i8").reshape(5, -1)
                dense[1:, x[0] - r * width] += x[1:]
        close()
        yield pa.RecordBatch.from_arrays([pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (tally, befores)], names=["tally", "befores"])

    blobs = spark.range(0, parts, numPartitions=min(n, parts)).mapInArrow(by_range, "r int, seen binary, heads binary")
    found = blobs.repartition(n, "r").sortWithinPartitions("r").mapInArrow(gather, "tally binary, befores binary").collect()  # a row for each partition
    total = lambda name: sum((np.frombuffer(x[name], dtype="<i8") for x in found), np.zeros(5, dtype=np.int64))
    model.few[level] = total("tally")
    if level == 2:
        model.few[1] = total("befores")


def scorer(model: Model) -> Scorer:
    """One for each model in a worker process, so that maps stay open."""
    return hold(("lm", model.folder, model.stage), lambda: Scorer(model))


SCORES = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())]


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then SCORES: log10 probabilities of the whole text, and perplexity by token."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(*x) for x in SCORES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)
        m = own.m
        end_count = m.texts
        distinct = m.vocabulary + (m.texts > 0)
        for b in slices(batches, holds=True):
            hashes, bounds = word_hashes(*text_buffers(b.column(len(keep))))
            ids, counts = own.numbers(hashes)
            tokens, before, starts = with_ends(ids, bounds)
            c = np.full(len(tokens), end_count, dtype=np.int64)
            c[tokens != END] = counts
            n = np.diff(np.append(starts, len(tokens)))
            base = np.add.reduceat(np.log10((c + 1) / (m.tokens + distinct + 1)), starts)
            logs = np.add.reduceat(own.log10(tokens, before, starts), starts)
            made = [n, np.add.reduceat((c > 0).astype(np.int64), starts), np.full(len(n), m.tokens), base, logs, 10 ** (-logs / n)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(x) for x in made)], names=schema.names)

    chosen = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(free_name(keep)))
    return bounded(chosen).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
