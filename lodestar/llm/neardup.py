"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

A document's set is that of its word shingles' 64-bit hashes; its sketch are the KEPT least: whole where the set fits,
else their upper 32 bits. Documents of equal sets (size and two sums of 64 bits) form a class, represented by its least id.

Inverted lists: a list for each run of RUN neighbouring retained values, so that a list has the few
documents that agree on a stretch of the hash order instead of all that have one common shingle. Of two
sets with a Jaccard of 0.8 and full sketches, the odds of no common run are 0.8^64; for sets that fit
into the sketch a common run is certain, given the shorter runs that small sets add (at most 15 values:
3; at most 5: 2), because I common values fall into at most U - I + 1 stretches.

Pairs come from the lists in two steps, neither of which emits all pairs of a list. First each member is
paired with the list's least member, its leader, and with the one before it, so pairs grow with members. The
union-sketch estimate drops pairs that are far off (SIGMAS standard deviations below the threshold), exact
Jaccard on full sets confirms the others, and links make components. Then come lists of at least four
members that still hold several components; a pair inside one component needs no check, as components
cannot change by it. In lists under WIDE members, members of different components are compared by their
sketches inside the task, and pairs near the threshold go on, each from one list only. Wider lists are
searched exactly without pairs: each member is written as its difference from the list's centre (shingles it adds,
shingles it lacks), in which the threshold bounds the size of the symmetric difference of two members. Two
members that may be linked though not both are linked with the centre share one of the first few elements of their
differences (prefix filter), at positions from which the overlap can still be reached (positional filter). Elements are
ordered by how many of the centre's members hold them, counted over all, the rarest first: what a passage or a frequent
word pair puts into many differences comes last and pairs nobody. What passes is confirmed on full sets. So no candidate
is dropped by a cap.

Where rows meet: a list that would fill a task (found on a 64th of the documents, which only decides where rows
go) is dealt over several, and its pieces count as wide, whose members need not meet; a document with many partners
meets them TOGETHER at a time. Sketches and texts travel to pairs, each as often as it has pairs, and are not written.

Components come from alternating large-star and small-star rounds on links between representatives, each
round written to the shared folder.

Defined results: a text with fewer words than a shingle has its whole sequence as one shingle; null and
empty texts and those of white space have an empty set, are linked with nothing and are their own
component; rows with a null id are linked with nothing and have a null component; rows that share an id are
documents of their own, each with its own set, links and component, which is still named by the least id in it; repeated
rows give equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._spark import bounded, free_name, materialize, shuffle_partitions, slices, text_buffers
from lodestar.llm.features import mix, words

#: Values in a sketch; neighbouring values in a list's key.
KEPT, RUN = 64, 4
#: Shorter runs for small sets: (largest set, run).
SHORT = ((15, 3), (5, 2))
#: Words in a shingle and the least similarity in percent, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Members from which a list counts as wide, and dimensions that sketch values are hashed to where members are compared.
WIDE, DIMS = 48, 2048
#: Rows of a few numbers up to which a table is broadcast; partners that a document meets in one task.
FEW, TOGETHER = 200_000, 500
#: Standard deviations of the estimate that a pair may lie under the threshold.
SIGMAS = 4.5


def reach(percent: int, kept: int) -> float:
    """The least estimate that is worth a look."""
    t = percent / 100
    return t - SIGMAS * (t * (1 - t) / kept) ** 0.5


def shingle_sets(view, offsets: list[int], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, bounds = words(view, offsets)
    n = len(hashes)
    rolled = hashes.copy()
    for j in range(1, size):
        rolled[: n - j] = mix(rolled[: n - j] * np.uint64(0x9E3779B97F4A7C15) + hashes[j:])
    out = []
    for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if j - i >= size:
            out.append(np.unique(rolled[i : j - size + 1]))
        elif j > i:
            h = np.array([j - i], dtype=np.uint64)
            for k in range(i, j):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + 1])
            out.append(h)
        else:
            out.append(hashes[:0])
    return out


def _column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def sketches(docs: DataFrame, key: str, text: str, size: int, kept: int) -> DataFrame:
    """(id, n, s1, s2, sketch) of each row: the set's size, two sums that stand for it, its least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(*text_buffers(b.column(1)), size)
            s1 = [int(mix(s).sum().astype(np.int64)) if len(s) else 0 for s in sets]
            s2 = [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)) if len(s) else 0 for s in sets]
            least = [s.astype("<u8") if len(s) <= kept else np.unique((s[:kept] >> np.uint64(32)).astype("<u4")) for s in sets]
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _column([x.tobytes() for x in least])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "sketch"])

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return bounded(chosen).mapInArrow(run, "id long, n long, s1 long, s2 long, sketch binary")


def tops(sketch: bytes, n: int, kept: int) -> np.ndarray:
    """Upper 32 bits of a sketch's values, ascending, for a set of n."""
    return (np.frombuffer(sketch, dtype="<u8") >> np.uint64(32)).astype("<u4") if n <= kept else np.frombuffer(sketch, dtype="<u4")


def run_keys(sketch: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Keys of the lists that a set belongs to."""
    out, sketch = [], sketch.astype(np.uint64)
    for length in (run, *(r for most, r in SHORT if n <= most)):
        if len(sketch) >= length:
            h = np.full(len(sketch) - length + 1, length, dtype=np.uint64)
            for j in range(length):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[j : len(sketch) - length + 1 + j])
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _lists(reps: DataFrame, kept: int) -> DataFrame:
    """(key, id, n) for each list that a representative belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            keys = [run_keys(tops(s, n, kept), n) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            times = [len(k) for k in keys]
            if sum(times):
                columns = [np.concatenate(keys).astype(np.int64), np.repeat(b.column(0).to_numpy(), times), np.repeat(b.column(1).to_numpy(), times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n"])

    return reps.select("id", "n", "sketch").mapInArrow(run, "key long, id long, n long")


def _crowded(reps: DataFrame, kept: int, every: int = 64) -> dict[int, int]:
    """Lists that may hold a quarter of a task's rows or more, by key, and over how many tasks to deal each.

    Counted on one document in `every`: only where rows go follows from it. At most four keys a task.
    """
    least = max(16, reps.count() // (4 * shuffle_partitions(reps.sparkSession)))
    some = _lists(reps.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), kept).groupBy("key").agg(F.count("*").alias("m"))
    return {r.key: 1 + r.m // least for r in some.filter(F.col("m") >= least).collect()}


def _near_in_lists(lists: DataFrame, percent: int, crowded: dict[int, int]) -> DataFrame:
    """Members of lists with two or more: (key, id, n, leader, near: whether sizes allow a link with it, previous if sizes
    allow one, m: the list's members, wide: whether they are WIDE or more, or lie in several tasks).

    Rows come sorted by key and id; rows wait for the end of their list or for WIDE of them, so a task holds a batch whatever the list.
    """
    piece = F.lit(0).cast("long")
    if crowded:
        parts = lists.sparkSession.createDataFrame(list(crowded.items()), "key long, parts int")
        lists = lists.join(F.broadcast(parts), "key", "left")
        piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")) + 1, piece)
    near = lists.select("key", "id", "n", piece.alias("piece")).repartition(shuffle_partitions(lists.sparkSession), "key", "piece").sortWithinPartitions("key", "piece", "id")
    names = ["key", "id", "n", "leader", "near", "previous", "m", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        held = (none, none, none, none)  # rows of a list whose end has not come
        open_list = None  # of a wide list that goes on: key, piece, leader, its size, the row before, its size

        def out(rows: tuple, goes_on: bool) -> Iterator[pa.RecordBatch]:
            """What whole lists give, and the rows so far of the last one if it is wide and goes on."""
            nonlocal open_list
            key, ids, n, piece = rows
            if not len(key):
                return
            new = np.empty(len(key), dtype=bool)
            new[0] = open_list is None or (key[0], piece[0]) != open_list[:2]
            new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
            starts = np.flatnonzero(np.append(True, new[1:]))
            sizes = np.diff(np.append(starts, len(key)))
            lead, lead_n = np.repeat(ids[starts], sizes), np.repeat(n[starts], sizes)
            prev, prev_n = np.append(ids[:1], ids[:-1]), np.append(n[:1], n[:-1])
            m, wide = np.repeat(sizes, sizes), np.repeat(sizes >= WIDE, sizes) | (piece > 0)
            if not new[0]:
                lead[: sizes[0]], lead_n[: sizes[0]] = open_list[2:4]
                prev[0], prev_n[0] = open_list[4:]
                wide[: sizes[0]] = True
            if goes_on:
                wide[starts[-1] :] = True
                open_list = (key[-1], piece[-1], lead[-1], lead_n[-1], ids[-1], n[-1])
            many = (m > 1) | wide
            if not many.any():
                return
            fits = lambda o: ~new & (100 * np.minimum(n, o) >= percent * np.maximum(n, o))
            columns = [key, ids, n, lead, fits(lead_n), prev, m, wide]
            arrays = [pa.array(c[many]) for c in columns]
            arrays[5] = pa.array(prev[many], mask=~(fits(prev_n) & (prev != lead))[many])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            rows = tuple(np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            key, piece = rows[0], rows[3]
            first = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))[-1])
            if len(key) - first >= WIDE or (open_list is not None and first == 0 and (key[0], piece[0]) == open_list[:2]):
                yield from out(rows, True)
                held = tuple(x[:0] for x in rows)
            else:
                yield from out(tuple(x[:first] for x in rows), False)
                held = tuple(x[first:] for x in rows)
        yield from out(held, False)

    return near.mapInArrow(run, "key long, id long, n long, leader long, near boolean, previous long, m long, wide boolean")


def estimate(x: np.ndarray, y: np.ndarray, kept: int) -> float:
    """Jaccard from the bottom of the union of two sketches' upper bits."""
    both = np.sort(np.concatenate([x, y]))
    shared, union = both[1:][both[1:] == both[:-1]], np.unique(both)
    k = min(kept, len(union))
    return int((shared <= union[k - 1]).sum()) / k


def _table(df: DataFrame, tag: str) -> DataFrame:
    """df, written, and broadcast in joins if it has at most FEW rows."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.count() <= FEW else df


def _beside_first(pairs: DataFrame, source: DataFrame, prepare, work, made: str, most: int = 20_000) -> DataFrame:
    """work(a, a's value, b, b's value, the pair's further columns) for each pair (a, b, ...): rows of `made`, which leave `most` or so at a time.

    Values are what `prepare` makes of a batch of source's columns after id. That of a comes before those of the b that it is
    paired with, at most TOGETHER or so of them, so a task holds one at a time and no a has a long task.
    """
    spark = pairs.sparkSession
    more = [c for c in pairs.columns if c not in ("a", "b")]
    values = [c for c in source.columns if c != "id"]
    load = pairs.groupBy("a").agg((F.floor(F.count("*") / TOGETHER).cast("int") + 1).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    seconds = pairs.join(_table(load.filter("parts > 1"), "near-busy"), "a", "left").select(F.col("b").alias("id"), "a", "b", part, *more)
    nulls = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in more]
    firsts = load.select(F.col("a").alias("id"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *nulls)
    places = _table(firsts.unionByName(seconds), "near-places")
    rows = source.join(places, "id").select("a", "b", *more, *values, "part").repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    rows = bounded(rows.drop("part"))
    names = [x.split()[0] for x in made.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in made.split(", ")]
    width = 2 + len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
            out.clear()
            return made

        for batch in slices(batches, 500):
            found = prepare(*batch.columns[width:])
            for value, a, b, *rest in zip(found, *(batch.column(i).to_pylist() for i in range(width)), strict=True):
                if b is None:
                    own = value
                else:
                    out += work(a, own, b, value, rest)
                if len(out) > most:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, made)


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, kept: int) -> DataFrame:
    """(a, b, sure) of pairs whose estimate is within reach of the threshold; sure: sketches are whole sets and it holds."""
    least = reach(percent, kept)

    def prepare(n: pa.Array, sketch: pa.Array) -> list[tuple[int, bytes]]:
        return list(zip(n.to_pylist(), sketch.to_pylist(), strict=True))

    def work(a: int, x: tuple[int, bytes], b: int, y: tuple[int, bytes], _) -> list[tuple]:
        (n, s), (m, t) = x, y
        if n <= kept and m <= kept:
            shared = len(np.intersect1d(np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8"), assume_unique=True))
            return [(a, b, True)] if 100 * shared >= percent * (n + m - shared) else []
        return [(a, b, False)] if estimate(tops(s, n, kept), tops(t, m, kept), kept) >= least else []

    return _beside_first(pairs, reps.select("id", "n", "sketch"), prepare, work, "a long, b long, sure boolean")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("__text"))


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b) of pairs (a, b, sure) that hold on full sets, made again from the texts."""
    pairs = materialize(pairs, "near-estimated")

    def work(a: int, x: np.ndarray, b: int, y: np.ndarray, _) -> list[tuple]:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return [(a, b)] if 100 * shared >= percent * (len(x) + len(y) - shared) else []

    prepare = lambda texts: shingle_sets(*text_buffers(texts), size)
    doubtful = _beside_first(pairs.filter("NOT sure").select("a", "b"), _texts(docs, key, text), prepare, work, "a long, b long")
    return doubtful.unionByName(pairs.filter("sure").select("a", "b"))


def _mixed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, n, component) of lists from four to WIDE members that hold several components."""
    rows = lists.filter("NOT wide AND m >= 4").select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_key = rows.groupBy("key").agg(F.collect_list(F.struct("id", "n", "component")).alias("rows"), F.min("component").alias("x"), F.max("component").alias("y"))  # under WIDE rows
    return by_key.filter("x <> y").select("key", F.inline("rows"))


def _across(mixed: DataFrame, reps: DataFrame, percent: int, kept: int) -> DataFrame:
    """Pairs (a, b) of different components in lists under WIDE members, whose sketches come near the threshold.

    A pair is named in the least of the lists that both are in only.
    """
    asked = _table(mixed.select("id").distinct(), "near-asked")
    near = reps.select("id", "sketch").join(asked, "id", "left_semi")
    rows = mixed.select("key", "id", "component", "n").join(near, "id").select("key", "id", "component", "n", "sketch")
    rows = rows.repartition(shuffle_partitions(reps.sparkSession), "key").sortWithinPartitions("key", "id")
    least = reach(percent, kept)

    def compare(key: int, members: list[list]) -> list[tuple[int, int]]:
        ids, comp, n = (np.array([m[i] for m in members]) for i in range(3))
        sk = [tops(m[3], m[2], kept) for m in members]
        hashed = np.zeros((len(members), DIMS), dtype=np.float32)
        for i, s in enumerate(sk):
            np.add.at(hashed[i], (s % np.uint32(DIMS)).astype(np.int64), 1)
        small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        # The dot product of hashed sketches is at least the number of shared values.
        fits = np.triu((hashed @ hashed.T >= np.floor(least * np.minimum(small, kept))) & (comp[:, None] != comp[None, :]) & (100 * small >= percent * large), 1)
        out, keys = [], {}
        for i, j in np.argwhere(fits).tolist():
            if estimate(sk[i], sk[j], kept) >= least:
                for x in (i, j):
                    if x not in keys:
                        keys[x] = run_keys(sk[x], int(n[x])).astype(np.int64)
                if np.intersect1d(keys[i], keys[j]).min() == key:
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], names=["a", "b"])

        for b in slices(batches, 4000):
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != now:
                    if members:
                        out += compare(now, members)
                    now, members = key, []
                members.append(row)
            yield batch()
            out = []
        if members:
            out += compare(now, members)
        yield batch()

    return rows.mapInArrow(run, "a long, b long")


def difference(c: np.ndarray, z: np.ndarray, percent: int) -> tuple[np.ndarray, bool, int, int]:
    """What z adds to c, then what it lacks; whether z is linked with c; how much of it counts to probe with, and to be found by.

    With w = (100 - percent) / (100 + percent), sets x, y are linked iff |x ^ y| <= w (|x| + |y|). For differences D from c,
    x ^ y = Dx ^ Dy, so linked ones overlap in o >= (|Dx| + |Dy| - w (|x| + |y|)) / 2. As |Dy| >= |Dx| - |x ^ y|, o >= |Dx| - w (|x| + |y|), and
    |y| <= 100 |x| / percent. If x is not linked with c, |Dx| > w (|x| + |c|) and |y| - |c| <= |Dy| give o > (1 - w) |Dy| / 2. Of n ordered
    elements with an overlap of o, one that is shared is among the first n - o + 1.
    """
    d = np.concatenate([np.setdiff1d(z, c, assume_unique=True), np.setdiff1d(c, z, assume_unique=True)])
    part, whole = 100 - percent, 100 + percent
    linked = whole * len(d) <= part * (len(c) + len(z))
    probe = min(len(d), part * (100 + percent) * len(z) // (whole * percent) + 1)
    found = min(probe, len(d) - (whole - part) * len(d) // (2 * whole))
    return d, linked, probe, found


def _stars(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(a: centre, b: member, component) of wide lists that hold several components.

    A centre is a document that shares much with a list's members, so that differences from it are short; it
    need not be in the list itself. Each list proposes the member that most wide lists have, each member takes
    the commonest proposal of its lists, and a list's centre is the commonest choice of its members: a group of near
    copies has one centre or a few, and each member one difference for each. Lists are only counted and named, by sums that tasks
    make before they meet; members keep the keys of their lists (one for each run of a sketch at most) in one row.
    """
    rows = lists.filter("wide").select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_id = materialize(rows.groupBy("id", "component").agg(F.collect_list("key").alias("keys")), "near-wide")
    each = by_id.select("id", "component", F.size("keys").alias("times"), F.explode("keys").alias("key"))
    by_key = each.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("times", (-F.col("id")).alias("minus"))).alias("most"))
    proposed = _table(by_key.filter("x <> y").select("key", (-F.col("most.minus")).alias("choice")), "near-proposed")
    taken = materialize(each.join(proposed, "key").groupBy("id", "component").agg(F.collect_list("key").alias("keys"), F.mode("choice", True).alias("choice")), "near-taken")
    votes = taken.select(F.explode("keys").alias("key"), "choice").groupBy("key", "choice").agg(F.count("*").alias("votes"))
    centres = votes.groupBy("key").agg((-F.max(F.struct("votes", (-F.col("choice")).alias("minus")))["minus"]).alias("centre"))
    members = taken.select("id", "component", F.explode("keys").alias("key")).join(_table(centres, "near-centres"), "key")
    return members.filter("centre <> id").select(F.col("centre").alias("a"), F.col("id").alias("b"), "component").distinct()


def _rarest(members: DataFrame) -> DataFrame:
    """(a, id, n, d, component, probe, found, pos, element): of each difference, the elements at its first places that another has too.

    Its order is by the number of the centre's members whose differences hold an element, then by element. Elements that no
    other has come first: they take places, but no rows, as they pair nothing. Any order that a centre's members share keeps
    the bounds of `difference`.
    """
    own = ["a", "id", "n", F.size("elements").alias("d"), "component", "probe", "first", "found"]
    each = members.select(*own, F.explode("elements").alias("element"))
    common = _table(each.groupBy("a", "element").agg(F.count("*").alias("held")).filter("held > 1"), "near-common")
    shared = each.join(common, ["a", "element"]).groupBy("a", "id", "n", "d", "component", "probe", "first", "found").agg(F.sort_array(F.collect_list(F.struct("held", "element"))).alias("shared"))
    alone = F.col("d") - F.size("shared")
    within = shared.withColumn("alone", alone).withColumn("shared", F.slice("shared", 1, F.greatest(F.col("first") - alone, F.lit(0)).cast("int")))
    placed = within.select("a", "id", "n", "d", "component", "probe", "found", "alone", F.posexplode("shared").alias("k", "e"))
    return placed.select("a", "id", "n", "d", "component", "probe", "found", (F.col("alone") + F.col("k")).alias("pos"), "e.element")


def _apart_from_centres(stars: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (a, b, sure) of different components in wide lists: links with the lists' centres, and what the filters leave."""

    def work(a: int, c: np.ndarray, b: int, z: np.ndarray, rest: list) -> list[tuple]:
        d, linked, probe, found = difference(c, z, percent)
        return [(a, b, len(z), rest[0], not linked, found if linked else probe, found, d.astype(np.int64))]

    made = "a long, id long, n long, component long, probe boolean, first long, found long, elements array<long>"
    prepare = lambda texts: shingle_sets(*text_buffers(texts), size)
    members = materialize(_beside_first(stars, _texts(docs, key, text), prepare, work, made, 100), "near-differences")
    rows = materialize(_rarest(members), "near-rarest")
    x, y = rows.filter("probe").alias("x"), rows.filter("pos < found").alias("y")
    part, whole = 100 - percent, 100 + percent
    near = F.expr(  # of two that both probe, the lesser id does
        f"x.a = y.a AND x.element = y.element AND x.component <> y.component AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" AND 2 * least(x.d - x.pos, y.d - y.pos) >= x.d + y.d - ({part} * (x.n + y.n)) div {whole} AND (NOT y.probe OR x.id < y.id)"
    )
    found = x.join(y, near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.lit(False).alias("sure")).distinct()
    linked = members.filter("NOT probe").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.lit(True).alias("sure"))
    return found.unionByName(linked)


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) for every id that a link (a, b) has; component: the least id reachable."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag)
    while True:
        # Done when each node has one edge, to a node that has none: what is left are stars.
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        busy = edges.select(F.col("v").alias("u")).distinct().join(parents.select("u"), "u", "left_semi")
        if parents.filter("n > 1").select("u").unionByName(busy).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = materialize(small, tag)
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _grouped(docs: DataFrame, rows: DataFrame, key: str, text: str, size: int, percent: int, kept: int) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row of sketches; ids that are not null are distinct."""
    full = rows.filter("n > 0 AND id IS NOT NULL")
    reps = materialize(full.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "near-classes")
    lists = materialize(_near_in_lists(_lists(reps, kept), percent, _crowded(reps, kept)), "near-lists")
    ordered = lambda c: [F.least(c, "id").alias("a"), F.greatest(c, "id").alias("b")]
    pairs = lists.filter("near").select(*ordered("leader")).unionByName(lists.filter("previous IS NOT NULL").select(*ordered("previous"))).distinct()
    links = materialize(_confirmed(_estimated(materialize(pairs, "near-pairs"), reps, percent, kept), docs, key, text, size, percent), "near-links")
    found = materialize(components(links), "near-components")
    mixed = materialize(_mixed(lists, found), "near-mixed")
    more = materialize(_across(mixed, reps, percent, kept).withColumn("sure", F.lit(False)), "near-across")
    stars = materialize(_stars(lists, found), "near-stars")
    if not stars.isEmpty():
        more = more.unionByName(_apart_from_centres(stars, docs, key, text, size, percent)).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    new = materialize(_confirmed(more, docs, key, text, size, percent), "near-new-links")
    if not new.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
    classes = reps.join(found, "id", "left").filter("copies > 1 OR component IS NOT NULL").select("n", "s1", "s2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    own = F.col("id").isNotNull() & (F.col("n") > 0)
    pick = lambda c: F.when(own, F.coalesce(c, "id")).otherwise(F.col("id")).alias(c)
    return out.select("id", F.col("n").alias("n_shingles"), pick("class_id"), pick("component_id"))


def _repeats(rows: DataFrame) -> bool:
    """Whether rows share an id."""
    return not rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty()


def _by_row(docs: DataFrame, key: str, row: str) -> DataFrame:
    """docs, written, with a number for each row that has an id."""
    return materialize(docs.withColumn(row, F.when(F.col(f"`{key}`").cast("long").isNotNull(), F.monotonically_increasing_id())), "near-rows")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle_words: int = WORDS, percent: int = PERCENT, kept: int = KEPT) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row: equal sets share a class, linked ones a component."""
    rows = materialize(sketches(docs, key, text, shingle_words, kept), "near-sketches")
    if not _repeats(rows):
        return _grouped(docs, rows, key, text, shingle_words, percent, kept)
    numbered = _by_row(_texts(docs, key, text), "id", "__row")
    rows = materialize(sketches(numbered, "__row", "__text", shingle_words, kept), "near-sketches")
    found = _grouped(numbered, rows, "__row", "__text", shingle_words, percent, kept).filter("id IS NOT NULL").withColumnRenamed("id", "__row")
    found = materialize(found.join(numbered.select("id", "__row"), "__row"), "near-found")
    for c in ("class_id", "component_id"):
        least = found.groupBy(F.col(c).alias("__g")).agg(F.min("id").alias("__least"))
        found = found.join(least, F.col(c) == F.col("__g")).withColumn(c, F.col("__least")).drop("__g", "__least")
    nulls = rows.filter("id IS NULL").select(F.col("id"), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return found.select("id", "n_shingles", "class_id", "component_id").unionByName(nulls)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, shingle_words=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle_words: int = WORDS, percent: int = PERCENT, kept: int = KEPT) -> DataFrame:
    """One row of each group of near duplicates, with its columns as they were: that of the least id.

    Rows without words or id all stay. Rows that share an id are documents of their own: unlike texts both stay; of copies
    that share the group's least id the one whose number of a first pass over the rows is least.
    """
    rows = materialize(sketches(docs, key, text, shingle_words, kept), "near-sketches")
    name = free_name(docs.columns, "__row")
    if _repeats(rows):
        docs = _by_row(docs, key, name)
        rows = materialize(sketches(docs, name, text, shingle_words, kept), "near-sketches")
        found = _grouped(docs, rows, name, text, shingle_words, percent, kept).filter("n_shingles > 0 AND id IS NOT NULL").select("id", F.col("component_id").alias("c"))
        found = materialize(found.join(docs.select(F.col(name).alias("id"), F.col(f"`{key}`").cast("long").alias("__key")), "id"), "near-found")
        best = found.groupBy("c").agg(F.min(F.struct("__key", "id"))["id"].alias("best"))
        gone = found.join(best, "c").filter("id <> best").select("id")
    else:
        found = _grouped(docs, rows, key, text, shingle_words, percent, kept)
        docs = docs.withColumn(name, F.col(f"`{key}`").cast("long"))
        gone = found.filter("id <> component_id").select("id")
    gone = materialize(gone.select(F.col("id").alias("__gone")), "near-gone")
    few = gone.count() <= 1_000_000
    return docs.join(F.broadcast(gone) if few else gone, docs[name] == gone["__gone"], "left_anti").drop(name)
