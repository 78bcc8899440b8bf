"""Document fingerprints by winnowing, with built-in functions only.

A text's words (runs of bytes other than 0x20 and 0x09 to 0x0D, as they are) are hashed; rolling k-grams of `k` words are
hashed from their words' hashes. In each window of `window` neighbouring k-grams the least hash is
chosen, of ties the rightmost, and kept with its position once. Two texts that share a run of at least
window + k - 1 words share a fingerprint (the match guarantee), and no run under k words is ever matched.

The order within a window is that of the hash's upper 32 bits; position and order are packed in one long,
so that the minimum is one `least` and distinct picks are one `array_distinct`. A text with at least one
but fewer than k words is one k-gram of all its words; one with fewer k-grams than a window has one window.

Neighbours in id order are found without a global sort of texts: ids fall into at most BUCKETS ranges of like numbers of rows,
whose bounds come from a sample of ids (of at most 32 a range; only where rows go follows from it). Each range sorts in one task, and
the first document of each range (one row a range, so that the side that is broadcast has a bound) is copied into the range before it.

Defined results: a null or empty text, or one of white space, has an empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0. Repeated rows are neighbours of each other, in the
order of their texts; a single document is its own next. Null ids form a range of their own, before all
others. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 4
#: Documents in a range of ids, about; and the most ranges.
IN_BUCKET, BUCKETS = 512, 65_536
_LAST = (1 << 31) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with array columns `out`_hash (longs) and `out`_pos (ints, the k-gram's first word), in order of position."""
    words, hashes, grams, packed, picks = (f"__{out}_{x}" for x in ("words", "hashes", "grams", "packed", "picks"))
    df = df.withColumn(words, F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    df = df.withColumn(hashes, F.when(F.element_at(words, 1) == "", F.array().cast("array<bigint>")).otherwise(F.transform(words, lambda w: F.xxhash64(w)))).drop(words)
    n = F.size(hashes)
    at = lambda a, i: F.get(F.col(a), i)
    rolling = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(at(hashes, i + j if j else i) for j in range(k))))
    short = F.array(F.xxhash64(F.col(hashes)))
    df = df.withColumn(grams, F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short).otherwise(rolling)).drop(hashes)
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(_LAST) - i.cast("long"))
    df = df.withColumn(packed, F.transform(grams, pack))
    m = F.size(packed)
    slide = F.transform(F.sequence(F.lit(0), m - window), lambda i: F.least(*(at(packed, i + j if j else i) for j in range(window))) if window > 1 else at(packed, i))
    best = F.when(m == 0, F.array().cast("array<bigint>")).when(m < window, F.array(F.array_min(packed))).otherwise(F.array_distinct(slide))
    df = df.withColumn(picks, best)
    place = lambda p: (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("int")
    df = df.withColumn(f"{out}_pos", F.transform(picks, place)).drop(packed, picks)
    return df.withColumn(f"{out}_hash", F.transform(f"{out}_pos", lambda p: at(grams, p))).drop(grams)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def digest(hashes: str, positions: str) -> Column:
    """A short name of a fingerprint, equal for equal hashes at equal positions."""
    return F.concat_ws("-", F.size(hashes).cast("string"), F.lower(F.hex(F.xxhash64(hashes))), F.lower(F.hex(F.xxhash64(F.lit(1), F.col(positions), F.col(hashes)))))


def _bounds(ids: DataFrame) -> list[int]:
    """Ids that cut all into ranges of like numbers of rows, from a sample with a bound."""
    n = ids.count()
    buckets = max(1, min(BUCKETS, -(-n // IN_BUCKET)))
    some = sorted(r[0] for r in ids.sample(min(1.0, 16 * buckets / max(1, n)), seed=7).limit(32 * buckets).collect())
    return sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []


def _above(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most the key, by halving; null for null."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(0))
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one constant
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        up = (at["lo"] < at["hi"]) & (F.get(held, mid) <= key)
        return F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(key.isNotNull(), F.aggregate(steps, start, halve, lambda at: at["lo"]))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text) in descending key order; after the last comes the first.

    Rows come range by range: each is in the partition of its range, sorted.
    """
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    bounds = _bounds(rows.select("__key").na.drop())
    rows = rows.withColumn("__bucket", F.coalesce(_above(bounds, F.col("__key")), F.lit(len(bounds) + 1)).cast("long"))
    # The first row of each range, and the range that comes before it in descending order; at most BUCKETS + 1 rows.
    heads = rows.groupBy("__bucket").agg(F.max("__key").alias("__head"))
    order = Window.orderBy(F.col("__bucket").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("__to", F.coalesce(F.lag("__bucket").over(order), F.last("__bucket").over(whole)))
    first = rows.join(F.broadcast(heads), (rows["__bucket"] == heads["__bucket"]) & rows["__key"].eqNullSafe(heads["__head"])).groupBy(heads["__to"]).agg(F.min("__text").alias("__text"))
    extra = first.select(F.lit(None).cast("long").alias("__key"), "__text", F.col("__to").alias("__bucket"), F.lit(1).alias("__guest"))
    together = rows.withColumn("__guest", F.lit(0)).unionByName(extra)
    return together.withColumn("__next", F.lead("__text").over(_in_order()))


def _in_order() -> Window:
    return Window.partitionBy("__bucket").orderBy("__guest", F.col("__key").desc_nulls_last(), "__text")


def edited(text: str, following: str, n: str) -> Column:
    """The last floor(n / 2) code points replaced by as many of the next text's first, or all it has."""
    half = F.floor(F.col(n) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.col(n) - half), F.substring(F.col(following), F.lit(1), half))


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = with_next(docs).withColumn("n_chars", F.char_length("__text"))
    df = with_fingerprint(df, "__text", "own")
    df = df.withColumn("next_hash", F.lead("own_hash").over(_in_order())).filter("__guest = 0")
    df = df.withColumn("edited", edited("__text", "__next", "n_chars")).drop("__text", "__next")
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = with_fingerprint(df, "edited", "new").drop("edited")
    return df.select(
        F.col("__key").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        digest("own_hash", "own_pos").alias("fingerprint"),
        digest("new_hash", "new_pos").alias("edited_fingerprint"),
        likeness("own_hash", "new_hash").alias("near_edited"),
        likeness("own_hash", "next_hash").alias("near_next"),
        F.size("own_hash").cast("long").alias("n_fingerprints"),
        F.col("own_hash").alias("hashes"),
        F.col("own_pos").alias("positions"),
    )
