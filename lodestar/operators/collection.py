"""Collections of points: upserts of named vectors with a payload, deletions, filtered and weighted search; stored pages over them.

A collection is a folder of segments, each a Parquet table that one write appends: points (id, payload columns, one
array<float> column for each named vector and its packed signs) or ids that are gone. The newest segment that names an id decides,
so an upsert moves only what it writes; `compact` folds all segments into one, partitioned by the payload column `partition`,
whose filters then prune folders; other filters reach the Parquet reader. Numbers of segments come from the driver, one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import vectors as V
from lodestar.operators import pages as P
from lodestar.operators import search
from lodestar.operators.storage import append_log, checked
from lodestar.registry import query, scratch, table


class Collection:
    """Points in a folder of the shared file system. vectors: name and dimensions of each named vector."""

    def __init__(self, spark: SparkSession, folder: str, vectors: dict[str, int], payload: str, partition: str | None = None):
        self.spark, self.folder, self.vectors, self.partition = spark, folder.rstrip("/"), vectors, partition
        self.payload = T._parse_datatype_string(payload)
        vector_fields = [f for v in vectors for f in (T.StructField(v, T.ArrayType(T.FloatType())), T.StructField(f"{v}_bits", T.BinaryType()))]
        self.schema = T.StructType([T.StructField("id", T.LongType()), *self.payload.fields, *vector_fields, T.StructField("gone", T.BooleanType()), T.StructField("segment", T.LongType())])
        self.newest = max(self._segments(), default=0)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def _segments(self) -> list[int]:
        path = self._path()
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in whole if n.startswith("part="))

    def _write(self, rows: DataFrame, split: bool = False) -> None:
        number = self.newest + 1
        out = rows.withColumn("segment", F.lit(number).cast("long")).select(*self.schema.names).write
        (out.partitionBy(self.partition) if split and self.partition else out).parquet(f"{self.folder}/part={number}")
        self.newest = number

    def upsert(self, points: DataFrame) -> None:
        """Points (id, payload columns, vectors); what is missing is null; of rows that share an id one is kept, the greatest."""
        have = {c: F.col(f"`{c}`") for c in points.columns}
        cols = [F.col("id").cast("long").alias("id"), *(have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.payload.fields)]
        for v, dims in self.vectors.items():
            vec = have.get(v, F.lit(None)).cast("array<float>")
            vec = F.when(F.size(vec) == dims, vec).when(vec.isNotNull(), F.raise_error(F.lit(f"{v} has not {dims} dimensions")))
            cols += [vec.alias(v), V.packed_bits(vec).alias(f"{v}_bits")]
        rows = points.filter("id IS NOT NULL").select(*cols)
        first = F.max(F.struct(*(c for c in rows.columns if c != "id")))
        one = rows.groupBy("id").agg(first.alias("p")).select("id", "p.*")
        self._write(one.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        rows = ids.select(F.col("id").cast("long").alias("id")).distinct()
        for f in self.schema.fields[1:-2]:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._write(rows.withColumn("gone", F.lit(True)))

    def points(self, *columns: str) -> DataFrame:
        """Current points, with the named columns or all."""
        names = [c for c in self.schema.names if c not in ("gone", "segment") and (not columns or c in ("id", *columns))]
        found = self._segments()
        if not found:
            return self.spark.createDataFrame([], T.StructType([self.schema[c] for c in names]))
        rows = None
        for n in found:
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder}/part={n}").select(*names, "gone", "segment")
            rows = part if rows is None else rows.unionByName(part)
        if len(found) > 1:
            # Only ids and segments meet; rows are then kept where they are the newest.
            last = rows.groupBy(F.col("id").alias("__id")).agg(F.max("segment").alias("__segment"))
            rows = rows.join(last, (F.col("id") == F.col("__id")) & (F.col("segment") == F.col("__segment")))
        return rows.filter("NOT gone").select(*names)

    def compact(self) -> None:
        """One segment of current points, partitioned; older ones go once it is whole."""
        old = self._segments()
        self._write(self.points().withColumn("gone", F.lit(False)), split=True)
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part={n}"), True)

    def info(self) -> DataFrame:
        """(points, vectors as JSON, segments)."""
        n = self.points("id").agg(F.count("*").alias("points"))
        return n.withColumn("vectors", F.lit(json.dumps(self.vectors))).withColumn("segments", F.lit(len(self._segments())))

    def search(self, queries: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, where: Column | None = None, threshold: float | None = None, two_stage: bool = False) -> DataFrame:
        """(query_id, id, score, rank): for each query (vec_id, embedding) of each named vector the best points that the
        filter leaves, scores above the threshold times weight, summed by query and id."""
        total = None
        for v, asked in queries.items():
            rows = self.points(v, f"{v}_bits", *(f.name for f in self.payload.fields))
            rows = rows.filter(where) if where is not None else rows
            rows = rows.filter(F.col(v).isNotNull()).select(F.col("id").alias("vec_id"), F.col(v).alias("embedding"), F.col(f"{v}_bits").alias("bits"))
            hits = search.two_stage(asked, rows, k) if two_stage else search.knn(asked, rows.drop("bits"), k)
            hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
            part = hits.select("query_id", F.col("vec_id").alias("id"), (F.col("score") * (weights or {}).get(v, 1.0)).alias("part"))
            total = part if total is None else total.unionByName(part)
        from pyspark.sql import Window

        summed = total.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class PageStore:
    """Stored pages: an append-only log of contents with checksums, a table of metadata, and vectors in a collection."""

    META = "page_id long, url string, domain string, content_length int, content_hash string, ordinal long"

    def __init__(self, spark: SparkSession, folder: str, dims: int):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.points = Collection(spark, f"{self.folder}/vectors", {"content": dims}, "url string, domain string", "domain")
        self.stored = 0

    def store(self, pages: DataFrame, vectors: DataFrame) -> None:
        """Appends pages (page_id, url, html) to the log, their metadata and vectors (id, content) to the tables. Ordinals follow
        page ids inside one call, and calls."""
        from lodestar.streaming.events import numbered

        content = F.coalesce("html", F.lit(""))
        rows = numbered(pages.select("page_id", "url", content.alias("content")), "page_id").withColumn("ordinal", F.col("number") + self.stored).drop("number")
        log = append_log(rows.select("ordinal", "page_id", "content"), "content", "ordinal").withColumn("appended_at", F.current_timestamp())
        log.write.mode("append").parquet(f"{self.folder}/log")
        meta = rows.select("page_id", "url", P.host("url").alias("domain"), F.octet_length("content").alias("content_length"), F.md5(F.col("content").cast("binary")).alias("content_hash"), "ordinal")
        meta.write.mode("append").parquet(f"{self.folder}/meta")
        self.points.upsert(meta.select(F.col("page_id").alias("id"), "url", "domain").join(vectors, "id", "left"))
        self.stored = self.spark.read.parquet(f"{self.folder}/log").agg(F.max("ordinal")).first()[0] + 1

    def log(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Entries by ordinal, in order, each with whether its checksum holds."""
        found = self.spark.read.parquet(f"{self.folder}/log").filter(F.col("ordinal") >= start)
        return checked(found if end is None else found.filter(F.col("ordinal") < end), "content").orderBy("ordinal")

    def get(self, ids: DataFrame) -> DataFrame:
        """(page_id, url, domain, content, embedding) of the asked pages (page_id): the newest metadata, the content at its ordinal."""
        meta = self.spark.read.parquet(f"{self.folder}/meta").join(ids.select("page_id").distinct(), "page_id", "left_semi")
        last = meta.groupBy("page_id").agg(F.max(F.struct("ordinal", "url", "domain")).alias("m")).select("page_id", "m.*")
        content = self.spark.read.parquet(f"{self.folder}/log").select("ordinal", "content")
        return last.join(content, "ordinal").join(self.points.points("content").select(F.col("id").alias("page_id"), F.col("content").alias("embedding")), "page_id", "left").drop("ordinal")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[Collection, DataFrame]:
    """The embeddings as points in two upserts, of which the second changes a third, and a deletion of a tenth."""
    emb = table(spark, sf_dir, "embeddings")
    c = Collection(spark, scratch(spark, "collection"), {"content": 64}, "label int, version int", "label")
    points = emb.select(F.col("vec_id").alias("id"), "label", F.lit(1).alias("version"), F.col("embedding").alias("content"))
    c.upsert(points)
    c.upsert(points.filter("id % 3 = 0").withColumn("version", F.lit(2)).withColumn("label", (F.col("label") + 1) % 10))
    c.delete(points.filter("id % 10 = 7").select("id"))
    return c, emb


_POINTS = "WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 7)"


@query(_POINTS + " SELECT id, CAST(label AS INTEGER) AS label, CAST(version AS INTEGER) AS version, round(v[1], 6) AS first FROM p")
def collection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection holds after upserts, a deletion and compaction."""
    c, _ = _labelled(spark, sf_dir)
    c.compact()
    return c.points().select("id", "label", "version", F.round(F.col("content")[0].cast("double"), 6).alias("first"))


@query(_POINTS + """ SELECT count(*) AS points, '{"content": 64}' AS vectors, CAST(3 AS INTEGER) AS segments FROM p""")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0].info()


@query(_POINTS + """, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, id, round(list_cosine_similarity(q, v), 9) AS score FROM q, p WHERE label IN (2, 3, 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score >= 0.1""")
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in points that a payload filter leaves, above a threshold."""
    c, emb = _labelled(spark, sf_dir)
    hits = c.search({"content": emb.filter("vec_id % 20 = 0")}, 5, where=F.col("label").isin(2, 3, 5), threshold=0.1)
    return hits.withColumn("score", F.round("score", 6))


@query("""SELECT page_id, url, strlen(html) AS n_bytes, md5(html) AS content_hash, v[1] IS NOT NULL AS has_vector, CAST(round(v[1], 6) AS DOUBLE) AS first
FROM pages LEFT JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) ON vec_id = page_id WHERE page_id % 20 = 0""")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to log, metadata and vectors in two calls, of which the second repeats some, and read back by id."""
    pages = table(spark, sf_dir, "pages")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("content"))
    store = PageStore(spark, scratch(spark, "pages"), 64)
    store.store(pages.withColumn("html", F.when(F.col("page_id") % 4 == 0, "old").otherwise(F.col("html"))), emb)
    store.store(pages.filter("page_id % 4 = 0"), emb)
    got = store.get(pages.filter("page_id % 20 = 0"))
    first = F.round(F.col("embedding")[0].cast("double"), 6)
    return got.select("page_id", "url", F.octet_length("content").cast("long").alias("n_bytes"), F.md5(F.col("content").cast("binary")).alias("content_hash"), first.isNotNull().alias("has_vector"), first.alias("first"))


@query("SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS ordinal, page_id, strlen(html) AS n_bytes, TRUE AS ok FROM pages QUALIFY ordinal >= 10 AND ordinal < 200")
def log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the log of stored pages by ordinal, checked on reading."""
    store = PageStore(spark, scratch(spark, "pages"), 64)
    pages = table(spark, sf_dir, "pages")
    store.store(pages, pages.select(F.col("page_id").alias("id"), F.lit(None).cast("array<float>").alias("content")))
    return store.log(10, 200).select("ordinal", "page_id", F.octet_length("content").cast("long").alias("n_bytes"), "ok")
