"""Text operators: tokens, chunks, BM25, fusion of ranked lists, diversification, embedding by hashing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.hashes import xxh64
from lodestar.operators.search import knn
from lodestar.registry import query, table, written

# BM25 parameters, rank constant of the fusion, weights of the hybrid merge, prefixes of two public embedding models.
K1, B = 1.5, 0.75
RRF = 60
VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}


def tokens(text: Column | str) -> Column:
    """Lower-case tokens between white space and ASCII punctuation that have more than two bytes."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[\s\p{Punct}]"), lambda x: F.octet_length(x) > 2)


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[\\s[:punct:]]'), lambda x: strlen(x) > 2)"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of each term; one row a document and term is shuffled, not one a token."""
    per_doc = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf) of the asked terms in documents (doc_id, t: tokens), from one pass over them; written."""
    terms = asked.select("term").distinct()
    each = words.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
    return written(each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")


def bm25(docs: DataFrame, queries: DataFrame, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, query): the sum over query tokens (repeats count again) of
    idf tf (k1 + 1) / (tf + k1 (1 - b + b len / mean len)); scores that are not positive are dropped.

    Documents shrink to the query terms' postings before they are shuffled; these are written and serve both sums. The number of
    documents and their mean length are two numbers from a pass of their own.
    """
    # A generator of one row, so that tokens are made once though two expressions read them.
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(tokens(text))).alias("t"))
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).first()
    n, mean = float(stats.n), float(stats["mean"] or 1.0)
    found = postings(words, asked)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = found.join(asked.join(idf, "term"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


_BM25 = f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
l AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY doc_id, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY item_id, term),
s AS (SELECT q.query_id, p.doc_id, round(sum(times * ln((l.n - d.df + 0.5) / (d.df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * p.len / l.mean))), 6) AS score
      FROM q JOIN p USING (term) JOIN d USING (term), l GROUP BY q.query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""


@query(_BM25 + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 20)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items whose id is divisible by 20 as queries: the stated set."""
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def merge(vector: DataFrame, text: DataFrame) -> DataFrame:
    """(query_id, id, score) by full outer join of two lists; what a list lacks counts 0."""
    both = vector.select("query_id", "id", F.col("score").alias("v")).join(text.select("query_id", "id", F.col("score").alias("t")), ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", F.round(VECTOR_WEIGHT * F.coalesce("v", F.lit(0.0)) + TEXT_WEIGHT * F.coalesce("t", F.lit(0.0)), 12).alias("score"))


def fuse(lists: list[DataFrame]) -> DataFrame:
    """(query_id, id, score): the sum over lists (query_id, id, rank from 1) of 1 / (RRF + rank)."""
    union = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", "id", "rank"))
    return union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 8).alias("score"))


def diversify(ranked: DataFrame, group: str, position: str = "rank", by: str = "query_id") -> DataFrame:
    """The best row of each group within each query; rows without a group all stay."""
    first = F.row_number().over(Window.partitionBy(by, group).orderBy(position))
    return ranked.withColumn("__first", first).filter((F.col("__first") == 1) | F.col(group).isNull()).drop("__first")


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For ids divisible by 20: the nearest vectors of the vector of that id, and the BM25 hits of the item."""
    emb = table(spark, sf_dir, "embeddings")
    v = knn(emb.filter("vec_id % 20 = 0"), emb, 20).withColumnRenamed("vec_id", "id")
    t = bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 20).withColumnRenamed("doc_id", "id")
    return v, t


_LISTS = _BM25 + """,
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a, e b WHERE a.vec_id % 20 = 0),
vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 20),
tl AS (SELECT query_id, doc_id AS id, score, rank FROM r WHERE rank <= 20)"""


@query(_LISTS + " SELECT query_id, id, round(0.7 * coalesce(vl.score, 0) + 0.3 * coalesce(tl.score, 0), 12) AS score FROM vl FULL OUTER JOIN tl USING (query_id, id)")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_two_lists(spark, sf_dir))


@query(_LISTS + " SELECT query_id, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM vl UNION ALL SELECT query_id, id, rank FROM tl) GROUP BY query_id, id")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(list(_two_lists(spark, sf_dir)))


@query(_BM25 + """, g AS (SELECT r.query_id, r.doc_id, r.rank, d.source FROM r JOIN documents d USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS f FROM g) WHERE f = 1""")
def diversify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = bm25(docs, _asked(spark, sf_dir), 20).join(docs.select("doc_id", "source"), "doc_id")
    return diversify(hits, "source").select("query_id", "doc_id", "rank", "source")


def preprocess(text: Column | str, lowercase: bool = True, strip_accents: bool = False, most: int = 512) -> Column:
    """Trimmed, in lower case, without accents, cut at `most` characters; each but the first as asked."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    c = F.lower(c) if lowercase else c
    c = without_accents(c) if strip_accents else c
    return F.substring(c, 1, most)


def without_accents(text: Column) -> Column:
    """Canonical decomposition without combining marks (Arrow batches; no built-in function decomposes)."""

    @F.pandas_udf("string")
    def strip(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return strip(text)


@query("SELECT doc_id, substr(lower(trim(text)), 1, 512) AS cleaned FROM documents")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preprocess("text").alias("cleaned"))


@query("SELECT item_id, substr(strip_accents(lower(trim(text))), 1, 512) AS cleaned FROM benchmark")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", preprocess("text", strip_accents=True).alias("cleaned"))


def with_prefix(text: Column | str, model: str, is_query: bool) -> Column:
    return F.concat(F.lit(PREFIXES[model][0 if is_query else 1]), F.col(text) if isinstance(text, str) else text)


@query("SELECT item_id, concat('query: ', text) AS e5, text AS bge FROM benchmark")
def model_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", with_prefix("text", "e5", True).alias("e5"), with_prefix("text", "bge", False).alias("bge"))


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, variant): the query and, for each of its words with a synonym (word, synonym), the query with all places of the word replaced."""
    words = queries.withColumn("word", F.explode(F.array_distinct(F.split("query", r"\s+"))))
    swapped = words.join(synonyms, F.lower("word") == F.col("synonyms_word")).select("query_id", F.replace("query", F.col("word"), F.col("synonym")).alias("variant"))
    return queries.select("query_id", F.col("query").alias("variant")).unionByName(swapped).distinct()


@query("""
WITH s(word, synonym) AS (VALUES ('the', 'this'), ('of', 'from'), ('the', 'that')),
q AS (SELECT item_id, text FROM benchmark),
w AS (SELECT DISTINCT item_id, text, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM q)
SELECT item_id AS query_id, text AS variant FROM q
UNION SELECT item_id, replace(text, w.word, s.synonym) FROM w JOIN s ON lower(w.word) = s.word""")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = spark.createDataFrame([("the", "this"), ("of", "from"), ("the", "that")], "synonyms_word string, synonym string")
    return expand(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), synonyms)


def chunk(text: str | None, size: int = 256, overlap: int = 50, separator: str = " ") -> list[str]:
    """Whole text if it has at most `size` bytes; else runs of words under `size` bytes (a word counts with its
    separator), each begun with the last words of the one before that fit into `overlap` bytes."""
    if not text:
        return []
    if len(text.encode()) <= size:
        return [text]
    room = len(separator.encode())
    out, held, used = [], [], 0
    for word in text.split(separator):
        cost = len(word.encode()) + room
        if held and used + cost > size:
            out.append(separator.join(held))
            kept, used = [], 0
            for w in reversed(held):
                if used + len(w.encode()) + room > overlap:
                    break
                kept.append(w)
                used += len(w.encode()) + room
            held = kept[::-1]
        held.append(word)
        used += cost
    if held:
        out.append(separator.join(held))
    return out


def chunks(docs: DataFrame, size: int = 256, overlap: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_order, chunk_text, chunk_size in bytes), one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                found = [chunk(t, size, overlap) for t in part.column(1).to_pylist()]
                ids = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = [c for f in found for c in f]
                order = [k for f in found for k in range(len(f))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), pa.array(order, pa.int32()), pa.array(flat, pa.string()), pa.array([len(c.encode()) for c in flat], pa.int32())], names=[id_col, "chunk_order", "chunk_text", "chunk_size"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{id_col} {kind}, chunk_order int, chunk_text string, chunk_size int")


# A run is found from where it begins: words up to `size` bytes in all, by sums of their costs.
@query("""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents WHERE strlen(text) > 256),
s AS (SELECT doc_id, words, list_transform(words, lambda w: strlen(w) + 1) AS costs FROM d),
p AS (SELECT doc_id, words, list_transform(range(1, len(costs) + 1), lambda i: list_sum(costs[1:i])) AS ends FROM s),
r(doc_id, k, first, last) AS (
SELECT doc_id, 0, 1, greatest(1, len(list_filter(ends, lambda x: x <= 256))) FROM p
UNION ALL SELECT doc_id, k + 1, first, greatest(prev + 1, len(list_filter(ends, lambda x: x <= 256 + CASE WHEN first > 1 THEN ends[first - 1] ELSE 0 END))) FROM (
SELECT r.doc_id, k, last AS prev, ends, greatest(r.first, CASE WHEN ends[last] > 50 THEN 2 + len(list_filter(ends, lambda x: x < ends[last] - 50)) ELSE 1 END) AS first FROM r JOIN p USING (doc_id) WHERE last < len(ends)))
SELECT doc_id, k AS chunk_order, array_to_string(words[first:last], ' ') AS chunk_text, CAST(strlen(array_to_string(words[first:last], ' ')) AS INTEGER) AS chunk_size FROM r JOIN p USING (doc_id)
UNION ALL SELECT doc_id, 0, text, CAST(strlen(text) AS INTEGER) FROM documents WHERE strlen(text) BETWEEN 1 AND 256""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(table(spark, sf_dir, "documents"))


def embed(docs: DataFrame, dims: int = 64, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, embedding): signed feature hashing of tokens, of length 1; a stand-in for a transformer.

    Tokens are hashed in the JVM and folded in Arrow batches, row by row, so nothing is shuffled. Null texts and those
    without tokens are zero vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                n, sizes = part.num_rows, part.column(1).value_lengths().fill_null(0).to_numpy()
                h = part.column(1).flatten().to_numpy()
                slot = np.repeat(np.arange(n), sizes) * dims + h % dims
                x = np.bincount(slot, np.where((h >> 33) & 1, -1.0, 1.0), n * dims).astype(float).reshape(n, dims)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(x.reshape(-1).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[id_col, "embedding"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.transform(tokens(text), lambda t: F.xxhash64(t)).alias("h")).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


_EMBED = f"""w AS (SELECT kind, id, term, count(*) AS n FROM (SELECT kind, id, unnest({_TOKENS}) AS term FROM x) GROUP BY ALL),
k AS ({xxh64('(SELECT DISTINCT term FROM w)')}),
g AS (SELECT kind, id, CAST(h & 63::UHUGEINT AS BIGINT) AS slot, sum(CASE WHEN (h >> 33) & 1::UHUGEINT = 1 THEN -n ELSE n END) AS c FROM w JOIN k USING (term) GROUP BY ALL),
z AS (SELECT kind, id, unnest(range(64)) AS slot FROM x),
m AS (SELECT kind, id, list(CAST(coalesce(c, 0) AS DOUBLE) ORDER BY slot) AS c, greatest(sqrt(CAST(sum(coalesce(c, 0) * coalesce(c, 0)) AS DOUBLE)), 1e-12) AS size FROM z LEFT JOIN g USING (kind, id, slot) GROUP BY kind, id),
e AS (SELECT kind, id, list_transform(c, lambda y: CAST(y / size AS FLOAT)) AS embedding FROM m)"""


@query(f"WITH x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents), {_EMBED} SELECT id AS doc_id, embedding FROM e")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(table(spark, sf_dir, "documents"))


@query(f"""WITH x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark WHERE item_id % 20 = 0), {_EMBED},
v AS (SELECT kind, id, CAST(embedding AS DOUBLE[]) AS v FROM e),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM v q, v d WHERE q.kind = 'q' AND d.kind = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.05 AND NOT isnan(score))
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, source, substr(text, 1, 500) AS preview FROM r JOIN documents USING (doc_id) WHERE rank <= 5""")
def rag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest documents of each query, by hashed embeddings, with previews."""
    docs = table(spark, sf_dir, "documents")
    asked = embed(_asked(spark, sf_dir), id_col="query_id", text="query").withColumnRenamed("query_id", "vec_id")
    hits = knn(asked, embed(docs).withColumnRenamed("doc_id", "vec_id"), 5, threshold=0.05)
    hits = hits.withColumn("score", F.round("score", 6))
    return hits.join(docs.select(F.col("doc_id").alias("vec_id"), "source", F.substring("text", 1, 500).alias("preview")), "vec_id").withColumnRenamed("vec_id", "doc_id")
