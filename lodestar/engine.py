"""The library's entry points over tables of pages: extract, crawl, search, code graph, ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import codegraph, crawl, pages, search, text
from lodestar.operators.collection import Collection
from lodestar.plans.planner import Request, ResultCache, execute
from lodestar.session import let_workers_import
from lodestar.sources import html


@dataclass
class Filters:
    """Conditions on hits; each counts if it is given."""

    domain: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    has_code: bool | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.domain is not None:
            df = df.filter(F.col("domain") == self.domain)
        if self.date_from is not None:
            df = df.filter(F.col("crawled_at") >= F.lit(self.date_from).cast("timestamp"))
        if self.date_to is not None:
            df = df.filter(F.col("crawled_at") <= F.lit(self.date_to).cast("timestamp"))
        if self.has_code is not None:
            df = df.filter(F.col("has_code") == self.has_code)
        for k, v in self.metadata.items():
            df = df.filter(F.try_element_at("metadata", F.lit(k)) == v)
        return df


class Engine:
    """All tools over one session. Results are lazy DataFrames."""

    def __init__(self, spark: SparkSession, dims: int = 64, embedder: Callable[[DataFrame, int, str], DataFrame] = text.embed):
        """embedder: (rows with an id column and text, dimensions, the id's name) to (id, embedding); any model can take its place."""
        self.spark, self.dims, self.cache, self.embedder = let_workers_import(spark), dims, ResultCache(), embedder

    def extract(self, stored: DataFrame) -> DataFrame:
        """Records of pages (page_id, url, html)."""
        return html.extracted(stored)

    def crawl(self, start: str, stored: DataFrame, depth: int = 3, max_pages: int = 50, same_domain: bool = True) -> DataFrame:
        """(url, depth, page_id) of stored pages that links reach from a URL, by levels; only http and https are followed."""
        links = self.extract(stored).select(F.col("url").alias("src"), F.explode("links").alias("dst")).filter("dst LIKE 'http://%' OR dst LIKE 'https://%'")
        if same_domain:
            links = links.filter(pages.host("dst") == pages.host(F.lit(start)))
        known = links.join(stored.select(F.col("url").alias("dst")), "dst", "left_semi")
        found = crawl.frontier(self.spark.createDataFrame([(start,)], "node string"), known, depth, max_pages)
        return found.select(F.col("node").alias("url"), "depth").join(stored.select("url", "page_id"), "url", "left")

    def sources(self, crawled: DataFrame) -> DataFrame:
        """Domains with their numbers of pages, the largest first."""
        return crawled.groupBy("domain").agg(F.count("*").alias("pages"), F.max("crawled_at").alias("last_crawled")).orderBy(F.col("pages").desc(), "domain")

    def index(self, docs: DataFrame, folder: str) -> Collection:
        """A stored collection of documents (doc_id, text, ...): embedded once, with previews and string metadata as payload."""
        metadata = [c for c in ("domain", "lang", "source") if c in docs.columns]
        c = Collection(self.spark, folder, {"content": self.dims}, ", ".join(["preview string", *(f"{m} string" for m in metadata)]))
        vectors = self.embedder(docs, self.dims, "doc_id").withColumnsRenamed({"doc_id": "id", "embedding": "content"})
        kept = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, html.PREVIEW).alias("preview"), *metadata)
        c.upsert(kept.join(vectors, "id"))
        return c

    def ask(self, question: str, index: Collection, k: int = 10, threshold: float = 0.0, filters: dict[str, str] | None = None, rows: int = 0, offset: int = 0) -> DataFrame:
        """(id, score, rank, preview) of the nearest stored documents. The plan chooses exact or two-stage search by `rows`, the
        collection's size; results that are worth it are kept."""
        filters = filters or {}
        request = Request("vector", k + offset, rows, tuple(sorted(filters.items())), f"{index.folder}#{index.newest}:{threshold}:{question}")

        def nearest(two_stage: bool):
            def run(_: dict, k: int) -> DataFrame:
                q = self.embedder(self.spark.createDataFrame([(0, question)], "vec_id long, text string"), self.dims, "vec_id")
                where = None
                for name, value in filters.items():
                    where = F.col(name) == value if where is None else where & (F.col(name) == value)
                return index.search({"content": q}, k, where=where, threshold=threshold, two_stage=two_stage)

            return run

        def limited(made: dict, n: int) -> DataFrame:
            return made["rows"].filter((F.col("rank") > offset) & (F.col("rank") <= n)).join(index.points("preview"), "id").select("id", "score", "rank", "preview")

        return self.cache.run(request, lambda p: execute(p, {"knn": nearest(False), "two_stage_search": nearest(True), "limit": limited}))

    def rag_query(self, question: str, docs: DataFrame, k: int = 10, threshold: float = 0.0, filters: Filters | None = None, offset: int = 0) -> DataFrame:
        """(doc_id, score, rank, preview) of the nearest documents (doc_id, text, ...) of a table that has no index; see `ask`."""
        kept = filters.apply(docs) if filters else docs
        q = self.embedder(self.spark.createDataFrame([(0, question)], "vec_id long, text string"), self.dims, "vec_id")
        vectors = self.embedder(kept.select(F.col("doc_id").alias("vec_id"), "text"), self.dims, "vec_id")
        hits = search.knn(q, vectors, k + offset, threshold=threshold).withColumnRenamed("vec_id", "doc_id").filter(F.col("rank") > offset)
        return hits.join(kept.select("doc_id", F.substring("text", 1, html.PREVIEW).alias("preview")), "doc_id").select("doc_id", "score", "rank", "preview")

    def search_code(self, blocks: DataFrame, keyword: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
        """Code blocks (page_id, language, content, created_at) by language and keyword, the newest first."""
        if language is not None:
            blocks = blocks.filter(F.col("language") == language)
        if keyword is not None:
            blocks = blocks.filter(F.col("content").contains(keyword))
        return blocks.orderBy(F.col("created_at").desc(), "page_id").limit(limit)

    def code_blocks(self, records: DataFrame, created_at: str = "crawled_at") -> DataFrame:
        return records.select("page_id", F.col(created_at).alias("created_at"), F.explode("code_blocks").alias("b")).select("page_id", "created_at", "b.*")

    def build_code_graph(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of files (repository, path, text)."""
        columns = ["repository", "path", "name", "element_type", "line"]
        py = codegraph.python_elements(files.filter("path LIKE '%.py'")).select(*columns)
        rs = codegraph.rust_elements(files.filter("path LIKE '%.rs'")).select(*columns)
        return codegraph.graph(py.unionByName(rs))

    def validate_script(self, script: DataFrame, nodes: DataFrame) -> DataFrame:
        known = nodes.select("name", F.lower("label").alias("element_type"))
        return codegraph.validate(codegraph.python_elements(script), known)

    def query_graph(self, nodes: DataFrame, edges: DataFrame, sql: str, limit: int = 100) -> DataFrame:
        """SQL over the views nodes and edges, always limited."""
        nodes.createOrReplaceTempView("nodes")
        edges.createOrReplaceTempView("edges")
        return self.spark.sql(sql).limit(limit)

    def sql(self, statement: str, **tables: DataFrame) -> DataFrame:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(statement)
