"""All queries of the library outside its llm subpackage, and their SQL."""

from __future__ import annotations

from lodestar import registry
from lodestar.operators import cluster, codegraph, collection, crawl, extra, pages, search, storage, text  # noqa: F401  (each registers its queries)
from lodestar.streaming import events  # noqa: F401

FLAGSHIP = "vector_knn"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
