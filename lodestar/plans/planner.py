"""Query plans: which steps a request takes, what it is expected to cost, whether its result is kept.

Only what Catalyst cannot know is decided here: a two-stage vector search instead of an exact one, a rerank
step, whether a result is worth persisting. Steps are DataFrame operations; Catalyst orders what is inside.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

# Caps of text and code retrieval, the limit from which results are reranked, the policy of the cache.
TEXT_CAP, CODE_CAP, RERANK_FROM = 200, 100, 50
HIT_RATE, SLOW_MS, TTL_S, MOST = 0.3, 500.0, 3600.0, 1000


@dataclass(frozen=True)
class Request:
    kind: str  # vector, text, hybrid, code or analytics
    limit: int = 10
    rows: int = 0
    filters: tuple[tuple[str, str], ...] = ()
    subject: str = ""  # what is asked, of what


@dataclass(frozen=True)
class Step:
    name: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    cost: float
    expected: int | None
    key: str


def cost(r: Request) -> float:
    """Linear in what a kind reads; a filter halves it."""
    base = {"vector": 1.0 + r.rows / 1e5, "text": 2.0 + r.rows / 5e4, "hybrid": 3.0 + r.rows / 3e4, "code": 1.5 + r.rows / 8e4, "analytics": 5.0 + r.rows / 1e4}
    return base[r.kind] * 0.5 ** len(r.filters)


def cache_key(r: Request) -> str:
    return hashlib.md5(json.dumps([r.kind, r.limit, r.rows, r.subject, sorted(r.filters)]).encode()).hexdigest()


def plan(r: Request) -> Plan:
    """The filter first, then retrieval, fusion, rerank and limit as the kind needs them."""
    steps = [Step("filter", dict(r.filters))] if r.filters else []
    if r.kind in ("vector", "hybrid"):
        steps.append(Step("two_stage_search" if r.rows > 1_000_000 else "knn", {"k": r.limit if r.kind == "vector" else max(r.limit, TEXT_CAP)}))
    if r.kind in ("text", "hybrid"):
        steps.append(Step("bm25", {"limit": min(TEXT_CAP, max(r.limit * 4, r.limit))}))
    if r.kind == "code":
        steps.append(Step("code_search", {"limit": min(CODE_CAP, r.limit * 4)}))
    if r.kind == "analytics":
        steps.append(Step("aggregate"))
    if r.kind == "hybrid":
        steps.append(Step("merge"))
    if r.kind in ("text", "hybrid") or (r.kind == "vector" and r.limit > RERANK_FROM):
        steps.append(Step("rerank"))
    if r.kind != "analytics":
        steps.append(Step("limit", {"n": r.limit}))
    return Plan(tuple(steps), cost(r), None if r.kind == "analytics" else r.limit, cache_key(r))


def execute(p: Plan, work: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """Runs the steps in order. work: by step a function of the results so far (by name, and `rows`: the newest) and the step's options.
    A step without one is passed over, as rerank is where no model reranks."""
    made: dict[str, DataFrame] = {}
    rows: DataFrame | None = None
    for s in p.steps:
        if s.name in work:
            rows = work[s.name](made | {"rows": rows}, **s.options)
            made[s.name] = rows
    if rows is None:
        raise ValueError("no step of the plan has work")
    return rows


@dataclass
class _Entry:
    result: DataFrame
    made: float
    used: float
    hits: int = 0


class ResultCache:
    """Persisted results by key, with a time to live; what is worth keeping is decided from past runs.

    Spark keeps blocks in memory and on disk and makes lost ones again from their lineage.
    """

    def __init__(self, most: int = MOST, ttl_s: float = TTL_S, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl_s, self.clock = most, ttl_s, clock
        self.entries: dict[str, _Entry] = {}
        self.runs: dict[str, tuple[int, int, float]] = {}  # runs, hits, total ms

    def worth(self, key: str) -> bool:
        """New, or often asked, or slow."""
        runs, hits, ms = self.runs.get(key, (0, 0, 0.0))
        return not runs or hits / runs >= HIT_RATE or ms / runs > SLOW_MS

    def record(self, key: str, hit: bool, ms: float) -> None:
        runs, hits, total = self.runs.get(key, (0, 0, 0.0))
        self.runs[key] = (runs + 1, hits + hit, total + ms)

    def get(self, key: str) -> DataFrame | None:
        found = self.entries.get(key)
        if found is None:
            return None
        if self.clock() - found.made > self.ttl_s:
            self.drop(key)
            return None
        found.hits, found.used = found.hits + 1, self.clock()
        return found.result

    def put(self, key: str, result: DataFrame) -> DataFrame:
        kept = result.persist(StorageLevel.MEMORY_AND_DISK)
        self.entries[key] = _Entry(kept, self.clock(), self.clock())
        if len(self.entries) > self.most:
            now = self.clock()
            by_use = sorted(self.entries, key=lambda k: self.entries[k].hits / max(1.0, now - self.entries[k].used))
            for k in by_use[: len(self.entries) - int(self.most * 0.8)]:
                self.drop(k)
        return kept

    def drop(self, key: str) -> None:
        if (found := self.entries.pop(key, None)) is not None:
            found.result.unpersist()

    def run(self, r: Request, make: Callable[[Plan], DataFrame]) -> DataFrame:
        """The kept result, or a new one."""
        p, start = plan(r), self.clock()
        found = self.get(p.key)
        out = found if found is not None else make(p)
        if found is None and self.worth(p.key):
            out = self.put(p.key, out)
        self.record(p.key, found is not None, (self.clock() - start) * 1000)
        return out
