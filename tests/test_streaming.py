"""Streams run to the end of what has landed and agree with their batch twins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.engine import Engine, Filters
from lodestar.streaming import events as S


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landed"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for lo in (0, 400, 800):
        rows.filter(f"event_id >= {lo} AND event_id < {lo + 400}").coalesce(1).write.mode("append").parquet(folder)
    return folder


def _batch(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_counters(spark, sf_dir, landed, tmp_path):
    got = S.drain(S.counters(S.as_sync(S.read_events(spark, landed))), str(tmp_path), "update", ["key"])
    want = S.counters(S.as_sync(_batch(spark, sf_dir)))
    assert {tuple(r) for r in got.select("key", "value").collect()} == {tuple(r) for r in want.collect()}


def test_dedup_and_hourly(spark, sf_dir, landed, tmp_path):
    got = S.drain(S.without_repeats(S.read_events(spark, landed), late="1000 days"), str(tmp_path / "d"))
    assert got.count() == 1000
    hours = S.drain(S.hourly(S.read_events(spark, landed)), str(tmp_path / "h"))
    want = {(r.hour, r.event_type): r.n for r in S.hourly(_batch(spark, sf_dir)).collect()}
    assert hours.count() > 0 and all(want[(r.hour, r.event_type)] == r.n for r in hours.collect())


def test_throttle(spark, sf_dir, landed, tmp_path):
    from lodestar.operators.crawl import Politeness, admission

    got = S.drain(S.throttled(S.read_events(spark, landed, 10), 1 / 3600, 2), str(tmp_path))
    want = admission(_batch(spark, sf_dir), "user_id", "ts", "event_id", Politeness(1 / 3600, 2))
    assert {(r.event_id, r.admitted_us) for r in got.collect()} == {(r.event_id, r.admitted_us) for r in want.select("event_id", "admitted_us").collect()}


def test_index_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    assert S.index_stream(stream, str(tmp_path / "out")) == {"total": 3, "success": 1, "failed": 2}


def test_engine(spark, sf_dir):
    e = Engine(spark)
    pages = spark.createDataFrame([(1, "http://a.example/", "<a href='/b'>b</a><a href='http://c.example/'>c</a>"), (2, "http://a.example/b", "<pre><code>x</code></pre>"), (3, "http://c.example/", "")], "page_id long, url string, html string")
    assert {(r.url, r.depth) for r in e.crawl("http://a.example/", pages).collect()} == {("http://a.example/", 0), ("http://a.example/b", 1)}
    assert e.crawl("http://a.example/", pages, same_domain=False).count() == 3
    blocks = e.code_blocks(e.extract(pages).withColumn("crawled_at", F.current_timestamp()))
    assert [r.page_id for r in e.search_code(blocks, "x").collect()] == [2]
    docs = spark.createDataFrame([(1, "apple banana cherry", "d"), (2, "quantum physics lecture", "d"), (3, None, "x")], "doc_id long, text string, domain string")
    assert e.rag_query("banana cherry", docs, 1, 0.1).first().doc_id == 1
    assert e.rag_query("banana cherry", docs, 1, 0.1, Filters(domain="x")).count() == 0
    files = spark.createDataFrame([("r", "a.py", "def f(x):\n  pass\n"), ("r", "b.rs", "fn g() {}\n")], "repository string, path string, text string")
    nodes, edges = e.build_code_graph(files)
    assert {r.name for r in nodes.filter("label = 'Function'").collect()} == {"f", "g"}
    assert e.query_graph(nodes, edges, "SELECT * FROM edges", 2).count() == 2
    script = spark.createDataFrame([("r", "s.py", "def f(a):\n  pass\ndef h(b):\n  pass\n")], "repository string, path string, text string")
    assert [(r.valid, r.names) for r in e.validate_script(script, nodes).collect()] == [(False, "h")]
