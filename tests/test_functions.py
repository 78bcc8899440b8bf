"""Literal cases, and invariants on random vectors."""

from __future__ import annotations

import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.functions import vectors as V
from lodestar.functions.hashes import crc32, xxh64
from lodestar.operators import cluster, codegraph, crawl, search, storage, text
from lodestar.operators.collection import Collection
from lodestar.plans.planner import Request, ResultCache, plan
from lodestar.sources import html as H


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def _v(*x):
    return F.array(*(F.lit(float(a)) for a in x))


def test_vector_literals(spark):
    r = _one(spark, same=V.cosine(_v(1, 0), _v(1, 0)), apart=V.cosine(_v(1, 0), _v(0, 1)), zero=V.cosine(_v(0, 0), _v(1, 0)), far=V.euclidean(_v(0, 0, 0), _v(3, 4, 0)), keep=V.unit(_v(0, 0)), agree=V.agreement(_v(1, 1, 1, 1, -1, -1, -1, -1), _v(1, 1, -1, -1, -1, -1, -1, -1)))
    assert (r.same, r.apart, r.zero, r.far, r.keep, r.agree) == (1.0, 0.0, 0.0, 5.0, [0.0, 0.0], 0.75)


def test_bits_round_trip(spark):
    v = [0.5, -1.0, 0.1, -0.2, 3.0, -4.0, 0.0, 9.0, 1.0]
    r = spark.createDataFrame([(v,)], "v array<double>").select(V.packed_bits("v").alias("b")).select("b", V.unpacked_signs("b", 9).alias("s")).first()
    assert bytes(r.b) == np.packbits(np.array(v) > 0, bitorder="little").tobytes()
    assert r.s == [1.0 if x > 0 else -1.0 for x in v]


def test_knn_small(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = search.knn(rows.filter("vec_id = 0"), rows, 2).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 2]
    assert search.knn(rows, rows, 0).count() == 0
    assert search.knn(rows.filter("vec_id > 9"), rows, 2).count() == 0


def test_kmeans_groups(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((5, 0), 0.1, (20, 2)), rng.normal((0, 5), 0.1, (20, 2))])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in cluster.assign(rows, cluster.kmeans(rows, 2)).collect()}
    assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[39]
    mean, w = cluster.whitening(rows, 2)
    assert np.allclose(np.cov(((x - mean) @ w).T), np.eye(2), atol=1e-8)


@pytest.mark.parametrize(("size", "overlap"), [(50, 10), (20, 5), (40, 15)])
def test_chunks_cover(size, overlap):
    t = "the quick brown fox jumps over the lazy dog and runs away from the big bear in the wood"
    got = text.chunk(t, size, overlap)
    assert len(got) > 1 and all(len(c) <= size for c in got)
    seen = iter(t.split())
    rest = next(seen)
    for c in got:
        for w in c.split():
            if w == rest:
                rest = next(seen, None)
    assert rest is None
    assert text.chunk("short", 50) == ["short"] and text.chunk(None) == []


def test_preprocess(spark):
    assert _one(spark, t=text.preprocess(F.lit("  HELLO Wörld! Café  "), strip_accents=True)).t == "hello world! cafe"


def test_html_record():
    page = "<html lang=en><head><title>T</title><meta property='og:title' content='OG'><meta name=description content=D><meta name=keywords content='a, b,'><script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"N\",\"offers\":{\"price\":5}}</script></head><body><h1>Head</h1><p>One <b>two</b><p><a href='/x#y'>link</a><img src=i.png><ul><li>a<li>b</ul><pre><code>x = 1\ny</code></pre><script>no</script></body></html>"
    r = H.extract(page, "https://h.example/d/")
    assert (r["title"], r["description"], r["keywords"], r["images"], r["links"]) == ("OG", "D", ["a", "b"], ["i.png"], ["https://h.example/x#y"])
    assert r["code_blocks"] == [{"language": None, "content": "x = 1\ny", "line_count": 2}]
    assert "no" not in r["text"].split() and r["markdown"].startswith("# Head\n\nOne **two**\n\n[link](/x#y)")
    assert "- a\n- b" in r["markdown"] and list(r["structured_data"]) == ["json_ld_0"]
    assert H.extract(None, None)["title"] == "Untitled"
    assert [n.tag for n in H.select(H.parse("<div class='a b' id=z><p>x</p></div>"), "div.a#z p")] == ["p"]


def test_products_and_articles(spark):
    page = "<title>t</title><script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"N\",\"brand\":{\"name\":\"B\"},\"offers\":{\"price\":5,\"priceCurrency\":\"EUR\"}}</script><p>" + "word " * 300
    rec = H.extracted(spark.createDataFrame([(1, "http://a.example/", page), (2, "http://b.example/", None)], "page_id long, url string, html string"))
    p = H.products(rec).collect()
    assert [(x.page_id, x.name, x.brand, x.price, x.currency) for x in p] == [(1, "N", "B", 5.0, "EUR")]
    a = H.articles(rec).collect()
    assert [(x.page_id, x.reading_time) for x in a] == [(1, 1)]


def test_fences(spark):
    t = "a\n```py\nx = 1\n```\nb\n```\n\n```\n```\nopen"
    assert H.fenced_blocks(t) == ["x = 1"]
    assert _one(spark, f=H.fenced(F.lit(t))).f == ["x = 1"]


def test_robots(spark):
    texts = spark.createDataFrame([("h", crawl.ROBOTS), ("e", "User-agent: a\nUser-agent: b\nDisallow: /x\nCrawl-delay: 3")], "host string, text string")
    rules = {r.host: r for r in crawl.robots_rules(texts, "b").collect()}
    assert (rules["h"].allow, rules["h"].disallow, rules["h"].crawl_delay, rules["h"].sitemap) == (["/en/4"], ["/en/", "/*.html$"], 2, "https://a.example/s.xml")
    assert (rules["e"].disallow, rules["e"].crawl_delay) == (["/x"], 3)
    cases = [("/a/b.html", "/*.html$", True), ("/a/b.html?x", "/*.html$", False), ("/ab", "/a", True), ("/b", "/a", False), ("/x/y/z", "/x/*/z", True), ("/a+b", "/a+b", True)]
    for path, pattern, want in cases:
        assert _one(spark, r=F.regexp_like(F.lit(path), crawl.pattern_regex(F.lit(pattern)))).r is want


def test_admission_is_a_bucket(spark):
    rng = np.random.default_rng(2)
    times = np.sort(rng.integers(0, 60_000_000, 200)).tolist()
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "k long, i long, t long").withColumn("ts", F.timestamp_micros("t"))
    for policy in (crawl.DEFAULT, crawl.POLITE, crawl.AGGRESSIVE):
        got = [r.admitted_us for r in crawl.admission(rows, "k", "ts", "i", policy).orderBy("i").collect()]
        assert got == crawl.replay(times, policy)


def test_frontier_budget(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in crawl.frontier(start, edges, 5).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.node for r in crawl.frontier(start, edges, 5, budget=2).collect()} == {"a", "b"}


def test_rust_scan():
    src = 'mod m {\n  #[inline]\n  pub fn f() { let s = "fn no() {"; }\n  pub(crate) struct S;\n  impl S { fn g() {} }\n}\n// fn c() {}\nenum E { A }\n'
    got = [(e["name"], e["element_type"], e["parent"], e["visibility"], e["line"]) for e in codegraph.scan_rust(src)]
    assert got == [("m", "module", None, "private", 1), ("f", "function", "m", "pub", 3), ("S", "struct", "m", "pub(crate)", 4), ("E", "enum", None, "private", 8)]


def test_backup(spark, tmp_path):
    rows = spark.range(10).withColumn("at", F.col("id").cast("string"))
    storage.backup(rows, str(tmp_path / "b"))
    storage.backup(rows, str(tmp_path / "b"), "incremental", "7", "at")
    found = storage.backups(spark, str(tmp_path / "b")).collect()
    assert [(r.kind, r.rows) for r in found] == [("incremental", 2), ("full", 10)]
    assert all(storage.verify(spark, r.path) for r in found)
    spark.range(1).withColumn("at", F.lit("x")).write.mode("append").parquet(f"{found[0].path}/data")
    assert not storage.verify(spark, found[0].path)


def test_planner(spark):
    assert [s.name for s in plan(Request("hybrid", 10, 5, (("domain", "d"),))).steps] == ["filter", "knn", "bm25", "merge", "rerank", "limit"]
    assert [s.name for s in plan(Request("vector", 60)).steps] == ["knn", "rerank", "limit"]
    now = [0.0]
    cache = ResultCache(most=2, ttl_s=10, clock=lambda: now[0])
    made = []
    for _ in range(2):
        cache.run(Request("text"), lambda p: made.append(p) or spark.range(3)).count()
    assert len(made) == 1
    now[0] = 11
    cache.run(Request("text"), lambda p: made.append(p) or spark.range(3))
    assert len(made) == 2
    for k in range(3):
        cache.put(str(k), spark.range(1))
    assert len(cache.entries) <= 2


def test_deep_pages():
    deep = "<div>" * 3000 + "<p>end</p>" + "</div>" * 3000
    assert H.extract(deep, None)["markdown"] == "end"
    assert H.extract("<b>" * 3000 + "x", None)["text"] == "x"
    assert "x" in H.extract("<p>" + "<b>" * 3000 + "x", None)["markdown"]
    lists = "<ul><li>a" * 1500 + "z"
    lines = H.extract(lists, None)["markdown"].split("\n")
    assert len(lines) == 1500 and lines[-1].endswith("- az")
    assert H.extract("<script type='application/ld+json'>" + "[" * 100_000 + "</script>", None)["structured_data"] == {}
    assert H.extract("<title>t</title><a href=/x>y</a>", "http://h.example/", frozenset({"links"})) == {"links": ["http://h.example/x"]}


def test_recipes_and_fences(spark):
    page = '<script type="application/ld+json">{"@type":"Recipe","name":"Soup","recipeIngredient":["water","salt"],"totalTime":"PT5M"}</script>'
    rec = H.extracted(spark.createDataFrame([(1, "http://a.example/", page), (2, "u", "<p>x")], "page_id long, url string, html string"), fields=("structured_data",))
    assert [tuple(r) for r in H.recipes(rec).collect()] == [(1, "http://a.example/", "Soup", ["water", "salt"], "PT5M")]
    assert [_one(spark, f=H.has_fence(F.lit(t))).f for t in ("a\n```\nb", "a ```b", None)] == [True, False, False]


def test_knn_ties_nulls_and_packed_signs(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 70)))
    rows = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    bits = rows.select("vec_id", V.packed_bits("embedding").alias("bits"))
    plain = search.knn(rows.filter("vec_id < 9"), rows, 20, "binary")
    packed = search.knn(bits.filter("vec_id < 9"), bits, 20, "binary", vec="bits", dims=70)
    want = set()
    for q in range(9):
        score = [round(float(((x[q] > 0) == (v > 0)).mean()), 9) for v in x]
        want |= {(q, c, r + 1) for r, c in enumerate(sorted(range(300), key=lambda c: (-score[c], c))[:20])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in plain.collect()} == {(r.query_id, r.vec_id, r["rank"]) for r in packed.collect()} == want
    full = search.similarity_matrix(rows.filter("vec_id < 3"), rows).collect()
    assert len(full) == 900 and all(r.score == 1.0 for r in full if r.a == r.b)


def test_embed_folds_as_plain_code(spark):
    import xxhash

    texts = ["alpha beta alpha gamma", "", None, "one, two; three four"]
    got = {r.doc_id: r.embedding for r in text.embed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(16)
        for w in (w for w in re.split(r"[\s\W]", (t or "").lower()) if len(w) > 2):
            h = xxhash.xxh64_intdigest(w, 42)
            signed = h - 2**64 if h >> 63 else h
            v[signed % 16] += -1.0 if (h >> 33) & 1 else 1.0
        assert np.allclose(got[i], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)


def test_collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", {"title": 2, "body": 3}, "domain string, year int", "domain")
    assert c.points().count() == 0
    point = "id long, domain string, year int, title array<float>, body array<float>"
    c.upsert(spark.createDataFrame([(1, "a", 2020, [1.0, 0.0], [1.0, 0.0, 0.0]), (2, "b", 2021, [0.0, 1.0], None), (None, "x", 1, None, None)], point))
    c.upsert(spark.createDataFrame([(2, "b", 2022, [0.0, 1.0], [0.0, 0.0, 1.0]), (3, "a", 2020, [1.0, 1.0], [1.0, 1.0, 0.0]), (3, "a", 2019, [1.0, 1.0], None)], point))
    assert {(r.id, r.year) for r in c.points("year").collect()} == {(1, 2020), (2, 2022), (3, 2020)}
    q = {"title": spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>"), "body": spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")}
    hits = c.search(q, 3, {"title": 0.25, "body": 0.75}).orderBy("rank").collect()
    assert [(r.id, r.score) for r in hits] == [(2, 0.75), (1, 0.25), (3, pytest.approx(0.25 * 0.5**0.5, abs=1e-8))]
    assert [r.id for r in c.search(q, 3, where=F.col("domain") == "a", two_stage=True).orderBy("rank").collect()] == [1, 3]
    c.delete(spark.createDataFrame([(1,)], "id long"))
    c.compact()
    again = Collection(spark, f"file://{tmp_path}/c", {"title": 2, "body": 3}, "domain string, year int", "domain")
    assert {r.id for r in again.points("domain").collect()} == {2, 3} and again.info().first().segments == 1
    with pytest.raises(Exception, match="dimensions"):
        again.upsert(spark.createDataFrame([(5, "a", 1, [1.0], None)], point))


def test_backups_are_retained(spark, tmp_path):
    for _ in range(4):
        storage.backup(spark.range(5), str(tmp_path / "b"), keep=2)
    assert storage.backups(spark, str(tmp_path / "b")).count() == 2
    storage.delete_backup(spark, storage.backups(spark, str(tmp_path / "b")).first().path)
    assert storage.backups(spark, str(tmp_path / "b")).count() == 1


def test_engine_asks_its_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple banana cherry", "d"), (2, "quantum physics lecture", "d"), (3, None, "x")], "doc_id long, text string, domain string")
    e = Engine(spark)
    index = e.index(docs, f"file://{tmp_path}/i")
    for rows in (0, 2_000_000):  # exact, then two-stage
        r = e.ask("banana cherry", index, 1, 0.1, rows=rows).collect()
        assert [(x.id, x["rank"], x.preview) for x in r] == [(1, 1, "apple banana cherry")]
    assert e.ask("banana cherry", index, 1, 0.1, {"domain": "x"}).count() == 0
    runs = dict(e.cache.runs)
    e.ask("banana cherry", index, 1, 0.1).count()
    assert sum(hits for _, hits, _ in e.cache.runs.values()) == sum(hits for _, hits, _ in runs.values()) + 1


def test_hash_sql_equals_libraries():
    words = ["", "a", "abcd", "abcdefg", "abcdefghijkl", "ñandú ñandúes", "x" * 31, "y" * 32, "zyxw" * 9 + "k", "qwertyuiop" * 20 + "é"]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS term", [words])
    assert dict(duck.execute(xxh64("t")).fetchall()) == {w: xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words}
    assert dict(duck.execute(crc32("term", "t", "term")).fetchall()) == {w: zlib.crc32(w.encode()) for w in words}


def test_seeds_do_not_depend_on_how_far_ids_lie_apart(spark):
    x = np.random.default_rng(5).normal(size=(300, 4))
    near = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    far = near.withColumn("vec_id", F.col("vec_id") * 1_000_003 - 77)
    found = x[:1]
    while len(found) < 5:
        d = ((x[:, None, :] - found[None, :, :]) ** 2).sum(axis=2).min(axis=1)
        found = np.vstack([found, x[np.flatnonzero(np.cumsum(d) >= d.sum() / 2 - 1e-12)[0]]])
    for rows in (near, far, far.union(spark.createDataFrame([(None, [9.0] * 4)], far.schema))):
        np.testing.assert_allclose(cluster.seeds(rows, 5), found)


def _batches(x):
    ids, vectors = np.arange(len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
    return [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 3000]), vectors[i : i + 3000]], names=["vec_id", "embedding"]) for i in range(0, len(x), 3000)]


def _peak(run):
    """What a second run returns and its peak MB; the first one may import modules."""
    run()
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


@pytest.mark.parametrize("metric", ["cosine", "binary"])
def test_memory_of_a_search_does_not_grow_with_its_queries(metric):
    x = np.random.default_rng(11).normal(size=(6000, 64))
    batches, peaks = _batches(x), []
    for n in (500, search.QUERY_BLOCK):
        out, peak = _peak(lambda n=n: pa.Table.from_batches(search._nearest(iter(batches), np.arange(n), x[:n], 10, metric, 64, ["query_id", "vec_id", "score"])))
        peaks.append(peak)
        assert out.num_rows == 10 * n
        if metric == "cosine":
            assert out["vec_id"].to_numpy().reshape(n, 10)[:, 0].tolist() == list(range(n))
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 40


def test_tiles_do_not_change_a_search(monkeypatch):
    x = np.round(np.random.default_rng(12).normal(size=(500, 8)))
    batches, q = _batches(x), x[:300]
    found = lambda: [pa.Table.from_batches(search._nearest(iter(batches), np.arange(300), q, k, m, 8, ["q", "c", "s"])).to_pydict() for k in (3, 600) for m in ("cosine", "euclid", "dot", "binary")]
    sums = lambda: pa.Table.from_batches(search._all_scores(iter(batches), np.arange(300), q, True)).to_pydict()
    scores = lambda: {(a, b): s for r in search._all_scores(iter(batches), np.arange(300), q, False) for a, b, s in zip(*(c.to_pylist() for c in r.columns), strict=True)}
    want, want_sums, want_scores = found(), sums(), scores()
    monkeypatch.setattr(search, "TILE", 7)
    monkeypatch.setattr(search, "CANDIDATES", 33)
    assert found() == want and len(want_scores) == 150_000
    assert sums()["n"] == want_sums["n"] == [500] * 300
    np.testing.assert_allclose(sums()["nearest"], want_sums["nearest"], atol=1e-12)
    np.testing.assert_allclose(sums()["total"], want_sums["total"], atol=1e-9)
    got = scores()
    assert got.keys() == want_scores.keys() and max(abs(got[k] - want_scores[k]) for k in got) < 1e-12


def test_memory_of_similarities_does_not_grow_with_their_queries():
    x = np.random.default_rng(13).normal(size=(4000, 64))
    rows, peak = _peak(lambda: sum(r.num_rows for r in search._all_scores(iter(_batches(x)), np.arange(search.QUERY_BLOCK), x[: search.QUERY_BLOCK], True)))
    assert rows == search.QUERY_BLOCK and peak < 40


@pytest.mark.parametrize("k", [20, 50], ids=["hybrid_merge", "vector_threshold"])
def test_memory_of_a_full_block_by_hits_asked(k):
    x = np.random.default_rng(14).normal(size=(4000, 64))
    found, peak = _peak(lambda: pa.Table.from_batches(search._nearest(iter(_batches(x)), np.arange(search.QUERY_BLOCK), x[: search.QUERY_BLOCK], k, "cosine", 64, ["query_id", "vec_id", "score"])))
    assert found.num_rows == k * search.QUERY_BLOCK and peak < 40
