"""Operators of lodestar.llm against brute force, round trips and held-out accuracy, with odd inputs."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import io
import math
import random
import re
import tarfile
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, entries, lm, media, mixing, neardup, quality, urls, warc, winnow

#: Nulls, empties, white space, one word, repeated rows, long texts, other scripts, markers of the formats.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "the quick brown fox jumps over the lazy dog"),
    (5, "the quick brown fox jumps over the lazy dog"),
    (6, "The QUICK brown fox\njumps over the lazy dog"),
    (7, "x" * 5000),
    (8, "word " * 4000),
    (9, "naïve café — 日本語 テキスト ́ é <|endoftext|> it's 100%   ok\x1c\x85"),
    (None, "a text without an id"),
    (10, "  "),
]
SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def ascii_lower(t):
    return (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, __text string, score int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# 1 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chunked():
    return bpe.ChunkEncoder(bpe.tokenizer_path(), chunk=32, reach=8, pieces=50, chunk_bytes=20_000)


def _same(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    got, decoded = encoder.encode(text.encode())
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert decoded.decode() == encoder.tokenizer.decode(ids, skip_special_tokens=False)
    assert encoder.decode(got) == decoded


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_bpe_any_text(chunked, text):
    _same(chunked, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "\n", "ing", "<|endoftext|>", "<|", "é", "́", "'s", "123", " ", "X", "日本"]), max_size=300))
def test_bpe_joins(chunked, parts):
    _same(chunked, "".join(parts))


def test_bpe_repairs_forced_cuts(chunked):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(4000))
    before = chunked.stats["repaired"]
    _same(chunked, text)
    assert chunked.stats["repaired"] > before


def test_bpe_shares_chunks():
    e = bpe.ChunkEncoder(bpe.tokenizer_path(), chunk=64)
    passage = " ".join(f"word{i} alpha beta" for i in range(400))
    e.encode(b"one start " + passage.encode())
    n, reused = e.stats["chunks"], e.stats["reused"]
    e.encode(b"quite another beginning here " + passage.encode())
    assert e.stats["reused"] - reused > 0.8 * (e.stats["chunks"] - n)


def test_bpe_query_against_the_tokenizer(spark, sf_dir, real):
    tokenizer = bpe.encoder(bpe.tokenizer_path()).tokenizer
    out = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    for i, t in real:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False).encode()
        assert tuple(out[i])[:4] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    assert len(out) == len(real)


def test_bpe_frame(odd, empty):
    out = bpe.encode_decode(odd, keep=("doc_id", "__text")).withColumn("array", bpe.ids_array())
    e = bpe.encoder(bpe.tokenizer_path())
    want = sorted((str(i), e.tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in ODD)
    assert sorted((str(r.doc_id), r.array) for r in out.collect()) == want
    assert bpe.encode_decode(empty).count() == 0


# 2 ---------------------------------------------------------------------------------------------------


def _plain_viterbi(pieces, model):
    """Roles and beginnings of every line of a transcript, by one pass over all its lines."""
    lines, blank = [], False
    for k, t in enumerate(pieces):
        for line in (t or "").split("\n"):
            if line.strip():
                marker, rest = chat.marker_of(line)
                lines.append((k, model.seen[marker, blank, rest.rstrip().endswith("?")]))
            blank = not line.strip()
    score, back = None, []
    for _, e in lines:
        if score is None:
            score = [model.moves[chat.FRESH, j] + e[j] for j in range(6)]
            continue
        ways = [[score[i] + model.moves[i, j] for i in range(6)] for j in range(6)]
        back.append([w.index(max(w)) for w in ways])
        score = [max(w) + e[j] for j, w in enumerate(ways)]
    if score is None:
        return []
    states = [score.index(max(score))]
    for b in reversed(back):
        states.append(b[states[-1]])
    return [(k, *chat.STATES[x]) for (k, _), x in zip(lines, reversed(states), strict=True)]


@pytest.mark.parametrize(("block", "run", "crowd"), [(2, 3, 2), (5, 2, 256), (32, 1024, 256)])
def test_chat_equals_plain_viterbi(spark, monkeypatch, block, run, crowd):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    monkeypatch.setattr(chat, "SUPER", run)
    monkeypatch.setattr(chat, "CROWD", crowd)
    rng = random.Random(5)
    names = ["User: ", "Assistant: ", "", "", "[system] ", "**Bot:** ", "## Human: "]
    say = lambda: rng.choice(["", "\n", "\n \n"]) + rng.choice(names) + f"words {rng.random()}" + rng.choice(["?", ".", "\nmore\n\nlines", ".\n", "?\n\n", ""])
    rows = [(conv, turn, rng.choice([None, "", "\n\n"]) if rng.random() < 0.15 else say()) for conv in range(6) for turn in range(rng.choice([1, 3, 70]))]
    rows += [(90, 0, None), (91, 0, "\n\n"), (91, 1, "User: x"), (92, None, "z"), (92, 0, "AI: q")]
    rows += [(93, 2, say()) for _ in range(9)] + [(93, 1, "User: b"), (93, 3, "same"), (93, 3, "same")]
    alone = [(None, 4, "AI: y"), (None, 4, "User: z\n\nmore?"), (None, None, None)]
    df = spark.createDataFrame(rows + alone, "c long, t long, raw string")
    h = {r.raw: r.h & (2**64 - 1) for r in df.select("raw", F.xxhash64("raw").alias("h")).collect()}
    model = chat.Model()
    want = []
    for conv in {r[0] for r in rows}:
        mine = sorted({(-1 if t is None else t, h[x] >> 33, x or "", t, x) for c, t, x in rows if c == conv}, key=lambda v: v[:3])
        found = _plain_viterbi([x for *_, x in mine], model)
        role = None
        for k, (*_, t, x) in enumerate(mine):
            own = [(r, begins) for place, r, begins in found if place == k]
            first = own[0] if own else (role, False)
            want += [(conv, t, None if first[0] is None else chat.ROLES[first[0]], first[1], len(own))] * rows.count((conv, t, x))
            role = own[-1][0] if own else role
    for _, t, x in alone:
        own = _plain_viterbi([x], model)
        want.append((None, t, chat.ROLES[own[0][1]] if own else None, bool(own and own[0][2]), len(own)))
    got = [(r.key, r.number, r.role, r.begins, r.n_lines) for r in chat.parse(df, key="c", number="t", text="raw").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert chat.parse(df.limit(0), key="c", number="t", text="raw").count() == 0


def test_chat_learns(spark):
    rows = [(c, t, ("Zed: " if t % 2 else "") + "text", ("user", "assistant")[t % 2]) for c in range(40) for t in range(6)] + [(None, 1, "x", "user"), (1, 9, None, "user"), (1, 10, "y", None), (1, 11, "y", "other")]
    df = spark.createDataFrame(rows, "c long, t long, raw string, role string")
    model = chat.fit(df, key="c", number="t", text="raw", role="role")
    # Of 240 beginnings and one alone none has a marker of MARKERS; a user is always followed by an assistant.
    assert model.p["begin"][0, 1] == pytest.approx((0.298 * chat.WEIGHT + 240) / (chat.WEIGHT + 240))
    assert model.p["next"][1, 2] > 0.95 and model.p["on"][0, 1] < 0.1
    assert chat.fit(df.limit(0), key="c", number="t", text="raw", role="role").p["first"].tolist() == chat.PRIOR["first"]


def test_chat_roles(spark, sf_dir):
    out = chat.op2_chat(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert len(out) == turns
    held = [r for r in out if r.held_out]
    assert sum(r.true_role == r.parsed_role for r in held) > 0.9 * len(held) > 0
    assert chat.render([(1, True, " hi "), (1, False, "there"), (2, True, "yes")]) == "<|user|>\nhi\nthere\n<|end|>\n<|assistant|>\nyes\n<|end|>"


# 3 ---------------------------------------------------------------------------------------------------


def test_media(odd, empty, tmp_path):
    index = media.store(odd, folder=f"file://{tmp_path}", shard_bytes=3000)
    stored = {}
    for p in tmp_path.glob("*.tar"):
        with tarfile.open(p) as tar:
            for m in tar:
                stored[m.name] = tar.extractfile(m).read()
    made = {r.digest: r for r in media.features(media.canonical(index)).collect()}
    refs = [(r.digest, x.id, x.n_bytes) for r in index.collect() for x in r.refs]
    assert sorted(str(i) for _, i, _ in refs) == sorted(str(i) for i, _ in ODD)
    for i, t in ODD:
        payload = media.pad((t or "").encode())
        d = hashlib.sha256(payload).hexdigest()
        r = made[d]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (d, zlib.crc32(payload[-16:]), len(payload))
        assert media.png_samples(stored[f"{d}.png"]).tobytes() == payload
        assert r.media_bytes == len(stored[f"{d}.png"]) and (r.width, r.height) == (64, len(payload) // 192)
        assert (d, i, len((t or "").encode())) in refs
    assert len(made) == len(stored) == len({media.pad((t or "").encode()) for _, t in ODD})
    assert media.store(empty).count() == 0
    head = media.headers(media.canonical(index))
    assert head.count() == len(made) and "height" in head.columns


def test_media_damage():
    good = media.png(media.pad(b"abc"))
    bad = good[:45] + bytes([good[45] ^ 1]) + good[46:]
    with pytest.raises(ValueError):
        media.png_samples(bad)


def _plain_feature(payload):
    n, rows = len(payload), len(payload) // 192
    counts = collections.Counter(payload)
    mean = sum(payload) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    starts = [min(i * rows // 8, rows - 1) for i in range(8)]
    cells = []
    for i, a in enumerate(starts):
        b = max(a + 1, starts[i + 1] if i < 7 else rows)
        for j in range(8):
            cells.append(sum(sum(payload[r * 192 + 24 * j : r * 192 + 24 * j + 24]) for r in range(a, b)) / (b - a))
    level = sum(cells) / 64
    bits = "".join("1" if c > level else "0" for c in cells)
    return f"mean={mean:.4f};std={std:.4f};entropy={entropy:.4f};ahash={int(bits, 2):016x}"


def test_media_query_against_plain_code(spark, sf_dir, real):
    out = {r.doc_id: r for r in media.op3_media(spark, sf_dir).collect()}
    assert len(out) == len(real)
    for i, t in real:
        r, payload = out[i], media.pad(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.png(payload)), hashlib.sha256(media.png(payload)).hexdigest())
        assert r.feature.rpartition(";")[0] == _plain_feature(payload).rpartition(";")[0], i
        # A cell at the very mean may fall to either side.
        assert bin(int(r.feature[-16:], 16) ^ int(_plain_feature(payload)[-16:], 16)).count("1") <= (1 if len(payload) > 1536 else 64)


def test_media_copies_of_one_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "REFS", 100)
    docs = spark.range(1000, numPartitions=2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("same").alias("text"))
    index = media.store(docs, folder=f"file://{tmp_path}").collect()
    assert max(len(r.refs) for r in index) <= 100 and sorted(x.id for r in index for x in r.refs) == list(range(1000))
    assert len(list(tmp_path.glob("*.tar"))) == 2 and len({(r.digest, r.shard) for r in index}) == 22


# 4 ---------------------------------------------------------------------------------------------------


def _brute_lm(train, texts):
    tok = lambda t: [*SPACE.findall(ascii_lower(t)), "</s>"]
    seqs = [tok(t) for t in train]
    c = collections.Counter(w for s in seqs for w in s)
    bi = collections.Counter(p for s in seqs for p in zip(["<s>", *s], s, strict=False))
    n, v, a = sum(c.values()), len(c), len(bi)
    before, after, fol = collections.Counter(w for _, w in bi), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (u, _), k in bi.items():
        after[u] += k
        fol[u][min(k, 3) - 1] += 1

    def cut(values):
        m = collections.Counter(values)
        if not (m[1] and m[2] and m[3]):
            return [0, 0.5, 1.0, 1.5]
        y = m[1] / (m[1] + 2 * m[2])
        return [0, *(min(max(d, 0.01 * k), k) for k, d in ((1, 1 - 2 * y * m[2] / m[1]), (2, 2 - 3 * y * m[3] / m[2]), (3, 3 - 4 * y * m[4] / m[3])))]

    d2, d1 = cut(bi.values()), cut(before.values())
    left = sum(d1[min(k, 3)] for k in before.values()) / max(1, a) if a else 1.0

    def p1(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / max(1, a) + left / (v + 1)

    def p2(u, w):
        if not after[u]:
            return p1(w)
        k = bi[u, w]
        return max(k - d2[min(k, 3)], 0) / after[u] + sum(x * y for x, y in zip(d2[1:], fol[u], strict=True)) / after[u] * p1(w)

    return [(len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), sum(math.log10(p2(u, w)) for u, w in zip(["<s>", *s], s, strict=False))) for s in map(tok, texts)]


def _brute_orders(train, texts, order):
    """log10 of texts by modified Kneser-Ney of an order, over plain tuples of words."""
    tok = lambda t: ["<s>", *SPACE.findall(ascii_lower(t)), "</s>"]
    seqs = [tok(t) for t in train]
    grams = {n: collections.Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1)) for n in range(2, order + 1)}
    counts = {order: grams[order]}
    for n in range(order - 1, 1, -1):
        before = collections.Counter(g[1:] for g in grams[n + 1])
        counts[n] = {g: c if g[0] == "<s>" else before[g] for g, c in grams[n].items()}
    counts[1] = collections.Counter(g[1:] for g in grams[2])
    vocabulary = len({w for s in seqs for w in s[1:]})

    def cut(values):
        m = collections.Counter(values)
        if not (m[1] and m[2] and m[3]):
            return [0, 0.5, 1.0, 1.5]
        y = m[1] / (m[1] + 2 * m[2])
        return [0, *(min(max(d, 0.01 * k), k) for k, d in ((1, 1 - 2 * y * m[2] / m[1]), (2, 2 - 3 * y * m[3] / m[2]), (3, 3 - 4 * y * m[4] / m[3])))]

    d = {n: cut(c.values()) for n, c in counts.items()}
    after = {n: collections.defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            after[n][g[:-1]].append(c)
    total = {n: {u: (sum(have), sum(d[n][min(x, 3)] for x in have)) for u, have in after[n].items()} for n in counts}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (vocabulary + 1)
        if gram[:-1] not in total[n]:
            return p(gram[1:])
        c, (mass, spare) = counts[n].get(gram, 0), total[n][gram[:-1]]
        return (max(c - d[n][min(c, 3)], 0) + spare * p(gram[1:])) / mass

    return [sum(math.log10(p(tuple(s[max(0, i - order + 1) : i + 1]))) for i in range(1, len(s))) for s in map(tok, texts)]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("source", ["real", "odd"])
def test_lm_orders_against_plain_code(spark, odd, real, monkeypatch, source, order):
    monkeypatch.setattr(lm, "LEAST_RANGE", 50)
    monkeypatch.setattr(lm, "PER_SHARD", 2000)
    rows = real[:80] if source == "real" else ODD
    df = spark.createDataFrame(rows, "doc_id long, text string") if source == "real" else odd
    want = _brute_orders([t for i, t in rows if i is not None and i % 3], [t for _, t in rows], order)
    got = [r.score for r in lm.score(df, lm.fit(df.filter(F.col("doc_id") % 3 != 0), order=order)).collect()]
    assert sorted(got) == pytest.approx(sorted(want), rel=1e-9)


def test_lm_orders_without_n_grams(spark, empty, odd):
    """Texts too short for any trigram, and none at all."""
    short = spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id long, text string")
    for train in (empty, short):
        scores = [r.score for r in lm.score(odd, lm.fit(train, order=4)).collect()]
        assert all(math.isfinite(x) for x in scores)
    with pytest.raises(ValueError):
        lm.fit(empty, order=1)


@pytest.mark.parametrize("source", ["real", "odd"])
def test_lm(spark, odd, real, source):
    rows = real[:120] if source == "real" else ODD
    df = spark.createDataFrame(rows, "doc_id long, text string") if source == "real" else odd
    train = df.filter(F.col("doc_id") % 3 != 0)
    want = _brute_lm([t for i, t in rows if i is not None and i % 3], [t for _, t in rows])
    got = lm.score(df, lm.fit(train)).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(((i, *x) for (i, _), x in zip(rows, want, strict=True)), key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_lm_query_against_plain_code(spark, sf_dir, real):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = _brute_lm([t for i, t in real if not held(i)], [t for _, t in real])
    got = {r.doc_id: r for r in lm.op4_lm(spark, sf_dir).collect()}
    assert len(got) == len(real)
    for (i, _), w in zip(real, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_lm_splits_cut_hot_contexts():
    cuts = lm._splits([1000, 1000], [100, 100], [np.array([[5], [900]]), np.zeros((2, 0), dtype=np.int64)], 2500, 500, 10)
    assert len(cuts) >= 8 and (np.diff(cuts.astype(np.int64)) > 0).all()
    hot = lm.FIRST + 5
    assert sum(hot << 32 < int(x) < (hot + 1) << 32 for x in cuts) >= 2


def test_lm_empty(empty, odd):
    model = lm.fit(empty)
    assert lm.score(empty, model).count() == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.score(odd, model).collect())


# 5 ---------------------------------------------------------------------------------------------------


def test_winnow_guarantee(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(300)}" for _ in range(600)]
    shared = [f"s{i}" for i in range(winnow.WINDOW + winnow.K - 1)]
    texts = [" ".join(words[i : i + 40] + shared + words[i + 50 : i + 90]) for i in range(0, 480, 60)]
    df = winnow.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", "f")
    sets = [set(r.f_hash) for r in df.collect()]
    assert all(a & b for a in sets for b in sets)


def test_winnow_picks(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 7, 8, 9, 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    grams = winnow.with_fingerprint(df, "t", "f", window=1)
    got = {r.i: (r.f_hash, r.f_pos) for r in winnow.with_fingerprint(df, "t", "f").collect()}
    # With a window of one each k-gram is picked, and picks are distinct by position.
    for r in grams.collect():
        h = [x & (2**64 - 1) for x in r.f_hash]
        m, w = len(h), winnow.WINDOW
        want = []
        for s in range(max(0, m - w + 1)) if m >= w else range(1 if m else 0):
            part = range(s, min(s + w, m))
            best = min(part, key=lambda p: (h[p] >> 32, -p))
            if best not in want:
                want.append(best)
        assert got[r.i][1] == want and [x & (2**64 - 1) for x in got[r.i][0]] == [h[p] for p in want]


@pytest.mark.parametrize("per", [1, 2, 512])
def test_winnow_neighbours(spark, odd, monkeypatch, per):
    monkeypatch.setattr(winnow, "IN_BUCKET", per)
    rows = [(i, t) for i, t in ODD if i is not None] + [(1000, "far away"), (-5, "below zero")]
    out = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string")).filter("__guest = 0").collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    want = sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert sorted((r["__key"], r["__text"], r["__next"]) for r in out) == want


def _plain_winnow(text):
    """Hashes and positions, in plain Python."""
    mask, words = 2**64 - 1, SPACE.findall((text or "").encode())
    signed = lambda x: x - 2**64 if x >> 63 else x
    h = [xxhash.xxh64_intdigest(w, 42) for w in words]

    def fold(values):
        x = 42
        for v in values:
            x = xxhash.xxh64_intdigest((v & mask).to_bytes(8, "little"), x)
        return x

    k, window = winnow.K, winnow.WINDOW
    grams = [fold(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [fold(h)] if h else []
    picks = []
    for i in range(max(1, len(grams) - window + 1)) if grams else []:
        best = min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j] >> 32, -j))
        if best not in picks:
            picks.append(best)
    return [signed(grams[p]) for p in picks], picks


def test_winnow_query_against_plain_code(spark, sf_dir, real):
    out = {r.doc_id: r for r in winnow.op5_winnow(spark, sf_dir).collect()}
    docs, names = sorted(real, reverse=True), {}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(docs):
        nxt, r = docs[(k + 1) % len(docs)][1], out[i]
        own, changed = _plain_winnow(t), _plain_winnow(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
        assert (r.hashes, r.positions) == own and r.n_fingerprints == len(own[0])
        assert r.near_edited == pytest.approx(like(set(own[0]), set(changed[0]))) and r.near_next == pytest.approx(like(set(own[0]), set(_plain_winnow(nxt)[0])))
        for name, value in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert names.setdefault(name, value) == value
    assert len(names) == len({str(v) for v in names.values()})


def test_winnow_far_ids_and_empty(spark, odd, empty):
    rows = [(-(2**63), "a"), (2**63 - 1, "b"), (0, None), (None, "n"), (None, "m"), (1, "c"), (1, "c")]
    out = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string")).filter("__guest = 0").collect()
    assert {(r["__key"], r["__text"], r["__next"]) for r in out} == {(None, "m", "n"), (None, "n", "b"), (2**63 - 1, "b", "c"), (1, "c", "c"), (1, "c", ""), (0, "", "a"), (-(2**63), "a", "m")}
    assert winnow.with_next(empty).count() == 0


def test_winnow_query(spark, sf_dir, real):
    out = {r.doc_id: r for r in winnow.op5_winnow(spark, sf_dir).collect()}
    docs = sorted(real, reverse=True)
    prints = collections.defaultdict(set)
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert out[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and out[i].n_chars == len(t)
        prints[t].add(out[i].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert np.mean([r.near_edited for r in out.values()]) > 0.25 > 0.05 > np.mean([r.near_next for r in out.values()])


# 6 ---------------------------------------------------------------------------------------------------


def test_urls(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rng = random.Random(11)
    names = ["a.example", "b.a.example", "c.example", "example"]
    history = [(rng.choice(names), rng.choice(["add", "remove", "ADD"]), day(rng.randrange(30))) for _ in range(40)] + [(None, "add", day(1)), ("c.example", None, day(1)), ("c.example", "add", None)]
    caps = [(i, u, day(rng.randrange(35))) for i, u in enumerate(["http://a.example/x", "https://user@B.A.Example.:80/?q", "http://xa.example/", "mailto:x@a.example", None, "not a url", "http://c.example"] * 6)] + [(99, "http://c.example", None)]
    out = {r.id: r for r in urls.evaluate(spark.createDataFrame(caps, "id long, u string, day date"), urls.intervals(spark.createDataFrame(history, "pattern string, action string, day date")), key="id", url="u", day="day").collect()}
    hosts = {"http://a.example/x": "a.example", "https://user@B.A.Example.:80/?q": "b.a.example", "http://xa.example/": "xa.example", "http://c.example": "c.example"}
    for i, u, d in caps:
        h, active = hosts.get(u), []
        for p in names:
            past = sorted((x[2], x[1].lower()) for x in history if x[0] == p and x[1] and x[2] and d and x[2] <= d)
            if h and d and past and past[-1][1] == "add" and (h == p or h.endswith("." + p)):
                active.append(p)
        assert (out[i].blocked, out[i].n_active, out[i].matched) == (bool(active), len(active), min(active, default=None)), (u, d)
    assert out[99].blocked is False


def test_urls_deep_hosts(spark):
    day = dt.date(2024, 1, 1)
    deep = "a.b.c.d.e.f.g.h.i.j.example.com"
    deepest = ".".join(["x"] * 125) + ".example.com"
    entries = [(p, "add", day) for p in ("example.com", "j.example.com", "b.c.d.e.f.g.h.i.j.example.com", deep, "ple.com")]
    caps = [(0, f"http://{deep}/x", day), (1, f"http://{deepest}/", day), (2, f"http://{deep}.org/", day)]
    active = urls.intervals(spark.createDataFrame(entries, "pattern string, action string, day date"))
    out = {r.id: (r.blocked, r.n_active, r.matched) for r in urls.evaluate(spark.createDataFrame(caps, "id long, u string, day date"), active, key="id", url="u", day="day").collect()}
    assert out == {0: (True, 4, deep), 1: (True, 1, "example.com"), 2: (False, 0, None)}


# 7 ---------------------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    rng = random.Random(13)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(120)) + "."
    bad = lambda: rng.choice(["".join(rng.choice("#$%&!") * 3 + w for w in good().split()), "buy now " * 90, good().upper()])
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, sample=250)).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 4 > 0) for i in range(300, 400)]) > 0.95
    model = quality.fit(odd, labels)
    scored = quality.score(odd, model, column="s").collect()
    assert len(scored) == len(ODD) and all(0 <= r.s <= 1 for r in scored)
    assert {r.s for r in quality.score(odd, quality.fit(odd, labels.limit(0)), column="s").collect()} == {0.5}
    assert quality.score(empty, model, column="s").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 330


def test_quality_is_a_direct_vote(spark, real):
    docs = spark.createDataFrame(real[:80] + real[:80] + [(9001, None), (9002, "ab")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in real[:60]] + [(real[3][0], 1 - real[3][0] % 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(model.labels) == 59  # an id with both labels trains nothing
    scored = quality.score(docs.withColumn("score", F.lit("own")), model)
    assert scored.columns == ["doc_id", "text", "score", "score_"]
    got = collections.defaultdict(set)
    for r in scored.collect():
        assert r.score == "own"
        got[r.text].add(r["score_"])
    points = [[int(v) for v in p] for p in model.points]
    for t, scores in got.items():
        raw = (t or "").encode()
        if len(raw) < 3:
            assert scores == {model.prior}
            continue
        (z,) = model.project(quality.vectors(memoryview(raw), [0, len(raw)])[0]).tolist()
        sims = [sum(int(a) * b for a, b in zip(z, p, strict=True)) for p in points]
        near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[: quality.NEIGHBOURS]
        weight = [max(sims[i], 0) / quality.UNIT**2 for i in near]
        want = sum(w**4 * model.labels[i] for w, i in zip(weight, near, strict=True)) / sum(w**4 for w in weight)
        assert len(scores) == 1 and min(scores) == pytest.approx(want, abs=1e-12)


def test_quality_held_out(spark):
    out = quality.op7_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = out.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).cast("int").alias("ok")).agg(F.avg("ok")).first()
    assert r[0] > 0.93


# 8 ---------------------------------------------------------------------------------------------------


def test_mixing_fit_matches_numpy(spark):
    rng = np.random.default_rng(17)
    t, p = rng.integers(0, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    target = np.array([0.6, 0.3, 0.1]) * t.sum()
    fit = mixing.fit_rates(rows, target, low=0.0, high=5.0, tolerance=1e-5)
    rates, _ = fit.rates(p)
    assert np.allclose((rates * t) @ p, target, rtol=1e-3) and (rates >= 0).all()
    got = np.array([r.rate for r in mixing.with_rate(rows, fit).collect()])
    assert np.allclose(np.sort(got), np.sort(np.where(t > 0, rates, 1.0)))  # rows without tokens keep rate 1, as documented
    bound = mixing.fit_rates(rows, target * 100, low=0.5, high=2.0)
    assert np.allclose(bound.rates(p)[0], 2.0, atol=1e-6)


def test_mixing_default_reaches_small_domains(spark):
    rng = np.random.default_rng(23)
    t, p = rng.integers(0, 500, 300), rng.dirichlet([0.3, 0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    target = np.array([0.5, 0.3, 0.15, 0.05]) * t.sum()
    fit = mixing.fit_rates(rows, target)
    got = (fit.rates(p)[0] * t) @ p
    assert np.linalg.norm(got - target) <= 2e-5 * np.linalg.norm(target) and np.allclose(got, target, rtol=2e-4)


def test_mixing_frames(spark, odd, empty):
    rng = random.Random(19)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(i, make("abcde" if i % 5 else "vwxyz"), "n") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rate string")
    labelled = spark.createDataFrame([(i, "b" if i % 5 else "a") for i in range(100)], "doc_id long, domain string")
    rated, fit, c = mixing.mix(docs, labelled, {"a": 1.0, "b": 1.0})
    assert c.domains == ["a", "b"] and abs(fit.totals[0] / fit.totals.sum() - 0.5) < 0.01
    assert np.mean([r.posterior[0] > 0.5 for r in rated.filter("doc_id % 5 = 0").collect()]) > 0.95
    out = mixing.apply(docs, labelled, {"a": 1.0, "b": 1.0}, low=1.0, high=6.0, grow_only=True)
    n = collections.Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and len(n) == 300 and sum(v for k, v in n.items() if k % 5 == 0) > 200
    again = mixing.apply(odd, labelled, {"a": 1.0, "b": 1.0}, low=1.0, high=1.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, odd.collect())) and again.columns == odd.columns
    rated, _, _ = mixing.mix(odd, labelled, {"a": 1.0, "b": 1.0})
    assert {r.rate for r in rated.filter("tokens = 0").collect()} == {1.0} and rated.filter("tokens = 0").count() == 3
    assert mixing.apply(odd, labelled, {"a": 1.0, "b": 1.0}).filter("doc_id IN (1, 2, 3)").count() == 3
    clash = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "a")], "doc_id long, domain string")
    assert mixing.fit_classifier(docs, clash).domains == ["a"]
    assert mixing.apply(empty, labelled, {"a": 1.0, "b": 1.0}).count() == 0


@pytest.mark.parametrize(("low", "high", "share"), [(0.0, 100.0, (0.5, 0.3, 0.2)), (0.5, 1.5, (0.9, 0.05, 0.05)), (1.0, 3.0, (0.1, 0.1, 0.8)), (0.0, 1.0, (0.4, 0.5, 0.1))])
def test_mixing_is_the_least_squares_optimum(spark, low, high, share):
    rng = np.random.default_rng(29)
    t, p = rng.integers(0, 300, 120), rng.dirichlet([0.4, 0.4, 0.4], 120)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    target = np.array(share) * t.sum() * 1.1
    fit = mixing.fit_rates(rows, target, low=low, high=high)
    # Coordinate descent: the exact minimum in one rate at a time, until none moves.
    a = (p * t[:, None]).T
    r = np.full(len(t), min(max(1.0, low), high))
    rest = a @ r - target
    for _ in range(3000):
        before = r.copy()
        for i in np.flatnonzero(t):
            new = min(max(r[i] - (a[:, i] @ rest) / (a[:, i] @ a[:, i]), low), high)
            rest += a[:, i] * (new - r[i])
            r[i] = new
        if np.abs(r - before).max() < 1e-12:
            break
    assert fit.off() * np.linalg.norm(target) <= np.linalg.norm(rest) + 2e-5 * np.linalg.norm(target)
    assert fit.ended == ("tolerance" if np.linalg.norm(rest) < 1e-6 * np.linalg.norm(target) else "bounds")


def test_mixing_says_when_it_has_not_ended(spark):
    rng = np.random.default_rng(31)
    rows = spark.createDataFrame([(int(a), [float(x), 1 - float(x)]) for a, x in zip(rng.integers(1, 300, 50), rng.random(50), strict=True)], "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="after 1 steps"):
        assert mixing.fit_rates(rows, np.array([9e5, 1e2]), most_steps=1).ended == "most_steps"


# 9 ---------------------------------------------------------------------------------------------------


PAGES = [(1, "http://a/", "x" * 1500), (2, None, "x" * 1500), (3, "http://c/ d", "x" * 1500), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 1500), (8, "é", "日本\r\n\r\n" * 300), (8, "é", "日本\r\n\r\n" * 300)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(PAGES)
    for r in got:
        html = next(h for i, _, h in PAGES if i == r.page_id) or ""
        again = r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert r.payload is None if again else bytes(r.payload).decode() == html
    skipped = warc.read_warc(spark, path, payload=False).filter("record_type = 'response' AND page_id IN (3, 8)")
    assert sorted((r.page_id, r.payload) for r in skipped.collect()) == [(3, None), (8, None), (8, None)]
    plan = skipped._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan
    warc.write_pages(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_skips_and_foreign_members():
    rows = [warc.record(i, "http://x/", b"<p>" * i, "response", None, "d", 3 * i) for i in range(5)]
    import gzip

    for data, gz in ((b"".join(map(warc.member, rows)), True), (b"".join(map(gzip.compress, rows)), True), (b"".join(rows), False)):
        read = lambda want, payload: list(warc.records(io.BufferedReader(io.BytesIO(data)), gz, want, payload))  # noqa: B023, E731
        assert [(r["page_id"], r["payload"]) for r in read(lambda r: r["page_id"] % 2 == 0, True)] == [(i, b"<p>" * i) for i in (0, 2, 4)]
        assert [r["payload"] for r in read(lambda r: True, False)] == [None] * 5
    # A payload that is skipped is not decoded: damage in it goes unnoticed.
    big = warc.member(warc.record(1, "u", random.Random(1).randbytes(90_000), "response", None, "d", 90_000))
    broken = big[:-8] + b"\0" * 8 + warc.member(rows[1])
    assert len(list(warc.records(io.BufferedReader(io.BytesIO(broken)), True, lambda r: True, False))) == 2
    with pytest.raises((zlib.error, ValueError, EOFError)):
        list(warc.records(io.BufferedReader(io.BytesIO(broken)), True, lambda r: True, True))


def test_warc_pushdown():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    r = warc.WarcReader("x", True)
    left = list(r.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 5)]))
    assert len(left) == 1 and len(r.tests) == 2


# 10 --------------------------------------------------------------------------------------------------


def _brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(ascii_lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def _families(seed, families, members, length, edits):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(length)] = rng.choice([f"e{rng.randrange(10**6)}", "x"])
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("rows", "size", "wide"), [(_families(1, 6, 25, 60, 14), 2, 48), (_families(2, 3, 60, 120, 24), 2, 8), (_families(3, 4, 40, 40, 5), 5, 6), (_families(4, 40, 4, 6, 2), 2, 48), (_families(5, 2, 90, 300, 60), 2, 10)])
def test_neardup_components(spark, monkeypatch, rows, size, wide):
    monkeypatch.setattr(neardup, "WIDE", wide)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle_words=size).collect()}
    assert got == _brute_components(rows, size, 80)


def test_neardup_odd(odd, empty):
    got = collections.Counter((r.id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd, shingle_words=2).collect())
    want = _brute_components([x for x in ODD if x[0] is not None], 2, 80)
    for i, _ in ODD:
        assert got[(i, 4, None) if i is None else (i, *want[i])] >= 1
    assert sum(got.values()) == len(ODD)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(odd, shingle_words=2)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, 10, None]))


def test_neardup_query_against_all_pairs(spark, sf_dir, real):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op10_neardup(spark, sf_dir).collect()}
    want = _brute_components(real, 2, 80)
    assert got == {i: (n, root, i == root) for i, (n, root) in want.items()}


def test_neardup_rows_that_share_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words[:30]), " ".join(words[30:]), "quite another text of a few words"
    near = a + " w30"
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y"), (7, near, "z"), (7, c, "z"), (9, b, "z"), (None, a, "n"), (8, None, "e"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(docs, shingle_words=2).collect())
    assert got == sorted([("1", 29, "1"), ("1", 29, "1"), ("1", 29, "1"), ("7", 30, "1"), ("7", 6, "7"), ("9", 29, "1"), ("None", 29, "None"), ("8", 0, "8"), ("8", 0, "8")])
    kept = neardup.keep_one(docs, shingle_words=2)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, (docs.filter("text IS NULL OR doc_id IS NULL").union(spark.createDataFrame([rows[0], rows[1], rows[4]], docs.schema)).collect())))


@pytest.mark.parametrize("together", [3, 500])
def test_neardup_crowded_lists(spark, monkeypatch, together):
    monkeypatch.setattr(neardup, "TOGETHER", together)
    monkeypatch.setattr(neardup, "WIDE", 8)
    rows = _families(6, 2, 70, 90, 18)
    crowded = lambda reps, kept: {r.key: 3 for r in neardup._lists(reps, kept).groupBy("key").count().filter("count > 10").collect()}
    monkeypatch.setattr(neardup, "_crowded", crowded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle_words=2).collect()}
    assert got == _brute_components(rows, 2, 80)


def test_neardup_difference_bounds():
    rng = np.random.default_rng(23)
    base = np.arange(100, dtype=np.uint64)
    for _ in range(3000):
        c, x, y = (np.unique(np.concatenate([rng.choice(base, rng.integers(60, 100), replace=False), rng.choice(np.arange(100, 400, dtype=np.uint64), rng.integers(0, 20))])) for _ in range(3))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 80 * (len(x) + len(y) - shared):
            continue
        (dx, lx, px, _), (dy, ly, _, fy) = neardup.difference(c, x, 80), neardup.difference(c, y, 80)
        if not lx:
            first, second = dx[:px].tolist(), dy[:fy].tolist()
            pairs = [(first.index(e), second.index(e)) for e in set(first) & set(second)]
            assert any(2 * min(len(dx) - i, len(dy) - j) >= len(dx) + len(dy) - 20 * (len(x) + len(y)) // 180 for i, j in pairs)


def test_neardup_centres_pair_few(spark):
    """Members that share a passage and frequent word pairs, but are not near each other, do not meet all with all."""
    rng = random.Random(61)
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join(passage + [f"c{k}" for k in range(60)])]
    for i in range(150):
        own = [f"m{i}_{k}" for k in range(20)]
        for k in range(20):
            own[k] += f" h{k % 10} g{k % 10}"
        texts.append(" ".join(passage + own))
    near = [t.split() for t in rng.sample(texts[1:], 6)]
    for t in near:
        t[rng.randrange(40, 100)] = "other"
    rows = list(enumerate([*texts, *map(" ".join, near)], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stars = spark.createDataFrame([(1, i, i) for i, _ in rows[1:]], "a long, b long, component long")
    pairs = {(r.a, r.b) for r in neardup._apart_from_centres(stars, docs, "doc_id", "text", 2, 80).filter("NOT sure").collect()}
    links = [(i, j) for i, root in ((i, root) for i, (_, root) in _brute_components(rows, 2, 80).items()) for j in (root,) if i != j]
    assert len(links) == 6 and {(min(x), max(x)) for x in links} <= pairs
    assert len(pairs) <= len(rows)


# All -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    found = c.execute(entries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    df = entries.queries()[name](spark, sf_dir).select(*names)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "mixing", "tokens"]
    good = P.quality(spark, docs, sf_dir)
    once = P.near_duplicates(spark, good, sf_dir)
    more = P.mixed(spark, once, sf_dir)
    for x in (good, once, more):
        assert x.columns == docs.columns
    a, b = {r.doc_id for r in once.collect()}, collections.Counter(r.doc_id for r in more.collect())
    assert set(b) == a
    # Languages as they are marked reach their shares of words, but for what posteriors and whole copies leave.
    n = collections.Counter()
    for r in more.collect():
        n[r.lang] += len((r.text or "").split())
    assert all(abs(n[k] / sum(n.values()) - v) < 0.05 for k, v in P.TARGETS.items())
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert a == {i for i, (_, root) in _brute_components(rows, 5, 80).items() if i == root}
    out = P.run(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in out) == b


def test_pipeline_odd_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = [(9001, None, "en", None, 0), (9002, "", None, "s", None), (9003, " \t", "de", "s", 3), (None, "words of a row without an id", "en", "s", None), (None, None, None, None, None)]
    odd = spark.createDataFrame(lines, docs.schema).unionByName(docs.limit(60)).unionByName(docs.limit(3)).withColumn("__text", F.lit(1)).withColumn("__row", F.lit("r"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, table in (("odd", odd), ("none", odd.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        stored = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, stored, f"{tmp_path}/{name}")
            assert sorted(out.columns) == sorted(stored.columns)
        assert (P.run(spark, f"{tmp_path}/{name}").count() > 0) == (name == "odd")
    stored = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    once = P.near_duplicates(spark, stored, "")
    assert once.filter("doc_id > 9000 OR doc_id IS NULL").count() == 5 and once.filter("doc_id < 9000").groupBy("doc_id").count().filter("count > 1").isEmpty()
    more = P.mixed(spark, stored, f"{tmp_path}/odd")
    assert more.filter("doc_id > 9000").count() == 3 and more.select("doc_id").distinct().count() == stored.select("doc_id").distinct().count()
    last = P.tokens(spark, stored, "").filter("doc_id > 9000 AND doc_id < 9003").collect()
    assert {r.n_tokens for r in last} == {0}
