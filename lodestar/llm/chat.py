"""Chat formatting: roles of raw transcripts by a hidden Markov model, and canonical turns.

A transcript is a sequence of lines. Each line has features: the speaker marker at its start (system, user,
assistant or none, in any of the styles of MARKERS), whether a blank line stands before it, and whether
it asks. The states are the three roles, each beginning a turn or going on with it; the transitions say
that a turn goes on or the next speaker begins. `fit` counts features and transitions of labelled turns, which add to the
PRIOR; Viterbi gives the likeliest states; markers are removed and turns rendered canonically, one turn as <|role|>, newline,
text, newline, <|end|>.

Long transcripts: lines come in blocks of at most BLOCK_TURNS numbered pieces of a transcript (of a number with very many
pieces, in blocks of its own by ranges of the texts' hashes). Viterbi is a product of matrices over (max, +), so each block
gives one matrix on its own, for either case of what a line before it leaves (a blank line, or none). Runs of SUPER blocks are
multiplied first; their products, one for each 32,768 pieces, meet in one task a transcript, which finds scores before and the state
after each run; each run then does so for its blocks, and each block is decoded on its own. Scores are whole numbers (2^-20
of a nat), so sums are exact: the result equals Viterbi over the whole transcript, and no transcript is ever in one task.

Defined results: a null text is an empty line; blank lines only set the next line's feature and belong to no turn;
a piece of blank lines only, or a null one, has the role before it, if there is one, and an empty rendering; a transcript
without any line has no turns; a row with a null id is a transcript of its own; pieces without a number come before
all others; of several pieces of one number the order is that of their texts' hashes; repeated rows are one piece, and each has
its result. Ties go to the state that comes first in STATES. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.gather import add_up
from lodestar.llm._spark import bounded, materialize, shuffle_partitions, slices

ROLES = ("system", "user", "assistant")
#: Beginning and going on, for each role.
STATES = tuple((r, begins) for r in range(3) for begins in (True, False))
#: Names of speakers, by role.
MARKERS = (("system", "sys", "instructions"), ("user", "human", "q", "question", "customer"), ("assistant", "ai", "bot", "a", "answer", "agent"))
#: Numbers in a block, blocks in a run, pieces from which a block is cut by hash.
BLOCK_TURNS, SUPER, CROWD = 32, 1024, 256
FRESH = len(STATES)

_NAMES = {name: r for r, names in enumerate(MARKERS) for name in names}
_ANY = "|".join(sorted(_NAMES, key=len, reverse=True))
_MARKER = re.compile(rf"^\s*(?:#{{1,4}}\s*|>{{1,2}}\s*|\*\*|\[|<\|?)?\s*({_ANY})\s*(?:\*\*\s*:|:\s*\*\*|\]\s*:?|\|?>\s*:?|:|>)\s*", re.IGNORECASE)

#: What labelled turns are added to, as probabilities that weigh WEIGHT turns. Of a line's marker, for states that begin: own,
#: none, another role's; else: none, any. Of a blank line before a line that goes on, or begins. Of a question, by role.
#: Of lines that go on. Of the next speaker, by the one before; of the first.
PRIOR = {
    "begin": [[0.7, 0.298, 0.002]],
    "inside": [[0.9985, 0.0015]],
    "blank": [[0.85, 0.15], [0.2, 0.8]],
    "asks": [[0.98, 0.02], [0.7, 0.3], [0.9, 0.1]],
    "on": [[0.4, 0.6]],
    "next": [[0.02, 0.9, 0.08], [0.01, 0.09, 0.9], [0.01, 0.9, 0.09]],
    "first": [[0.3, 0.6, 0.1]],
}
WEIGHT, NAT = 20.0, 1 << 20
_SLOTS = {name: slice(at, at + sum(map(len, rows))) for (name, rows), at in zip(PRIOR.items(), np.cumsum([0, *(sum(map(len, r)) for r in PRIOR.values())]), strict=False)}
SLOTS = sum(sum(map(len, r)) for r in PRIOR.values())


class Model:
    """Log odds in whole numbers: MOVES from each state (and FRESH, before any line) to each, and of a line's features by state."""

    def __init__(self, counts: np.ndarray | None = None):
        p = {}
        for name, rows in PRIOR.items():
            seen = np.zeros(np.shape(rows)) if counts is None else counts[_SLOTS[name]].reshape(np.shape(rows))
            total = np.array(rows) * WEIGHT + seen
            p[name] = total / total.sum(axis=1, keepdims=True)
        self.p = p
        self.moves = np.full((FRESH + 1, FRESH), -np.inf)
        for j, (q, begins) in enumerate(STATES):
            if begins:
                self.moves[FRESH, j] = p["first"][0, q]
                for i, (r, _) in enumerate(STATES):
                    self.moves[i, j] = p["on"][0, 0] * p["next"][r, q]
            else:
                for i, (r, _) in enumerate(STATES):
                    if r == q:
                        self.moves[i, j] = p["on"][0, 1]
        self.moves = self._whole(self.moves)
        self.seen = {(m, b, a): self._emission(m, b, a) for m in (None, 0, 1, 2) for b in (False, True) for a in (False, True)}

    @staticmethod
    def _whole(p: np.ndarray) -> np.ndarray:
        return np.rint(np.log(p, out=np.full(p.shape, -np.inf), where=p > 0) * NAT)

    def _emission(self, marker: int | None, blank: bool, asks: bool) -> np.ndarray:
        out = np.empty(FRESH)
        for i, (r, begins) in enumerate(STATES):
            if begins:
                x = self.p["begin"][0, 0 if marker == r else 1 if marker is None else 2] / (2 if marker not in (None, r) else 1)
            else:
                x = self.p["inside"][0, int(marker is not None)] / (1 if marker is None else 3)
            out[i] = x * self.p["blank"][int(begins), int(blank)] * self.p["asks"][r, int(asks)]
        return self._whole(out)


def marker_of(line: str) -> tuple[int | None, str]:
    """The role that a line's marker names, and the line without it."""
    found = _MARKER.match(line)
    return (_NAMES[found[1].lower()], line[found.end() :]) if found else (None, line)


def lines_of(pieces: list[tuple[int, str | None]]) -> tuple[list[tuple[int, str, int | None, bool, bool]], bool]:
    """Of the lines that are not blank: the piece's place, the line without marker, its marker, whether a blank line is before it,
    whether it asks. Then whether a blank line comes after the last of them."""
    out, blank = [], False
    for place, (_, text) in enumerate(pieces):
        for line in (text or "").split("\n"):
            if not line.strip():
                blank = True
                continue
            marker, rest = marker_of(line)
            out.append((place, rest, marker, blank, rest.rstrip().endswith("?")))
            blank = False
    return out, blank


def emissions(lines: list, model: Model, carried: bool) -> list[np.ndarray]:
    """Log odds of each line; carried: a blank line comes before the block."""
    return [model.seen[m, b or (carried and k == 0), a] for k, (_, _, m, b, a) in enumerate(lines)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


#: A block's part in the chain: by what is carried into it the matrix from each state before it to each after it (states and
#: FRESH), and what it carries on.
Link = tuple[np.ndarray, np.ndarray]


def link_of(lines: list, blank: bool, model: Model) -> Link:
    mats = np.full((2, FRESH + 1, FRESH + 1), -np.inf)
    for c in (0, 1):
        m = np.where(np.eye(FRESH + 1, dtype=bool), 0.0, -np.inf)
        for e in emissions(lines, model, bool(c)):
            m = np.column_stack([_times(m, model.moves) + e[None, :], np.full(FRESH + 1, -np.inf)])
        mats[c] = m
    return mats, np.array([blank, blank if lines else True])


def chained(links: list[Link]) -> Link:
    mats, carry = links[0]
    for more, out in links[1:]:
        mats = np.stack([_times(mats[c], more[int(carry[c])]) for c in (0, 1)])
        carry = out[carry.astype(int)]
    return mats, carry


def exits(links: list[Link], entry: np.ndarray, carried: bool, last: int | None) -> list[tuple[np.ndarray, bool, int]]:
    """Of each link the scores before it, what is carried into it, and the state after it on the likeliest way."""
    before, score = [], entry
    for mats, carry in links:
        before.append((score, carried, mats[int(carried)]))
        score = (score[:, None] + mats[int(carried)]).max(axis=0)
        carried = bool(carry[int(carried)])
    state = int(score.argmax()) if last is None else last
    out = []
    for scores, c, m in reversed(before):
        out.append((scores, c, state))
        state = int((scores + m[:, state]).argmax())
    return out[::-1]


def viterbi(entry: np.ndarray, lines: list[np.ndarray], model: Model, last: int | None = None) -> list[int]:
    """The likeliest states of a block's lines (their log odds), given scores before it and the state at its end."""
    score, back = entry, []
    for k, e in enumerate(lines):
        ways = score[:, None] + (model.moves if k == 0 else model.moves[:FRESH])
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    state = int(score.argmax()) if last is None else last
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def fresh() -> np.ndarray:
    out = np.full(FRESH + 1, -np.inf)
    out[FRESH] = 0.0
    return out


def _pieces(pieces: DataFrame, key: str, number: str, text: str, role: str | None = None) -> DataFrame:
    """(key, number, text, h, role, copies): one row for repeated ones."""
    role_of = F.lit(None).cast("string") if role is None else F.col(f"`{role}`").cast("string")
    rows = pieces.select(F.col(f"`{key}`").alias("key"), F.col(f"`{number}`").cast("long").alias("number"), F.col(f"`{text}`").cast("string").alias("text"), role_of.alias("role"))
    return rows.groupBy("key", "number", "text", "role").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("text"))


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, block, apart, sub, pieces): pieces in order; blocks of neighbouring numbers, cut by number and hash where they are more
    than CROWD; apart: a block of its run is cut, so that the run's blocks are no run together."""
    block = F.floor(F.coalesce(F.col("number"), F.lit(-1 << 62)) / BLOCK_TURNS).alias("block")
    rows = rows.filter("key IS NOT NULL").select("*", block)
    crowd = rows.groupBy(F.col("key").alias("__k"), F.col("block").alias("__b")).agg(F.count("*").alias("m")).filter(F.col("m") > CROWD)
    crowd = crowd.select("__k", "__b", F.floor(F.col("m") / CROWD + 1).alias("parts"))
    crowd = materialize(crowd, "chat-crowd")  # one for CROWD rows at most
    runs = crowd.select(F.col("__k").alias("__r"), F.floor(F.col("__b") / SUPER).alias("__s"), F.lit(True).alias("apart")).distinct()
    part = F.floor((F.shiftrightunsigned("h", 33)) * F.col("parts") / float(1 << 31))
    place = lambda c: F.when(F.col("parts").isNotNull(), c).otherwise(F.lit(0).cast("long"))
    order = F.struct(place(F.coalesce("number", F.lit(-1 << 62))).alias("n"), place(part.cast("long")).alias("p"))
    dealt = rows.join(crowd, (rows["key"] == crowd["__k"]) & (rows["block"] == crowd["__b"]), "left")
    dealt = dealt.join(runs, (F.col("key") == F.col("__r")) & (F.floor(F.col("block") / SUPER) == F.col("__s")), "left")
    dealt = dealt.select("key", "block", F.coalesce("apart", F.lit(False)).alias("apart"), order.alias("sub"), "number", "h", "text", "role", "copies")
    inside = F.struct("number", F.shiftrightunsigned("h", 33).alias("u"), "h", "text", "role", "copies")
    return dealt.groupBy("key", "block", "apart", "sub").agg(F.sort_array(F.collect_list(inside)).alias("pieces"))


def fit(pieces: DataFrame, *, key: str, number: str, text: str, role: str) -> Model:
    """Counts features and transitions of labelled turns, each a piece with its role. Transitions are counted inside blocks."""
    rows = _pieces(bounded(pieces.filter(F.col(f"`{role}`").isin(*ROLES))), key, number, text, role)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(SLOTS)
        at = {name: s.start for name, s in _SLOTS.items()}
        for b in slices(batches, 200):
            for block, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, _ = lines_of([(p["number"], p["text"]) for p in cell])
                roles = [ROLES.index(p["role"]) for p in cell]
                seen = -1
                for place, _, marker, blank, asks in lines:
                    r, begins = roles[place], place != seen
                    c[at["on"] + (not begins)] += 1
                    c[at["blank"] + 2 * begins + blank] += 1
                    c[at["asks"] + 2 * r + asks] += 1
                    if begins:
                        c[at["begin"] + (0 if marker == r else 1 if marker is None else 2)] += 1
                        if seen >= 0:
                            c[at["next"] + 3 * roles[seen] + r] += 1
                        elif block == 0:
                            c[at["first"] + r] += 1
                    else:
                        c[at["inside"] + (marker is not None)] += 1
                    seen = place
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], names=["sums"])

    return Model(add_up(_blocks(rows).select("block", "pieces").mapInArrow(run, "sums binary")))


def _packed(links: list[Link]) -> list[bytes]:
    return [mats.astype("<f8").tobytes() + bytes(carry.astype(np.uint8)) for mats, carry in links]


def _unpacked(raw: bytes) -> Link:
    return np.frombuffer(raw[:-2], dtype="<f8").reshape(2, FRESH + 1, FRESH + 1), np.frombuffer(raw[-2:], dtype=np.uint8).astype(bool)


def _by_group(rows: DataFrame, group: int, work, made: str) -> DataFrame:
    """work(rows of a group: lists of values) for each run of rows that agree in their first `group` columns; sorted by the caller."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return made

        for b in slices(batches, 1000):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:group] != now:
                    if held:
                        out += work(held)
                    now, held = row[:group], []
                held.append(row)
                if len(out) > 1000:
                    yield batch()
        if held:
            out += work(held)
        yield batch()

    return rows.mapInArrow(run, made)


def parse(pieces: DataFrame, *, key: str, number: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, number, role, begins, n_lines, rendered) of each piece of a transcript.

    role is that of the piece's first line, begins whether a turn starts there, rendered its lines as
    canonical turns; lines that go on with a turn from an earlier piece are rendered under its role.
    """
    spark, model = pieces.sparkSession, model or Model()
    n = shuffle_partitions(spark)
    kind = pieces.schema[key].dataType.simpleString()
    rows = materialize(_pieces(bounded(pieces), key, number, text), "chat-pieces")
    blocks = materialize(_blocks(rows), "chat-blocks")
    pairs_of = lambda cell: [(p["number"], p["text"]) for p in cell]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            found = []
            for cell in b.column(3).to_pylist():
                lines, blank = lines_of(pairs_of(cell))
                found.append(link_of(lines, blank, model))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_packed(found), pa.binary())], names=["key", "run", "at", "link"])

    run = F.when(F.col("apart"), F.struct(F.col("block").alias("a"), F.col("sub.n").alias("n"), F.floor(F.col("sub.p") / SUPER).alias("p"))).otherwise(F.struct(F.floor(F.col("block") / SUPER).alias("a"), F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("p")))
    small = blocks.select("key", F.struct("apart", run.alias("r")).alias("run"), F.struct("block", "sub").alias("at"), "pieces")
    run_kind, at_kind = "run struct<apart:boolean,r:struct<a:long,n:long,p:long>>", "at struct<block:long,sub:struct<n:long,p:long>>"
    near = materialize(small.mapInArrow(links, f"key {kind}, {run_kind}, {at_kind}, link binary"), "chat-links")
    near_run = near.repartition(n, "key", "run").sortWithinPartitions("key", "run", "at")
    whole = _by_group(near_run, 2, lambda held: [(held[0][0], held[0][1], held[0][2], _packed([chained([_unpacked(r[3]) for r in held])])[0])], f"key {kind}, {run_kind}, {at_kind}, link binary")

    def between(held: list) -> list:
        found = exits([_unpacked(r[3]) for r in held], fresh(), False, None)
        return [(r[0], r[1], e.astype("<f8").tobytes(), c, s) for r, (e, c, s) in zip(held, found, strict=True)]

    ends = _by_group(whole.select("key", "run", "at", "link").repartition(n, "key").sortWithinPartitions("key", "at"), 1, between, f"key {kind}, {run_kind}, entry binary, carried boolean, last int")
    ends = materialize(ends, "chat-runs")
    within = near.join(ends, ["key", "run"]).select("key", "run", "at", "link", "entry", "carried", "last").repartition(n, "key", "run").sortWithinPartitions("key", "run", "at")

    def inside(held: list) -> list:
        found = exits([_unpacked(r[3]) for r in held], np.frombuffer(held[0][4], dtype="<f8"), held[0][5], held[0][6])
        return [(r[0], r[2], e.astype("<f8").tobytes(), c, s) for r, (e, c, s) in zip(held, found, strict=True)]

    steps = _by_group(within, 2, inside, f"key {kind}, {at_kind}, entry binary, carried boolean, last int")
    placed = blocks.select("key", F.struct("block", "sub").alias("at"), "pieces").join(steps, ["key", "at"]).select("key", "pieces", "entry", "carried", "last")
    alone = rows.filter("key IS NULL").select("key", F.array(F.struct("number", F.shiftrightunsigned("h", 33).alias("u"), "h", "text", "role", "copies")).alias("pieces"), F.lit(None).cast("binary").alias("entry"), F.lit(False).alias("carried"), F.lit(None).cast("int").alias("last"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows = []
            for k, cell, raw, carried, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                entry = fresh() if raw is None else np.frombuffer(raw, dtype="<f8")
                items = pairs_of(cell)
                lines, _ = lines_of(items)
                states = viterbi(entry, emissions(lines, model, carried), model, last) if lines else []
                # Without a line the state after the block is the one before it.
                state = (int(last) if last is not None else FRESH) if not lines else int((entry + model.moves[:, states[0]]).argmax())
                role = None if state == FRESH else STATES[state][0]
                at = 0
                for place, (no, _) in enumerate(items):
                    mine = []
                    while at < len(lines) and lines[at][0] == place:
                        mine.append((*STATES[states[at]], lines[at][1]))
                        at += 1
                    if mine:
                        role = mine[0][0]
                    rows.append((k, no, None if role is None else ROLES[role], bool(mine and mine[0][1]), len(mine), render(mine), cell[place]["copies"]))
                    if mine:
                        role = mine[-1][0]
            kinds = (b.column(0).type, pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "number", "role", "begins", "n_lines", "rendered", "copies"])

    out = placed.unionByName(alone).mapInArrow(decode, f"key {kind}, number long, role string, begins boolean, n_lines long, rendered string, copies long")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def render(lines: list[tuple[int, bool, str]]) -> str:
    """Canonical turns of lines (role, begins, text)."""
    out: list[str] = []
    for role, begins, text in lines:
        if begins or not out:
            if out:
                out.append("<|end|>")
            out.append(f"<|{ROLES[role]}|>")
        out.append(text.strip())
    return "\n".join([*out, "<|end|>"]) if out else ""


#: Marker styles of the query's transcripts; {} is the speaker.
STYLES = ("{}: ", "### {}: ", "[{}] ", "**{}:** ")


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as somebody might have saved them: a style of markers each, one marker in five and one blank line in six missing."""
    speaker = F.element_at(F.create_map(*(F.lit(x) for pair in (("system", "System"), ("user", "User"), ("assistant", "Assistant")) for x in pair)), F.coalesce("role", F.lit("user")))
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "conv_id", "turn"), F.lit(30)).cast("int")
    style: Column = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    marked = F.when((pick("marker") < 6) & (F.col("turn") > 0), F.lit("")).otherwise(F.replace(F.element_at(F.array(*map(F.lit, STYLES)), style + 1), F.lit("{}"), F.coalesce(speaker, F.lit("User"))))
    gap = F.when((pick("gap") < 5) | (F.col("turn") == 0), F.lit("")).otherwise(F.lit("\n"))
    return conversations.withColumn("raw", F.concat(gap, marked, F.coalesce("text", F.lit(""))))


def trains(key: str) -> Column:
    """Conversations whose roles are learned from: a third, by their ids."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of conversations, from transcripts without roles: the recovered role beside the true one.

    The model learns from a third of the conversations (`held_out` is false). Of several true roles of a turn the least is given.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    raw = raw_transcripts(turns)
    model = fit(raw.filter(trains("conv_id")), key="conv_id", number="turn", text="raw", role="role")
    found = parse(raw, key="conv_id", number="turn", text="raw", model=model)
    true = turns.groupBy(F.col("conv_id").alias("__key"), F.col("turn").cast("long").alias("__number")).agg(F.min("role").alias("true_role"))
    out = found.join(true, found["key"].eqNullSafe(true["__key"]) & found["number"].eqNullSafe(true["__number"]), "left")
    held = F.coalesce(~trains("conv_id"), F.lit(True))
    return out.select(F.col("key").alias("conv_id"), F.col("number").alias("turn"), "true_role", F.col("role").alias("parsed_role"), "begins", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256")).withColumn("held_out", held)
