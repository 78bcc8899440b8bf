"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes chooses chunk ends, so that passages which documents share fall into
equal chunks wherever they stand. A worker encodes each distinct chunk once and keeps its ids in a
bounded two-generation cache (an evicted chunk is encoded again: only time is lost). Inside a new
chunk, the pieces between ASCII white space go through a second cache of the same kind. Chunk joins
are then checked: the text around each join is encoded anew and must agree with what the two chunks
gave; chunks whose join disagrees are merged and encoded as one, until every join agrees.

The reuse is per worker process. A corpus-wide table of chunks would shuffle all texts more than
once, which costs more than encoding the shared ones again in each worker; so the operator is one
map over the input without any shuffle, and a lost executor only repeats its own tasks.

Defined results: null and empty texts give no ids and an empty decoded text; repeated rows give
equal rows; the other columns of the input, whatever their names, pass through if listed in `keep`;
an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._spark import bounded, free_name, hold, slices, text_buffers

#: Bytes in the rolling window; the mean chunk has CHUNK bytes.
WINDOW, CHUNK = 16, 4096
#: A cut that finds no white space within so many bytes falls between two characters.
REACH = 256
#: Entries of each generation of the piece cache, bytes of each generation of the chunk cache.
PIECES, CHUNK_BYTES = 200_000, 24_000_000

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def tokenizer_path() -> str:
    """The public 49k word BPE file that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunk_cuts(data: np.ndarray, window: int = WINDOW, chunk: int = CHUNK, reach: int = REACH) -> np.ndarray:
    """Sorted inner cut positions of one text's bytes.

    The polynomial hash of the `window` bytes before each position is built by doubling; a position
    whose hash falls under 2^32 / chunk is moved forward to the next white space within `reach`
    bytes, else to the next start of a character. Equal surroundings give equal cuts.
    """
    n = len(data)
    if n <= window:
        return np.empty(0, dtype=np.int64)
    h, width, base = data.astype(np.uint32) + np.uint32(1), 1, 0x9E3779B1
    while width < window:
        h = h[:-width] * np.uint32(base) + h[width:]
        base, width = base * base & 0xFFFFFFFF, width * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    found = np.flatnonzero(h < np.uint32((1 << 32) // chunk)) + window
    if not len(found):
        return found
    spaces = np.flatnonzero(_SPACES[data])
    at = np.searchsorted(spaces, found)
    ahead = np.append(spaces, np.int64(n + reach + 1))[at]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    forced = np.append(starts, n)[np.searchsorted(starts, found)]
    cuts = np.unique(np.where(ahead - found <= reach, ahead, forced))
    return cuts[(cuts > 0) & (cuts < n)]


class ChunkEncoder:
    """Encodes texts by chunks with one tokenizer; results equal those of encoding whole texts."""

    def __init__(self, path: str, window: int = WINDOW, chunk: int = CHUNK, reach: int = REACH, pieces: int = PIECES, chunk_bytes: int = CHUNK_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.strings: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.strings[i] = token.encode()
        special = [(t.content.encode(), i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.single_word and not t.lstrip and not t.rstrip]
        self.mark = min(special, key=lambda x: x[1]) if special else None
        self.risk = self.mark[0][:2] if self.mark else b""
        self.window, self.chunk, self.reach = window, chunk, reach
        self.most_pieces, self.most_bytes = pieces, chunk_bytes
        # Of pieces, the ids and the decoded bytes; and whether any decodes to nothing.
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.old_ids: dict[bytes, bytes] = {}
        self.old_decoded: dict[bytes, bytes] = {}
        self.some_blank = False
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.old_chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0
        self.stats = {"chunks": 0, "reused": 0, "repaired": 0}

    def _whole(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian u32) and decoded bytes of each text, straight from the tokenizer.

        Many texts go in one call with a special token between them: the tokenizer cuts at special
        tokens before all else, so what stands on one side never changes the other. Texts that may
        hold such a token themselves are encoded one by one.
        """
        strings, out = self.strings, []
        if self.mark is None or len(texts) < 4 or any(self.risk in t for t in texts):
            for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
                ids = e.ids
                out.append((np.array(ids, dtype="<u4").tobytes(), b" ".join([strings[i] for i in ids])))
            return out
        for i in range(0, len(texts), 20_000):
            (e,) = self.tokenizer.encode_batch_fast([self.mark[0].join(texts[i : i + 20_000]).decode()], add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark[1]).tolist()
            raw, tokens = ids.tobytes(), [strings[x] for x in ids.tolist()]
            out += [(raw[4 * x : 4 * y], b" ".join(tokens[x:y])) for x, y in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True)]
        return out

    def learn(self, parts: Iterable[bytes]) -> None:
        """Put pieces in the cache; those that are new are encoded together."""
        have = self.ids
        new = [p for p in dict.fromkeys(parts) if p not in have]
        if len(have) + len(new) > self.most_pieces:
            self.old_ids, self.old_decoded = have, self.decoded
            have = self.ids = {}
            self.decoded = {}
            new = list(dict.fromkeys(parts))
        old, decoded, old_decoded, missing = self.old_ids, self.decoded, self.old_decoded, []
        for p in new:
            if (v := old.get(p)) is None:
                missing.append(p)
            else:
                have[p] = v
                decoded[p] = old_decoded[p]
        for p, (ids, text) in zip(missing, self._whole(missing) if missing else [], strict=True):
            have[p] = ids
            decoded[p] = text
            self.some_blank = self.some_blank or not text

    def _by_piece(self, chunk: bytes) -> tuple[bytes, bytes]:
        parts = chunk.split()
        try:
            ids = b"".join(map(self.ids.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            ids = b"".join(map(self.ids.__getitem__, parts))
        decoded = map(self.decoded.__getitem__, parts)
        return ids, b" ".join(filter(None, decoded) if self.some_blank else decoded)

    def encode_chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        self.stats["chunks"] += 1
        if (v := self.chunks.get(chunk)) is not None:
            self.stats["reused"] += 1
            return v
        if (v := self.old_chunks.get(chunk)) is None:
            v = self._by_piece(chunk)
        else:
            self.stats["reused"] += 1
        size = len(chunk) + len(v[0]) + len(v[1]) + 200
        if self.held + size > self.most_bytes:
            self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
        if size < self.most_bytes // 8:
            self.chunks[chunk] = v
            self.held += size
        return v

    def _agrees(self, left: bytes, right: bytes) -> bool:
        """Whether the text around a join, encoded anew, gives what both sides give."""
        tail = left.rsplit(None, 1)[-1] if left.strip() else b""
        tail = tail if left.endswith(tail) else b""
        head = right.split(None, 1)[0] if right.strip() else b""
        gap = right[: right.find(head)] if head else right
        if not tail or not head:
            return True
        apart = self._by_piece(tail)[0] + self._by_piece(head)[0]
        return self._whole([tail + gap + head])[0][0] == apart

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian u32 bytes, and the decoded text's bytes."""
        cuts = chunk_cuts(np.frombuffer(text, dtype=np.uint8), self.window, self.chunk, self.reach).tolist()
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        joins = [self._agrees(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while not all(joins):
            self.stats["repaired"] += joins.count(False)
            merged, run = [], [parts[0]]
            kept: list[bool | None] = []
            touched = False
            for good, part in zip(joins, parts[1:], strict=True):
                if good:
                    merged.append((b"".join(run), touched))
                    run, touched = [part], False
                else:
                    run.append(part)
                    touched = True
            merged.append((b"".join(run), touched))
            for (a, x), (b, y) in zip(merged, merged[1:], strict=False):
                kept.append(self._agrees(a, b) if x or y else True)
            parts, joins = [p for p, _ in merged], kept
        values = [self.encode_chunk(p) for p in parts]
        return b"".join([v[0] for v in values]), b" ".join([v[1] for v in values if v[1]])

    def decode(self, ids: bytes) -> bytes:
        """What the tokenizer's decode(ids, skip_special_tokens=False) gives."""
        return b" ".join([self.strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so that chunks are shared by all documents it sees."""
    return hold(("bpe", path), lambda: ChunkEncoder(path))


def encode_decode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Columns `keep`, then n_tokens (long), ids (binary, little-endian u32) and decoded (string)."""
    path = path or tokenizer_path()
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in slices(batches, holds=True):
            view, offsets = text_buffers(b.column(len(keep)))
            data = bytes(view)
            own.learn({p for i, j in zip(offsets, offsets[1:], strict=False) for p in data[i:j].split()})
            out = [own.encode(data[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            ids = pa.array([v[0] for v in out], pa.binary())
            decoded = pa.array([v[1] for v in out], pa.binary()).cast(pa.string())
            columns = [*b.columns[: len(keep)], pa.array([len(v[0]) // 4 for v in out], pa.int64()), ids, decoded]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(free_name(keep)))
    return bounded(chosen).mapInArrow(run, schema)


def ids_array(ids: str = "ids") -> F.Column:
    """The binary ids as an array of longs, with built-in functions."""
    h = F.hex(F.col(ids))
    at = lambda i, k: F.substring(h, (i * 8 + 1 + 2 * k).cast("int"), F.lit(2))
    positions = F.when(F.length(ids) == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), (F.length(ids) / 4).cast("long") - 1))
    return F.transform(positions, lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
