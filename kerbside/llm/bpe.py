"""BPE encoding and decoding by reuse of content-defined chunks.

A rolling hash over the bytes cuts a text where its content says so, so equal passages give equal chunks
in different documents.  A chunk is encoded once: the chunks that save most over the whole corpus are found by
a count, encoded once and handed to all tasks (at most ``DICTIONARY`` chunks of at most ``LARGEST`` bytes);
every other chunk is encoded once by a task.  Tokens next to a join of two chunks may differ from those of
the whole text.  They are encoded again from the last certain token boundary before the join to the first one
after it; without one, the window grows over further chunks, to the whole text at worst.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_rows, small_batches
from kerbside.llm.secrets import default_vocabulary, encoder

END, END_ID = "<|endoftext|>", 50256
SMALLEST, MEAN_BITS, LARGEST = 64, 9, 4096
DICTIONARY, CACHE_BYTES = 4096, 48 << 20
_GEAR = np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; each lies between two characters."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # after these steps each value covers the last 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    ends, last = [], 0

    def cut(at: int) -> int:
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
        return at

    for m in marks.tolist():
        while m - last > LARGEST:
            last = cut(last + LARGEST)
        if m - last >= SMALLEST:
            last = cut(m)
    while n - last > LARGEST:
        last = cut(last + LARGEST)
    if last < n:
        ends.append(n)
    return ends


def _is_boundary(data: bytes, at: int) -> bool:
    """Whether a space at ``at`` follows a character that is no white space: there every pre-token ends."""
    if at <= 0 or data[at] != 0x20:
        return False
    back = at - 1
    while back > 0 and data[back] & 0xC0 == 0x80:
        back -= 1
    return not data[back:at].decode("utf-8", "replace").isspace()


class Codec:
    """Encoder and decoder of one vocabulary with a bounded memory of chunks."""

    def __init__(self, vocabulary: str, shared: dict[bytes, bytes] | None = None):
        self.bpe = encoder(vocabulary)
        self.tokens = [self.bpe.decode_single_token_bytes(i) for i in range(self.bpe.n_vocab)]
        if self.bpe.n_vocab <= END_ID:
            self.tokens.append(END.encode())
        self.width = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.texts = [str(i) for i in range(len(self.tokens))]
        self.shared = shared or {}
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def plain(self, data: bytes) -> np.ndarray:
        self.encoded += 1
        return np.asarray(self.bpe.encode_ordinary(data.decode()), dtype=np.uint16)

    def chunk(self, data: bytes) -> np.ndarray:
        ids = self.cache.get(data)
        if ids is None:
            known = self.shared.get(hashlib.blake2b(data, digest_size=16).digest()) if self.shared else None
            ids = np.frombuffer(known, dtype=np.uint16) if known is not None else self.plain(data)
            self.held += len(data) + ids.nbytes + 200
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = len(data) + ids.nbytes + 200
            self.cache[data] = ids
        else:
            self.reused += 1
        return ids

    def segment(self, data: bytes) -> list[np.ndarray]:
        """Tokens of a text without special tokens, in pieces."""
        ends = cuts(data)
        out: list[np.ndarray] = []
        start = 0      # of the tokens held in ``ids``, which are exact but for what lies after the last boundary
        ids = np.empty(0, dtype=np.uint16)
        for i, end in enumerate(ends):
            piece = self.chunk(data[(ends[i - 1] if i else 0):end])
            if not i:
                ids = piece
                continue
            join = ends[i - 1]
            left = data.rfind(b" ", start, join)
            while left > start and not _is_boundary(data, left):
                left = data.rfind(b" ", start, left)
            if left <= start:
                left = start
            right = data.find(b" ", join + 1, end)
            while right >= 0 and not _is_boundary(data, right):
                right = data.find(b" ", right + 1, end)
            if right < 0:
                # no certain boundary in this chunk: all of it is encoded again, with what stood before it
                right = end
            tail = self.width[ids][::-1].cumsum()
            keep = len(ids) - (int(np.searchsorted(tail, join - left)) + 1 if join > left else 0)
            head = self.width[piece].cumsum()
            skip = int(np.searchsorted(head, right - join)) + 1
            middle = self.plain(data[left:right])
            out.append(ids[:keep])
            if right == end:
                start, ids = left, middle
            else:
                out.append(middle)
                start, ids = right, piece[skip:]
        out.append(ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for i, segment in enumerate(text.split(END)):
            if i:
                parts.append(np.array([END_ID], dtype=np.uint16))
            parts += self.segment(segment.encode())
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint16)

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")

    def written(self, ids) -> str:
        return ",".join(map(self.texts.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def shared_chunks(docs: DataFrame, text: str = "text", vocabulary: str | None = None, most: int = DICTIONARY) -> dict[bytes, bytes]:
    """Encodings of the ``most`` chunks whose reuse saves most bytes: hash of the chunk -> 16-bit ids.

    Bounded by ``most`` chunks of ``LARGEST`` bytes; it only saves work, the result is the same without it.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    small_batches(docs.sparkSession)

    def chunks(texts):
        for t in texts:
            for segment in t.split(END):
                data, at = segment.encode(), 0
                for end in cuts(data):
                    yield data[at:end]
                    at = end

    def count(batches):
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for c in chunks(b.column(0).to_pylist()):
                seen.setdefault(chunk_hash(c), [0, len(c)])[0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([n for n, _ in seen.values()], pa.int64()),
                 pa.array([w for _, w in seen.values()], pa.int64())], names=["h", "n", "w"])

    counted = rows.mapInArrow(count, "h binary, n long, w long").groupBy("h").agg(F.sum("n").alias("n"), F.first("w").alias("w"))
    best = counted.where("n > 1").orderBy((F.col("n") * F.col("w")).desc(), "h").limit(most).select("h")
    wanted = docs.sparkSession.sparkContext.broadcast({bytes(r.h) for r in best.collect()})

    def fetch(batches):
        # a task hands each wanted chunk on once
        had: set[bytes] = set()
        for b in batches:
            new = []
            for c in chunks(b.column(0).to_pylist()):
                if (h := chunk_hash(c)) in wanted.value and h not in had:
                    had.add(h)
                    new.append((h, c))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in new], pa.binary()), pa.array([c for _, c in new], pa.binary())], names=["h", "c"])

    def encode(batches):
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([own.plain(c).tobytes() for c in b.column(1).to_pylist()], pa.binary())], names=["h", "ids"])

    once = rows.mapInArrow(fetch, "h binary, c binary").groupBy("h").agg(F.min("c").alias("c"))
    return {bytes(r.h): bytes(r.ids) for r in once.mapInArrow(encode, "h binary, ids binary").collect()}


def _with_codec(docs: DataFrame, text: str, vocabulary: str | None, most: int, fn, schema: str) -> DataFrame:
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, text, path, most))

    def run(texts):
        own = codec(path)
        own.shared = shared.value
        return [fn(own, t) for t in texts]

    return map_rows(docs, run, text, schema)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, most: int = DICTIONARY) -> DataFrame:
    """Every row with ``ids`` (array of int) in place of its text, and ``exact``: they decode to the text; null text: no ids.

    The text ``<|endoftext|>`` is the special token.  Repeated rows each give a row, an empty table an empty one.
    """
    def one(own: Codec, t: str):
        ids = own.encode(t)
        return ids.astype(np.int32), own.decode(ids.tolist()) == t

    return _with_codec(docs, text, vocabulary, most, one, "ids array<int>, exact boolean")


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Every row with the ``decoded`` text in place of its ids; null ids: an empty text."""
    path = vocabulary or default_vocabulary()
    packed = encoded.withColumn(ids, F.concat_ws(",", F.col(ids).cast("array<string>")))
    return map_rows(packed, lambda texts: [(codec(path).decode(map(int, t.split(","))) if t else "",) for t in texts], ids, "decoded string")


def digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None, most: int = DICTIONARY) -> DataFrame:
    """Every row with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (the text decoded from its ids)."""
    def one(own: Codec, t: str):
        ids = own.encode(t).tolist()
        sha = hashlib.sha256
        return len(ids), sha(own.written(ids).encode()).hexdigest(), sha(own.decode(ids).encode()).hexdigest()

    return _with_codec(docs, text, vocabulary, most, one, "n_tokens long, ids_sha256 string, decoded_sha256 string")
