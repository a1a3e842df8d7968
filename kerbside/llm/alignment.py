"""Alignment of two tokenizations of one text: byte-level BPE (A) and sentence pieces (B).

Both tokenizers encode the whole text behind a space.  Where a token of A and one of B end at the same byte and the
next of both starts with a space lies an anchor; anchors split a document into windows of token ids, and the
alignment of a window is worked out once for each pair of id tuples that a task meets.

Encoding is exact and mostly a matter of memory: before a space that follows no white space A always starts
a pre-token, and B, where no piece of its vocabulary holds a space mark behind another character, can never merge over it.  So
what lies between such spaces is encoded once.  A vocabulary of other pieces, or a text that B does not give back byte by
byte, is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import staged
from kerbside.llm.secrets import default_vocabulary, encoder

SPACE_MARK = "▁"
CUT = re.compile(r"(?<=\S) ")
#: Characters of texts encoded at a time, and bounds of the memory of a task.
SLICE, MEMORY_CHUNKS, MEMORY_CHARS = 1 << 20, 250_000, 8 << 20
#: Pairs of ids that are sent to all tasks; with more of them documents and pairs meet by shuffle.
BROADCAST_PAIRS = 4_000_000
SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a: int, b: int, n: int>>"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Links:
    """Numbers in one growing array; a run of them is known by where it begins and how many it has."""

    def __init__(self):
        self.data, self.size = np.empty(1 << 16, dtype=np.int64), 0

    def add(self, values: np.ndarray) -> int:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(end, len(self.data)), dtype=np.int64)])
        self.data[self.size:end] = values
        start, self.size = self.size, end
        return start

    def runs(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The given runs end to end."""
        total = int(sizes.sum())
        return self.data[np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total)] if total else np.empty(0, np.int64)


class Aligner:
    """Both tokenizers with a bounded memory of chunks and windows."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        self.a = encoder(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.wide_a, self.wide_b = (np.array([len(t) for t in tokens], dtype=np.int64) for tokens in (self.bytes_a, self.bytes_b))
        self.mark_a, self.mark_b = (np.array([t.startswith(b" ") for t in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = (list(map(str, range(len(tokens)))) for tokens in (self.bytes_a, self.bytes_b))
        self.lone = names.index(SPACE_MARK) if SPACE_MARK in names else None
        probe = " a  b "
        self.cuts = (self.lone is not None and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)
                     and self.joined_b(self.b.encode(probe)) == b" " + probe.encode())
        self.chunks: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Only chunks that came back since the last time stay, if they are the smaller part."""
        kept = np.flatnonzero(self.hits[:len(self.chunks)] > 1) if self.chunks else np.empty(0, np.int64)
        if len(kept) > MEMORY_CHUNKS // 2:
            kept = kept[:0]
        names = list(self.chunks)
        old = (self.texts, self.numbers, self.links) if len(kept) else ([], np.empty((0, 6), np.int64), Links())
        self.chunks = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.held = sum(map(len, self.chunks))
        self.windows: dict[tuple[bytes, bytes], int] = {}
        # of a window: text of its groups; groups, where its links begin, how many
        self.window_texts: list[str] = []
        self.window_rows: list[tuple[int, int, int]] = []
        self.links = Links()
        # of a chunk: the same, with the tokens of both sides, and whether both give back its bytes
        self.texts: list[str] = [old[0][k] for k in kept.tolist()]
        self.numbers = np.empty((max(1 << 12, 2 * len(kept)), 6), dtype=np.int64)
        self.numbers[:len(kept)] = old[1][kept]
        self.numbers[:len(kept), 3] = np.cumsum(np.r_[0, old[1][kept, 4]])[:-1]
        self.links.add(old[2].runs(old[1][kept, 3], old[1][kept, 4]))
        self.hits = np.zeros(len(self.numbers), dtype=np.int64)

    hits = np.empty(0, dtype=np.int64)

    def joined_b(self, ids) -> bytes:
        return b"".join(map(self.bytes_b.__getitem__, ids))

    def tokens(self, new: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for chunks, each behind a space."""
        # behind a character that is no white space the next chunk's space begins a pre-token, so A takes many chunks in one text
        joint = [bool(c) and not c[-1].isspace() for c in new] if self.cuts else [False] * len(new)
        flat = self.a.encode_ordinary("".join(" " + c for c, j in zip(new, joint) if j))
        ends = np.cumsum(self.wide_a[flat]) if flat else np.empty(0, np.int64)
        marks = np.searchsorted(ends, np.cumsum([1 + len(c.encode()) for c, j in zip(new, joint) if j])) + 1
        cuts = iter(zip([0, *marks.tolist()], marks.tolist()))
        a = []
        for c, j in zip(new, joint):
            if j:
                start, end = next(cuts)
                a.append(flat[start:end])
            else:
                a.append(self.a.encode_ordinary(" " + c))
        b = self.b.encode(new, num_threads=1)
        if self.lone is not None:
            b = [ids if c else [self.lone] for c, ids in zip(new, b)]
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Windows that follow one another, given by their tokens end to end and the bytes where they end:
        text of their groups, groups, links end to end, links of each."""
        end_a, end_b = np.cumsum(self.wide_a[a]), np.cumsum(self.wide_b[b])
        # between two neighbouring ends of either side lies one pair of overlapping tokens
        ends = np.union1d(end_a, end_b)
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        size = np.diff(np.searchsorted(ends, edges, side="right"), prepend=0)
        last = np.searchsorted(both, edges, side="right")
        to_a = (np.searchsorted(end_a, both) + 1).tolist()
        to_b = (np.searchsorted(end_b, both) + 1).tolist()
        own_a, own_b = list(map(self.name_a.__getitem__, a.tolist())), list(map(self.name_b.__getitem__, b.tolist()))
        groups = [",".join(own_a[i:j]) + "|" + ",".join(own_b[k:m]) for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        texts = [groups[i] if j - i == 1 else ";".join(groups[i:j]) for i, j in zip([0, *last.tolist()], last.tolist())]
        return texts, np.diff(last, prepend=0), links, size

    def aligned(self, a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(texts, numbers) of texts, given as for ``align``: they are cut into windows at their anchors, and what is known of a
        window by its ids is not worked out again.  Numbers: tokens of both sides, groups, place of the links, their count."""
        end_a, end_b = np.cumsum(self.wide_a[a]), np.cumsum(self.wide_b[b])
        anchors = np.intersect1d((end_a - self.wide_a[a])[self.mark_a[a]], (end_b - self.wide_b[b])[self.mark_b[b]], assume_unique=True)
        stops = np.union1d(anchors[anchors > 0], edges)
        to_a, to_b = np.searchsorted(end_a, stops) + 1, np.searchsorted(end_b, stops) + 1
        data_a, data_b = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        cut_a, cut_b = [0, *(4 * to_a).tolist()], [0, *(4 * to_b).tolist()]
        keys = [(data_a[i:j], data_b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        fresh = [k for k in dict.fromkeys(keys) if k not in self.windows]
        if fresh:
            new_a = np.frombuffer(b"".join(k[0] for k in fresh), np.int32).astype(np.int64)
            new_b = np.frombuffer(b"".join(k[1] for k in fresh), np.int32).astype(np.int64)
            count = np.cumsum([len(k[0]) // 4 for k in fresh])
            texts, groups, links, size = self.align(new_a, new_b, np.cumsum(self.wide_a[new_a])[count - 1])
            start = self.links.add(links) + np.r_[0, np.cumsum(size)[:-1]]
            for k, t, row in zip(fresh, texts, zip(groups.tolist(), start.tolist(), size.tolist())):
                self.windows[k] = len(self.window_texts)
                self.window_texts.append(t)
                self.window_rows.append(row)
        at = list(map(self.windows.__getitem__, keys))
        rows = np.array([self.window_rows[w] for w in at], dtype=np.int64).reshape(-1, 3)
        of = np.searchsorted(edges, stops)
        first = np.searchsorted(stops, np.r_[0, edges[:-1]], side="right")
        numbers = np.zeros((len(edges), 5), dtype=np.int64)
        last_a, last_b = np.searchsorted(end_a, edges) + 1, np.searchsorted(end_b, edges) + 1
        numbers[:, 0], numbers[:, 1] = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        numbers[:, 2] = np.bincount(of, rows[:, 0], len(edges))
        numbers[:, 3] = rows[first, 1]
        numbers[:, 4] = np.bincount(of, rows[:, 2], len(edges))
        texts = [self.window_texts[at[i]] for i in first.tolist()]
        for d in np.flatnonzero(np.bincount(of, minlength=len(edges)) > 1).tolist():
            own = slice(int(first[d]), int(first[d]) + int((of == d).sum()))
            texts[d] = ";".join(self.window_texts[w] for w in at[own])
            numbers[d, 3] = self.links.add(self.links.runs(rows[own, 1], rows[own, 2]))
        return texts, numbers

    def learn(self, new: list[str]) -> None:
        """Encode and align chunks, each behind a space."""
        if not new:
            return
        a, b = self.tokens(new)
        data = [b" " + c.encode() for c in new]
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == d and self.joined_b(y) == d for x, y, d in zip(a, b, data)]
        first = len(self.texts)
        if first + len(new) > len(self.numbers):
            grown = max(2 * len(self.numbers), first + len(new))
            self.numbers = np.concatenate([self.numbers, np.empty((grown - len(self.numbers), 6), np.int64)])
            self.hits = np.concatenate([self.hits, np.zeros(grown - len(self.hits), np.int64)])
        rows = np.zeros((len(new), 6), dtype=np.int64)
        texts = [""] * len(new)
        ok = np.flatnonzero(good)
        if len(ok):
            flat_a, flat_b = (np.fromiter(chain.from_iterable(side[i] for i in ok.tolist()), np.int64) for side in (a, b))
            some, numbers = self.aligned(flat_a, flat_b, np.cumsum([len(data[i]) for i in ok.tolist()]))
            rows[ok, :5], rows[ok, 5] = numbers, 1
            for i, t in zip(ok.tolist(), some):
                texts[i] = t
        self.chunks.update(zip(new, range(first, first + len(new))))
        self.held += sum(map(len, new))
        self.numbers[first:first + len(new)] = rows
        self.texts += texts

    def run(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: (n_a, n_b, n_groups, n_links), its groups, and how many distinct pairs it has; then these pairs end to end
        and how often each comes."""
        if len(self.chunks) > MEMORY_CHUNKS or self.held > MEMORY_CHARS:
            self.forget()
        parts = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        self.learn([c for c in dict.fromkeys(chain.from_iterable(parts)) if c not in self.chunks])
        used = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(parts)), np.int64)
        doc = np.repeat(np.arange(len(texts)), list(map(len, parts)))
        broken = np.unique(doc[self.numbers[used, 5] == 0])
        if len(broken):
            # a chunk whose bytes B changes: the text counts only if all its bytes agree when it is taken in one piece
            whole = {d: (self.whole(texts[d]) if self.cuts else None) for d in broken.tolist()}
            stays = ~np.isin(doc, broken)
            used, doc = used[stays], doc[stays]
        n = len(texts)
        np.add.at(self.hits, used, 1)
        counts = np.stack([np.bincount(doc, self.numbers[used, c], n) for c in (0, 1, 2, 4)], axis=1).astype(np.int64)
        ends = np.searchsorted(doc, np.arange(n), side="right").tolist()
        own = list(map(self.texts.__getitem__, used.tolist()))
        groups = [";".join(own[i:j]) for i, j in zip([0, *ends], ends)]
        kinds, often = np.unique(doc * len(self.texts) + used, return_counts=True)
        of, kind = kinds // max(len(self.texts), 1), kinds % max(len(self.texts), 1)
        size = self.numbers[kind, 4]
        pairs = self.links.runs(self.numbers[kind, 3], size)
        # documents of a slice, and pairs of ids, are few enough for one number
        b_ids = len(self.bytes_b)
        code = np.repeat(of, size) * (len(self.bytes_a) * b_ids) + (pairs >> 32) * b_ids + (pairs & 0xFFFFFFFF)
        code, back = np.unique(code, return_inverse=True)
        times = np.bincount(back, np.repeat(often, size), len(code)).astype(np.int64)
        of, pair = code // (len(self.bytes_a) * b_ids), code % (len(self.bytes_a) * b_ids)
        pair = (pair // b_ids) << 32 | pair % b_ids
        if len(broken):
            for d, found in whole.items():
                if found is not None:
                    counts[d], groups[d] = found[0], found[1]
                    at = np.searchsorted(of, d)
                    of, pair, times = np.insert(of, at, [d] * len(found[2])), np.insert(pair, at, found[2]), np.insert(times, at, found[3])
        return counts, groups, np.bincount(of, minlength=n), pair, times

    def whole(self, text: str):
        """(counts, groups, pairs, how often each) of a text taken in one piece; nothing if its bytes do not agree."""
        a, b, data = self.a.encode_ordinary(" " + text), self.b.encode(text), b" " + text.encode()
        if self.joined_b(b) != data or b"".join(map(self.bytes_a.__getitem__, a)) != data:
            return None
        texts, numbers = self.aligned(np.array(a, np.int64), np.array(b, np.int64), np.array([len(data)]))
        pairs, n = np.unique(self.links.runs(numbers[:, 3], numbers[:, 4]), return_counts=True)
        return numbers[0, [0, 1, 2, 4]], texts[0], pairs, n


@lru_cache(maxsize=1)
def aligner(vocabulary: str, pieces: str) -> Aligner:
    return Aligner(vocabulary, pieces)


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, links) of every row; other columns are left behind, so none can clash.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, ids of A and B in order; ``links``: each linked pair of ids and how often it occurs.
    A null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros, an empty text, no links.
    Repeated rows and ids each give a row; an empty table gives an empty one.
    """
    paths = vocabulary or default_vocabulary(), pieces or default_pieces()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = rows.drop("t").schema
    for f in docs.sparkSession.createDataFrame([], SCHEMA).schema:
        out = out.add(f)
    names = out.fieldNames()

    def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE:
                yield start, i + 1
                start, size = i + 1, 0
        if start < len(texts):
            yield start, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in slices(texts):
                counts, groups, size, pairs, often = own.run(texts[start:end])
                links = pa.StructArray.from_arrays(
                    [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(often.astype(np.int32))],
                    names=["a", "b", "n"])
                offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), *[pa.array(counts[:, k]) for k in range(4)], pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(offsets, links)], names=names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best) for every linked pair of ids: the rows that hold it, and whether no pair of ``a`` has more."""
    pairs = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    # at most one row for each id of B meets at an id of A
    top = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its links.

    The pairs are counted over all rows.  Up to ``broadcast_pairs`` of them, by count, go to all tasks; more are
    joined by shuffle, where AQE splits the common pairs.  Either way a row's links come together by its own number.
    """
    names = [c for c in aligned.columns if c != "links"]
    rows = staged(aligned.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], "links").withColumn("uid", F.monotonically_increasing_id()))
    pairs = staged(pair_counts(rows))
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    each = rows.select("uid", F.inline("links")).join(pairs, ["a", "b"])
    sums = each.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    out = rows.drop("links").join(sums, "uid", "left")
    zero = F.lit(0).cast("long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"))
