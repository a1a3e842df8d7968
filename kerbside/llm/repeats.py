"""Removal of repeated passages: fixed-block anchors, probed by every rolling window and extended to maximal repeats.

A repeat of ``window`` words holds, wherever it starts, one whole block of ``(window + 1) // 2`` words of the grid that
cuts its reference document into blocks without overlap.  So the blocks of all documents are indexed, every rolling window
of a block's length probes them, and only around hits is anything extended: the windows over a hit are keyed by their
words, and the least document of each key decides.  What lies under windows with an earlier document, taken together,
are the maximal exact repeats.

Documents travel in packs, a bounded share of the text each, and hashes in parts, a bounded share of them each.  A
pack sends a part its distinct hashes in one row and gets one bit for each back, so a passage that half of all documents
share costs one entry for each pack, never a pair of documents.  The text is shuffled once, by pack.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SEED = 13, 42
#: Words of a pack and hashes of a part, as long as ``SMALL_WORDS`` words are not exceeded; beyond, both grow with the root of their number,
#: so that a row from a pack to a part keeps over sixty hashes.
PACK_WORDS, PART_HASHES, SMALL_WORDS = 600_000, 1_500_000, 10_000_000_000
#: Words kept by their hash in a Python worker.
MEMORY_WORDS = 400_000
#: Bytes sent of a block hash, whose part is known besides (equal ones of unequal blocks only cost a look at the windows there),
#: and of each half of a window's key, which decides.
BLOCK_BYTES, KEY_BYTES = 5, 6
_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < MEMORY_WORDS:
            self[word] = value
        return value


_WORDS = Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` words: a polynomial in ``factor``, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= factor
        total += hashes[k:k + n]
    return mixed(total)


@dataclass
class Pack:
    """Documents of one pack: distinct (id, text) pairs with how often each comes, and the hashes of their words end to end."""

    ids: list
    texts: list[bytes]
    times: list[int]

    def __post_init__(self):
        self.words = [t.split() for t in self.texts]
        self.start = np.cumsum([0, *map(len, self.words)])
        one = _WORDS.__getitem__
        self.hashes = np.fromiter((one(w) for ws in self.words for w in ws), dtype=np.uint64, count=int(self.start[-1]))

    def inside(self, width: int) -> np.ndarray:
        """Which runs of ``width`` words lie in one document."""
        n = max(len(self.hashes) - width + 1, 0)
        ok = np.ones(n, dtype=bool)
        for edge in self.start[1:-1].tolist():
            ok[max(edge - width + 1, 0):edge] = False
        return ok

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Number of the document at each place."""
        return np.searchsorted(self.start, places, side="right") - 1


def pack_of(t: pa.Table) -> Pack:
    seen: dict[tuple, int] = {}
    for key in zip(t.column("id").to_pylist(), t.column("text").to_pylist()):
        seen[key] = seen.get(key, 0) + 1
    return Pack([k[0] for k in seen], [k[1] for k in seen], list(seen.values()))


class Anchors:
    """Distinct rolling block hashes of a pack in ascending order; the low two bits of a sent value say whether the
    hash is that of a grid block here, and whether it lies in more than one document here."""

    def __init__(self, pack: Pack, block: int):
        ok = np.flatnonzero(pack.inside(block))
        self.at = ok
        value = rolling(pack.hashes, block, _ONE)[ok] & ~np.uint64(3)
        owner = pack.owner(ok)
        grid = (ok - pack.start[owner]) % block == 0
        self.hash, self.back = np.unique(value, return_inverse=True)
        least = np.full(len(self.hash), len(pack.ids))
        most = np.full(len(self.hash), -1)
        np.minimum.at(least, self.back, owner)
        np.maximum.at(most, self.back, owner)
        flags = (least != most).astype(np.uint64) << np.uint64(1)
        flags[self.back[grid]] |= np.uint64(1)
        self.sent = self.hash | flags


class Windows:
    """Distinct windows around the hits of a pack, ascending by their 128-bit key, each with its least document here."""

    def __init__(self, pack: Pack, anchors: Anchors, shared: np.ndarray, window: int, block: int):
        hit = np.zeros(len(pack.hashes) + 1, dtype=np.int32)
        hit[anchors.at[shared[anchors.back]]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        ok = pack.inside(window)
        # a window is extended from any hit that it covers
        near = before[window - block + 1:][:len(ok)] > before[:len(ok)]
        self.at = np.flatnonzero(ok & near)
        one = rolling(pack.hashes, window, _ONE)[self.at]
        two = rolling(mixed(pack.hashes + _TWO), window, _TWO)[self.at]
        self.owner = pack.owner(self.at)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
        self.back = np.empty(len(order), dtype=np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.one, self.two = one[new], two[new]
        ids = rank_of(pack.ids)
        self.rank = ids[self.owner]
        self.least = np.full(len(self.one), len(pack.ids), dtype=np.int64)
        np.minimum.at(self.least, self.back, self.rank)


def rank_of(ids: list) -> np.ndarray:
    """Place of each id among the distinct ids; a null id has none and stands last, beyond every id."""
    place = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    return np.array([place.get(v, len(place)) for v in ids], dtype=np.int64)


def place_type(ids: int) -> type:
    return np.uint16 if ids < 1 << 16 else np.uint32


def bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the parts in ascending 64-bit hashes."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def short(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def longer(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def sizes(words: int, pack_words: int, part_hashes: int, small: int) -> tuple[int, int]:
    """(packs, parts) for a corpus of so many words."""
    wider = max(1.0, math.sqrt(words / small))
    return max(1, math.ceil(words / (pack_words * wider))), max(1, math.ceil(words / (part_hashes * wider)))


def batch(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


SENT = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("ids", pa.list_(pa.int64())), ("of", pa.binary())])
BACK = pa.schema([("pack", pa.int64()), ("kind", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])


def replied(t: pa.Table, kind: int) -> np.ndarray:
    """The bits that all parts sent back to a pack, in the order of its hashes."""
    rows = sorted(r for r in zip(t.column("kind").to_pylist(), t.column("part").to_pylist(), t.column("bits").to_pylist()) if r[0] == kind)
    # the first four bytes say how many bits a part has
    found = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for _, _, b in rows]
    return np.concatenate(found).astype(bool) if found else np.empty(0, bool)


def bits_of(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def match_blocks(t: pa.Table) -> pa.Table:
    """One part of the index: which hashes are a grid block somewhere and lie in more than one document."""
    rows = list(zip(t.column("pack").to_pylist(), t.column("part").to_pylist(), (longer(b, BLOCK_BYTES) for b in t.column("keys").to_pylist())))
    sent = np.concatenate([r[2] for r in rows])
    value, back, times = np.unique(sent & ~np.uint64(3), return_inverse=True, return_counts=True)
    grid = np.zeros(len(value), dtype=bool)
    grid[back[(sent & np.uint64(1)) > 0]] = True
    many = times > 1  # every pack holds other documents
    many[back[(sent & np.uint64(2)) > 0]] = True
    good = (grid & many)[back]
    ends = np.cumsum([0, *[len(r[2]) for r in rows]])
    return batch(BACK, pack=[r[0] for r in rows], kind=[1] * len(rows), part=[r[1] for r in rows],
                 bits=[bits_of(good[a:b]) for a, b in zip(ends[:-1], ends[1:])])


def match_windows(t: pa.Table) -> pa.Table:
    """One part of the windows: which of a pack's have a smaller document elsewhere than its own least one."""
    rows = sorted(zip(t.column("pack").to_pylist(), t.column("part").to_pylist(), t.column("keys").to_pylist(), t.column("more").to_pylist(),
                      t.column("ids").to_pylist(), t.column("of").to_pylist()), key=lambda r: r[0])
    one = np.concatenate([longer(r[2], KEY_BYTES) for r in rows])
    two = np.concatenate([longer(r[3], KEY_BYTES) for r in rows])
    own, none = [], []
    for r in rows:
        known = np.array([*r[4], 0], dtype=np.int64)
        of = np.frombuffer(r[5], place_type(len(r[4])))
        own.append(known[of])
        none.append(of == len(r[4]))
    own, none = np.concatenate(own), np.concatenate(none)
    order = np.lexsort((own, none, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]
    earlier = np.empty(len(order), dtype=bool)
    # the first of each key has the least id; a key without any id has none earlier
    earlier[order] = ~none[first] & (none[order] | (own[order] > own[first]))
    ends = np.cumsum([0, *[len(r[2]) // KEY_BYTES for r in rows]])
    return batch(BACK, pack=[r[0] for r in rows], kind=[2] * len(rows), part=[r[1] for r in rows],
                 bits=[bits_of(earlier[a:b]) for a, b in zip(ends[:-1], ends[1:])])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, pack_words: int = PACK_WORDS,
                    part_hashes: int = PART_HASHES, small_words: int = SMALL_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept, removed) for every row: the words that stay, joined by one space, and the removed runs.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if it lies in ``window`` consecutive words that also stand in a row with a smaller id.
    ``removed`` holds maximal runs as (first word, number of words).  Null text: no words.  Rows of one id
    never shorten each other, equal rows give equal results, and a row with a null id keeps all its words and shortens none.  Ids are
    whole numbers.  Other columns are left behind, so none can clash; an empty table gives an empty one.
    """
    block = (window + 1) // 2
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    # about six bytes a word; the numbers only size packs and parts
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    packs, parts = sizes(words, pack_words, part_hashes, small_words)
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("id", "text"), F.lit(packs)).cast("long")).repartition(packs, "pack")

    def send(pack: int, hashes: np.ndarray, extra: dict | None = None) -> Iterator[dict]:
        ends = bounds(hashes, parts)
        for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if b > a:
                if extra is None:
                    yield {"part": p, "pack": pack, "keys": short(hashes[a:b], BLOCK_BYTES), "more": b"", "ids": [], "of": b""}
                else:
                    yield {"part": p, "pack": pack, "keys": short(hashes[a:b], KEY_BYTES), "more": short(extra["two"][a:b], KEY_BYTES),
                           "ids": extra["ids"], "of": extra["of"][a:b].tobytes()}

    def probe(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(send(t.column("pack")[0].as_py(), Anchors(pack_of(t), block).sent)), SENT)

    def extend(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SENT.empty_table()
        pack = pack_of(t)
        found = Windows(pack, Anchors(pack, block), replied(back, 1), window, block)
        ids = sorted({v for v in pack.ids if v is not None})
        extra = {"two": found.two, "of": found.least.astype(place_type(len(ids))), "ids": ids}
        return pa.Table.from_pylist(list(send(t.column("pack")[0].as_py(), found.one, extra)), SENT)

    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                     ("removed", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))])

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        pack = pack_of(t)
        found = Windows(pack, Anchors(pack, block), replied(back, 1), window, block)
        earlier = replied(back, 2)
        gone = found.at[(earlier[found.back] | (found.rank > found.least[found.back])) if len(found.at) else []]
        nameless = np.array([v is None for v in pack.ids])
        gone = gone[~nameless[pack.owner(gone)]] if len(gone) else gone
        cover = np.zeros(len(pack.hashes) + window + 1, dtype=np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        covered = np.cumsum(cover)[:len(pack.hashes)] > 0
        result = []
        for d, (key, times) in enumerate(zip(pack.ids, pack.times)):
            a, b = int(pack.start[d]), int(pack.start[d + 1])
            own, ws = covered[a:b], pack.words[d]
            runs = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2)
            kept = ws if not len(runs) else [w for w, g in zip(ws, own.tolist()) if not g]
            row = {"id": key, "n_words": b - a, "n_removed": int(own.sum()), "kept": b" ".join(kept).decode(),
                   "removed": [{"first": int(x), "words": int(y - x)} for x, y in runs]}
            result += [row] * times
        return pa.Table.from_pylist(result, out)

    sent_ddl = "part long, pack long, keys binary, more binary, ids array<long>, of binary"
    back_ddl = "pack long, kind long, part long, bits binary"
    anchored = rows.groupBy("pack").applyInArrow(probe, sent_ddl).groupBy("part").applyInArrow(match_blocks, back_ddl)
    # one exchange for both uses, as for the rows
    anchored = anchored.repartition(packs, "pack")
    extended = rows.groupBy("pack").cogroup(anchored.groupBy("pack")).applyInArrow(extend, sent_ddl)
    decided = extended.groupBy("part").applyInArrow(match_windows, back_ddl)
    done = rows.groupBy("pack").cogroup(anchored.union(decided).groupBy("pack")).applyInArrow(
        cut, "id long, n_words long, n_removed long, kept string, removed array<struct<first: long, words: long>>")
    return done.withColumnRenamed("id", id_col)
