"""Quality rules: fixed base rules, then a line-labelling field whose content share decides.

Every line of a text gets features; a linear-chain conditional random field, trained on the lines of labelled
documents, marks each as content or boilerplate by Viterbi decoding.  The share of characters in content lines decides.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_rows, small_batches
from kerbside.llm.crf import Crf, train

TRAIN_DOCS = 1500
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEATS, WINDOW = 10, 20, 5

_CODES = np.arange(256)
_SPACE = np.isin(_CODES, [0x20, *range(0x09, 0x0E)])
_LEAD = (_CODES & 0xC0) != 0x80
_SYMBOL = np.isin(_CODES, list(b"#*$%&|<>"))
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_STOP = np.isin(_CODES, list(b".,;:"))
_LOUD = np.isin(_CODES, list(b"!?"))
_CLASSES = [(_LEAD & ~_SPACE), _SYMBOL, _UPPER, _LOWER | (_CODES >= 0xC0), _DIGIT, _STOP, _LOUD, _CODES == 0x7C]
FEATURES = 17


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the text, the first one included."""
    if len(words) <= WINDOW:
        return 0
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def measure(data: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features of each line with a word."""
    words = data.split()
    lines = data.split(b"\n")
    raw = np.frombuffer(data + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    sums = np.stack([np.add.reduceat(c[raw].astype(np.int32), starts) for c in _CLASSES], 1).astype(np.float64)
    seen: dict[bytes, int] = {}
    dup = np.zeros(len(lines))
    shape = np.zeros((len(lines), 5))
    for i, line in enumerate(lines):
        own = line.split()
        if not own:
            continue
        dup[i] = line in seen
        seen[line] = i
        kinds = set(own)
        n = len(own)
        shape[i] = n, len(kinds) / n, max(map(len, own)), sum(1 for a, b in zip(own, own[1:]) if a == b) / n, line.rstrip()[-1:] in b".!?\"'"
    full = shape[:, 0] > 0
    chars, n, place = sums[:, 0], np.maximum(shape[:, 0], 1), np.arange(len(lines))
    per = sums[:, 1:] / np.maximum(chars, 1)[:, None]
    f = np.c_[np.log1p(chars), np.log1p(shape[:, 0]), chars / n / 10, per, shape[:, 1], shape[:, 2] / 20,
              shape[:, 3], shape[:, 4], dup, place == 0, place == len(lines) - 1]
    return len(words), int(sums[:, 0].sum()), int(sums[:, 1].sum()), int(dup.sum()), repeat_words(words), np.c_[f, chars][full]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> Crf:
    """Train on the lines of at most ``most`` labelled documents of each quality, taken by the hash of their ids.

    A line is content if its document has quality 1; lines that documents of both kinds hold are left unknown.
    Without labels of both kinds nothing can be learnt, and the field calls every line content.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("kb_q"))
    parts = [known.where(F.col("kb_q") == q).orderBy(F.xxhash64(id_col), id_col).limit(most) for q in (0, 1)]
    chosen = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("kb_t")).join(
        F.broadcast(parts[0].union(parts[1])), id_col)

    def run(texts):
        rows = []
        for t in texts:
            data = t.encode()
            f = measure(data)[-1][:, :-1]
            rows.append(([hash_line(x) for x in data.split(b"\n") if x.split()], f.astype(np.float32).tobytes()))
        return rows

    rows = map_rows(chosen, run, "kb_t", "lines array<long>, f binary", keep=["kb_q"]).collect()
    both = [set(h for r in rows if r.kb_q == q for h in r.lines) for q in (0, 1)]
    rows = [r for r in rows if r.lines]
    if len({r.kb_q for r in rows}) < 2:
        return Crf(np.r_[np.zeros((FEATURES, 2)), [[0.0, 1.0]]], np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES))
    rows.sort(key=lambda r: (r.kb_q, r.lines))
    shared = both[0] & both[1]
    marks = np.array([-1 if h in shared else r.kb_q for r in rows for h in r.lines])
    x = np.concatenate([np.frombuffer(r.f, dtype=np.float32).reshape(-1, FEATURES) for r in rows])
    return train(x, np.array([len(r.lines) for r in rows]), marks)


def hash_line(line: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line, 42) - 2**63


def judge(docs: DataFrame, field: Crf, text: str = "text", min_share: float = MIN_SHARE, keep: list[str] | None = None) -> DataFrame:
    """Every row (of it ``keep``, by default all but the text), with the base counts, ``content_share``, ``base_failed`` and ``kept``.

    Null or empty text: no words, so the base rules reject it (share 0).  Repeated rows each give a row; an
    empty table an empty one; other columns pass through.
    """
    def run(texts):
        found = [measure(t.encode()) for t in texts]
        lengths = np.array([len(m[-1]) for m in found], dtype=np.int64)
        lines = np.concatenate([m[-1] for m in found]) if found else np.empty((0, FEATURES + 1))
        content = field.viterbi(lines[:, :-1], lengths)
        rows, at = [], 0
        for (n, chars, symbols, dup, repeats, f), k in zip(found, lengths.tolist()):
            total = f[:, -1].sum()
            share = float((f[:, -1] * content[at:at + k]).sum() / total) if total else 0.0
            at += k
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATS * n
            rows.append((n, chars, symbols, dup, repeats, share, failed, not failed and share >= min_share))
        return rows

    small_batches(docs.sparkSession)
    return map_rows(docs, run, text, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                    "content_share double, base_failed boolean, kept boolean", keep)
