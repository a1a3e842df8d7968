"""Secret scans: key patterns, and random strings exposed by a low count of characters per token."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_rows

#: The base kinds in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of fewer than 24 characters fail and nothing of them can match again, so they need not be proposed.
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")

#: What could be a random string, and what is known not to be a secret by its shape.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
                    r"|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2})")
IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9_=+/-]+")
#: Names of parts, which are an identifier only if each part is a word by its characters per token.
COMPOUND = re.compile(r"([A-Za-z]+(?:[_=+/-]+[A-Za-z]+)+)[_/-]?[0-9]{0,8}")
PART = re.compile(r"[A-Za-z]+")
MAX_RATIO = 1.9


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE of a tiktoken rank file, loaded once for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def compound(s: str, vocabulary: str, max_ratio: float) -> bool:
    """Whether ``s`` is parts of letters, all words: a single letter, or more than ``max_ratio`` characters a token."""
    m = COMPOUND.fullmatch(s)
    return bool(m) and all(len(p) == 1 or len(p) > max_ratio * len(encoder(vocabulary).encode_ordinary(p)) for p in PART.findall(m[1]))


def random_spans(text: str, vocabulary: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """Strings of 20 characters or more, not only digits, with at most ``max_ratio`` characters a token."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0].strip("=-_/+")
        if len(s) < 20 or DIGEST.fullmatch(s) or IDENTIFIER.fullmatch(s):
            continue
        if len(s) <= max_ratio * len(encoder(vocabulary).encode_ordinary(s)) and not compound(s, vocabulary, max_ratio):
            found.append((m.start(), m.end()))
    return found


def spans(text: str, vocabulary: str, max_ratio: float = MAX_RATIO) -> tuple[list, list]:
    """Base spans, and all spans: (start, kind number, end), sorted; kind 3 is ``random``.

    A random string that overlaps a base span is not named again.
    """
    base = sorted(base_spans(text))
    more = [(a, 3, b) for a, b in random_spans(text, vocabulary, max_ratio)
            if not any(s < b and a < e for s, _, e in base)]
    return base, sorted(base + more)


NAMES = (*KINDS, "random")


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, text: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every row without its text, with ``kb_base``, ``kb_spans`` (kind:start:end, code points) and counts.

    Null text counts as empty; repeated rows each give a row; other columns, whatever their names, pass
    through unless named as the added ones.
    """
    path = vocabulary or default_vocabulary()

    def run(texts):
        rows = []
        for t in texts:
            base, every = spans(t, path, max_ratio)
            rows.append((written(base), written(every), *(sum(k == i for _, k, _ in every) for i in range(4))))
        return rows

    return map_rows(docs, run, text, "kb_base string, kb_spans string, n_assign long, n_access long, n_hex long, n_random long")


def masked(text: str, found: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by spans replaced once."""
    parts, at = [], 0
    for s, _, e in found:
        if s >= at:
            parts += [text[at:s], mask]
        at = max(at, e)
    return "".join(parts) + text[at:] if found else text


def redact(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` masked and ``n_chars`` the new length; null stays null."""
    path = vocabulary or default_vocabulary()

    def run(texts):
        return [(masked(t, spans(t, path, max_ratio)[1], mask),) for t in texts]

    rest = docs.withColumn("kb_null", F.col("text").isNull())
    out = map_rows(rest, run, "text", "kb_clean string")
    clean = F.when(~F.col("kb_null"), F.col("kb_clean"))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("kb_null"), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
