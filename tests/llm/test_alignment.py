"""Token alignment against the libraries on whole texts and a plain count of links."""

import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from kerbside.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
A.no_truncation()
A.no_padding()
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b ", "\n", "x\n y", "don't  stop\t now", "<|endoftext|> end", "<s> x </s> <0x41> <unk>", "▁", "a ▁b", "漢字かな交じり文 の テスト",
       "é é   　x", "\x00 a\x00b \x1c c", "🙂🙃 👩‍👩‍👧", "1234567 89, 10.5%", "A" * 300, "a b " * 400, " x \u0085 y", "ﬁ ½ Å"]


def byte_chars():
    """Character of each byte in the byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


CHARS = byte_chars()
NAMES = {i: t for t, i in A.get_vocab().items()}


def plain(text):
    """(ids of A, ids of B, groups, links by position) of one text, from ends of tokens alone."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    ta = [bytes(CHARS[c] for c in NAMES[i]) for i in a]
    tb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    data = (" " + text).encode()
    if b"".join(ta) != data or b"".join(tb) != data:
        return None

    def spans(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    sa, sb = spans(ta), spans(tb)
    links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (x, y) in enumerate(sb) if s < y and x < e]
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], 0
    for e in ends:
        groups.append(",".join(str(a[i]) for i, s in enumerate(sa) if at <= s[0] < e) + "|" + ",".join(str(b[j]) for j, s in enumerate(sb) if at <= s[0] < e))
        at = e
    return a, b, groups, links


def expected(texts):
    found = [plain(t) for t in texts]
    counts = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        a, b, groups, links = f
        out.append((len(a), len(b), len(groups), len(links), ";".join(groups), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)))
    return out


def texts():
    rng = random.Random(5)
    words = ["the", "quick,", "Straße", "año", "naïve.", "\n", "x1y2", "###", "  ", "\t", "日本", "don't", "", "ingea", "▁"]
    return [None, *ODD, *[" ".join(rng.choices(words, weights=[9, 5, 5, 5, 5, 1, 3, 1, 1, 1, 2, 3, 1, 9, 0.05], k=rng.randrange(60))) for _ in range(60)]]


@pytest.mark.parametrize("broadcast_pairs", [0, 10**6])
def test_equals_libraries_and_plain_count(spark, broadcast_pairs):
    given = texts()
    rows = [(i, t, "x", 7) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, n_best int").repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in alignment.scored(alignment.align(docs), broadcast_pairs).collect()}
    want = expected(given)
    for i, t in enumerate(given):
        assert out[i] == want[i], repr(t)


def told(own, given):
    """What an aligner says of each text, as plain values."""
    counts, groups, size, pairs, often = own.run(given)
    ends = [0, *size.cumsum().tolist()]
    return [(*c, g, pairs[i:j].tolist(), often[i:j].tolist()) for c, g, i, j in zip(counts.tolist(), groups, ends, ends[1:])]


def fresh():
    return alignment.Aligner(alignment.default_vocabulary(), alignment.default_pieces())


def test_vocabulary_without_certain_cuts_is_encoded_whole():
    own = fresh()
    assert own.cuts
    given = [t or "" for t in texts()]
    with_cuts = told(own, given)
    own = fresh()
    own.cuts = False
    assert told(own, given) == with_cuts
    # windows are known by their ids, here as there
    assert len(own.windows) > 10


def test_memory_is_bounded_and_keeps_what_comes_back(monkeypatch):
    given = [["one two three four five six seven one one"], ["eight nine ten eleven one"], ["one two\n three ▁"], [""], ["one two one"]]
    want = [told(fresh(), g) for g in given]
    monkeypatch.setattr(alignment, "MEMORY_CHUNKS", 4)
    own = fresh()
    for _ in range(3):
        assert [told(own, g) for g in given] == want
    assert "one" in own.chunks and len(own.chunks) < 12


def test_null_id_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    out = alignment.scored(alignment.align(docs)).collect()
    assert sorted((str(r.doc_id), r.n_links, r.count_sum) for r in out) == [("1", 2, 6), ("1", 2, 6), ("2", 0, 0), ("None", 2, 6)]
    assert alignment.scored(alignment.align(docs.where("false"))).collect() == []


def test_long_text_without_spaces_takes_linear_time():
    import time

    own = fresh()
    start = time.time()
    n = told(own, ["x7" * 200_000])
    assert n[0][0] and time.time() - start < 60
