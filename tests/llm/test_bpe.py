"""Chunk-wise BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kerbside.llm import bpe
from kerbside.llm.secrets import default_vocabulary


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(5)
    atoms = ["the ", "and", "n't", "'re", "'", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "ß ", "日本語", "🙂", "123", " 45", "!!", " ,", "'s ",
             "<|endoftext|>", "<|endof", "x", "\x1c", "\r\n", "ation", " word"]
    out = ["", " ", "a", "<|endoftext|>", "a" * 9000, "é" * 5000, " " * 9000, "日本" * 4000, "ab " * 5000, "x'" * 4000]
    out += ["".join(rng.choice(atoms) for _ in range(rng.choice([5, 300, 4000]))) for _ in range(60)]
    return out + [("same passage that many share, word for word. " * 30) + str(i) for i in range(5)]


def test_codec_equals_library(plain):
    own = bpe.Codec(default_vocabulary())
    for t in texts():
        want = plain.encode(t, add_special_tokens=False).ids
        got = own.encode(t).tolist()
        assert got == want
        assert own.decode(got) == plain.decode(want, skip_special_tokens=False) == t
    assert own.reused


def test_cuts_follow_the_content():
    body = "".join(random.Random(1).choice("abcdefgh ,.é") for _ in range(20000)).encode()
    one, two = bpe.cuts(body), bpe.cuts(b"a prefix of some other length " + body)
    pieces = lambda d, e: {d[a:b] for a, b in zip([0, *e], e)}
    assert len(pieces(body, one) & pieces(b"a prefix of some other length " + body, two)) >= len(one) - 4
    assert all(body[e] & 0xC0 != 0x80 for e in one[:-1]) and one[-1] == len(body)


def test_operator(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, None, None), (None, "null id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").drop("ids").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()))
    want = []
    for d, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((d is None, d or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {(r.doc_id, r.decoded) for r in bpe.decode(bpe.encode(docs, most=3)).collect()}
    assert back == {(d, t or "") for d, t, _ in rows}


def test_dictionary_holds_shared_chunks_once(spark):
    docs = spark.createDataFrame([(i, "a passage that all the documents share; " * 60) for i in range(8)], "doc_id long, text string").repartition(4)
    shared = bpe.shared_chunks(docs, most=5)
    assert 1 <= len(shared) <= 5


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
