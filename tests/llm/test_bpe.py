import codecs
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from siftwork.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["a", "b", "the", " ", "  ", "\n", "é", "日", "語", "😀", "1", "!", "'s", "\t", "\x85", " ", "​", "₝", "꭭", "Straße"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat(encoder, text):
    return [i for block in encoder.blocks(text) for i in block]


def test_equals_the_library(ranks, library):
    encoder, rng = bpe.Encoder(ranks, PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice([*BITS, chr(rng.randrange(0xD000))]) for _ in range(rng.randint(0, 50)))
        assert flat(encoder, text) == library.encode_ordinary(text), text
    long = "a" * 100_000 + " word" * 70_000 + "é" * 500 + " " * 3000 + "\n"
    assert flat(encoder, long) == library.encode_ordinary(long)


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    encoder = bpe.Encoder(ranks, PATTERN)
    encoder.machine.most_moves = 20
    text = "Some wörds, and more of them; some words again: unbelievably 12345 longwindedness."
    assert flat(encoder, text * 3) == library.encode_ordinary(text * 3)


def test_merges_of_an_unruly_vocabulary():
    """Random merges, tokens that merging doesn't give among them: a piece that is a token is that token."""
    rng = random.Random(4)
    for _ in range(60):
        ranks = {bytes([k]): k for k in range(256)}
        known = [b"a", b"b", b"c"]
        while len(ranks) < 280:
            token = rng.choice(known) + rng.choice(known)
            if token not in ranks:
                known.append(token)
                ranks[token] = len(ranks)
        names = list(range(len(ranks)))
        rng.shuffle(names)
        shuffled = {t: names[r] for t, r in ranks.items()}
        for r in (ranks, shuffled):
            own, theirs = bpe.Transducer(r), tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=r, special_tokens={})
            for _ in range(40):
                piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
                assert own.encode(piece.encode()) == theirs.encode_ordinary(piece), (piece, r)


def test_streaming_decode(ranks):
    decoder, rng = bpe.Decoder(ranks), random.Random(2)
    for _ in range(1500):
        ids = [rng.randrange(50256) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randint(0, 20))]
        cut = sorted(rng.randint(0, len(ids)) for _ in range(3))
        parts = [ids[: cut[0]], ids[cut[0] : cut[1]], ids[cut[1] : cut[2]], ids[cut[2] :]]
        got = "".join(map(decoder.feed, parts)) + decoder.finish()
        assert got == codecs.decode(b"".join(decoder.tokens[i] for i in ids), "utf-8", "replace")
    text = "ein 😀 日本語 text"
    ids = [k for byte in text.encode() for k in [ranks[bytes([byte])]]]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_rows(spark, odd, none, library):
    rows = bpe.round_trip(odd, PATH, PATTERN).collect()
    assert len(rows) == odd.count()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert bpe.round_trip(none, PATH, PATTERN).collect() == []


def test_query_on_the_table(spark, library):
    from siftwork.llm import queries

    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for r in queries.op11_byte_bpe(spark, at).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
