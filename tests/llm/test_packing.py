import random
import zlib

import numpy as np
import public_tokenizers
from siftwork.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    texts = ["don't  it's\tI'LL <|endoftext|> x", "a\x1cb c　d é É ÉÉ.. ,. .", "µm ªº ß ẞ İ ſ straße...", "12.5, 3., x!. y*, z", " \x85 \xa0x\n\n", "", "   ", "Ω Σας ΣΑΣ.", ".,a", "q_. r", "end."]
    texts += ["".join(rng.choices("abÉé'.s, \n\t1$-_!", k=60)) for _ in range(2000)]
    encoder = packing.Encoder(PATH)
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(text)[:-1], text


def test_encoder_stays_small(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "MOST", 400)
    monkeypatch.setattr(packing.Encoder, "MOST_IDS", 2000, raising=False)
    encoder = packing.Encoder(PATH)
    rng = random.Random(9)
    for k in range(60):  # among them chunks of many ids each
        long = "".join(rng.choices("abcdefgh", k=3000))
        texts = [" ".join(["the", "same", "words", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))]), long, f"{k} {k}"]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == ids_of(text)[:-1], text
        assert len(encoder.keys) <= 400 + 70 and len(encoder.keys) == len(encoder.at) == len(encoder.n)
        assert encoder.arena.nbytes <= 4 * (2000 + 4000) * 5 // 4 + 4 * (1 << 16)
        assert encoder.used <= 2000 + 4000
    # What is met again stays, with its ids.
    encoder._cut_down()
    assert 0 < len(encoder.keys) < 10 and (np.diff(encoder.keys.astype(object)) > 0).all()
    used = encoder.used
    assert encoder.encode(["the same words"])[0].tolist() == ids_of("the same words")[:-1] and encoder.used == used


def check(rows, texts, capacity):
    """Pieces in order, exact ids, gapless sequences of at most the capacity."""
    want = sorted((d, k, k * capacity, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for d, t in texts for ids in [ids_of(t)] for k, p in enumerate([ids[i : i + capacity] for i in range(0, len(ids), capacity)]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((-1 if w[0] is None else w[0], *w[1:]) for w in [(x if x[0] != -1 else (-1, *x[1:])) for x in want])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packs_every_row(spark, odd):
    rows = packing.best_fit_packing(odd, PATH, 64).collect()
    texts = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    n = check(rows, texts, 64)
    total = sum(len(ids_of(t)) for _, t in texts)
    assert n <= -(-total // 64) + 1


def test_empty(spark, none):
    assert packing.best_fit_packing(none, PATH).collect() == []


def test_many_rows_of_one_document_share_buckets(spark):
    docs = spark.createDataFrame([(7, "same words")] * 3000, "doc_id long, text string")
    found = packing.pack(packing._common.stash(packing.pieces(docs, PATH, 64)), 64, bucket=500).collect()
    assert check(found, [(7, "same words")] * 3000, 64) <= -(-3000 * len(ids_of("same words")) // 64) + 6


def test_evolution_beats_or_equals_best_fit():
    rng = random.Random(5)
    for seed in range(5):
        size = [rng.randint(300, 1300) for _ in range(400)]
        plain = packing.best_fit([], list(range(len(size))), size, 2048)
        best = packing.evolve(size, 2048, seed, [packing.evolve(size, 2048, i) for i in (1, 2)])
        assert sorted(i for b in best for i in b) == list(range(len(size)))
        assert max(sum(size[i] for i in b) for b in best) <= 2048
        assert len(best) <= len(plain)


def test_crossover_keeps_items():
    rng = random.Random(1)
    size = [rng.randint(1, 900) for _ in range(200)]
    a, b = (packing.first_individual(size, 1000, random.Random(k), False) for k in (1, 2))
    child = packing.cross(a, b, size, 1000, rng)
    assert sorted(i for x in child for i in x) == list(range(200))
    assert all(sum(size[i] for i in x) <= 1000 for x in child)


def test_no_island_searches_what_best_fit_has_solved(monkeypatch):
    rng = np.random.default_rng(5)
    size = [int(x) for x in rng.integers(1, 400, 3000)]
    plain = packing.first_individual(size, 2048, random.Random(0), True)
    assert len(plain) == -(-sum(size) // 2048)
    blurred = []
    own = packing.first_individual
    monkeypatch.setattr(packing, "first_individual", lambda size, capacity, rng, exact: (exact or blurred.append(1), own(size, capacity, rng, exact))[1])
    best = packing.evolve(size, 2048, 1, exact=False)
    assert len(best) == len(plain) and sorted(i for b in best for i in b) == list(range(len(size)))
    assert not blurred
