import random

import numpy as np
from siftwork.llm import toxicity

WORDS = ["the house is old", "we walk along the river", "they read a good book", "a bird sings in the tree", "the letter came today", "idiot moron stupid"]


def model(spark):
    df = spark.createDataFrame([(w,) for w in WORDS * 40], "text string")
    return toxicity.letter_model(toxicity.triple_counts(df))


def test_triple_counts(spark):
    counts = toxicity.triple_counts(spark.createDataFrame([("Ab é",), (None,), ("b",)], "text string").coalesce(1))
    at = lambda a, b, c: counts[tuple(toxicity.NUMBER.get(x, 0) for x in (a, b, c))]
    assert at(" ", " ", "a") == 1 and at(" ", "a", "b") == 1 and at("a", "b", " ") == 1 and at(" ", " ", "b") == 1 and at(" ", "b", " ") == 1
    probabilities = np.exp(np.array(toxicity.letter_model(counts)))
    assert np.allclose(probabilities.sum(axis=2), 1)


def every_reading(word, model):
    """All readings of a word with their scores, by trying every way through the lattice."""
    found = {}

    def go(k, a, b, score, text):
        if k == len(word):
            end = score + (model[a][b][0] if b else 0.0)
            found[text] = max(found.get(text, -1e9), end)
            return
        c = word[k]
        own = toxicity.NUMBER.get(c)
        letters = [own] if own else [toxicity.NUMBER[r] for r in toxicity.LEET.get(c, "")]
        for r in letters:
            go(k + 1, b, r, score + (0.0 if own or c == toxicity.MASK else toxicity.READ) + model[a][b][r], text + toxicity._LETTERS[r - 1])
        if b in letters:
            go(k + 1, a, b, score + toxicity.REPEAT, text)
        elif not own:
            go(k + 1, a, b, score + (toxicity.UNMASK if c == toxicity.MASK else toxicity.SEPARATE if c in toxicity.SEPARATORS else toxicity.DROP), text)

    go(0, 0, 0, 0.0, "")
    return sorted(found, key=lambda x: -found[x])


def test_best_readings_equal_brute_force(spark):
    m = model(spark)
    for word in ("1d1ot", "m0r0n", "b00k", "l*tter", "ww4lkk", "r1v3r", "s-t.u_p1d", "||", "7h3", "", "é1"):
        want = every_reading(word, m)
        assert toxicity.restorations(word, m)[:3] == want[: min(3, len(toxicity.restorations(word, m)))], word


def test_viterbi_restores(spark):
    m = model(spark)
    assert toxicity.restore("1d1ot", m) == "idiot"
    assert toxicity.restore("m0r0n", m) == "moron"
    assert toxicity.restore("i.d.i.o.t", m) == "idiot"
    assert toxicity.spaced("you s t u p i d one", m)[0] == "stupid"
    assert "idiot" in toxicity.readings("idiooooot", m)
    assert toxicity.readings("plain", m) == ["plain"]


def test_words_that_are_joined_or_long(spark):
    m = model(spark)
    assert "stupid" in toxicity.spaced("you are a s t u p i d one", m)
    assert "idiot" in toxicity.spaced("t h e i d i o t", m) + toxicity.spaced("r e a d a n i d i o t", m)
    assert "idiot" in toxicity.readings("hello,idiot/you", m) and "idiot" in toxicity.readings("river;1d1ot", m)
    assert "idiot" in toxicity.readings("river," * 20 + "1d1ot", m)
    assert toxicity.restore("r.i.v.e." * 40, m) == "rive" * 40
    assert len(toxicity.spaced("t h e " * 40 + "x", m)[0]) > 100
    assert toxicity.features("idiot" * 10)[1:] == ["idio-", "idiot-", "idioti-"]


def test_learns_and_scores(spark, odd, none):
    m = model(spark)
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [rng.choice("abcdefgh") * 3 + str(rng.choice("xyz")) for _ in range(30)]
        if k % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron"])
        rows.append((" ".join(words), int(k % 4 == 0)))
    weights = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), m)
    assert weights["idiot"] > 0.9 and weights["moron"] > 0.9
    texts = spark.createDataFrame([(1, "such an 1D1OT here"), (2, "a fine day"), (3, None), (4, "i d i o t !"), (5, "word " * 30000 + "moron")], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(texts, weights, m).collect()}
    assert [got[k][1] for k in range(1, 6)] == [1, 0, 0, 1, 1]
    assert got[2][0] == got[3][0] == toxicity.BASE or np.isclose(got[2][0], toxicity.BASE)
    assert len(toxicity.score(odd, weights, m, ("doc_id", "held_out")).collect()) == odd.count()
    assert toxicity.score(none, weights, m).collect() == []
    assert toxicity.learn(spark.createDataFrame([], "text string, toxic int"), m) == {}


def test_sample_joins_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.sample(docs, labels).collect()] == [("a", 1)]


def test_held_out_precision_and_recall(spark):
    from siftwork.llm.queries import op5_toxicity

    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in op5_toxicity(spark, at).collect() if r.held_out and r.doc_id in labels]
    right = sum(a == b == 1 for a, b in rows)
    assert right >= 0.9 * sum(a for a, _ in rows) and right >= 0.95 * sum(b for _, b in rows)


def test_disguised_words_are_restored(spark):
    """Of learned words disguised in each manner, nine in ten are found again, and far fewer without restoring."""
    from siftwork.llm import queries

    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", queries.held_out(5, 0).alias("held_out"))
    m = toxicity.letter_model(toxicity.triple_counts(docs))
    weights = toxicity.learn(toxicity.sample(docs.where("NOT held_out"), spark.read.parquet(f"{at}/labels.parquet")), m)
    words = sorted(w for w in weights if w.isalpha() and w.isascii() and len(w) >= 5)
    assert len(words) >= 10
    rng = random.Random(12)
    leet = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7", "l": "1", "g": "9", "b": "8"}

    def swap(w):
        at = [k for k, c in enumerate(w) if c in leet]
        for k in rng.sample(at, min(2, len(at))):
            w = w[:k] + leet[w[k]] + w[k + 1 :]
        return w

    def star(w):
        at = [k for k, c in enumerate(w) if c in "aeiou" and k]
        k = rng.choice(at) if at else 1
        return w[:k] + "*" + w[k + 1 :]

    def double(w):
        k = rng.randrange(len(w))
        return w[: k + 1] + w[k] + w[k + 1 :]

    manners = {"leet": swap, "star": star, "double": double, "spaces": " ".join, "points": ".".join, "leet and double": lambda w: double(swap(w)), "stretched": lambda w: w[:2] + w[2] * 4 + w[3:]}
    for name, disguise in manners.items():
        tries = [(w, disguise(w)) for w in words for _ in range(5)]
        read = lambda x: {f for w in toxicity.readings(x, m) + toxicity.spaced(x, m) for f in toxicity.features(w)}
        hits = sum(w in read(x) for w, x in tries)
        assert hits >= 0.9 * len(tries), (name, hits, len(tries))
