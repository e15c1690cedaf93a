import itertools

import numpy as np
import public_tokenizers
from siftwork.llm import language

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    model = language.Model(["^a", "a", "ab", "b", "^ab", "c", "^"], ["x", "y"])
    rng = np.random.default_rng(1)
    model.p[model.ends] = rng.random((len(model.ends), 2)) / 5

    def p(piece, lang):
        return model.p[model.node(piece), lang]

    for word in ("ab", "abab", "cab", "aab", "abc", "zab", "a"):
        marked = "^" + word
        for lang in (0, 1):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
                parts, last = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        parts.append(marked[last:i])
                        last = i
                parts.append(marked[last:])
                total += np.prod([p(x, lang) for x in parts])
            assert np.isclose(np.exp(model.score([word])[0, lang]), total), word


def test_long_words_are_summed_whole():
    """Words far beyond the range of a double, against whole-number sums by exact fractions."""
    from fractions import Fraction

    model = language.Model(["^a", "a", "ab", "b", "^ab", "ba", "^"], ["x"])
    model.p[model.ends] = np.random.default_rng(2).random((len(model.ends), 1)) / 1000
    word = "ab" * 200 + "c" + "ba" * 150
    marked = "^" + word
    ways = [Fraction(1)] + [Fraction(0)] * len(marked)
    for i in range(len(marked)):
        for k in range(1, 4):
            if i + k <= len(marked):
                ways[i + k] += ways[i] * Fraction(float(model.p[model.node(marked[i : i + k]), 0])) if model.node(marked[i : i + k]) else 0
    exponent = 12_000
    value = ways[-1] * (1 << exponent)
    digits = int(value).bit_length()
    want = (digits - exponent) * np.log(2) + np.log(float(Fraction(int(value), 1 << digits)))
    assert want < -1000 and np.isclose(model.score([word])[0, 0], want)
    used = model.expect([word], np.array([3.0]), 0)
    pieces = {model.node(p): len(p) for p in ("^a", "a", "ab", "b", "^ab", "ba", "^", "c")}
    assert np.isclose(sum(used[node] * size for node, size in pieces.items()), 3 * len(marked))


def test_expectation_maximisation_raises_likelihood():
    model = language.Model(language.vocabulary(VOCAB), ["en"])
    counts = {"the": 50, "then": 10, "other": 8, "rather": 5}
    words = list(counts)
    before = model.score(words)[:, 0] @ np.array(list(counts.values()))
    model.fit({"en": counts})
    assert model.score(words)[:, 0] @ np.array(list(counts.values())) > before


EN = ["the house stands on the hill and the wind is strong", "they said that this was the best of them all", "when will you come with me to the river"]
DE = ["das haus steht auf dem berg und der wind ist stark", "sie sagten dass dies das beste von allen war", "wann kommst du mit mir an den fluss"]


def test_learn_and_judge(spark, odd, none):
    rows = [(t * 5, lang) for lang, ts in (("en", EN), ("de", DE)) for t in ts] + [("no language", None), (None, "en")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), VOCAB)
    names, scores = language.judge(["this is the other house", "dies ist ein anderes haus", None, "", "123 !!", "  ", "word " * 20000, "日本語"], model)
    assert names[:2] == ["en", "de"] and names[2:6] == [language.UND] * 4 and names[6] == "en" and names[7] in ("de", "en")
    assert scores[2] == 0.0 and all(0 <= s <= 1 for s in scores)
    found = language.identify(odd, model, ("doc_id", "held_out")).collect()
    assert len(found) == odd.count() and found[0].held_out == "clash"
    assert language.identify(none, model).collect() == []
    assert language.judge(["words"], None) == ([language.UND], [0.0])
    assert language.learn(none, VOCAB) is None


def test_held_out_accuracy(spark):
    from siftwork.llm.queries import op8_language_id

    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op8_language_id(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert held and sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)
