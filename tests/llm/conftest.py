import pytest

#: Every column null, empty, blank, repeated, long; `clash` columns carry names that operators use inside.
LONG = "The " + "long line of words and more words " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, "one two three four five six seven eight\nnine ten", "en", "a", 39),
        (1, "one two three four five six seven eight\nnine ten", "en", "a", 39),
        (2, "one two three four five six seven eight\nnine ten", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "en", None, 0),
        (None, "the row without an id has words of its own", "en", "b", 41),
        (None, None, None, None, None),
        (5, "   \n\t\n", "xx", "b", 6),
        (6, LONG, "en", "c", len(LONG)),
        (7, "été ça naïve 😀😀 ß", "fr", "é", 18),
        (8, "12345 !!! ###", "en", "b", 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "lang_pred", "kept", "h", "nr", "line", "drops", "k", "n", "sketch", "tie", "size", "shard", "taken", "nth", "held_out", "piece", "b"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
