"""Toxicity by noisy-channel deobfuscation and a lexicon learned from labels.

Words that look disguised (leetspeak, letters set apart, repeated letters) are restored first: each character opens a
few readings (itself, letters it stands for, nothing if it repeats or separates, a word's end if it separates), each with
the channel's cost, and a Viterbi search over that lattice finds the likeliest readings under an interpolated
letter-triple model counted over every document. The `BEST` likeliest are kept, as a vowel or a doubled letter may go
either way. Plain and restored words, also with doubled letters collapsed, and their
beginnings are then looked up among features whose labels in the training sample are nearly all toxic; a score joins the
probabilities of a text's words as independent causes.

Labels come from a bounded sample (`TRAIN` labelled rows in expectation, by a hash), in which near copies (equal least
word-triple hash) count once. Every word of every text is scored, and the letter model covers all texts.

Defined results: null and empty texts, and texts without a feature, score `BASE`; without labels all texts do; of
several labels for a doc_id the largest counts; null labels and ids are not learned from; repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common
from .neardup import shingle_sets

TRAIN = 10_000
#: A feature needs this share of the toxic sample, and no fewer documents than FEWEST.
SUPPORT, FEWEST = 0.008, 5
PRECISION = 0.9
MOST_FEATURES = 20_000
BASE = 0.03
PREFIXES = (4, 5, 6)
LONGEST = 32
#: Distinct chunks that a task remembers before it starts anew.
REMEMBERED = 200_000

#: Letters that other characters stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou",
}
SEPARATORS = " .-_*'~,:;/\\"
#: Costs, as logarithms: a reading by LEET, a dropped repetition, a dropped separator, any other dropped character. What is
#: dropped costs about as much as a letter under the model, so that neither short nor long readings are favoured.
READ, REPEAT, SEPARATE, DROP = -1.0, -3.5, -0.3, -7.0
#: What hides a letter rather than stands for one: its readings cost nothing, dropping it this much.
MASK, UNMASK = "*", -2.0
#: Readings that are kept, and pairs of last letters that the search goes on from.
BEST, BEAM = 8, 32
#: Weight of the shorter context in the letter model, in letters seen.
BACK_OFF = 5.0

TRIM = ".,;:!?\"'()[]{}<>*_-«»“”‘’…#%&=/\\"
DISGUISED = re.compile(r"[^\W\d_].*[\d@$!|+(<€£¡#*_.\-].*[^\W\d_]|(.)\1\1|[\d@$!|+(<€£¡#].*[^\W\d_]{2}|[^\W\d_]{2}.*[\d@$!|+(<€£¡#]")
#: Punctuation that may join words.
JOINTS = re.compile(r"[.,;:?\"'()\[\]{}=&%~/\\…–—_-]+")
SPACED = re.compile(r"(?<![^\s])[^\s][ .\-_*](?:[^\s][ .\-_*])+[^\s](?![^\s.,;:!?])")
_CLASS = np.zeros(0x180, dtype=np.int64)
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
for _i, _c in enumerate(_LETTERS):
    _CLASS[ord(_c)] = _i + 1
SIZE = len(_LETTERS) + 1
NUMBER = {c: k + 1 for k, c in enumerate(_LETTERS)}
SEPARATED = set(SEPARATORS)
DOUBLE = re.compile(r"([^\W\d_])\1+")


def triple_counts(docs: DataFrame) -> np.ndarray:
    """Letter triples over all texts (0: a word's edge, and all before it), [first, second, third]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in _common.slices(batches, "text"):
            text = "\n".join(["", "", *[t for t in batch.column("text").to_pylist() if t], ""]).lower()
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            c = _CLASS[np.where(code < len(_CLASS), code, 0)]
            if len(c) > 2:
                first = np.where(c[1:-1] == 0, 0, c[:-2])
                total += np.bincount((first * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["triple", "n"])

    out = np.zeros(SIZE**3)
    for r in docs.select("text").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        out[r["triple"]] = r["n"]  # at most SIZE**3 rows
    return out.reshape(SIZE, SIZE, SIZE)


def letter_model(counts: np.ndarray) -> list[list[list[float]]]:
    """Logarithmic probabilities of a letter after two others, by their numbers (0: a word's edge); shorter contexts mixed in."""
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + BACK_OFF * one) / (two.sum(axis=1, keepdims=True) + BACK_OFF)
    three = (counts + BACK_OFF * two) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    return np.log(three).tolist()


def restorations(word: str, model: list[list[list[float]]], edges: bool = False) -> list[str]:
    """The likeliest readings of `word` (lower case), best first; with `edges`, separators may also be a space between words."""
    # A state is the last two letters, with its best hypotheses. What was read so far is a chain of (before, letter), so
    # long runs cost no more for a character than short ones.
    states: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
    for c in word:
        following: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
        own = NUMBER.get(c)
        letters = [own] if own else [NUMBER[r] for r in LEET.get(c, "")]
        read = 0.0 if own or c == MASK else READ
        drop = None if own else UNMASK if c == MASK else SEPARATE if c in SEPARATORS else DROP
        for (a, b), found in states.items():
            after = model[a][b]
            for r in letters:
                following.setdefault((b, r), []).extend([(s + read + after[r], (chain, r)) for s, chain in found])
            stay = REPEAT if b in letters else drop
            if stay is not None:
                following.setdefault((a, b), []).extend([(s + stay, chain) for s, chain in found])
            if edges and b and c in SEPARATORS:
                following.setdefault((0, 0), []).extend([(s + SEPARATE + after[0], (chain, 0)) for s, chain in found])
        for key, found in following.items():
            if len(found) > 1:
                following[key] = sorted(found, key=lambda x: -x[0])[:BEST]
        if len(following) > BEAM:
            following = dict(sorted(following.items(), key=lambda x: -x[1][0][0])[:BEAM])
        states = following
    ends = sorted(((s + (model[a][b][0] if b else 0.0), chain) for (a, b), found in states.items() for s, chain in found), key=lambda x: -x[0])
    out: dict[str, None] = {}
    for _, chain in ends:
        text = []
        while chain:
            chain, r = chain
            text.append(_LETTERS[r - 1] if r else " ")
        out["".join(reversed(text))] = None
        if len(out) == BEST:
            break
    return list(out)


def restore(word: str, model: list[list[list[float]]], edges: bool = False) -> str:
    """The likeliest reading of `word`."""
    return restorations(word, model, edges)[0]


def features(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in a hyphen."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]] if len(word) >= 3 else []


def collapsed(words: list[str]) -> list[str]:
    """The words, and those with doubled letters once more with each run as one letter."""
    return [*words, *[DOUBLE.sub(r"\1", w) for w in words if DOUBLE.search(w)]]


def readings(chunk: str, model: list) -> list[str]:
    """The words a chunk of lower-case text may be: one, or several that punctuation joins."""
    plain = chunk.strip(TRIM)
    out = collapsed([plain])
    # A mask at one end hides a letter; at both it stands for quotes.
    masked = MASK in chunk and len(plain) > 1 and not (chunk[0] == MASK and chunk[-1] == MASK)
    if masked or not plain.isalpha() or DISGUISED.search(plain):
        # The pattern looks back and forth, so long chunks are read without it.
        if masked or len(chunk) > 2 * LONGEST or DISGUISED.search(chunk):
            own = chunk.strip('.,;:?"')
            out += collapsed(restorations(own, model))
            if not SEPARATED.isdisjoint(own):
                for text in restorations(own, model, True):
                    if " " in text:
                        out += collapsed(text.split())
        parts = [x for x in JOINTS.split(plain) if x]
        if len(parts) > 1:
            out += [w for x in parts for w in readings(x, model)]
    return out


def spaced(text: str, model: list) -> list[str]:
    """Words whose letters are set apart: each run as one word, and as several where it reads so."""
    out = []
    for m in SPACED.finditer(text):
        out += collapsed(restorations(m.group(), model))
        for x in restorations(m.group(), model, True):
            if " " in x:
                out += collapsed(x.split())
    return out


def learn(rows: DataFrame, model: list) -> dict[str, float]:
    """Features and their probabilities from `rows` (text, toxic), a bounded sample that is written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            out = []
            marks = [int(s[0]) if len(s) else 0 for s in shingle_sets(batch.column("text"), 3)]
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                words = {w for c in set(low.split()) for w in readings(c, model)} | set(spaced(low, model))
                out.append(sorted({f for w in words for f in features(w)}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), batch.column("toxic"), pa.array(out, pa.list_(pa.string()))], names=["mark", "toxic", "f"]
            )

    each = rows.mapInArrow(run, "mark long, toxic int, f array<string>").groupBy("mark").agg(F.max_by(F.struct("toxic", "f"), F.size("f")).alias("x")).select("x.toxic", "x.f")
    each = _common.stash(each)
    toxic = each.where("toxic = 1").count()
    counts = each.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    least = max(FEWEST, SUPPORT * toxic)
    good = counts.where((F.col("t") >= least) & (F.col("t") >= PRECISION * F.col("n"))).orderBy(F.desc("t"), "f").limit(MOST_FEATURES)
    return {r["f"]: (r["t"] + 0.5) / (r["n"] + 1.5) for r in good.collect()}


def score(docs: DataFrame, weights: dict[str, float], model: list, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of `docs`, score and predicted of every text. Weights and model, of bounded size, are broadcast."""
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    held = docs.sparkSession.sparkContext.broadcast((weights, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = held.value

        def best(words: list[str]) -> tuple[str, float]:
            return max(((f, weights[f]) for w in words for f in features(w) if f in weights), key=lambda x: x[1], default=("", 0.0))

        seen: set[str] = set()
        hits: dict[str, tuple[str, float]] = {}
        for batch in _common.slices(batches, "text"):
            out = []
            if len(seen) > REMEMBERED:
                seen, hits = set(), {}
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                own = set(low.split())
                new = own - seen
                for c in new:
                    if (found := best(readings(c, model)))[1]:
                        hits[c] = found
                seen |= new
                found = {c: hits[c] for c in own & hits.keys()}
                for w in spaced(low, model):
                    if (x := best([w]))[1]:
                        found[w] = x
                miss = sum(math.log1p(-min(p, 0.98)) for _, p in sorted(found.values()))
                out.append(1.0 - (1.0 - BASE) * math.exp(miss))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=[*keep, "score", "predicted"]
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of about TRAIN labelled rows of `docs`, written out. The labels that are joined are bounded."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < 1_000_003 * min(1.0, TRAIN / max(total, 1)))
    return _common.stash(docs.join(F.broadcast(some), "doc_id").select("text", "toxic"))
