"""Language identification by unigram pieces, summed over all segmentations of each word.

Each language has a probability for every piece of a fixed public vocabulary, whose pieces of letters are lower-cased as
texts are. A forward pass over a word, of any length, adds up the
probabilities of all its segmentations; a text's score is the sum of its words' logarithms. The probabilities come from
expectation-maximisation over word counts of a bounded sample of labelled rows (`TRAIN_PER_LANGUAGE` documents a
language in expectation, chosen by a hash of the row); prediction covers every word of every text.

Pieces that hold a letter which no learned word has keep their share of the probability and are left out of the trie: they
have the same small probability in every language.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing was learned; rows with a
null language are never learned from; repeated rows are judged alike; an empty table gives an empty result; ties go to
the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

TRAIN_PER_LANGUAGE = 600
#: Of one language, distinct words that are learned from, the most frequent first.
TRAIN_WORDS = 40_000
EM_ROUNDS = 3
#: Uses of a piece that are taken as seen beforehand.
BEFOREHAND = 0.02
#: Characters after which a forward or backward pass brings its numbers to scale again.
RESCALE = 16
#: Characters of words of one length that are passed over at once.
AT_ONCE = 100_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Words' worth of evidence that the reported score is tempered to.
EVIDENCE = 8.0
UND = "und"


def vocabulary(path: str) -> list[str]:
    """Pieces of letters of the public sentencepiece model at `path`, lower-cased; `^` marks a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        low, start = p.lstrip("▁").lower(), p.startswith("▁")
        if low.isalpha():
            found.add("^" * start + low)
    return sorted(found)


class Model:
    """A trie over pieces, and each language's logarithmic scores of words through it."""

    def __init__(self, pieces: list[str], langs: list[str], left_out: int = 0):
        self.langs, self.left_out = langs, left_out
        self.longest = max(map(len, pieces), default=1)
        # Letters of longer pieces come first: only they have columns beyond the root's.
        inner = {c for p in pieces if len(p) > 1 for c in p} | {"^"}
        self.chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p} | {"^"}, key=lambda c: (c not in inner, c)))}
        nodes: list[dict[int, int]] = [{}, {}]  # 0: nothing leads on from here; 1: the root
        ends = {}
        for p in pieces:
            at = 1
            for c in p:
                k = self.chars[c]
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                at = nodes[at][k]
            ends[at] = p
        # Any letter alone is a piece, known or not: those without one of their own share node `other`.
        self.other = len(nodes)
        self.first = np.full(len(self.chars) + 1, self.other, dtype=np.int32)
        self.next = np.zeros((len(nodes) + 1, len(inner) + 1), dtype=np.int32)
        for a, b in enumerate(nodes):
            for k, to in b.items():
                if a == 1:
                    self.first[k] = to
                else:
                    self.next[a, k] = to
        self.ends = np.array(sorted({*ends, self.other, *self.first.tolist()}), dtype=np.int64)
        self.p = np.zeros((len(nodes) + 1, len(langs)))
        self.p[self.ends] = 1.0 / len(self.ends)

    def onward(self, m: np.ndarray) -> np.ndarray:
        """Columns of `next` for character codes."""
        return np.where(m < self.next.shape[1], m, 0)

    def node(self, piece: str) -> int:
        """The node of a piece; 0 if nothing leads there."""
        code = [self.chars.get(c, 0) for c in piece]
        at = self.first[code[0]]
        for k in code[1:]:
            at = self.next[at, k if k < self.next.shape[1] else 0]
        return int(at)

    def codes(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words by length: (their numbers, a matrix of character codes that starts with the word-start mark)."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        table = np.zeros(0x250, dtype=np.int64)
        far = {}
        for c, k in self.chars.items():
            if ord(c) < 0x250:
                table[ord(c)] = k
            else:
                far[ord(c)] = k
        out = []
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            raw = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le"), dtype="<u4")
            code = table[np.minimum(raw, 0x24F)] * (raw < 0x250)
            for c in np.unique(raw[raw >= 0x250]):
                code[raw == c] = far.get(int(c), 0)
            m = code.reshape(len(own), n)
            out.append((own, np.concatenate([np.full((len(own), 1), self.chars["^"]), m], axis=1)))
        return out

    def forward(self, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | float]]:
        """Probability of every prefix of the words of `m` under each language, [length + 1, word, language], and the
        logarithm of each length's scale."""
        rows, n = m.shape
        on = self.onward(m)
        alpha, scale = np.zeros((n + 1, rows, self.p.shape[1])), 0.0
        alpha[0] = 1.0
        scales: list[np.ndarray | float] = []
        for i in range(n + 1):
            if i and i % RESCALE == 0:
                most = alpha[i : i + self.longest].max(axis=0)
                alpha[i : i + self.longest] /= most
                scale = scale + np.log(most)
            scales.append(scale)
            for k in range(min(self.longest, n - i)):
                at = self.next[at, on[:, i + k]] if k else self.first[m[:, i]]
                if k and not at.any():
                    break
                alpha[i + k + 1] += alpha[i] * self.p[at]
        return alpha, scales

    def score(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's probability: [word, language]."""
        out = np.zeros((len(words), self.p.shape[1]))
        for own, m in self.codes(words):
            step = max(1, AT_ONCE // m.shape[1])
            for a in range(0, len(own), step):
                alpha, scales = self.forward(m[a : a + step])
                out[own[a : a + step]] = np.log(alpha[-1]) + scales[-1]
        return out

    def expect(self, words: list[str], count: np.ndarray, lang: int) -> np.ndarray:
        """Expected number of uses of each node's piece, over `words` in language `lang`."""
        used = np.zeros(len(self.p))
        p = self.p[:, lang]
        own_p, self.p = self.p, self.p[:, lang : lang + 1]
        try:
            for every, whole in self.codes(words):
                step = max(1, AT_ONCE // whole.shape[1])
                for a in range(0, len(every), step):
                    own, m = every[a : a + step], whole[a : a + step]
                    rows, n = m.shape
                    on = self.onward(m)
                    alpha, before = self.forward(m)
                    alpha = alpha[:, :, 0]
                    before = [x[:, 0] if isinstance(x, np.ndarray) else x for x in before]
                    beta, scale = np.zeros((n + 1, rows)), 0.0
                    beta[n] = 1.0
                    total = np.log(alpha[n]) + before[n]
                    for i in range(n - 1, -1, -1):
                        uses = []
                        for k in range(min(self.longest, n - i)):
                            at = self.next[at, on[:, i + k]] if k else self.first[m[:, i]]
                            if k and not at.any():
                                break
                            through = p[at] * beta[i + k + 1]
                            beta[i] += through
                            uses.append((at, through))
                        weight = alpha[i] * count[own] * np.exp(before[i] + scale - total)
                        for at, through in uses:
                            used += np.bincount(at, through * weight, minlength=len(used))
                        if (n - i) % RESCALE == 0:
                            most = beta[i : i + self.longest].max(axis=0)
                            beta[i : i + self.longest] /= most
                            scale = scale + np.log(most)
        finally:
            self.p = own_p
        return used

    def fit(self, counts: dict[str, dict[str, int]]) -> None:
        for lang, own in counts.items():
            k, words = self.langs.index(lang), sorted(own)
            count = np.array([own[w] for w in words], dtype=float)
            for _ in range(EM_ROUNDS):
                used = self.expect(words, count, k)[self.ends] + BEFOREHAND
                self.p[self.ends, k] = used / (used.sum() + BEFOREHAND * self.left_out)


def learn(rows: DataFrame, vocab: str) -> Model | None:
    """Fit on `rows` (text, lang). Two scans: languages and their sizes, then word counts of the sample."""
    row = F.xxhash64(*[c for c in ("doc_id", "text") if c in rows.columns])
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", row.alias("row"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # Every language has its own share of the hash range, so that the sample is bounded for each.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, TRAIN_PER_LANGUAGE / n))])
    sample = rows.where(F.pmod(F.col("row"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen.update((lang, w) for w in LETTERS.findall(text.lower()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())],
            names=["lang", "word", "n"],
        )

    words = _common.stash(sample.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang in sorted(sizes):  # at most TRAIN_WORDS rows each
        for r in words.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(TRAIN_WORDS).collect():
            counts[lang][r["word"]] = r["n"]
    seen = {c for own in counts.values() for w in own for c in w} | {"^"}
    every = vocabulary(vocab)
    pieces = [p for p in every if seen.issuperset(p)]
    model = Model(pieces, sorted(sizes), len(every) - len(pieces))
    model.fit(counts)
    return model


def judge(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text. Distinct chunks of the batch are scored once."""
    known: dict[str, int] = {}
    each = []
    for t in texts:
        count = Counter(t.lower().split()) if t else {}
        each.append((np.fromiter((known.setdefault(c, len(known)) for c in count), np.int64, len(count)), np.fromiter(count.values(), np.int64, len(count))))
    found = [LETTERS.findall(c) for c in known]
    distinct: dict[str, int] = {}
    flat = [distinct.setdefault(w, len(distinct)) for ws in found for w in ws]
    owner = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
    langs = model.langs if model else []
    of_chunk = np.zeros((len(known), len(langs) + 1))
    if model and distinct:
        values = np.concatenate([model.score(list(distinct)), np.ones((len(distinct), 1))], axis=1)[flat]
        for k in range(values.shape[1]):
            of_chunk[:, k] = np.bincount(owner, values[:, k], minlength=len(known))
    names, scores = [], []
    for at, n in each:
        total = n @ of_chunk[at] if len(at) else np.zeros(len(langs) + 1)
        if not langs or not total[-1]:
            names.append(UND)
            scores.append(0.0)
            continue
        own = total[:-1] * min(1.0, EVIDENCE / total[-1])
        best = int(np.argmax(own))
        names.append(langs[best])
        scores.append(float(1.0 / np.exp(own - own[best]).sum()))
    return names, scores


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of `docs`, language and score of each text under the names `named`. The model, of fixed size, is broadcast."""
    docs = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = docs.select(*keep).schema.add(named[0], "string").add(named[1], "double")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text", 2 << 20):
            names, scores = judge(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, *named],
            )

    return docs.mapInArrow(run, schema)
