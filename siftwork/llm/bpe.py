"""Byte-level BPE: merges compiled into a lazily determinised finite-state transducer, and a streaming decoder.

The nondeterministic machine reads a piece's bytes along a trie of the tokens and may, where it stands at a token, end
it, if that token can follow the one before: merging the bytes of both in rank order leaves exactly these two. A
sequence whose neighbours all can follow each other is the encoding of its bytes, and no other sequence is, so that of
the readings that end at a place one survives. `Transducer` determinises this machine as texts are read: a state is the
set of readings that are still alive, each with the tokens that it has and others don't. What all of them share is
emitted at once. A reading that is alive began within the longest token, so the lookahead is bounded. States and moves
are kept up to a number and then built anew, which changes no result.

Decoding runs an automaton of well-formed UTF-8 over tokens: its move over a whole token, from each of its states, is a
table; characters that a token leaves open wait for the next one. Malformed bytes become U+FFFD, one for each maximal
part of a character.

Defined results: a null text is empty, and an empty text has no tokens (digests of nothing); repeated rows are encoded
each; null ids stay null; texts of any length are read piece by piece; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import _common

#: Moves of a transducer that are kept, encodings of pieces that are kept, and the longest of these pieces in characters.
MOST_MOVES, MOST_PIECES, SHORT = 1 << 20, 1 << 18, 32
#: Pieces, and tokens, of a text that are worked on at a time.
BLOCK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _read_otherwise(name: str) -> tuple[str, str]:
    """Code points that only this module's pattern engine counts to a class, and those that only the library's does: their
    versions of Unicode differ."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bare = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    theirs = set(bytes(bare.encode_ordinary(every)).decode())
    ours = set(regex.findall(name, every))
    return "".join(sorted(ours - theirs)), "".join(sorted(theirs - ours))


def as_library(pattern: str) -> tuple[str, str]:
    """`pattern` with its classes as the library's engine has them, in this module's engine's set operations, which are slow;
    and the code points that make a difference: texts without any are read by `pattern` as it stands."""
    odd = ""
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        less, more = _read_otherwise(name)
        if name in pattern and (less or more):
            more_, less_ = regex.escape(more), regex.escape(less)
            pattern = pattern.replace(name, f"[[{name}{more_}]--[{less_}]]" if less else f"[{name}{more_}]")
            odd += less + more
    return pattern, odd


class Transducer:
    """Encodes a piece of text, reading a byte at a time. `ranks` holds a token for each byte, at least."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int = MOST_MOVES):
        self.ranks, self.most_moves = ranks, most_moves
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: node << 8 | byte -> node, and the token that ends at a node. Node 0 is its root.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
            self.token_at[node] = rank
        self.inner = {key >> 8 for key in self.child}
        self._follows: dict[tuple[int | None, int], bool] = {}
        self._edges_of: dict[int, tuple[list, list, bool] | None] = {}
        self.never = max(ranks.values()) + 1
        self._begin()

    def _begin(self) -> None:
        # A reading is (its last token, its tokens that are not emitted, its node); the first state has an empty one.
        first = ((None, (), 0),)
        self.states, self.state_of = [first], {first: 0}
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def follows(self, last: int | None, token: int) -> bool:
        """Whether merging the bytes of both leaves these two (or the token alone, if there is none before it).

        Each merges as it would alone until a part at the end of the first and one at the beginning of the second, both
        there at a time, make a token of lower rank than what either goes into next. Of equal ranks the left one is first.
        """
        found = self._follows.get((last, token))
        if found is None:
            if len(self._follows) > self.most_moves:
                self._follows.clear()
            found = self._follows[last, token] = self._stays(last, token)
        return found

    def _stays(self, last: int | None, token: int) -> bool:
        after = self._edges(token)
        if last is None or after is None:
            return after is not None
        before = self._edges(last)
        if not (before[2] and after[2]):
            return self._merged(self.bytes_of[last] + self.bytes_of[token])[0] == [self.bytes_of[last], self.bytes_of[token]]
        for x, x_made, x_gone in before[1]:
            for y, y_made, y_gone in after[0]:
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_gone and rank <= y_gone and x_made <= y_gone and y_made < x_gone:
                    return False
        return True

    def _merged(self, text: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """What merging by lowest ranks leaves, and the steps: rank, first and last part after it."""
        parts, steps = [text[k : k + 1] for k in range(len(text))], []
        rank = [self.ranks.get(text[k : k + 2]) for k in range(len(text) - 1)]
        while (best := min((r for r in rank if r is not None), default=None)) is not None:
            k = rank.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del rank[k]
            for at in (k - 1, k):
                if 0 <= at < len(rank):
                    rank[at] = self.ranks.get(parts[at] + parts[at + 1])
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _edges(self, token: int) -> tuple[list, list, bool] | None:
        """Of a token as it is merged: its first parts and its last parts, each with the ranks at which it is made and goes
        into another, and whether ranks only rise. None if merging its bytes doesn't give it."""
        if token not in self._edges_of:
            text = self.bytes_of[token]
            parts, steps = self._merged(text)
            sides = []
            for side, part in ((1, text[:1]), (2, text[-1:])):
                made, seen = -1, []
                for step in steps:
                    if step[side] != part:
                        seen.append((part, made, step[0]))
                        part, made = step[side], step[0]
                sides.append([*seen, (part, made, self.never)])
            rises = all(a[0] <= b[0] for a, b in zip(steps, steps[1:]))
            self._edges_of[token] = (*sides, rises) if len(parts) == 1 else None
        return self._edges_of[token]

    def _move(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        alive = []
        for last, tokens, node in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at.get(node)
            ends = token is not None and self.follows(last, token)
            # A leaf of the trie goes nowhere; it stays only where a whole piece may be a token that merging doesn't give.
            if node in self.inner or not ends and last is None and not tokens:
                alive.append((last, tokens, node))
            if ends:
                alive.append((token, (*tokens, token), 0))
        shared = 0
        while all(len(tokens) > shared and tokens[shared] == alive[0][1][shared] for _, tokens, _ in alive):
            shared += 1
        emitted = alive[0][1][:shared]
        key = tuple((last, tokens[shared:], node) for last, tokens, node in alive)
        to = self.state_of.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        move = self.moves[state << 8 | byte] = emitted, to
        return move

    def _end(self, state: int) -> tuple[int, ...]:
        """What is left to emit where a piece ends. A piece that is a token is that token."""
        readings = self.states[state]
        whole = [(self.token_at[node],) for last, tokens, node in readings if last is None and not tokens and node in self.token_at]
        out = self.ends[state] = (whole or [tokens for _, tokens, node in readings if node == 0])[0]
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > self.most_moves:
            self._begin()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        found = self.ends.get(state)
        return out + list(self._end(state) if found is None else found)


class Encoder(dict):
    """Tokens of short pieces that were met lately, by piece; `blocks` encodes a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, exact: tuple[str, str] | None = None):
        super().__init__()
        self.machine, self.older = Transducer(ranks), {}
        exact, odd = exact or as_library(pattern)
        self.plain, self.exact = regex.compile(pattern), regex.compile(exact, regex.V1)
        self.odd, self.first_odd = frozenset(odd), ord(min(odd, default=chr(0x10FFFF)))

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.machine.encode(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= MOST_PIECES:  # what isn't met again before this is full once more is forgotten
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, those of up to BLOCK pieces at a time."""
        most = 0 if text.isascii() else int(np.frombuffer(text.encode("utf-32-le"), "<u4").max())
        pattern = self.plain if most < self.first_odd or self.odd.isdisjoint(text) else self.exact
        if len(text) <= BLOCK:
            yield list(chain.from_iterable(map(self.__getitem__, pattern.findall(text))))
            return
        found = (m.group() for m in pattern.finditer(text))
        while pieces := list(islice(found, BLOCK)):
            yield list(chain.from_iterable(map(self.__getitem__, pieces)))


#: Automaton of well-formed UTF-8. States: 0 between characters, 1 to 3 so many bytes to come, 4 to 7 after E0, ED, F0 and F4, whose next byte is
#: restricted, 8 malformed. Ranges of bytes and the states they lead to, by state: fixed values.
MALFORMED = 8
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}


def utf8_table() -> np.ndarray:
    """State after each byte, by state and byte."""
    table = np.full((MALFORMED + 1, 256), MALFORMED, dtype=np.uint8)
    for state, ranges in UTF8.items():
        for low, high, to in ranges:
            table[state, low : high + 1] = to
    return table


class Decoder:
    """Text of tokens that come in blocks: `feed` gives what is complete, `finish` the rest."""

    table = utf8_table()

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # The state after a whole token, from every state: all tokens move on by one byte at a time.
        size = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.over = np.repeat(np.arange(MALFORMED + 1, dtype=np.uint8)[:, None], len(size), axis=1)
        start = np.concatenate([[0], np.cumsum(size)])
        every = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            self.over[:, at] = self.table[self.over[:, at], every[start[at] + k]]
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def _after(self, ids: np.ndarray) -> int:
        """State after these tokens. Between characters, only tokens that leave one open, or are malformed, count."""
        state, at = self.state, 0
        opens = np.flatnonzero(self.over[0, ids])
        while at < len(ids):
            if state == 0:
                k = np.searchsorted(opens, at)
                if k == len(opens):
                    return 0
                at = int(opens[k])
            state = int(self.over[state, ids[at]])
            if state == MALFORMED:
                return state
            at += 1
        return state

    def feed(self, ids: list[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        after = self._after(np.array(ids, dtype=np.int64))
        if after == MALFORMED:
            return self._mend(data)
        open_ = 0
        if after:
            open_ = next(k for k in range(1, 4) if data[-k] >= 0xC0)
        self.state, self.held = after, data[len(data) - open_ :]
        return data[: len(data) - open_].decode()

    def _mend(self, data: bytes) -> str:
        """By single bytes: a byte that cannot come next ends a part of a character, and is read anew."""
        out: list[str] = []
        state, begin = 0, 0
        for at, byte in enumerate(data):
            to = int(self.table[state, byte])
            if to == MALFORMED:
                out.append("�")
                begin = at
                if state:
                    to = int(self.table[0, byte])
                    if to == MALFORMED:
                        out.append("�")
                if to == MALFORMED:
                    begin, to = at + 1, 0
            state = to
            if state == 0 and begin <= at:
                out.append(data[begin : at + 1].decode())
                begin = at + 1
        self.state, self.held = state, data[begin:]
        return "".join(out)

    def finish(self) -> str:
        """What is left: U+FFFD if a character is open."""
        out = "�" if self.state else ""
        self.reset()
        return out


@cache
def machines(ranks_path: str, pattern: str, exact: tuple[str, str]) -> tuple[Encoder, Decoder, list[str]]:
    """One of each for a Python worker, which keeps what it has compiled from task to task, and the ids in decimal."""
    ranks = read_ranks(ranks_path)
    return Encoder(ranks, pattern, exact), Decoder(ranks), [str(k) for k in range(max(ranks.values()) + 1)]


FIELDS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def row_digests(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder, names: list[str]) -> pa.RecordBatch:
    """FIELDS of each row: its text is encoded and decoded block by block."""
    rows = []
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        n, in_ids, in_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in encoder.blocks(text.as_py() or ""):
            if ids:
                in_ids.update(("," * bool(n) + ",".join(map(names.__getitem__, ids))).encode())
                in_bytes.update(decoder.feed(ids).encode())
                n += len(ids)
        in_bytes.update(decoder.finish().encode())
        rows.append((doc_id, n, in_ids.hexdigest(), in_bytes.hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), FIELDS.values())], names=list(FIELDS))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `docs` (doc_id, text): no shuffle, texts in small batches.

    The vocabulary file is read where the work is done.
    """
    exact = as_library(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and moves and encodings are many
        try:
            for batch in _common.slices(batches, "text"):
                yield row_digests(batch, *machines(ranks_path, pattern, exact))
        finally:
            if collects:
                gc.enable()

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
