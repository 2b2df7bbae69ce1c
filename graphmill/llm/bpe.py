"""Byte-level BPE by a lazily determinised finite-state transducer.

A segmentation into tokens is the one that merging by rank gives exactly if
every token is what its own bytes merge into, and every two neighbours are what
their joined bytes merge into. So the merges compile into a transducer whose
states are (last token, place in the trie of tokens): reading a byte goes down
the trie, and at a token that fits the last one the path may also emit it and
return to the root. That machine is nondeterministic, yet each prefix has exactly
one path that ends in a finished token. Sets of paths are determinised as they
are met, and kept up to a bound: the deterministic machine names for each byte
the token that would end there. Paths that leave the trie drop out, so once the
open ones, none longer than the longest token, are resolved, the tokens before
them are settled and emitted by stepping back from end to end.

Encoding splits text by the tokenizer's pattern and runs each piece through the
transducer; a piece that is itself a token becomes it, as the public library
has it. Ids are kept packed, as little-endian unsigned 32-bit integers.
Decoding joins the tokens' bytes in blocks and runs them through an incremental
UTF-8 state machine.

The vocabulary is read and compiled on the driver, once, and broadcast (under 5 MB): the
trie, and of each token the two parts of its last merge. No shuffle; memory per task is bounded by the caches' sizes and one Arrow batch.

Defined results: null text is the empty text, which has no ids; empty ids decode
to the empty text; text of any length is one document; repeated rows get equal
ids. Bytes that are not UTF-8 decode to U+FFFD. Only the named column is read.
"""

from __future__ import annotations

import base64
import gc
import pickle
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from struct import Struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.shared import file_system, small_batches, text_of

ROOT = 0
NONE = -1
SHIFT = 24
NODE = (1 << SHIFT) - 1
#: Stands for the last token where a piece begins.
START = NODE
NEVER = 1 << 62
#: Bounds of what one task remembers: determinised sets, pairs, pieces.
STATES, PAIRS, PIECES = 160_000, 250_000, 100_000
BLOCK = 1 << 12


def merged(piece: bytes, ranks: dict[bytes, int], merges: list | None = None) -> list[int]:
    """The ids that merging the bytes of a short piece by rank gives. merges, if
    given, collects each merge: its rank, its left and its right part."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        if merges is not None:
            merges.append((best, parts[at], parts[at + 1]))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Tables(NamedTuple):
    """A vocabulary, compiled once and sent to the tasks."""

    ranks: dict[bytes, int]
    child: dict[int, int]  # node << 8 | byte -> node
    token: array  # that ends at a node
    inner: bytearray  # whether longer tokens go on from a node
    #: Of each token the two parts that its last merge joins; NONE for one byte.
    first: array
    second: array
    #: Whether all merges on the way to a token come in the order of their ranks.
    ordered: bool


def compiled(ranks: dict[bytes, int]) -> Tables:
    child, at, inner, ordered = {}, array("i", [NONE]), bytearray(1), True
    first, second = (array("i", [NONE]) * (max(ranks.values()) + 1) for _ in range(2))
    for token, i in ranks.items():
        merges: list[tuple[int, bytes, bytes]] = []
        if len(token) == 1 or merged(token, ranks, merges) == [i]:
            ordered &= merges == sorted(merges, key=lambda m: m[0])
            if merges:
                first[i], second[i] = ranks[merges[-1][1]], ranks[merges[-1][2]]
            node = ROOT
            for b in token:
                inner[node] = 1
                node = child.setdefault(node << 8 | b, len(at))
                if node == len(at):
                    at.append(NONE)
                    inner.append(0)
            at[node] = i
    return Tables(ranks, child, at, inner, first, second, ordered)


class Transducer:
    """Encodes pieces of bytes; sets of paths are determinised when first met.

    A set is one tuple: of each path the token it ended last, then its trie node. The
    last path has just ended one, so the set says which token ends where it is reached.
    """

    def __init__(self, tables: Tables):
        self.ranks, self.child, self.token, self.inner, self.first, self.second, self.ordered = tables
        self.bytes_of = [b""] * len(self.first)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = (START, ROOT)
        self.number = {start: 0}
        self.paths = [start]
        self.next: dict[int, int] = {}  # state << 8 | byte -> next state

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if left == START:
            found = True
        elif self.ordered:
            found = self.apart(left, right)
        else:
            found = merged(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        self.pairs[left << SHIFT | right] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens. The merges of both are
        undone, latest first (of equal ranks the one further left came first): one
        crosses if the parts at the border then have a rank below the merge undone last."""
        ranks, bytes_of, first, second, limit = self.ranks, self.bytes_of, self.first, self.second, NEVER
        while True:
            rank = ranks.get(bytes_of[left] + bytes_of[right])
            if rank is not None and rank < limit:
                return False
            if second[left] != NONE and (left > right or first[right] == NONE):
                limit, left = left, second[left]
            elif first[right] != NONE:
                limit, right = right + 1, first[right]
            else:
                return True

    def step(self, state: int, byte: int) -> int:
        """The transition of a set of paths on a byte. Paths stand with the longest
        open token first; exactly one of them can end a token here."""
        child, inner, tokens = self.child.get, self.inner, self.token
        paths, ended, flat = [], NONE, iter(self.paths[state])
        for last, node in zip(flat, flat, strict=True):
            node = child(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                paths += last, node
            if ended == NONE and (token := tokens[node]) != NONE:
                fits = self.pairs.get(last << SHIFT | token)
                if fits or fits is None and self.fits(last, token):
                    ended = token
        key = (*paths, ended, ROOT)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.paths)
            self.paths.append(key)
        self.next[state << 8 | byte] = to
        return to

    def settled(self, states: list[int]) -> list[int]:
        """The tokens of a stretch, from the state after each byte."""
        ids, at, paths, data = [], len(states), self.paths, self.bytes_of
        while at:
            token = paths[states[at - 1]][-2]
            ids.append(token)
            at -= len(data[token])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.paths) >= STATES:
            self.forget()
        get, state, states, ids = self.next.get, 0, [], []
        for at in range(0, len(piece), BLOCK):
            for byte in piece[at : at + BLOCK]:
                to = get(state << 8 | byte)
                if to is None:
                    to = self.step(state, byte)
                state = to
                states.append(to)
            if at + BLOCK < len(piece):
                # Where one path is left no open token reaches past: the tokens up to there are settled.
                for place in range(len(states), max(0, len(states) - BLOCK), -1):
                    if len(self.paths[states[place - 1]]) == 2:
                        ids += self.settled(states[:place])
                        states = states[place:]
                        break
        return ids + self.settled(states)


@lru_cache(1000)
def packer(n: int):
    return Struct(f"<{n}I").pack


class Pieces(dict):
    """piece of text -> its packed ids. tables: the ranks compiled, if they are already."""

    def __init__(self, ranks: dict[bytes, int], tables: Tables | None = None):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.machine = Transducer(tables or compiled(ranks))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:  # what isn't asked for again before the next turn goes
            self.older = self.copy()
            self.clear()
        if piece in self.older:
            self[piece] = self.older[piece]
            return self[piece]
        data = piece.encode()
        whole = self.machine.ranks.get(data)
        ids = self.machine.encode(data) if whole is None else [whole]
        packed = packer(len(ids))(*ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Utf8Stream:
    """Bytes in any cuts -> text; a character cut in two waits for its rest."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def complete(data: bytes) -> int:
        """How many bytes of data end with a whole character."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return len(data) - back if back < need else len(data)
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        whole = self.complete(data)
        self.waiting = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Packed ids -> text, block by block through one UTF-8 stream."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = {i: b for b, i in ranks.items()}
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.pool = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        shift = self.start[ids] - np.concatenate(([0], np.cumsum(length)[:-1]))
        return self.pool[np.arange(length.sum()) + np.repeat(shift, length)].tobytes()

    def decode(self, ids: bytes) -> str:
        numbers, stream = np.frombuffer(ids, "<u4"), Utf8Stream()
        texts = [stream.feed(self.joined(numbers[at : at + BLOCK])) for at in range(0, len(numbers), BLOCK)]
        return "".join(texts) + stream.finish()


#: The common split pattern, and what its classes hold below U+0100.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"


def splitter(pattern: str):
    """text -> its pieces. Texts of characters below U+0100 are split by the
    common pattern written out for these, which the faster library can run."""
    split = regex.compile(pattern).findall
    if pattern != COMMON:
        return split
    other = f"[^{SPACES}{LETTERS}{NUMBERS}]+"
    narrow = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?{other}|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall

    def by_width(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return split(text)
        return narrow(text)

    return by_width


def parsed_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def pieces_of(data: bytes) -> Pieces:
    return Pieces(parsed_ranks(data))


def decoder_of(data: bytes) -> Decoder:
    return Decoder(parsed_ranks(data))


@contextmanager
def task_tables(data: bytes) -> Iterator[tuple[Pieces, Decoder]]:
    """A task's transducer, its caches and its decoder, of pickled Tables. They go with the task:
    the worker's next task may belong to another operator with tables of its own."""
    tables = Tables(*pickle.loads(data))
    pieces, decoder = Pieces(tables.ranks, tables), Decoder(tables.ranks)
    gc.freeze()  # the vocabulary needn't be traversed again and again
    try:
        yield pieces, decoder
    finally:
        gc.unfreeze()


class Tokenizer:
    """encode() and decode() on columns, for a rank file and split pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        system, inner = file_system(path)
        with system.open_input_stream(inner) as source:
            ranks = parsed_ranks(source.read())
        vocabulary = spark.sparkContext.broadcast(pickle.dumps(tuple(compiled(ranks))))

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task_tables(vocabulary.value) as (pieces, _):
                split = splitter(pattern)
                for texts in batches:
                    yield pa.array([b"".join(map(pieces.__getitem__, split(t))) for t in texts.to_pylist()], pa.binary())

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder = Decoder(pickle.loads(vocabulary.value)[0])
            for ids in batches:
                yield pa.array([decoder.decode(x) for x in ids.to_pylist()], pa.string())

        @F.arrow_udf("ids binary, decoded string")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task_tables(vocabulary.value) as (pieces, decoder):
                split = splitter(pattern)
                for texts in batches:
                    ids = [b"".join(map(pieces.__getitem__, split(t))) for t in texts.to_pylist()]
                    yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(decoder.decode, ids), pa.string())], ["ids", "decoded"])

        self._encode, self._decode, self._both = encode, decode, both
        small_batches(spark)

    def encode(self, text: str | Column) -> Column:
        """Packed ids of a text column."""
        return self._encode(text_of(text))

    def decode(self, ids: str | Column) -> Column:
        """The text of packed ids."""
        return self._decode(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.lit(b"")))

    def round_trip(self, text: str | Column) -> Column:
        """Both at once: a struct of the packed ids and of the text that these
        decode to, from one pass through one worker."""
        return self._both(text_of(text))


def n_tokens(ids: str | Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
