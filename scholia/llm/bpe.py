"""Byte-level BPE by prefix dynamic programming, over public rank files.

For every prefix of a piece there is exactly one token that can end its encoding. It is the longest vocabulary entry ending
there that is compatible with the last token of the prefix before it; two tokens are compatible when the
merges would rebuild just this pair from their joined bytes. The table of last tokens is the whole state: walking it backwards
gives the encoding of any prefix, more bytes extend it, and after an edit only the entries near it change.
Texts are cut into pieces by the tokenizer's pattern first, and pieces never merge with each other.

Scale: one pass over the documents, no shuffle. The rank file (under a megabyte, its size is the vocabulary's) is read by the driver and
broadcast. ``round_trip`` and ``encode`` cut some ``SPAN`` bytes of text into pieces at a time and fill the tables of all different pieces together,
one byte further at each step (``Tables``); single texts go through ``Encoder.parts``. Each worker remembers at most twice ``REMEMBERED`` words,
``PIECES`` pieces, and ``PAIRS`` pairs: some 150 MB; ``Tables`` remembers up to a million pairs, 9 MB.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from scholia.llm.common import held, map_batches

#: Bytes of text that are encoded together, and bytes of a piece whose table is filled with those of others.
SPAN, SHORT = 2_000_000, 64
REMEMBERED, PIECES, PAIRS = 120_000, 60_000, 300_000
#: Below this the letters of all Unicode versions are the same.
EASY = "\u0250"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """Tokens by rank, how each is merged, and which pairs may stand side by side."""

    def __init__(self, data: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        # Finds all tokens within a piece, the longest first for each end. Bytes stand as the characters of the same number.
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, r in self.rank.items():
            self.finder.add_word(token.decode("latin-1"), r)
        self.finder.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            pair = self._last_merge(token, r) if len(token) > 1 else None
            self.parts[r] = pair
            if pair:
                self.merged[pair] = r
        # Pairs judged so far: for each left token, right ones.
        self.after: list[dict[int, bool]] = [{} for _ in range(max(self.bytes) + 1)]
        self.sizes = [len(self.bytes.get(r, b"")) for r in range(len(self.after))]
        self.decimal = [str(r) for r in range(len(self.after))]
        self.judged = 0

    def _last_merge(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens that merges of rank below ``limit`` leave of the token's bytes; None if it can't be reached."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, limit) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low >= limit:
                return None
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes end in exactly these two tokens."""
        known = self.after[left].get(right)
        if known is None:
            if self.judged >= PAIRS:
                for pairs in self.after:
                    pairs.clear()
                self.judged = 0
            known = self.after[left][right] = self._fits(left, right)
            self.judged += 1
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges at the seam, latest first. Just before a merge of rank ``below`` happened, its parts lay open: a
        # pair across the seam with a lower rank would have been merged first. Equal ranks go to the left one.
        below = 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < below:
                return False
            cut_left, cut_right = self.parts[left], self.parts[right]
            if cut_left is None and cut_right is None:
                return True
            if cut_right is None or (cut_left is not None and left > right):
                below, left = left, cut_left[1]
            else:
                below, right = right + 1, cut_right[0]


class Prefixes:
    """The last token of every prefix of one piece."""

    __slots__ = ("vocabulary", "piece", "last")

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"", known: "Prefixes | None" = None) -> None:
        """``known``: the table of some prefix of the piece, which is taken over."""
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        if known:
            self.piece, self.last = known.piece, known.last.copy()
        self.append(piece[len(self.piece):])

    def append(self, more: bytes) -> None:
        """Exactly the state of the longer piece; nothing before it is computed again."""
        self.piece += more
        self._extend(len(self.last))

    def _extend(self, start: int, old: list[int] | None = None, shift: int = 0) -> None:
        """Fills the table from ``start``. With ``old``, stops once the entries repeat the old ones, shifted, for as long as a token can reach."""
        v, last, done, same = self.vocabulary, self.last, start - 1, 0
        fits, after = v.fits, v.after
        sizes = v.sizes
        for at, token in v.finder.iter(self.piece.decode("latin-1"), max(0, start - v.longest)):
            if at < done:
                continue
            begin = at + 1 - sizes[token]
            if begin:
                left = last[begin]
                ok = after[left].get(token)
                if not (fits(left, token) if ok is None else ok):
                    continue
            elif at and v.parts[token] is None:
                continue
            last.append(token)
            done = at + 1
            if old is not None:
                same = same + 1 if old[done - shift] == token else 0
                if same >= v.longest:
                    last.extend(old[done - shift + 1:])
                    return

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts ``new`` in place of piece[start:stop]; only entries near the edit are computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.piece, self.last = self.piece[:start] + new + self.piece[stop:], self.last[:start + 1]
        edited = start + len(new)
        whole, self.piece = self.piece, self.piece[:edited]
        self._extend(start + 1)
        self.piece = whole
        self._extend(edited + 1, old, shift)

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes."""
        at, out, last, sizes = len(self.piece) if end is None else end, [], self.last, self.vocabulary.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out


def mixed(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Slots of the keys in a table of 2 ** bits."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED270B7A3C1F * level)) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """Numbers from 0 by keys, for whole arrays; -1 for unknown keys. Of keys with the same slot one stays, the others go to a table behind."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int = 0) -> None:
        self.level, self.bits = level, max(4, len(keys).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, -1, np.int32)
        slots = mixed(keys, level, self.bits)
        self.keys[slots] = keys
        lost = self.keys[slots] != keys
        self.values[slots[~lost]] = values[~lost]
        self.behind = Lookup(keys[lost], values[lost], level + 1) if lost.any() else None

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = mixed(keys, self.level, self.bits)
        same = self.keys[slots] == keys
        found = np.where(same, self.values[slots], -1)
        if self.behind:
            rest = np.flatnonzero(~same & (self.values[slots] >= 0))
            found[rest] = self.behind(keys[rest])
        return found


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as counted, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Tables:
    """Last tokens of every prefix of many pieces together: a step takes all of them one byte further."""

    BITS = 20

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = v = vocabulary
        self.sizes = np.array(v.sizes, np.int64)
        cuts = [v.parts.get(r) or (-1, -1) for r in range(len(v.sizes))]
        self.head, self.tail = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
        merged = np.array([(*pair, r) for pair, r in v.merged.items()], np.int64).reshape(-1, 3)
        self.merged = Lookup(pairs(merged[:, 0], merged[:, 1]), merged[:, 2])
        self.ranks = np.array(list(v.rank.values()), np.int64)
        self.tokens = pa.array(list(v.rank), pa.large_binary())
        # A tree of the bytes of all tokens: the node after two bytes by themselves, further ones by node and byte.
        nodes: dict[int, int] = {}
        whole, self.after_two = [-1], np.zeros(1 << 16, np.int64)
        self.single = np.full(256, -1, np.int64)
        for token, r in v.rank.items():
            if len(token) == 1:
                self.single[token[0]] = r
            elif v.parts[r] is not None:  # merges never make the others
                at = int(self.after_two[token[0] << 8 | token[1]])
                if not at:
                    at = self.after_two[token[0] << 8 | token[1]] = len(whole)
                    whole.append(-1)
                for b in token[2:]:
                    key = at << 8 | b
                    at = nodes.get(key, 0)
                    if not at:
                        at = nodes[key] = len(whole)
                        whole.append(-1)
                whole[at] = r
        self.whole = np.array(whole, np.int64)
        self.next = Lookup(np.array(list(nodes), np.uint64), np.array(list(nodes.values()), np.int64))
        self.known, self.judged = np.full(1 << self.BITS, ~np.uint64(0)), np.zeros(1 << self.BITS, bool)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As the vocabulary judges each pair; a slot remembers its newest pair."""
        keys = pairs(left, right)
        slots = mixed(keys, 0, self.BITS)
        out = self.judged[slots]
        new = np.flatnonzero(self.known[slots] != keys)
        if len(new):
            fresh, place = np.unique(keys[new], return_inverse=True)
            ok = self._fits((fresh >> np.uint64(32)).astype(np.int64), (fresh & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[new] = ok[place]
            # Two new pairs may share a slot: its key and its verdict have to be of the same one.
            slots = mixed(fresh, 0, self.BITS)
            self.known[slots] = fresh
            mine = self.known[slots] == fresh
            self.judged[slots[mine]] = ok[mine]
        return out

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out, at, below = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(at):
            across = self.merged(pairs(left, right))
            torn = (across >= 0) & (across < below)
            out[at[torn]] = False
            cut_left, cut_right = self.tail[left], self.head[right]
            on = ~torn & ((cut_left >= 0) | (cut_right >= 0))
            at, left, right, cut_left, cut_right = at[on], left[on], right[on], cut_left[on], cut_right[on]
            lefts = (cut_right < 0) | ((cut_left >= 0) & (left > right))
            below = np.where(lefts, left, right + 1)
            left, right = np.where(lefts, cut_left, left), np.where(lefts, right, cut_right)
        return out

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the pieces (large_binary, none empty), and where those of each start and how many they are."""
        known = pc.index_in(pieces, value_set=self.tokens)
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        known = known.fill_null(-1).to_numpy(zero_copy_only=False)
        short = np.flatnonzero((known < 0) & (size <= SHORT))
        long = np.flatnonzero((known < 0) & (size > SHORT))
        found, of = self._short(pieces.take(pa.array(short)), size[short])
        tables = [Prefixes(self.vocabulary, p.as_py()).ids() for p in pieces.take(pa.array(long))]
        count = np.ones(len(pieces), np.int64)
        count[short], count[long] = of, [len(t) for t in tables]
        starts = np.empty(len(pieces), np.int64)
        ones = known >= 0
        starts[ones] = known[ones]
        starts[short] = len(self.ranks) + np.cumsum(of) - of
        starts[long] = len(self.ranks) + len(found) + np.cumsum(count[long]) - count[long]
        return np.concatenate([self.ranks, found, *(np.array(t, np.int64) for t in tables)]), starts, count

    def _short(self, pieces: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        if not len(pieces):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = binary(pieces)[1]
        begin = np.cumsum(size) - size
        # Where each byte stands in its piece, and all tokens found: where they end, which they are.
        offset = np.arange(len(raw)) - np.repeat(begin, size)
        left = np.repeat(size, size) - offset
        ends, tokens = [np.arange(len(raw))], [self.single[raw]]
        at = np.flatnonzero(left >= 2)
        node, length = self.after_two[raw[at].astype(np.int64) << 8 | raw[at + 1]], 2
        while len(at):
            on = node > 0
            at, node = at[on], node[on]
            token = self.whole[node]
            hit = token >= 0
            ends.append(at[hit] + (length - 1))
            tokens.append(token[hit])
            on = left[at] > length
            at, node = at[on], node[on]
            node = self.next((node.astype(np.uint64) << np.uint64(8)) | raw[at + length])
            length += 1
        ends, tokens = np.concatenate(ends), np.concatenate(tokens)
        # Shorter tokens come first: of those that fit at one end, the last and longest stays.
        order = np.argsort(offset[ends].astype(np.uint8), kind="stable")
        ends, tokens = ends[order], tokens[order]
        last, steps = np.empty(len(raw), np.int64), np.cumsum(np.bincount(offset[ends]))
        before = ends - self.sizes[tokens]
        first = offset[ends] == self.sizes[tokens] - 1
        for a, b in zip([0, *steps], steps):
            end, token, ok = ends[a:b], tokens[a:b], first[a:b].copy()
            inner = np.flatnonzero(~ok)
            ok[inner] = self.fits(last[before[a:b][inner]], token[inner])
            last[end[ok]] = token[ok]
        # Backwards from the end of each piece.
        at, stop, piece, count, back = begin + size - 1, begin - 1, np.arange(len(size)), np.zeros(len(size), np.int64), []
        while len(piece):
            token = last[at]
            back.append((piece, token))
            count[piece] += 1
            at = at - self.sizes[token]
            on = at > stop
            at, stop, piece = at[on], stop[on], piece[on]
        out, stops = np.empty(count.sum(), np.int64), np.cumsum(count)
        for i, (piece, token) in enumerate(back, 1):
            out[stops[piece] - i] = token
        return out, count


def binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from 0) and bytes of a large_binary or large_string array without nulls."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset:values.offset + len(values) + 1]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8)


class Sizes(dict):
    """How many tokens a word after a space has; not a number if white space ends it, as the next space then follows white space. Sums of
    such numbers are not one either, so a text needs no test of each word."""

    def __init__(self, encoder: "Encoder") -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> float:
        e = self.encoder
        if not word or word[-1].isspace():
            size = math.nan
        else:
            size = e.size(" " + word)
        if len(word) <= 64:
            if len(self) >= 2 * REMEMBERED:
                self.clear()
            self[word] = size
        return size


#: Ids, the same in decimals, how many, and the bytes they decode to.
Part = tuple[tuple[int, ...], str, int, bytes]
DECIMAL, SIZE, DECODED = map(itemgetter, (1, 2, 3))


#: Below this the kinds of a character that the pattern tells apart are looked up; all are of one or two bytes.
ODD, WHITE = 0x240, 4
KINDS = np.array([next(i for i, p in ((1, r"\p{L}"), (2, r"\p{N}"), (WHITE, r"\s"), (3, r"(?s).")) if regex.match(p, chr(c))) for c in range(ODD)], np.uint8)
#: A space that follows no white space.
SAFE = re.compile(rb"(?<=[!-~]) ").search


class Encoder:
    """Encodes and decodes texts; remembers pieces, and the words between two spaces.

    A space that follows no white space always starts a piece, so texts are first cut there and most words are found in memory.
    Texts with a space after white space are cut by the pattern alone.
    """

    def __init__(self, data: bytes, pattern: str) -> None:
        self.vocabulary = Vocabulary(data)
        self.find = regex.compile(pattern).findall
        self.cut = pattern == public_tokenizers.PATTERN
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, Part | None] = {}
        self.older: dict[str, Part | None] = {}
        self.sizes = Sizes(self)
        self.pattern, self.library = pattern, None
        # All tokens in decimals, after a comma, and their bytes.
        self.decimal = pa.array(["," + d for d in self.vocabulary.decimal], pa.large_string())
        self.decoded = pa.array([self.vocabulary.bytes.get(r, b"") for r in range(len(self.vocabulary.sizes))], pa.large_binary())
        self.tables: Tables | None = None

    # Tuples of numbers, since the garbage collector soon leaves those alone.
    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None and piece[:1] == " " and (known := self.words.get(piece[1:])):
            return known[0]
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.vocabulary.rank.get(raw)
            if len(raw) > 64:
                return (whole,) if whole is not None else tuple(Prefixes(self.vocabulary, raw).ids())
            ids = (whole,) if whole is not None else self._short(raw.decode("latin-1"))
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def spaced(self, word: str) -> tuple[int, ...]:
        """Letters after a space are one piece."""
        raw = " " + word if word.isascii() else (" " + word).encode().decode("latin-1")
        whole = self.vocabulary.finder.get(raw, None)
        return (whole,) if whole is not None else self._short(raw)

    def _short(self, raw: str) -> tuple[int, ...]:
        """As the ids of a table that is not kept. Bytes stand as the characters of the same number."""
        v = self.vocabulary
        sizes, after, fits, last, done = v.sizes, v.after, v.fits, [-1], 0
        for at, token in v.finder.iter(raw):
            if at < done:
                continue
            begin = at + 1 - sizes[token]
            if begin:
                left = last[begin]
                ok = after[left].get(token)
                if not (fits(left, token) if ok is None else ok):
                    continue
            elif at and v.parts[token] is None:
                continue
            last.append(token)
            done = at + 1
        out = []
        while done:
            token = last[done]
            out.append(token)
            done -= sizes[token]
        return tuple(out[::-1])

    def plain(self, text: str) -> tuple[int, ...]:
        found = self.find(text)
        return self.piece(found[0]) if len(found) == 1 else tuple([i for p in found for i in self.piece(p)])

    def part(self, ids: tuple[int, ...]) -> Part:
        decimal, raw = self.vocabulary.decimal, self.vocabulary.bytes
        return ids, ",".join([decimal[i] for i in ids]), len(ids), b"".join([raw[i] for i in ids])

    def _word(self, word: str) -> Part | None:
        """Ids of the word after a space, in decimals too, and how many; None if white space ends it, as the next space then follows white space."""
        found = self.older.get(word)
        if found is None:
            if not word or word[-1].isspace():
                return None
            found = self.part(self.spaced(word) if word.isalpha() and (word.isascii() or max(word) < EASY) else self.plain(" " + word))
        if len(self.words) >= REMEMBERED:
            self.older, self.words = self.words, {}
        # Ends of lines with the beginnings of the next hardly repeat.
        if len(word) <= 64 and "\n" not in word:
            self.words[word] = found
        return found

    def parts(self, text: str) -> list[Part]:
        """The encoding of the text, cut where cutting changes nothing."""
        first, *rest = text.split(" ") if self.cut else [text]
        if rest:
            last, get, word = rest.pop(), self.words.get, self._word
            found = [get(w) or word(w) for w in rest]
            if None not in found:
                ends = [self.plain(first), self.plain(" " + last)] if not first or not first[-1].isspace() else [None]
                if None not in ends:
                    head, tail = map(self.part, ends)
                    return [head, *found, tail] if head[2] else [*found, tail]
        ids = self.plain(text)
        return [self.part(ids)] if ids else []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            out += part[0]
        return out

    def size(self, text: str) -> int:
        """Tokens of a text by itself. Short ones that nobody remembers go to the tokenizer's own library, which is faster when no table is kept."""
        if len(text) > 64:
            return len(self.plain(text))
        if self.library is None:
            self.library = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=self.vocabulary.rank, special_tokens={})
        return len(self.library.encode_ordinary(text))

    def count(self, text: str) -> int:
        """The length of the encoding, from the lengths of its words alone."""
        first, *rest = text.split(" ") if self.cut else [text]
        if rest and not first[-1:].isspace():
            last = rest.pop()
            inner = sum(map(self.sizes.__getitem__, rest))
            if inner == inner:
                return inner + self.size(first) + self.size(" " + last)
        return len(self.plain(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))

    def spans(self, texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """The encoding of many texts (null: empty), some ``SPAN`` bytes at a time: for parts of texts in their order which text each is of, the ids of
        all, and where those of each part end (from 0). Only a longer text has several parts."""
        if not self.cut:
            for i, text in enumerate(texts):
                ids = np.array(self.plain(text.as_py() or ""), np.int64)
                yield [i], ids, np.array([0, len(ids)])
            return
        if self.tables is None:
            self.tables = Tables(self.vocabulary)
        texts.validate(full=True)  # bytes that are no UTF-8 would shift the kinds
        ends, raw = binary(texts.cast(pa.large_string()).fill_null(""))
        ends, of, stops = ends.tolist(), [], [0]
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            while b - a > SPAN and (space := SAFE(raw, a + SPAN, b)):
                a = space.start()
                of.append(i)
                stops.append(a)
            of.append(i)
            stops.append(b)
        at = 0
        while at < len(of):
            to = at + 1
            while to < len(of) and stops[to + 1] - stops[at] <= SPAN:
                to += 1
            part = np.array(stops[at:to + 1], np.int64) - stops[at]
            ids, ends = self._span(raw[stops[at]:stops[to]], part)
            yield of[at:to], ids, ends
            at = to

    def _span(self, raw: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, which begin and end at ``part``, and where those of each end."""
        if not len(raw):
            return np.empty(0, np.int64), np.zeros(len(part), np.int64)
        starts = np.flatnonzero(self._cuts(raw, np.unique(part[part < len(raw)])))
        ends = np.append(starts, len(raw))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        known, first, count = self.tables.ids(pieces.dictionary)
        code = pieces.indices.to_numpy()
        count = count[code]
        return known[ranges(first[code], count)], np.append(0, np.cumsum(count))[np.searchsorted(ends, part)]

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each byte of the texts, which begin at ``starts``: where letters, digits, white space and others change. Words with
        letters from ``ODD`` on, other white space than ASCII's or an apostrophe are cut by the pattern."""
        kind = KINDS[np.minimum(raw, 0x80)]
        lead = np.flatnonzero(raw >= 0xC0)
        odd = lead[raw[lead] >= 0xC0 | ODD >> 6]
        lead = lead[raw[lead] < 0xC0 | ODD >> 6]
        kind[lead] = kind[lead + 1] = KINDS[(raw[lead].astype(np.int64) & 31) << 6 | raw[lead + 1] & 63]
        odd = np.concatenate([odd, lead[kind[lead] == WHITE], np.flatnonzero(raw == ord("'"))])
        white, space = kind == WHITE, raw == ord(" ")
        cut = np.empty(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (white[1:] | ~space[:-1])
        # The last of several spaces goes with what follows, in the same text.
        final = white[:-1] & ~white[1:]
        final[starts[1:] - 1] = False
        cut[:-1] |= final
        cut[starts] = True
        if len(odd):
            at = np.flatnonzero(space[1:] & ~white[:-1]) + 1
            # White space of three bytes, and some other letters that end in the same two, are no place to cut.
            two, one = raw[np.maximum(at - 2, 0)], raw[at - 1]
            wide = (kind[at - 1] == 0) & (((two == 0x80) & (one <= 0xAF)) | ((two == 0x9A) & (one == 0x80)) | ((two == 0x81) & (one == 0x9F)))
            bounds = np.unique(np.concatenate([starts, at[~wide], [len(raw)]]))
            words, known = np.unique(np.searchsorted(bounds, odd, "right")) - 1, {}
            for a, b in zip(bounds[words].tolist(), bounds[words + 1].tolist()):
                word = raw[a:b].tobytes()
                places = known.get(word)
                if places is None:
                    sizes = [len(p.encode()) for p in self.find(word.decode())]
                    places = known[word] = np.cumsum([0, *sizes[:-1]])
                cut[a:b] = False
                cut[places + a] = True
        return cut


@contextmanager
def uncollected() -> Iterator[None]:
    """The caches hold many small objects and no cycles: looking through them for garbage takes as long as the encoding."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def lists(n: np.ndarray, ids: list[np.ndarray]) -> pa.Array:
    """Lists of ``n`` ids each."""
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate(ids).astype(np.int32))


def shipped(df: DataFrame, ranks: str, pattern: str):
    """A function that gives the encoder inside a task."""
    with open(ranks, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: held(Encoder, data.value, pattern)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the token ids of the whole ``text`` (null: empty), without special tokens; a column of that name is replaced, others stay."""
    get, docs = shipped(docs, ranks, pattern), docs.drop(ids)
    place = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, kept = np.zeros(batch.num_rows, np.int64), [np.empty(0, np.int64)]
        for of, found, ends in get().spans(batch.column(place)):
            np.add.at(n, of, np.diff(ends))
            kept.append(found)
        found = lists(n, kept)
        return pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, ids])

    return map_batches(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{ids}` array<int>")


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the bytes that ``ids`` stand for; null where ``ids`` is null. A column of that name is replaced."""
    get, df = shipped(df, ranks, pattern), df.drop(text)
    place = df.columns.index(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([None if x.as_py() is None else get().decode(x.as_py()) for x in batch.column(place)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return map_batches(df, run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{text}` binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every document, and ``ids`` if asked for: encoded, then
    decoded from the ids, in one pass. Null texts are empty; repeated rows stay; other columns are ignored."""
    get = shipped(docs, ranks, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, n, kept = get(), np.zeros(batch.num_rows, np.int64), [np.empty(0, np.int64)]
        ids_sha, sha = ([hashlib.sha256() for _ in n] for _ in range(2))
        for of, ids, ends in e.spans(batch.column(1)):
            for shas, values, comma in (ids_sha, e.decimal, 1), (sha, e.decoded, 0):
                at, raw = binary(values.take(pa.array(ids)))
                for i, a, b in zip(of, at[ends].tolist(), at[ends[1:]].tolist()):
                    shas[i].update(raw[a if n[i] or a == b else a + comma:b])
            np.add.at(n, of, np.diff(ends))
            if keep_ids:
                kept.append(ids)
        columns = [batch.column(0), pa.array(n), *(pa.array([h.hexdigest() for h in shas], pa.string()) for shas in (ids_sha, sha))]
        if keep_ids:
            columns.append(lists(n, kept))
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return map_batches(docs.select("doc_id", "text"), run, schema)


def token_counts(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens; null texts have none."""
    get = shipped(docs, ranks, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = get()
        with uncollected():
            n = [e.count(t.as_py() or "") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint")
