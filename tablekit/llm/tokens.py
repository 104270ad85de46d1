"""Pre-tokens and token ids of many texts at once: the public GPT-2 style pattern on numpy arrays."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import regex

from .common import strings

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
#: Fixed value: the pattern whose matches pretokens() finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The most distinct words whose ids a worker keeps.
CACHED_WORDS = 400_000


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: \\p{L}, \\p{N}, \\s or another."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    code = np.array(points, np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, text):
            out[code[m.start() : m.end()]] = kind
    return out


class Classes:
    """Code point classes as a library sees them, whose Unicode version may be older: asked once for each code point met."""

    def __init__(self, library: Callable[[str], list[int]]):
        self.library, self.table, self.asked = library, classes().copy(), np.zeros(0x110000, bool)
        self.asked[:0x80] = True

    def of(self, code: np.ndarray) -> np.ndarray:
        fresh = ~self.asked[code]
        if fresh.any():
            new = np.unique(code[fresh])
            self.asked[new] = True
            self.table[new] = np.where(self.table[new] == WHITE, WHITE, 0)
            for before, kind in (("x", LETTER), ("1", NUMBER), ("!", OTHER)):
                starts = self.library("".join(f"\n{before}{chr(c)}" for c in new))
                joined = ~np.isin(3 * np.arange(len(new)) + 2, starts)
                self.table[new[joined]] = kind
        return self.table[code]


def pretokens(data: np.ndarray, offsets: np.ndarray, of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where the pattern's matches start in the texts, and how many matches each text has.

    The matches of PATTERN tile a text: runs of one class, with a space before a run drawn to it, and contractions cut off.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(code)
    first = np.searchsorted(at_byte, offsets)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    kind = of(code) if of else classes()[code]
    head = edge[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(head)
    end = np.append(run[1:], n)
    kind = kind[run]
    white = kind == WHITE
    goes_on = ~edge[end]

    start = np.zeros(n + 1, bool)
    start[run[~white | ~goes_on]] = True
    start[run[white & goes_on & (end - run > 1)]] = True
    last = end[white & goes_on] - 1
    start[last] = True  # of a single white space or the last of several: a match of its own, or the start of the next one
    spaced = last[code[last] == 32] + 1
    start[spaced] = False

    quote = np.flatnonzero((kind == OTHER) & (end - run == 1) & (code[run] == 39) & start[run] & goes_on)
    quote = quote[quote + 1 < len(run)]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        a = code[run[quote] + 1]
        b = np.where(end[quote + 1] - run[quote + 1] > 1, code[np.minimum(run[quote] + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, k in ((one, 1), (two, 2)):
            q = quote[found]
            start[run[q + 1]] = False
            longer = q[end[q + 1] - run[q + 1] > k]
            start[run[longer + 1] + k] = True
    places = np.flatnonzero(start[:n])
    return at_byte[places], np.diff(np.searchsorted(places, first))


def words(data: np.ndarray, offsets: np.ndarray, of: Callable[[np.ndarray], np.ndarray] | None = None):
    """The distinct pre-tokens as an Arrow array, the index of each pre-token, and how many each text has."""
    starts, counts = pretokens(data, offsets, of)
    coded = strings(data, np.diff(np.append(starts, len(data)))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def gathered(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``index`` of ``flat`` one after another, and the length of each."""
    each = lengths[index]
    ends = np.cumsum(each)
    at = np.repeat(first[index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], each


class WordCoder:
    """Ids of texts by way of their distinct pre-tokens; a worker keeps the ids of up to CACHED_WORDS words.

    ``encode`` gives each word's ids as little-endian 32-bit integers. When half of the cache is full, words that are not
    met again before the other half is full are forgotten.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], of: Callable[[np.ndarray], np.ndarray] | None = None, added: dict[bytes, int] | None = None):
        self.encode, self.of, self.known, self.older, self.added = encode, of, {}, {}, added or {}
        self.found = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")

    def _lookup(self, listed: list[bytes]) -> list[bytes]:
        pieces = [*map(self.known.get, listed)]
        missing = [k for k, piece in enumerate(pieces) if piece is None]
        if len(self.known) + len(missing) > CACHED_WORDS // 2:
            self.known, self.older, missing, pieces = {}, self.known, range(len(listed)), [None] * len(listed)
        new = []
        for k in missing:
            piece = pieces[k] = self.older.get(listed[k])
            if piece is None:
                new.append(k)
        for k, piece in zip(new, self.encode([listed[k] for k in new])):
            pieces[k] = piece
        self.known.update((listed[k], pieces[k]) for k in missing)
        return pieces

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where added tokens begin and end in the texts, and their ids: the first, of those that begin there the longest."""
        begin, end, ids, raw = [], [], [], data.tobytes()
        if self.found.search(raw):
            for t in np.flatnonzero(np.diff(np.searchsorted([m.start() for m in self.found.finditer(raw)], offsets))):
                for m in self.found.finditer(raw, offsets[t], offsets[t + 1]):
                    begin.append(m.start()), end.append(m.end()), ids.append(self.added[m.group()])
        return np.array(begin, np.int64), np.array(end, np.int64), np.array(ids, np.uint32)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; added tokens are cut out of the texts first."""
        begin, end, special = self._added(data, offsets)
        if not len(begin):
            return self._plain(data, offsets)
        cuts = np.unique(np.concatenate([offsets, begin, end]))  # pieces between texts' ends and added tokens
        ids, counts = self._plain(data, cuts)
        first = np.cumsum(counts) - counts
        marked = np.searchsorted(cuts, begin)
        keep = np.ones(len(ids), bool)
        for k in marked:
            keep[first[k] : first[k] + counts[k]] = False
        keep[first[marked]] = True
        ids = ids.copy()
        ids[first[marked]] = special
        counts[marked] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids[keep], np.diff(ends[np.searchsorted(cuts, offsets)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, index, counts = words(data, offsets, self.of)
        pieces = self._lookup(distinct.to_numpy(zero_copy_only=False).tolist())  # several times faster than to_pylist()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        ids, each = gathered(flat, np.cumsum(lengths) - lengths, lengths, index)
        ends = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(counts)
        return ids, ends[last] - ends[last - counts]


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for themselves, the
    other bytes in order for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@functools.cache
def hub_coder(path: str) -> WordCoder:
    """By the tokenizers library, as its encode(text, add_special_tokens=False) does: the strings of the file's added tokens
    are these tokens wherever they stand in a text. Added tokens that take white space or word edges along are refused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        added = {t["content"].encode(): t for t in json.load(f)["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()):
        raise ValueError(f"added tokens of {path} do not stand for themselves alone")
    model, letters = tokenizer.model, str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def encode(new: list[bytes]) -> list[bytes]:
        spelled, cuts = b"".join(new).decode("latin-1").translate(letters), [0, *accumulate(map(len, new))]  # a letter for each byte
        ids, ends = array("I"), [0]
        for a, b in zip(cuts, cuts[1:]):
            ids.extend([t.id for t in model.tokenize(spelled[a:b])])
            ends.append(len(ids))
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return WordCoder(encode, Classes(lambda text: [at for _, (at, _) in split(text)]).of, {text: t["id"] for text, t in added.items()})


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
