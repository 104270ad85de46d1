"""Words and lines of many UTF-8 texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mixed, strings

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z on bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; runs end where a text does."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:-1] = inside
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts: bounds in bytes, exact ids within this set, and the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.solid = ~SPACE[data]
        self.starts, self.ends = spans(self.solid, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.values = strings(data[self.solid], self.ends - self.starts).dictionary_encode()
        self.ids = self.values.indices.to_numpy().astype(np.int64)
        self.n_ids = len(self.values.dictionary)

    def windows(self, n: int) -> np.ndarray:
        """Places of the first words of all windows of ``n`` words that lie within one text."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.ids))
        return at[at + n <= last]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands: sums of mixed (place, byte) pairs."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    at = np.arange(total) + base
    place = at - np.repeat(starts, lengths)
    terms = mixed((place.astype(np.uint64) << np.uint64(8)) | data[at].astype(np.uint64))
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mixed(sums ^ lengths.astype(np.uint64))


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines (an empty text is one empty line), and each text's first line."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    starts[head] = offsets[:-1]
    starts[~head] = breaks + 1
    ends[tail] = offsets[1:]
    ends[~tail] = breaks
    assert n == len(per_text)
    return starts, ends, first
