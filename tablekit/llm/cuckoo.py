"""A cuckoo filter over 64-bit hashes with vectorised insertion, lookup and deletion."""

from __future__ import annotations

import numpy as np

from .common import mixed

SLOTS = 4
#: The share of slots that may be filled before the table doubles.
LOAD = 0.8


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint's two buckets follow from each other.

    Deleting a key that was inserted removes one copy of its fingerprint, so insertions are reversible. The table
    doubles by rebuilding from its keys, which the caller's exact table has: see fits() and build().
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        assert buckets & (buckets - 1) == 0
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(len(keys), 1) / (SLOTS * LOAD)))))
        while True:
            out = cls(buckets)
            if out.insert(keys):
                return out
            buckets *= 2

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int((self.table > 0).sum())

    def fits(self, more: int) -> bool:
        return len(self) + more <= LOAD * self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(keys.astype(np.uint64))
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(print_.astype(np.uint64)) & self.mask)

    def insert(self, keys: np.ndarray) -> bool:
        """Inserts all keys; False if the table is too full for them."""
        print_, at, other = self._places(keys)
        turn = np.random.default_rng(len(keys))
        for attempt in range(500):
            if not len(at):
                return True
            for _ in range(2):  # one key for each bucket gets a free slot, of its first bucket, then of its second
                _, one = np.unique(at, return_index=True)
                free = self.table[at[one]] == 0
                one, free = one[free.any(1)], free[free.any(1)]
                self.table[at[one], free.argmax(1)] = print_[one]
                left = np.ones(len(at), bool)
                left[one] = False
                print_, at, other = print_[left], other[left], at[left]
            if attempt % 4 == 3 and len(at):  # all stay full: one key for each bucket drives another out
                _, one = np.unique(at, return_index=True)
                full = (self.table[at[one]] > 0).all(1)
                one = one[full]
                slot = turn.integers(0, SLOTS, len(one))
                out = self.table[at[one], slot].copy()
                self.table[at[one], slot] = print_[one]
                print_[one] = out
                other[one] = at[one]
                at[one] = self._other(at[one], out)
        return not len(at)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(keys)
        return (self.table[a] == print_[:, None]).any(1) | (self.table[b] == print_[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        for print_, a, b in zip(*self._places(keys)):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == print_)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
