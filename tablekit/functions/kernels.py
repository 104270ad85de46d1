"""Hash and address functions that Spark has not, on Arrow batches."""

from __future__ import annotations

import ipaddress

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the FNV-1a and MurmurHash2 (64A) hash functions.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MURMUR_SEED, MURMUR_M, MURMUR_R = 0x9747B28C, 0xC6A4A7935BD1E995, 47
MASK = (1 << 64) - 1


def fnv63(text: str) -> int:
    """FNV-1a over the low bytes of the UTF-16 units, folded by 32 bits, without the sign bit."""
    h = FNV_OFFSET
    for unit in text.encode("utf-16-le", "surrogatepass")[::2]:
        h = ((h ^ unit) * FNV_PRIME) & MASK
    return (h ^ (h >> 32)) & (MASK >> 1)


def _fnv63_all(texts: pd.Series) -> pd.Series:
    """fnv63() of many texts at once, one step for each place."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint8)[::2] for t in texts]
    size = np.array([len(u) for u in units])
    h = np.full(len(units), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")
    flat = np.zeros((len(units), int(size.max(initial=0))), np.uint8) if size.max(initial=0) <= 512 else None
    if flat is None:
        return pd.Series([fnv63(t) for t in texts])
    for k, i in enumerate(order):
        flat[k, : size[i]] = units[i]
    live = np.searchsorted(-size[order], -np.arange(1, flat.shape[1] + 1), "right")
    with np.errstate(over="ignore"):
        for place, m in enumerate(live):
            h[:m] = (h[:m] ^ flat[:m, place]) * np.uint64(FNV_PRIME)
    out = np.empty(len(units), np.int64)
    out[order] = ((h ^ (h >> np.uint64(32))) & np.uint64(MASK >> 1)).astype(np.int64)
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def hash63(value: pd.Series) -> pd.Series:
    """The 63-bit hash of text; null stays null."""
    out = pd.Series([None] * len(value), dtype="Int64", index=value.index)
    known = value.notna()
    if known.any():
        out[known] = _fnv63_all(value[known]).to_numpy()
    return out


def murmur2_64a(data: bytes, seed: int = MURMUR_SEED) -> int:
    """MurmurHash2, 64-bit variant A, as a signed number."""
    h = (seed ^ (len(data) * MURMUR_M)) & MASK
    whole = len(data) // 8 * 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = (k * MURMUR_M) & MASK
        k = ((k ^ (k >> MURMUR_R)) * MURMUR_M) & MASK
        h = ((h ^ k) * MURMUR_M) & MASK
    if tail := data[whole:]:
        h = ((h ^ int.from_bytes(tail, "little")) * MURMUR_M) & MASK
    h = ((h ^ (h >> MURMUR_R)) * MURMUR_M) & MASK
    h ^= h >> MURMUR_R
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def murmur64(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else murmur2_64a(v.encode()) for v in value], dtype="Int64")


@F.pandas_udf(T.BinaryType())
def ipv6_to_bytes(value: pd.Series) -> pd.Series:
    """16 bytes of an IPv6 (or mapped IPv4) address or of 32 hexadecimal digits; null for other text."""

    def one(v: str | None) -> bytes | None:
        if v is None:
            return None
        try:
            a = ipaddress.ip_address(v.strip())
            return a.packed if a.version == 6 else b"\0" * 10 + b"\xff\xff" + a.packed
        except ValueError:
            try:
                raw = bytes.fromhex(v.replace("-", ""))
                return raw if len(raw) == 16 else None
            except ValueError:
                return None

    return value.map(one)


@F.pandas_udf(T.StringType())
def bytes_to_ipv6(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else str(ipaddress.IPv6Address(bytes(v))))


def bytes_to_uuid(value: Column) -> Column:
    """The text form of 16 bytes: 8-4-4-4-12 hexadecimal digits."""
    return F.regexp_replace(F.lower(F.hex(value)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
