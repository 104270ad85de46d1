"""Operator 10, quality rules: repetition coverage by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, mixed, narrow, positional, strings, utf8
from .words import Words, line_bounds

#: Lengths in words of the n-grams whose repetition counts, and the largest share of word characters inside repeated
#: ones that a kept text may have (shorter n-grams repeat by chance more easily).
COVERAGE = {5: 0.55, 8: 0.50, 10: 0.45}
#: The largest share of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.30
#: The largest number of symbols for each word.
SYMBOLS_PER_WORD = 0.30

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("ngram_coverage", "double"), ("line_coverage", "double")]


def _repeated(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True where an element's keys equal those of another; ``order`` sorts them."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        k = key[order]
        same &= k[1:] == k[:-1]
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    out = np.zeros(len(order), bool)
    out[order] = twice[1:] | twice[:-1]
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the words inside a window of ``n`` words that starts at one of ``at``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of the texts; see quality_rules()."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    letters = np.concatenate([[0], np.cumsum(w.solid & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    total = letters[offsets[1:]] - letters[offsets[:-1]]
    each = letters[w.ends] - letters[w.starts]

    def per_text(flags: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(w.doc[flags], None if weights is None else weights[flags], minlength=n)

    at = w.windows(3)
    if w.n_ids < 1 << 21:
        triple = (w.ids[at] << 42) | (w.ids[at + 1] << 21) | w.ids[at + 2]
    else:
        pair = np.unique(w.ids[at] * w.n_ids + w.ids[at + 1], return_inverse=True)[1]
        triple = pair * w.n_ids + w.ids[at + 2]
    doc = w.doc[at]
    twice = _repeated(np.lexsort((triple, doc)), triple, doc)
    repeat_words = per_text(_covered(at[twice], 3, len(w.ids)))

    with np.errstate(over="ignore"):
        code, salt = mixed(w.ids.astype(np.uint64)), mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
        rolled, width, coverage, bad = code.copy(), 1, np.zeros(n), np.zeros(n, bool)
        for size, most in COVERAGE.items():
            while width < size:  # from windows of width words to those of one word more; ends of texts are cut off below
                rolled = rolled[: max(len(code) - width, 0)] * BASE + code[width:]
                width += 1
            at = w.windows(size)
            key = mixed(rolled[at] ^ salt[w.doc[at]])
            share = per_text(_covered(at[_repeated(np.argsort(key), key)], size, len(w.ids)), each) / np.maximum(total, 1)
            coverage = np.maximum(coverage, share)
            bad |= share > most

    starts, ends, first = line_bounds(data, offsets)
    line_doc = np.repeat(np.arange(n), np.diff(first))
    letters_in = letters[ends] - letters[starts]
    ids = strings(data[data != 10], ends - starts).dictionary_encode().indices.to_numpy()
    full = np.flatnonzero(letters_in > 0)
    order = full[np.lexsort((full, ids[full], line_doc[full]))]
    again = np.zeros(len(starts), bool)
    again[order[1:]] = (ids[order][1:] == ids[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    line_share = np.bincount(line_doc[again], letters_in[again], minlength=n) / np.maximum(total, 1)

    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    failed = (w.counts < 50) | (100 * repeat_words > 50 * w.counts)
    verdict = ~bad & (line_share <= LINE_COVERAGE) & (n_symbols <= SYMBOLS_PER_WORD * w.counts)
    return {"n_words": w.counts, "word_chars": total, "n_symbols": n_symbols, "n_dup_lines": np.bincount(line_doc[again], minlength=n), "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~failed & verdict, "ngram_coverage": coverage, "line_coverage": line_share}


def quality_rules(docs: DataFrame) -> DataFrame:
    """Figures and verdict for each row (doc_id, text).

    One pass without a shuffle, in chunks of bounded size, so neither a hot source nor a long text matters. A null or
    empty text has no words and fails the base rules; a null doc_id stays null; repeated rows each get their row;
    an empty table gives an empty result; further columns are ignored.
    """
    src = narrow(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            found = measure(*utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[k]) if found[k].dtype == bool or found[k].dtype == float else pa.array(found[k].astype(np.int64)) for k, _ in FIELDS]], ["doc_id", *[k for k, _ in FIELDS]])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{k} {t}" for k, t in FIELDS]]))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules() keeps, all columns unchanged; no shuffle.

    A null or empty text goes, as it fails the base rules; ids may be null or repeat, each row is judged by its own text,
    however long; an empty table gives an empty one; further columns, also such as differ only by case, stay.
    """
    place, plain = docs.columns.index("text"), positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, place):
            yield part.filter(pa.array(measure(*utf8(part.column(place)))["kept"]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
