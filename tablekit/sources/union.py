"""One table over many files of equal columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from .paths import FileFilter, FileInfo, read_text, walk


@dataclass(frozen=True)
class Descriptor:
    """A .union file: directory, pattern (a regular expression for file names), max_depth and sort (asc, desc, none)."""

    directory: str
    pattern: str
    max_depth: int = 2
    sort: str = "none"

    @classmethod
    def parse(cls, text: str, base: str = "") -> Descriptor:
        found = {}
        for line in text.splitlines():
            m = re.match(r"\s*([\w-]+)\s*[=:]\s*(.*?)\s*$", line)
            if m and not line.lstrip().startswith("#"):
                found[m[1].lower().replace("-", "_")] = m[2]
        if "directory" not in found or "pattern" not in found:
            raise EngineError("INVALID_OPERATION", "a union needs directory and pattern")
        directory = found["directory"]
        if base and not re.match(r"[a-z]+:|/", directory):
            directory = f"{base}/{directory}"
        return cls(directory, found["pattern"], int(found.get("max_depth", 2)), found.get("sort", "none").lower())


def files(spark: SparkSession, d: Descriptor, keep: FileFilter = lambda f: True) -> list[FileInfo]:
    """The files of a union; those that ``keep`` rejects, say by a date in their path, are never opened."""
    found = [f for f in walk(spark, d.directory, d.max_depth) if re.fullmatch(d.pattern, f.name) and keep(f)]
    return sorted(found, key=lambda f: f.name, reverse=d.sort == "desc") if d.sort in ("asc", "desc") else found


def union_all(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows; names and number of columns must be those of the first source."""
    if not sources:
        raise EngineError("TABLE_NOT_FOUND", "the union has no files")
    names = [c.lower() for c in sources[0].columns]
    out = sources[0]
    for s in sources[1:]:
        if [c.lower() for c in s.columns] != names:
            raise EngineError("COLUMN_MISMATCH", f"{s.columns} are not {names}")
        out = out.union(s)
    return out


def read(spark: SparkSession, d: Descriptor, open_one: Callable[[str], DataFrame], keep: FileFilter = lambda f: True, ordered: bool = False, likeness: Callable[[str], tuple | None] | None = None, open_alike: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """The rows of all files, read in parallel; ``ordered`` gives them file by file, rows in their files' order.

    ``likeness`` looks at a file's head: files of equal likeness, which starts with the column names, are read by
    ``open_alike`` as one, so many files make one scan; those it gives None for are opened one by one.
    """
    found = files(spark, d, keep)
    if not ordered and likeness and open_alike:
        with ThreadPoolExecutor(16) as pool:
            kinds = list(pool.map(lambda f: likeness(f.path), found))
        alike: dict[tuple, list[str]] = {}
        for f, kind in zip(found, kinds):
            alike.setdefault(kind or (None, f.path), []).append(f.path)
        return union_all([open_one(paths[0]) if kind[0] is None else open_alike(paths) for kind, paths in alike.items()])
    sources = [open_one(f.path) for f in found]
    if not ordered:
        return union_all(sources)
    union_all(sources)
    numbered = [s.withColumn("_source", F.lit(k)).withColumn("_row", F.monotonically_increasing_id()) for k, s in enumerate(sources)]
    return union_all(numbered).orderBy("_source", "_row").drop("_source", "_row")


def descriptor(spark: SparkSession, path: str) -> Descriptor:
    return Descriptor.parse(read_text(spark, path), path.rpartition("/")[0])
