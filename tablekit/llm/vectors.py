"""Operator 1, embedding near-dedup: collision counting on one-dimensional projections."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow, remove, utf8, written
from .graph import components
from .minhash import bounds, by_group

#: Projections whose collisions are counted, and half the width of their windows, in standard deviations of the
#: difference of two vectors at the threshold.
COUNTED, WINDOW = 24, 2.5
#: The share of pairs at the threshold that may have fewer collisions than a candidate must.
MISS = 1e-6
#: Projections that deal vectors to cells, and half the width of the windows in which a query also visits the other
#: side of a split: a pair at the threshold is missed with probability 7e-6 for each split.
ROUTES, VISIT = 16, 4.5
#: Vectors for which a cell is meant; larger cells are cut into blocks of so many.
CELL = 2048
#: Queries that are compared at a time.
QUERIES = 256


@functools.cache
def directions(dim: int) -> np.ndarray:
    """Fixed Gaussian directions: COUNTED for counting, then ROUTES for dealing."""
    return np.random.default_rng([7, dim]).standard_normal((dim, COUNTED + ROUTES))


@functools.cache
def least_collisions(miss: float = MISS) -> int:
    """The largest count that pairs at the threshold fall short of with probability ``miss`` at most.

    For fixed vectors and Gaussian directions the projections' differences are independent and normal, so a pair at the
    threshold collides in each window with the same probability and its count is binomial.
    """
    p = math.erf(WINDOW / math.sqrt(2))
    below = 0.0
    for t in range(COUNTED + 1):
        below += math.comb(COUNTED, t) * p**t * (1 - p) ** (COUNTED - t)
        if below > miss:
            return t
    return COUNTED


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors (rows) of a column of bytes: of ``dim`` floats or doubles each, as doubles."""
    raw, offsets = utf8(column)
    return raw.view("<f4" if offsets[1] == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to between 1/2 and 1: exact, and so that
    neither products nor norms overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def prepared(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, dim (null: linked with nothing), a fingerprint (f1, f2) of label and vector, and its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, f1, f2, raw = [], [], [], []
            for x, label in zip(batch.column(1), batch.column(2).to_pylist()):
                v = None
                if label is not None and x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy().astype(kind) + np.zeros(1, kind)  # -0 is 0
                    v = v if np.isfinite(v).all() and v.any() else None
                if v is None:
                    for out in (dim, f1, f2, raw):
                        out.append(None)
                else:
                    digest = np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16, key=str(label).encode()).digest(), "<i8")
                    dim.append(len(v)), f1.append(int(digest[0])), f2.append(int(digest[1])), raw.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dim, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "label", "dim", "f1", "f2", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, dim int, f1 bigint, f2 bigint, vector binary")


def projected(batch: pa.RecordBatch, vector: int, dim: int) -> np.ndarray:
    x = scaled(matrix(batch.column(vector), dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions(dim)


def routes(classes: DataFrame) -> DataFrame:
    """``classes`` with the routing projections as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            out = np.zeros((batch.num_rows, ROUTES))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = projected(batch.take(pa.array(at)), 3, int(d))[:, COUNTED:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, ROUTES, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["rep", "label", "dim", "vector", "copies", "route"])

    return classes.select("rep", "label", "dim", "vector", "copies").mapInArrow(run, "rep bigint, label bigint, dim int, vector binary, copies bigint, route array<double>")


def placed(rows: DataFrame, spread: float) -> DataFrame:
    """Each vector once as data in its cell and as a query in every cell that its windows touch.

    A cell is a side of the median for each of the label's first ``levels`` routing projections.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column(6).to_numpy()
            route, middle = [np.asarray(batch.column(k).values).reshape(-1, ROUTES) for k in (5, 7)]
            side = route > middle
            near = np.abs(route - middle) <= VISIT * spread
            at, cell, data = [np.arange(batch.num_rows)], [np.zeros(batch.num_rows, np.int64)], [np.ones(batch.num_rows, bool)]
            home = sum(np.where(levels > k, side[:, k].astype(np.int64) << k, 0) for k in range(ROUTES))
            row, code = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k in range(ROUTES):
                live = levels[row] > k
                both = live & near[row, k]
                code = np.concatenate([code | np.where(live & side[row, k], 1 << k, 0), (code | np.where(side[row, k], 0, 1 << k))[both]])
                row = np.concatenate([row, row[both]])
            at, cell = np.concatenate([at[0], row]), np.concatenate([home, code])
            data = np.append(data[0], np.zeros(len(row), bool))
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns[:5], pa.array(cell), pa.array(data)], ["rep", "label", "dim", "vector", "copies", "cell", "data"])

    return rows.mapInArrow(run, "rep bigint, label bigint, dim int, vector binary, copies bigint, cell bigint, data boolean")


def collisions(queries: np.ndarray, data: np.ndarray, width: float) -> np.ndarray:
    """For each pair of a query and a data vector (rows of projections) in how many of the sorted projections the vector
    lies in the window that is centred on the query: its rank is one of the window's."""
    count = np.zeros((len(queries), len(data)), np.uint8)
    rank = np.empty(len(data), np.int32)
    for c in range(queries.shape[1]):
        order = np.argsort(data[:, c], kind="stable")
        rank[order] = np.arange(len(data))
        first = np.searchsorted(data[order, c], queries[:, c] - width).astype(np.int32)
        last = np.searchsorted(data[order, c], queries[:, c] + width, "right").astype(np.int32)
        count += (rank - first[:, None]).view(np.uint32) < (last - first).view(np.uint32)[:, None]
    return count


def compared(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Of one tile (queries and data of a cell): how many vectors each query is linked with, and edges (a, b) that
    hang linked vectors on the smallest id that they reach within the tile."""
    dim = table.column(2)[0].as_py()
    is_data = table.column("data").to_numpy()
    x = matrix(table.column("vector"), dim)
    unit = scaled(x)
    norm = np.linalg.norm(unit, axis=1)
    p = (unit / norm[:, None]) @ directions(dim)[:, :COUNTED]
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    d, q = np.flatnonzero(is_data), np.flatnonzero(~is_data)
    links, pairs = np.zeros(len(rep), np.int64), []
    for k in range(0, len(q), QUERIES):
        own = q[k : k + QUERIES]
        a, b = np.nonzero(collisions(p[own], p[d], WINDOW * math.sqrt(2 - 2 * threshold) + 1e-6) >= least_collisions())
        for part in range(0, len(a), 200_000):
            i, o = own[a[part : part + 200_000]], d[b[part : part + 200_000]]
            hit = (np.einsum("ij,ij->i", unit[i], unit[o]) / (norm[i] * norm[o]) >= threshold) & ~((rep[i] == rep[o]) & (x[i] == x[o]).all(1))
            i, o = i[hit], o[hit]
            links += np.bincount(i, copies[o], minlength=len(rep)).astype(np.int64)
            pairs.append((i, o))
    i, o = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    root = rep.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[o])
        np.minimum.at(root, o, root[i])
        if (root == before).all():
            break
    tied = np.flatnonzero(root != rep)
    n = len(q)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[q], rep[tied]])), pa.array(np.concatenate([root[q], root[tied]]), mask=np.arange(n + len(tied)) < n), table.column(1).take(pa.array(np.concatenate([q, tied]))).combine_chunks(), pa.array(np.concatenate([links[q], np.zeros(len(tied), np.int64)])), table.column("vector").take(pa.array(np.concatenate([q, tied]))).combine_chunks()], ["a", "b", "label", "links", "vector"])


def near_duplicates(spark: SparkSession, rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row (vec_id, embedding, label).

    Vectors of equal label, not null, are linked if their cosine in double precision is at least ``threshold``; n_links
    counts the other rows linked directly, component_id is the smallest vec_id that links reach.

    Equal vectors of a label are one class with a number of copies. Each label is cut into cells at the medians of
    routing projections, as many as its size asks for; a class is data in its own cell and a query in every cell that
    its window around each split touches. Within a cell, cut into blocks where it is large, all projections are sorted,
    each query's window collisions are counted per pair, and pairs are verified with a count that all but MISS of the pairs
    at the threshold reach. Tiles emit a number for each query and edges of stars, never
    pairs. Cells keep the work for large labels below all pairs; a dense group's links are counted in its tiles.

    Components are floats or doubles as the column has them. Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, have no
    links; vectors of different lengths are not compared. Rows that share a vec_id count as one vector with several
    positions. A null vec_id is linked with nothing, its component_id null, and kept. An empty table gives an empty
    result; further columns are ignored.
    """
    src = narrow(rows, "vec_id", "embedding", "label")
    kind = "float" if isinstance(src.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    src = src.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{kind}>"), F.col("label").cast("bigint"))
    table = written(spark, prepared(src, "<f4" if kind == "float" else "<f8"), "vectors")
    classes = written(spark, table.filter("dim IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "dim", "f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")), "classes")
    routed = routes(classes)
    medians = F.array(*[F.percentile_approx(F.col("route")[k], 0.5, 2000) for k in range(ROUTES)])
    stats = routed.groupBy("label", "dim").agg(F.count("*").alias("n"), medians.alias("middle")).select("label", "dim", F.expr(f"cast(least({ROUTES}, greatest(0, ceil(log2(n / {CELL})))) AS int)").alias("levels"), "middle")
    in_cells = placed(routed.join(stats, ["label", "dim"]).select("rep", "label", "dim", "vector", "copies", "route", "levels", "middle"), math.sqrt(2 - 2 * threshold))
    in_cells = written(spark, in_cells, "cells")
    sizes = in_cells.groupBy("label", "dim", "cell").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / CELL)).cast("bigint").alias(n) for n, c in (("of_data", F.col("data")), ("of_queries", ~F.col("data")))])
    here = F.pmod(F.xxhash64("rep", "vector"), F.when(F.col("data"), F.col("of_data")).otherwise(F.col("of_queries")))
    there = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("data"), F.col("of_queries")).otherwise(F.col("of_data")) - 1))
    tiles = in_cells.join(sizes, ["label", "dim", "cell"]).withColumn("here", here).withColumn("there", there)
    tiles = tiles.withColumn("td", F.when(F.col("data"), F.col("here")).otherwise(F.col("there"))).withColumn("tq", F.when(F.col("data"), F.col("there")).otherwise(F.col("here")))
    keys = ["cell", "label", "dim", "td", "tq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, 5, 2 * CELL):
            cuts = bounds(whole, 5)
            for lo, hi in zip(cuts, cuts[1:]):
                part = whole.slice(lo, hi - lo)
                yield compared(part.select(["cell", "label", "dim", "td", "tq", "rep", "vector", "copies", "data"]), threshold)

    found = tiles.select(*keys, "rep", "vector", "copies", "data").repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint, label bigint, links bigint, vector binary")
    found = written(spark, found, "links")
    remove(spark, in_cells)
    links = found.filter("b IS NULL").groupBy("a", "label", "vector").agg(F.sum("links").alias("links"))
    again = table.filter("vec_id IS NOT NULL").groupBy("vec_id").count().filter("count > 1").select("vec_id")
    reused = table.join(again, "vec_id").join(classes.select("label", "dim", "f1", "f2", "rep"), ["label", "dim", "f1", "f2"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    roots = components(spark, found.filter("b IS NOT NULL").select("a", "b").unionByName(reused))
    final = classes.join(links, (classes["rep"] == links["a"]) & (classes["label"] == links["label"]) & (classes["vector"] == links["vector"]), "left").select(classes["label"], "dim", "f1", "f2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    final = final.join(roots, F.col("rep") == F.col("node"), "left").select("label", "dim", "f1", "f2", "links", F.coalesce("root", "rep").alias("class_root"))
    out = table.select("vec_id", "label", "dim", "f1", "f2").join(final, ["label", "dim", "f1", "f2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("class_root", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
