"""Operator 4, MinHash near-dedup: banded candidates, sequential Bayesian verification, exact confirmation."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mixed, narrow, release, remove, utf8, written
from .graph import components
from .words import LOWER, Words

#: Bands and rows of the signature. A pair of similarity 0.8 shares no band with probability 5e-5, one of 0.85 with 4e-7.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time.
STEP = 25
#: The chosen probability with which a candidate pair exactly at the threshold is pruned.
MISS = 1e-4
#: Members of a bucket, and shingles of a candidate group, that one task compares; larger ones are cut into blocks.
BLOCK, BLOCK_SHINGLES = 4096, 400_000
#: Bytes of whole groups that a worker holds at a time (a larger group more), and shingles that it compares at a time.
HELD_BYTES, COMPARED = 2 << 20, 100_000
SMALL = 24

_seed = np.random.default_rng(20240)
MULTIPLY = _seed.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _seed.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles of ``size`` words, sorted, text by text, and how many each has.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; fewer words than ``size`` make one shingle, none make none.
    """
    w = Words(LOWER[data], offsets)
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.values.dictionary.to_pylist()), np.uint64, w.n_ids)
    code = known[w.ids]
    with np.errstate(over="ignore"):
        at = w.windows(size)
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = mixed(h + code[at + k])
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):
            g = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                have = w.counts[short] > k
                g[have] = mixed(g[have] + code[w.first[:-1][short[have]] + k])
            h, doc = np.concatenate([h, mixed(g + w.counts[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[new], np.bincount(doc[new], minlength=len(offsets) - 1)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2), 8-bit signature, band keys; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            h, counts = shingle_sets(*utf8(part.column(1)), size)
            full = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[full]
            n = len(counts)
            f = np.zeros((2, n), np.uint64)
            low = np.zeros((n, HASHES), np.uint32)
            if len(full):
                f[0, full], f[1, full] = np.add.reduceat(mixed(h), first), np.add.reduceat(mixed(~h), first)
                x = (h >> np.uint64(32)).astype(np.uint32)
                for k in range(HASHES):
                    low[full, k] = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], first)
            bands = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                bands = mixed(bands + low[:, k::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
            short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            signature = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * HASHES + 1, HASHES, dtype=np.int32)), pa.py_buffer(short.tobytes())])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), signature, keys], ["doc_id", "n_shingles", "f1", "f2", "signature", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, signature binary, bands array<bigint>")


def pruned_at_threshold(least: list[int], percent: int) -> float:
    """The probability that a pair whose similarity is percent/100 falls short of the fewest matches at some step."""
    p = percent / 100 + (1 - percent / 100) / 256
    step = np.array([math.comb(STEP, k) * p**k * (1 - p) ** (STEP - k) for k in range(STEP + 1)])
    alive = np.ones(1)  # by the number of matches so far
    for most in least:
        alive = np.convolve(alive, step)
        alive[:most] = 0
    return 1 - float(alive.sum())


@functools.cache
def least_matches(percent: int) -> list[int]:
    """By steps of STEP compared values: the fewest matches with which the posterior probability that the similarity is at
    least percent/100 exceeds a limit. The prior is uniform; 8-bit values also match by chance.

    The limit is not the miss rate: a pair is looked at several times. The largest limit is taken, by halving, with which
    a pair at the threshold is pruned with probability MISS at most.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    tails = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p + 1e-12)
        weight = np.exp(log - log.max(1, keepdims=True))
        tails.append(weight[:, j >= percent / 100].sum(1) / weight.sum(1))
    limit = MISS
    while True:
        out = [int(np.argmax(tail > limit)) for tail in tails]
        if pruned_at_threshold(out, percent) <= MISS:
            return out
        limit /= 2


def passing(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b; a may be one row) that no comparison step prunes."""
    left = np.arange(len(b))
    seen = np.zeros(len(b), np.int64)
    for k, least in enumerate(least_matches(percent)):
        cols = slice(k * STEP, (k + 1) * STEP)
        seen = seen + ((a[left, cols] if len(a) > 1 or len(b) == 1 else a[:, cols]) == b[left, cols]).sum(1)
        left, seen = left[seen >= least], seen[seen >= least]
    return left


def spread(n: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs of a spanning forest."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def search(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which linked(i, rest) tells with which of ``rest`` node i is linked.

    Breadth first: a node is compared only with nodes that no tree has reached yet, so a group of copies that all
    resemble one takes a single pass.
    """
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            found = linked(i, rest)
            out += [(i, int(x)) for x in rest[found]]
            queue += rest[found].tolist()
            rest = np.delete(rest, found)
    return out


def by_group(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows arrive sorted by their first ``width`` columns; about ``most`` rows or HELD_BYTES at a time."""
    held: list[pa.RecordBatch] = []
    factor = 1
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= factor * most or sum(b.nbytes for b in held) >= factor * HELD_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(k).to_numpy() for k in range(width)]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new):
                yield table.slice(0, int(new[-1]))
                held = pa.Table.from_batches(table.slice(int(new[-1])).to_batches()).combine_chunks().to_batches()
            factor = 1 if len(new) else 2 * factor
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    release()


def bounds(table: pa.Table, width: int) -> np.ndarray:
    keys = [table.column(k).to_numpy() for k in range(width)]
    new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return np.concatenate([[0], new, [table.num_rows]])


def tiled(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Each row for every pair of blocks of its group that it belongs to: ti <= tj. ``blocks``: SQL for their number."""
    mine = rows.withColumn("blocks", F.expr(blocks)).withColumn("mine", F.expr(f"pmod(xxhash64({key}, 1), blocks)"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    return mine.select("*", other).withColumn("ti", F.least("mine", "other")).withColumn("tj", F.greatest("mine", "other")).drop("mine", "other", "blocks")


def forest(spark: SparkSession, members: DataFrame, source: DataFrame, limit: int, compare: Callable[[DataFrame], DataFrame], once: bool = False) -> DataFrame:
    """(a, b): edges that connect all members of a group (group, rep, weight) that ``compare`` links, directly or by way of
    others, of whatever groups. Groups of one are dropped by a count that is summed up before its shuffle.

    ``compare`` gets rows (group, ti, tj, rep, the other columns of ``source``) and gives a spanning forest of the links
    within each tile. ``once``: source is large and each rep in one group alone, so it is read a single time, and what its
    rows of large groups hold is kept in the shared folder for when they meet again. Groups of a weight of up to ``limit`` are one tile. Larger ones are cut into blocks, each row in one of them alone: what resembles
    each other within a block is contracted. Then one row of each such set, and of each group, is compared with the others.
    Only where sets are left that nothing connects, rows meet again: those of all but the heaviest set of a group with
    every block. So a large group of copies travels once, whatever its size; work is quadratic only in what is unlike.
    """
    totals = members.groupBy("group").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).filter("n > 1")
    cut, seen = members.join(totals, "group").withColumn("blocks", F.ceil(F.col("total") / limit).cast("bigint")), Observation()
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks"))
    placed = cut.observe(seen, F.max("blocks").alias("most")).select("group", own.alias("ti"), own.alias("tj"), "rep", "blocks")
    names = ["group", "ti", "tj", *source.columns]

    def joined(tiles: DataFrame, source: DataFrame, *more: str) -> DataFrame:
        return (tiles.hint("merge") if once else tiles).join(source, "rep").select(*names, *more)

    if once:
        held = written(spark, joined(placed, source, "blocks"), "held")
        within = written(spark, compare(held.select(names)), "forest")
        source = held.filter("blocks > 1").select(source.columns)
    else:
        within = written(spark, compare(joined(placed, source)), "forest")
    try:
        most = seen.get["most"]
    except Py4JJavaError:  # adaptive execution found that there are no rows, and left the observation out
        most = None
    if not most or most == 1:
        if once:
            remove(spark, held)
        return within
    large = written(spark, cut.filter("blocks > 1").select("group", "rep", "weight"), "large")

    def marked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The large groups' rows with the set that the edges put them in."""
        roots = components(spark, edges)
        return large.join(roots, F.col("rep") == F.col("node"), "left").select("group", "rep", "weight", F.coalesce("root", "rep").alias("set")), roots

    sets, roots = marked(within)
    ones = sets.groupBy("group", "set").agg(F.min_by("rep", "rep").alias("rep"), F.min_by("weight", "rep").alias("weight"))
    several = ones.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).filter("n > 1")
    tiles = tiled(ones.join(several, "group"), f"cast(ceil(total / {limit}) AS bigint)", "rep").select("group", "ti", "tj", "rep")
    across = written(spark, compare(joined(tiles, source)), "forest")
    remove(spark, roots)
    both = within.unionByName(across)
    sets, roots = marked(both)
    heavy = sets.groupBy("group", "set").agg(F.sum("weight").alias("total")).groupBy("group").agg(F.count("*").alias("n"), F.max_by("set", F.struct("total", "set")).alias("heaviest"), F.max("total").alias("most"), F.sum("total").alias("total"))
    left = sets.join(heavy.filter("n > 1"), "group").withColumn("first", F.ceil(F.col("most") / limit).cast("bigint")).withColumn("second", F.ceil((F.col("total") - F.col("most")) / limit).cast("bigint"))
    main = F.col("set") == F.col("heaviest")
    block = F.when(main, F.pmod(F.xxhash64("rep", F.lit(2)), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("rep", F.lit(2)), F.col("second")))
    others = F.when(main, F.sequence(F.col("first"), F.col("first") + F.col("second") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("first") + F.col("second") - 1))
    met = left.withColumn("mine", block).withColumn("other", F.explode(others)).select("group", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"), "rep")
    rest = written(spark, compare(joined(met, source)), "forest")
    for table in (roots, large, *([held] if once else [])):
        remove(spark, table)
    return both.unionByName(rest)


def candidate_edges(spark: SparkSession, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what shares a bucket and is not pruned by Bayesian verification.

    ``classes``: (rep, signature, bands).
    """
    members = classes.select(F.explode("bands").alias("group"), "rep", F.lit(1).cast("bigint").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 3, 20_000):
            cuts = bounds(table, 3)
            rep = table.column(3).to_numpy()
            sig = utf8(table.column(4))[0].reshape(-1, HASHES)
            sizes = np.diff(cuts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero(sizes[group] <= SMALL)
            pairs: list[tuple[int, int]] = []
            for d in range(1, SMALL):  # all pairs of the small groups, at one distance after another
                i = small[small + d < len(group)]
                i = i[group[i + d] == group[i]]
                if not len(i):
                    break
                for part in np.array_split(i, -(-len(i) // 50_000)):
                    hit = part[passing(sig[part], sig[part + d], percent)]
                    pairs += zip(hit.tolist(), (hit + d).tolist())
            pairs = spread(len(group), pairs)
            for g in np.flatnonzero(sizes > SMALL):
                own = sig[cuts[g] : cuts[g + 1]]
                pairs += [(cuts[g] + a, cuts[g] + b) for a, b in search(len(own), lambda i, rest: passing(own[i : i + 1], own[rest], percent))]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at[:, 0]]), pa.array(rep[at[:, 1]])], ["a", "b"])

    def compare(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.col("group"), F.col("ti"), F.col("tj")).sortWithinPartitions("group", "ti", "tj").mapInArrow(run, "a bigint, b bigint").distinct()

    return forest(spark, members, classes.select("rep", "signature"), BLOCK, compare)


def exact_edges(spark: SparkSession, docs: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): edges that connect the documents of each candidate group whose whole shingle sets are similar enough.

    ``groups``: (root, rep, n_shingles), each rep once. All texts are read and dealt out once, to find those of the groups;
    these travel once to their group, more often only where it has blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 3, 500):
            cuts = bounds(table, 3)
            rep = table.column(3).to_numpy()
            edges: list[tuple[int, int]] = []
            h, counts = shingle_sets(*utf8(table.column(4)), size)
            first = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in zip(cuts, cuts[1:]):
                n = counts[lo:hi]

                def linked(i: int, rest: np.ndarray) -> np.ndarray:
                    own = h[first[lo + i] : first[lo + i + 1]]
                    parts = np.split(np.arange(len(rest)), np.flatnonzero(np.diff(np.cumsum(n[rest]) // COMPARED)) + 1)
                    return np.concatenate([p[alike(i, own, rest[p])] for p in parts])

                def alike(i: int, own: np.ndarray, rest: np.ndarray) -> np.ndarray:
                    each = n[rest]
                    starts = np.cumsum(each) - each
                    at = np.repeat(first[lo + rest] - starts, each) + np.arange(int(each.sum()))
                    other = h[at]
                    place = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                    same = (own[place] == other) if len(own) else np.zeros(len(other), bool)
                    total = np.concatenate([[0], np.cumsum(same)])
                    shared = total[starts + each] - total[starts]
                    return np.flatnonzero((100 * shared >= percent * (n[i] + each - shared)) & (each > 0))

                edges += [(lo + a, lo + b) for a, b in search(hi - lo, linked)]
            at = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at[:, 0]]), pa.array(rep[at[:, 1]])], ["a", "b"])

    def compare(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.col("group"), F.col("ti"), F.col("tj")).sortWithinPartitions("group", "ti", "tj").mapInArrow(run, "a bigint, b bigint")

    members = groups.select(F.col("root").alias("group"), "rep", F.col("n_shingles").alias("weight"))
    return forest(spark, members, docs.select(F.col("doc_id").alias("rep"), "text"), BLOCK_SHINGLES, compare, once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word shingles;
    component_id is the smallest doc_id that links reach, kept tells whether it is the row's own.

    Documents of equal sets (compared by 128-bit fingerprints) are one class, so thousands of copies cost one
    candidate. Classes that share a band of the signature are candidates; within a bucket they are verified on growing
    parts of their signatures and only a spanning forest of those that remain is emitted. Its components are then
    confirmed on the full sets, again as forests. Large buckets and groups are cut into blocks and contracted (see
    forest()), so no task gathers an unbounded group and no group's pairs are emitted; beyond MISS for a pair at the
    threshold nothing is lost.

    Rows without words have an empty set, are linked with nothing and kept. Rows that share a doc_id count as one
    document with several texts. A null doc_id is linked with nothing: component_id null, kept true; others must be whole
    numbers, or texts of such. Long texts are read whole. An empty table gives an empty result; further columns, whatever
    their names, are ignored.
    """
    src = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketch = written(spark, sketches(src, size), "sketches")
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(spark, usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")), "classes")
    groups = components(spark, candidate_edges(spark, classes, percent))
    rooted = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = written(spark, classes.select("rep", "n_shingles").join(rooted, F.col("rep") == F.col("node")).select("root", "rep", "n_shingles"), "members")
    remove(spark, groups)
    edges = exact_edges(spark, src, members.groupBy("root", "rep").agg(F.sum("n_shingles").alias("n_shingles")), size, percent)
    again = usable.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    reused = usable.join(again, "doc_id").join(classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(spark, edges.unionByName(reused))
    remove(spark, members)
    final = classes.select("f1", "f2", "n_shingles", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n_shingles", F.coalesce("root", "rep").alias("class_root"))
    out = sketch.select("doc_id", "n_shingles", "f1", "f2").join(final, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, all columns unchanged: one document of each group.

    Of rows that share a doc_id, that of the smallest text stays; rows without a doc_id all stay.
    """
    gone = near_duplicates(spark, docs, size, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"_c{docs.columns.index('text')}"), F.lit(""))
    plain = plain.withColumn("_key", plain[f"_c{docs.columns.index('doc_id')}"].cast("bigint"))
    kept = plain.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    again = written(spark, plain.filter("_key IS NOT NULL").groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_again")), "repeated")
    if again.head(1):
        whole = F.struct(*kept.columns)
        one = kept.join(again, F.col("_key") == F.col("_again"), "left_semi").groupBy("_key").agg(F.min_by(whole, text).alias("_row")).select("_row.*")
        kept = kept.join(again, F.col("_key") == F.col("_again"), "left_anti").unionByName(one)
    return kept.drop("_key").toDF(*docs.columns)
