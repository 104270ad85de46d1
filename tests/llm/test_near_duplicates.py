"""Operators 1 and 4 and components: brute force and odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import minhash, vectors
from tablekit.llm.graph import components

from ..conftest import SF, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union_find(ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(a, b):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)

    return top, join


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    r = random.Random(1)
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(0, k) for k in range(1, 60)], "random": [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(5, 5), (None, 1)], "empty": []}[shape]
    r.shuffle(edges)
    top, join = union_find(range(100))
    for a, b in edges:
        if a is not None:
            join(a, b)
    got = dict(components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {x: top(x) for x in range(100) if top(x) != x}


def brute_documents(data, size, percent):
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        s = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
        sets.setdefault(i, []).append(s)
    top, join = union_find([i for i in sets if i is not None])
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                join(a, b)
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, all_ in sets.items() for s in all_), key=repr)


def near_copies(seed=1):
    """Groups of edits of edits, exact copies, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    data = []
    for _ in range(12):
        text = [word() for _ in range(r.choice([4, 30, 120]))]
        for _ in range(r.choice([1, 3, 8, 40])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = word()
            data.append(" ".join(copy))
            if r.random() < 0.3:
                text = copy
    ids = list(range(len(data)))
    r.shuffle(ids)
    return [*zip(ids, data), (900, None), (901, ""), (902, "two words"), (903, "Two WORDS "), (904, "one"), (None, "two words"), (905, data[0]), (905, "another text of the same id altogether here"), (906, "another text of the same id altogether here"), (907, "x " * 30_000)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_documents(spark, size, percent):
    data = near_copies()
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in data], "text string, doc_id bigint, kept int, rep string")
    assert rows(minhash.near_duplicates(spark, df, size, percent)) == brute_documents(data, size, percent)
    kept = minhash.keep_one(spark, df, size, percent)
    stay = {i for i, *_, k in brute_documents(data, size, percent) if k}
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(stay, key=repr)  # one row of each


def test_blocks(spark, monkeypatch):
    """Buckets and groups that are cut into pairs of blocks give the same result."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(minhash, "SMALL", 3)
    data = near_copies(2)
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(minhash.near_duplicates(spark, df, 3, 85)) == brute_documents(data, 3, 85)


def test_large_groups_read_the_texts_once(spark, monkeypatch, tmp_path):
    """Whatever the blocks, all texts are read for their sketches and once for the confirmation; before, three times for it."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    data, seen, names, written = near_copies(2), tmp_path / "seen", [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda spark, df, name: [names.append(name), written(spark, df, name)][1])

    def noted(batches):
        with seen.open("a") as f:
            f.write("read\n")
        yield from batches

    df = spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1).mapInArrow(noted, "doc_id bigint, text string")
    assert rows(minhash.near_duplicates(spark, df, 3, 85)) == brute_documents(data, 3, 85)
    assert seen.read_text().split() == ["read"] * 2 and "large" in names


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(spark, df).count() == 0 and minhash.keep_one(spark, df).count() == 0


def test_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(minhash.near_duplicates(spark, df, 3, 85)) == brute_documents(data, 3, 85)


def test_pruning_keeps_pairs_at_the_threshold():
    r = np.random.default_rng(1)
    n, kept = 4000, 0
    a = r.integers(0, 256, (n, minhash.HASHES)).astype(np.uint8)
    b = np.where(r.random(a.shape) < 0.85, a, r.integers(0, 256, a.shape).astype(np.uint8))
    kept = len(minhash.passing(a, b, 85))
    far = np.where(r.random(a.shape) < 0.4, a, r.integers(0, 256, a.shape).astype(np.uint8))
    assert kept / n > 0.999 and len(minhash.passing(a, far, 85)) == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_miss_rate(percent):
    """The chosen miss probability holds for pairs at the threshold, as computed and as simulated."""
    least = minhash.least_matches(percent)
    assert minhash.pruned_at_threshold(least, percent) <= minhash.MISS
    r, n, missed = np.random.default_rng(2), 40_000, 0
    for _ in range(10):
        same = r.random((n, minhash.HASHES)) < percent / 100
        a = r.integers(0, 256, same.shape).astype(np.uint8)
        missed += n - len(minhash.passing(a, np.where(same, a, r.integers(0, 256, same.shape).astype(np.uint8)), percent))
    assert missed / (10 * n) < 2 * minhash.MISS


def brute_vectors(data, threshold=0.98):
    good = []
    for k, (i, v, label) in enumerate(data):
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(np.float32(v)) > 0:
            good.append((k, i, np.float32(v).astype(float), label))
    top, join = union_find({i for i, _, _ in data if i is not None})
    links = [0] * len(data)
    for k, i, v, label in good:
        for m, j, w, other in good:
            if k != m and label == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[k] += 1
                join(i, j)
    return sorted(((i, links[k], None if i is None else top(i), i is None or top(i) == i) for k, (i, _, _) in enumerate(data)), key=repr)


def some_vectors(seed=1):
    r = np.random.default_rng(seed)
    data, k = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = r.standard_normal(16)
            for _ in range(int(r.choice([1, 1, 2, 12]))):
                data.append((k * 7919 % 1009, (base + r.standard_normal(16) * r.choice([0.0, 0.02, 0.05])).astype(np.float32).tolist(), label))
                k += 1
    v = data[0][1]
    return [*data, (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [*v[:-1], None], 1), (2004, [*v[:-1], float("nan")], 1), (2005, [*v[:-1], float("inf")], 1), (2006, v, None), (2007, v, None), (2008, v[:8], 1), (2009, v[:8], 1), (None, v, 1), (2010, v, 1), (2010, v, 2), (2011, [2 * x for x in v], 2)]


@pytest.mark.parametrize("cell", [2048, 6])
def test_vectors(spark, monkeypatch, cell):
    """In one cell, and in many that are cut into blocks."""
    monkeypatch.setattr(vectors, "CELL", cell)
    data = some_vectors()
    df = spark.createDataFrame([(v, i, label, "x") for i, v, label in data], "embedding array<float>, vec_id bigint, label int, rep string")
    assert rows(vectors.near_duplicates(spark, df)) == brute_vectors(data)


def test_doubles(spark):
    """Doubles stay doubles: large and small ones, and such as differ by less than a float holds."""
    big, near, far = [1e39, 0.0], *([c, (1 - c * c) ** 0.5] for c in (0.98 + 1e-9, 0.98 - 1e-9))
    data = [(1, big, 1), (2, [1.0, 0.0], 1), (3, [5e-320, 0.0], 1), (4, [1e300, 1e300], 1), (5, [2.0, 2.0 + 1e-12], 1), (6, [1.0, 1e-12], 1), (7, near, 1), (8, far, 1), (9, [1e308, float("inf")], 1), (10, [0.0, -0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark, spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got[9] == (0, 9) and got[10] == (0, 10) and got[4] == got[5] == (1, 4)
    assert [got[k] for k in (1, 2, 3, 6)] == [(4, 1)] * 4 and got[7] == (5, 1) and got[8] == (1, 1)  # 8 is linked with 7 alone


def test_the_count_decides():
    """Window collisions are what brute force counts, and few pairs but the linked ones have enough."""
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 64))
    x[750:] = x[:750] + 0.1 * r.standard_normal((750, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x @ vectors.directions(64)[:, : vectors.COUNTED]
    width = vectors.WINDOW * (2 - 2 * 0.98) ** 0.5
    count = vectors.collisions(p, p, width)
    assert (count[::50] == (np.abs(p[::50, None, :] - p[None]) <= width).sum(2)).all()
    linked, candidate = x @ x.T >= 0.98, count >= vectors.least_collisions()
    assert candidate[linked].all() and candidate.sum() < 0.01 * candidate.size and linked.sum() > 1500


def test_recall(spark):
    """Every row whose id is divisible by 50 against all rows of the larger table."""
    rows_ = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    data = rows_.collect()
    x, label = np.array([r.embedding for r in data], np.float32).astype(float), np.array([r.label for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark, rows_).collect()}
    for k, r in enumerate(data):
        if r.vec_id % 50 == 0:
            assert got[r.vec_id] == int(((x @ x[k] >= 0.98) & (label == r.label)).sum()) - 1


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark, spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_vector_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert rows(vectors.near_duplicates(spark, df)) == brute_vectors(data)


def test_calibration():
    """The count that a pair at the threshold reaches all but MISS of the time."""
    t = vectors.least_collisions()
    r = np.random.default_rng(1)
    hits = (np.abs(r.standard_normal((200_000, vectors.COUNTED))) <= vectors.WINDOW).sum(1)
    assert (hits < t).mean() < 1e-4 and t > vectors.COUNTED * 0.6


def test_queries_have_the_columns(spark):
    from tablekit.llm import queries

    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert F is not None and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
