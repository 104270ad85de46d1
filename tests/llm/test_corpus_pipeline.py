"""Each stage of the pipeline against brute force on its own input, and odd rows through all of it."""

import functools
import importlib.util
import math
import re

import pytest
from pyspark.sql import functions as F

from tablekit.llm import toxicity

from ..conftest import SF, rows
from .test_near_duplicates import brute_documents
from .test_text_operators import brute_lines, brute_quality

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of each stage, written and read again."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "quality_rules", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def brute_score(model, words_in, text):
    """A text's score token by token, and run by run of single characters."""
    found, run = {}, []
    for token in [*re.findall(r"[^\x20\x09-\x0D]+", text or ""), "end of text"]:
        if len(token) == 1 and (token.isalnum() or token in toxicity.LEET):
            run.append(token)
        else:
            if len(run) > 2:
                found.update(words_in(" ".join(run)))
            run = []
        if token != "end of text":
            found.update(words_in(token))
    return 1 - (1 - model.base) * math.prod(1 - p for p in found.values())


def test_toxicity(spark):
    """On the larger table, whose labels are enough to learn from."""
    import corpus_pipeline

    folder = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.civil(spark, docs, folder).select("doc_id").collect()}
    words_in, n = functools.cache(model.words_in), 0
    for r in docs.select("doc_id", "text").collect():
        assert (brute_score(model, words_in, r.text) < 0.7) == (r.doc_id in kept), r.doc_id
        n += 1
    assert model.evidence and 0.9 * n < len(kept) < n


def test_quality(stages):
    _, before, after = stages[1]
    text = before.columns.index("text")
    assert rows(after) == [r for r in rows(before) if brute_quality(r[text] or "")[2]] and after.count() < before.count()


def test_lines_and_copies(stages):
    _, before, after = stages[2]
    data = rows(before)
    at = before.columns.index("text")
    kept = brute_lines([r[at] for r in data], 10)
    wanted = {r[0]: "\n".join(k) for r, k in zip(data, kept)}
    assert {r.doc_id: r.text for r in after.collect()} == wanted
    assert after.filter(F.char_length("text") != F.col("n_chars")).count() == before.filter(F.char_length("text") != F.col("n_chars")).count()
    _, before, after = stages[3]
    data = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, _, _, k in brute_documents(data, 5, 80) if k}


def test_packing(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    ends = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in ends) and len(ends) <= -(-sum(r.n for r in ends) // 1024) + 1


def test_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = " ".join(f"w{k}" for k in range(80))
    data = [(1, good, "en", "s", 9, 1), (None, good, None, None, None, 2), (2, None, "en", "s", None, 3), (3, "", "en", "s", 0, 4), (4, good + " more words", "en", None, 1, 5), (4, good + " more words", "en", None, 1, 5)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_dropped int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}, key=repr) == [1, None]
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark, tmp_path):
    """Every stage takes columns that differ only by case, and all but the last give them back."""
    import corpus_pipeline

    good = " ".join(f"w{k}" for k in range(80))
    data = [(k, None if k == 3 else f"{good} {k}\nsame line", "en", None, k) for k in range(12)] + [(None, "", None, None, None)]
    docs = spark.createDataFrame(data, "a bigint, b string, c string, d string, e bigint").toDF("doc_id", "text", "Text", "DOC_ID", "n_chars")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= 13
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == 13
