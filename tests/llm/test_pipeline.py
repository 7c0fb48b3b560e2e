"""The five stages on the small table, each against what it promises."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import near_dedup


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(results):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "bpe codec"]
    assert all(r.columns == results[0].columns for r in results[:-1])


def test_filters_only_remove(results):
    rows = [{tuple(r) for r in df.collect()} for df in results[:4]]
    assert rows[1] <= rows[0] and rows[2] <= rows[1] and rows[3] <= rows[2]
    assert len(rows[3]) < len(rows[0])


def test_one_document_of_each_group_stays(results):
    groups = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(results[1], k=5).collect()}
    assert {r.doc_id for r in results[2].select("doc_id").collect()} == set(groups.values())


def test_last_stage_holds_every_text(results):
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in results[4].collect()}
    assert {r.doc_id: r.decoded_sha256 for r in results[5].collect()} == want
    assert results[4].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_run_equals_the_stages(spark, sf, results):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, results[5].collect()))


def test_repeated_rows_and_odd_rows(spark, sf):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", "en", "s", 13), (None, "a b c", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_duplicates(spark, df, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    empty = df.filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
