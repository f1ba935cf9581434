"""The pipeline's stages one after the other, and every query against its SQL."""

import pytest
from compare import differences, duck
from conftest import MEDIUM

import corpus_pipeline
from holdfast.llm.near_dup import near_duplicates
from holdfast.llm.queries import LLM_ORACLE, LLM_QUERIES
from holdfast.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], MEDIUM)))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[-1].columns == [*stages[0].columns, "copy"]


def test_each_stage_takes_effect(spark, stages):
    raw, good, single, clean, safe, mixed = stages
    ids = [set(r.doc_id for r in s.select("doc_id").collect()) for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    kept = good.join(labels, "doc_id").where("quality = 0").count()
    assert kept < 0.1 * labels.where("quality = 0").count()
    known = near_duplicates(good)
    assert single.count() == known.select("class_id").distinct().count()
    assert ids[2] == {r.class_id for r in known.collect()}
    items = [r.text for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in single.collect() if any(t in r.text for t in items)}
    assert leaking and ids[2] - ids[3] == leaking
    assert ids[3] == ids[4]
    assert safe.where(r"text rlike '[0-9a-f]{16}'").count() == 0
    assert clean.where(r"text rlike '[0-9a-f]{16}'").count() > 0
    assert safe.where("n_chars != length(text)").count() == 0
    assert mixed.count() > 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, MEDIUM)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_stages_take_an_empty_table(spark, stages):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), MEDIUM).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(LLM_QUERIES[name](spark, MEDIUM), duck(MEDIUM), LLM_ORACLE[name]) == []


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 11))
