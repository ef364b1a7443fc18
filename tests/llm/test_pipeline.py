"""The pipeline's stages against plain versions of themselves, and the rows they keep."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plain_stages import decontaminated, first_of_groups, packed, winnowed
from torquelog.llm import common


@pytest.fixture(scope="module")
def stages(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], directory), "test_stage"))
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_order_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0] == "quality_classifier" and names[-1] == "best_fit_packing"
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_quality_keeps_the_clean_and_drops_low_grades(spark, directory, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    clean = [k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    junk = [k for k, r in labels.items() if r["quality"] == 0]
    assert sum(k in after for k in clean) >= 0.95 * len(clean)
    assert sum(k in after for k in junk) <= 0.2 * len(junk)


def test_lines(stages):
    assert texts(stages[2]) == winnowed(texts(stages[1]))


def test_near_duplicates(stages):
    before = texts(stages[2])
    assert texts(stages[3]) == {k: before[k] for k in first_of_groups(before)}


def test_benchmark(spark, directory, stages):
    items = [r["text"] for r in spark.read.parquet(f"{directory}/benchmark.parquet").collect()]
    assert texts(stages[4]) == decontaminated(texts(stages[3]), items)


def test_packing(stages):
    assert sorted(tuple(r)[:5] for r in stages[5].collect()) == packed(texts(stages[4]))


def test_run_applies_all_stages(spark, directory, stages):
    pick = lambda frame: sorted(tuple(r)[:5] for r in frame.collect())
    assert pick(corpus_pipeline.run(spark, directory)) == pick(stages[5])
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, directory, k):
    none = spark.read.parquet(f"{directory}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, none, directory).count() == 0
