import os

import pytest

import corpus_pipeline
from forage.llm import jaccard_join, novelty, zstd_quality
from tests.llm.test_duplicates import shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark, folder):
    from forage.session import work_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_stages_return_the_columns_of_documents(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * (len(stages) - 1)
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_each_stage_does_its_work(spark, stages):
    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    scored = zstd_quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows[1]) == {r.doc_id for r in scored if r.predicted == 1}
    sets = {k: shingles(r.text) for k, r in rows[2].items()}
    kept = sorted(sets)
    assert not any(4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[:i] if sets[a] and sets[b])
    assert set(rows[2]) == {r.doc_id for r in jaccard_join.digest(stages[1]).collect() if r.doc_id == r.component_id}
    assert not [r for r in __import__("forage.llm.automaton", fromlist=["x"]).contamination(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated]
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    assert not [r for r in novelty.report(stages[4]).collect() if r.n_assign + r.n_access + r.n_hex]
    assert sum(r.taken for r in rows[5].values()) == pytest.approx(sum(r.size for r in rows[5].values()), rel=0.1)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.text, r.taken)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))
