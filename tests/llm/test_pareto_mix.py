import collections
import re

import pytest
from pyspark.sql import functions as F

from forage.llm import pareto_mix
from tests.llm.conftest import CLASHING


def wanted_targets(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.fixture(scope="module")
def mixed(documents, prose):
    docs = [(k, prose(k, 1 + (k * 37) % 300), "en", ["b", "a", "é", "Z", None, "tiny"][0 if k < 300 else k % 6]) for k in range(900)]
    docs += [(2000, None, "en", "empty"), (2001, "", "en", "empty"), (2002, " \n", "en", "a"), (None, "one two three", "en", "a"), (5, docs[5][1], "en", "b"), (5, docs[5][1], "en", "b")]
    return docs, rows_of(pareto_mix.mix(documents(docs, CLASHING)))


def test_sizes_and_targets(mixed):
    docs, rows = mixed
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d[0]), len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))) for d in docs)
    sizes = collections.Counter()
    for d in docs:
        sizes[d[3]] += len((d[1] or "").split())
    want = wanted_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])


def test_taken_words_come_near_targets_in_whole_copies(mixed):
    _, rows = mixed
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert all(r[c] == "x" for c in CLASHING if c not in ("size", "target", "taken", "source_size", "copies"))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= largest[source] / 2 + 1


def test_reruns_and_partitions_agree(documents, mixed):
    docs, rows = mixed
    again = rows_of(pareto_mix.mix(documents(docs[::-1], CLASHING).repartition(7)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_few_bins_choose_the_same_documents(documents, mixed, monkeypatch):
    docs, rows = mixed
    monkeypatch.setattr(pareto_mix, "BINS", 4)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows_of(pareto_mix.mix(documents(docs))))) == sorted(map(key, rows))


def test_empty_table_and_no_words(documents):
    assert pareto_mix.digest(documents([])).count() == 0
    rows = pareto_mix.digest(documents([(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_plan_has_no_python(documents):
    plan = pareto_mix.digest(documents([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_more_odds_are_taken_more_often(spark, documents, prose):
    docs = documents([(k, prose(k, 20 if k % 2 else 160), "en", "a") for k in range(2000)] + [(9999, prose(1, 40000), "en", "b")])
    found = pareto_mix.mix(docs).filter("source = 'a'").groupBy((F.col("size") > 100).alias("long")).agg(F.avg("copies").alias("copies")).collect()
    share = {r.long: r.copies for r in found}
    assert share[True] > share[False]
