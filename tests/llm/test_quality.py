import collections
import random
import re
import zlib

import numpy as np
import pytest

from forage.llm import rule_forest, zstd_quality
from tests.llm.conftest import CLASHING


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = collections.Counter(windows)
    covered = {p for k, w in enumerate(windows) if times[w] > 1 for p in (k, k + 1, k + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@pytest.fixture(scope="module")
def corpus(prose):
    """Good prose, shouted prose and prose with symbols; labels for most."""
    docs, labels = [], []
    for k in range(240):
        text, bad = prose(k, 60 + k % 50), k % 4 == 0
        if bad:
            text = " ".join(w + "&&&" for w in text.split()) if k % 8 else " ".join(w.upper() + "!!" for w in text.split())
        docs.append((k, text))
        if k % 10 < 9:
            labels.append((k, 0 if bad else 1, 0))
    return docs, labels


ODD = [(1000, None), (1001, ""), (1002, "a"), (1003, " \n\t"), (1003, " \n\t"), (1004, "x y z " * 40), (None, "line\nline\nother"), (1005, "é#漢 |<> " * 5000)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_quality_and_odd_rows(spark, documents, corpus):
    docs, labels = corpus
    rows = zstd_quality.classify(documents(docs + ODD, CLASHING), labelled(spark, labels)).collect()
    assert len(rows) == len(docs) + len(ODD)
    truth = dict((k, q) for k, q, _ in labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)


def test_labels_that_may_not_be_learnt_change_nothing(spark, documents, corpus):
    docs, labels = corpus
    wrong = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in labels]
    score = lambda given: {r.doc_id: r.score for r in zstd_quality.classify(documents(docs), labelled(spark, given)).collect()}
    assert score(labels) == score(wrong)


def test_without_labels_or_documents(spark, documents, corpus):
    none = labelled(spark, [])
    assert {r.score for r in zstd_quality.classify(documents(corpus[0][:5]), none).collect()} == {0.5}
    assert zstd_quality.classify(documents([]), none).count() == 0
    assert rule_forest.judge(documents([]), none).count() == 0


def test_keep_good_returns_the_columns_of_documents(spark, documents, corpus):
    docs, labels = corpus
    table = documents(docs, ["score", "_row"])
    kept = zstd_quality.keep_good(table, labelled(spark, labels))
    assert kept.columns == table.columns
    rows = kept.collect()
    assert {r.score for r in rows} == {"x"}
    good = {k for k, _ in docs if k % 4}
    assert good - {r.doc_id for r in rows} == set() and len(rows) < len(good) + 6


def test_rule_statistics_equal_brute_force(spark, documents, prose):
    rng = random.Random(9)
    docs = [(k, "".join(rng.choice(["a", "b b", " ", "\n", "#", "é", "c\n", "a b c "]) for _ in range(rng.randrange(80)))) for k in range(60)] + [r for r in ODD if r[0] is not None]
    got = rule_forest.statistics(documents(docs)).select("doc_id", *rule_forest.BASE).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *rule_counts(t)) for k, t in docs)


def test_forest_refuses_junk_and_keeps_clean(spark, documents, corpus):
    docs, labels = corpus
    rows = rule_forest.judge(documents(docs + ODD, CLASHING), labelled(spark, labels)).collect()
    assert len(rows) == len(docs) + len(ODD)
    by_id = {r.doc_id: r for r in rows}
    junk, clean = [by_id[k] for k, _ in docs if k % 4 == 0], [by_id[k] for k, _ in docs if k % 4]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert np.mean([r.kept for r in clean]) > 0.97
    assert np.mean([r.kept for r in junk]) < 0.2


def test_forest_scores_what_is_alone_higher():
    rng = np.random.default_rng(0)
    usual = rng.normal(size=(500, 3))
    forest = rule_forest.Forest.grow(usual, np.array([[-9.0] * 3, [9.0] * 3]))
    scores = forest.scores(np.concatenate([usual, [[8.0, 8.0, 8.0]]]))
    assert scores[-1] > scores[:-1].max()


def test_the_space_of_the_forest_spans_all_rows(documents, prose):
    docs = [(k, prose(k, 60)) for k in range(300)] + [(300, "A" * 70 + " " + prose(1, 60)), (301, "7 " * 3), (302, prose(2, 60) + " ####" * 30)]
    stats = rule_forest.statistics(documents(docs).select("doc_id", "text"))
    rows = stats.toPandas()
    every = rule_forest.ratios({c: rows[c].to_numpy() for c in rule_forest.BASE + rule_forest.MORE})
    low, high = rule_forest.box(stats)
    assert (low == every.min(0)).all() and (high == every.max(0)).all()
    assert rule_forest.box(stats.limit(0)) is None
