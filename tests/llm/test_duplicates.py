import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forage.llm import compact_windows, jaccard_join
from forage.llm.components import components
from tests.llm.conftest import CLASHING

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    sets = [(k, shingles(t)) for k, t in docs]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted((str(k), len(s), str(least.get(top(i)))) for i, (k, s) in enumerate(sets))


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def docs(prose):
    rng = random.Random(4)
    passage = prose(999, 60)
    rows = [(k, prose(k, 20 + k % 90)) for k in range(60)]
    rows += [(100 + k, f"{prose(200 + k, 30)} {passage} {prose(300 + k, 30)}") for k in range(45)]
    root = prose(77, 120)
    rows += [(200 + k, edited(rng, root, 0.03)) for k in range(60)]
    rows += [(300 + k, root.upper() if k % 2 else root) for k in range(30)]
    chain = words_of(prose(55, 100))
    rows += [(400 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(10)]
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One  TWO"), (504, "two one"), (505, "a b c d e"), (506, "a b c d e e"), (507, "das " * 400), (508, "das " * 90), (None, root), (None, "alone here now"), (3, prose(3, 23)), (3, "other text of the same id")]
    rng.shuffle(rows)
    return rows


def joined(documents, docs, **options):
    rows = jaccard_join.join(documents(docs, CLASHING), **options).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def test_join_equals_brute_force(documents, docs):
    assert joined(documents, docs) == brute_components(docs)


def test_pivots_windows_and_blocks_give_the_same(documents, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "SPARE", 1)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    assert joined(documents, docs, region=7) == brute_components(docs)


def test_similarity_of_three_in_four_is_linked(documents):
    left, right = "a b c d e f g", "a b c d e f g h"  # 3 and 4 shingles, 3 shared
    assert joined(documents, [(2, left), (1, right)]) == [("1", 4, "1"), ("2", 3, "1")]
    assert joined(documents, [(2, "a b c d e f"), (1, "a b c d e f g")])[1][2] == "2"  # 2 of 3


def test_empty_table(documents):
    assert joined(documents, []) == []
    assert compact_windows.passages(documents([])).count() == 0


def test_keep_first_keeps_one_of_each(documents, docs):
    table = documents(docs, ["_again"])
    kept = jaccard_join.keep_first(table)
    assert kept.columns == table.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    want = {c for _, _, c in brute_components([d for d in docs if d[0] is not None])}
    assert {str(k) for k in ids if k is not None} == want
    assert ids[None] == 2


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(-5, 7), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == -5 for k in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.integers(1, 7))
def test_windows_are_the_wide_nodes_of_the_cartesian_tree(values, span):
    values = np.array(values, dtype=np.uint64)
    want = set()

    def split(a, b):
        if b - a + 1 >= span:
            c = a + int(np.argmin(values[a : b + 1]))
            want.add((a, c, b))
            split(a, c - 1)
            split(c + 1, b)

    split(0, len(values) - 1)
    assert set(zip(*(x.tolist() for x in compact_windows.windows(values, span)))) == want


def test_every_repeated_passage_is_found_and_none_other(documents, docs, prose):
    rng = random.Random(8)
    near = prose(888, 80)
    docs = docs + [(600 + k, f"{prose(700 + k, 90)} {edited(rng, near, 0.02)} {prose(800 + k, 90)}") for k in range(6)]
    docs = [d for d in docs if d[0] not in (None, 3)]
    text = dict(docs)
    again = [(100, prose(4321, 120)), (None, None)]
    rows = [r for r in compact_windows.passages(documents(docs + again, CLASHING)).collect() if r.doc_id is not None]
    hit = {r.doc_id for r in rows}
    own, repeated = {}, set()
    for k, t in docs:
        w = words_of(t)
        for i in range(len(w) - 49):
            first = own.setdefault(tuple(w[i : i + 50]), k)
            if first != k:
                repeated |= {first, k}
    assert repeated <= hit
    assert len(hit & set(range(600, 606))) >= 5
    for r in rows:
        a, b = words_of(text[r.doc_id])[r.start : r.end], words_of(text[r.other_id])[r.other_start : r.other_end]
        assert r.doc_id != r.other_id and min(len(a), len(b)) >= 50
        a, b = shingles(" ".join(a)), shingles(" ".join(b))
        assert len(a & b) >= 0.75 * len(a | b)
    clean = {k for k in range(60)} - {k for k, t in docs if k < 60 and any(x != k and len(shingles(t) & shingles(o)) > 5 for x, o in docs)}
    assert not hit & clean


@pytest.mark.parametrize("size, edits", [(50, 1), (60, 1), (66, 1), (100, 2), (130, 3)])
def test_evenly_edited_passages_are_verified(size, edits):
    x, y = list(range(size)), list(range(size))
    for k in range(1, edits + 1):
        y[k * size // (edits + 1)] = -k
    x, y = (near_stretch(w, side) for w, side in ((x, 1), (y, 2)))
    (a, b, c, d, similarity), *_ = compact_windows.verified(x, y)
    assert b - a >= compact_windows.SPAN and d - c >= compact_windows.SPAN and similarity >= 0.75


def near_stretch(words, side):
    """Shingle numbers of words between 40 words that are the side's own."""
    own = [(side, k) for k in range(80)]
    w = [*own[:40], *words, *own[40:]]
    return np.array([hash(tuple(w[i : i + 5])) & (2**64 - 1) for i in range(len(w) - 4)], dtype=np.uint64)


def test_a_block_that_one_text_lacks_is_verified():
    words = list(range(100))
    (_, _, _, _, similarity), *_ = compact_windows.verified(near_stretch(words[:44] + words[56:], 1), near_stretch(words, 2))
    assert similarity >= 0.75


def test_edited_passages_are_verified_as_often_as_they_are_near():
    rng = random.Random(3)
    lost = near = 0
    for k in range(400):
        words = list(range(rng.randrange(50, 180)))
        other = [w if rng.random() > 0.03 else -1 - w for w in words if rng.random() > 0.01]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        if len(other) >= 50 and len(a & b) >= 0.75 * len(a | b):
            near += 1
            lost += not compact_windows.verified(near_stretch(words, 1), near_stretch(other, 2))
    assert near > 100 and lost == 0


def test_near_texts_around_phrases_of_all_texts_are_found(documents):
    rng = random.Random(5)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    one, two = own(17), own(17)
    docs = []
    for k in range(60):
        a = [*own(10), *one, *own(9), *two, *own(10)]
        b = list(a)
        b[(4, 31, 58)[k % 3]] = "other"
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    hit = {r.doc_id for r in compact_windows.passages(documents(docs)).select("doc_id").distinct().collect()}
    assert sum(2 * k in hit and 2 * k + 1 in hit for k in range(60)) >= 57


def test_near_texts_that_share_most_of_their_words_with_all_are_found(documents):
    """Pairs around a phrase of 40 words: their signatures are those of all texts, so only comparing with all that can be near tells them apart."""
    rng = random.Random(9)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    phrase, docs = own(40), []
    for k in range(150):
        a = [*own(8), *phrase, *own(8)]
        b = list(a)
        b[rng.choice([*range(8), *range(48, 56)])] = "other"
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    hit = {r.doc_id for r in compact_windows.passages(documents(docs)).select("doc_id").distinct().collect()}
    assert sum(2 * k in hit and 2 * k + 1 in hit for k in range(150)) >= 148


@settings(max_examples=100, deadline=None)
@given(st.integers(46, 120).flatmap(lambda n: st.tuples(st.lists(st.integers(1, 5), min_size=n, max_size=n), st.randoms())))
def test_every_run_has_its_rarest_places(values):
    counts, rng = np.array(values[0]), values[1]
    keys = np.array(rng.sample(range(1000), len(counts)))
    got, span = compact_windows.rarest(counts, keys), compact_windows.SPAN
    want = set()
    for k in range(len(counts) - span + 1):
        want |= set(sorted(range(k, k + span), key=lambda i: (counts[i], keys[i]))[: compact_windows._RAREST])
    assert set(np.flatnonzero(got).tolist()) == want


def test_signatures_of_texts_joined_together_are_those_of_each():
    rng = np.random.default_rng(1)
    parts = [rng.integers(1, 1 << 62, size=n).astype(np.uint64) for n in (46, 60, 300, 47)]
    laid = [(f, *w) for f, w in enumerate(compact_windows._laid_windows(parts, compact_windows._SEEDS))]
    f, owner, values, *places = (np.concatenate(x) for x in zip(*[(np.full(len(w[1]), w[0]), *w[1:]) for w in laid]))
    rows = np.stack([f, *places], 1)
    twice = np.concatenate([np.arange(len(rows)), np.arange(0, len(rows), 3)])
    together = compact_windows._joined_intervals(owner[twice], rows[twice], values[twice], 3)
    each = [compact_windows._joined_intervals(np.full((owner == k).sum(), k), rows[owner == k], values[owner == k], 3) for k in range(len(parts))]
    assert sorted(zip(*(x.tolist() for x in together))) == sorted(row for e in each for row in zip(*(x.tolist() for x in e)))
    # a signature's places are those where both functions have one window
    _, keys, _, _, first, last = together
    assert (first <= last).all() and len(keys) >= 3 * len(parts)


def test_texts_are_read_twice_at_most(spark, documents, docs):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = documents(docs, CLASHING)
    rows = table.count()
    compact_windows.passages(table.mapInArrow(counted, table.schema)).count()
    assert rows <= read.value <= 2 * rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40))
def test_nearest_smaller_values(values):
    low, high = compact_windows._smaller(np.array(values, dtype=np.uint64))
    n = len(values)
    assert low.tolist() == [max((j for j in range(i) if values[j] <= values[i]), default=-1) for i in range(n)]
    assert high.tolist() == [min((j for j in range(i + 1, n) if values[j] < values[i]), default=n) for i in range(n)]


def test_cells_whose_middle_is_in_a_passage_are_covered(spark):
    links = spark.createDataFrame([(1, 2, 0, 60, 500, 560, 1.0), (1, 3, 50, 90, 0, 40, 1.0), (1, 3, 200, 250, 40, 90, 1.0), (4, 1, 0, 50, 10, 30, 1.0)], compact_windows.LINK)
    cells = [(1, m, m) for m in (0, 57, 87, 88, 197, 198, 247, 248)] + [(2, 10, 10), (2, 510, 510), (5, 1, 1)]
    left = compact_windows._not_covered(spark.createDataFrame(cells, "node long, low int, high int"), links)
    assert left.columns == ["node", "low", "high"]
    # A cell low..high of shingles has words up to high + 4, so the middle of one shingle is low + 2.
    assert sorted((r.node, r.low) for r in left.collect()) == [(1, 88), (1, 197), (1, 248), (2, 10), (5, 1)]


def test_first_and_last_places_of_a_texts_key_are_marked():
    owner, keys, place = np.array([0, 0, 0, 1, 1]), np.array([7, 7, 8, 7, 7], dtype=np.uint64), np.array([5, 3, 9, 2, 2])
    least, most = compact_windows._outermost(owner, keys, place)
    assert least.tolist() == [False, True, True, True, True] and most.tolist() == [True, False, True, True, True]
