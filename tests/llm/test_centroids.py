import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from forage.llm import centroids
from tests.llm.conftest import CLASHING

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows, extra=()):
        schema = T.StructType([*VEC.fields, *(T.StructField(n, T.StringType()) for n in extra)])
        return spark.createDataFrame([(i, v, 0, *("x" for _ in extra)) for i, v in rows], schema)

    return make


def whole(values):
    if values is None or len(values) != 64 or any(x is None or not np.isfinite(x) for x in values):
        return None
    return [max(-centroids.LARGEST, min(centroids.LARGEST, int(np.floor(64 * float(np.float32(x)))))) for x in values]


def brute(rows):
    kept = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [w for _, w in sorted(kept, key=key)[:16]]
    near = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, c)), n) for n, c in enumerate(cents))
    for _ in range(3):
        groups = {}
        for _, w in kept:
            groups.setdefault(near(w)[1], []).append(w)
        cents = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else cents[n] for n in range(len(cents))]
    found = [(i, *near(w)[::-1]) for i, w in kept]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(16)}
    most = (1 << 63) - 1
    return sorted(
        ((i, c, d, min(most, total[c]), min(most, sum(total.values())), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=repr
    )


def result(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=repr)


def sample(n, seed=1):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.2) for _ in range(64)]) for k in range(n)]


@pytest.fixture(scope="module")
def odd():
    rows = sample(120)
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (501, []), (502, [0.0] * 63), (503, [0.0] * 65), (504, [None] + [0.0] * 63), (505, [nan] + [0.0] * 63), (506, [-inf] + [0.0] * 63)]
    rows += [(None, [0.5] * 64), (None, [0.25] * 64), (7, rows[7][1]), (7, rows[8][1]), (600, [3e38] * 64), (601, [-3e38] * 64), (602, [0.0] * 64)]
    rows += [(700 + k, [0.1] * 64) for k in range(50)]
    return rows


def test_rounds_equal_brute_force(vectors, odd):
    assert result(centroids.digest(vectors(odd, CLASHING).repartition(5))) == brute(odd)


def test_few_vectors(vectors):
    assert result(centroids.digest(vectors(odd_rows := sample(5)))) == brute(odd_rows)
    assert centroids.digest(vectors([])).count() == 0
    assert centroids.digest(vectors([(1, None), (2, [1.0])])).count() == 0


def test_assign_keeps_columns(vectors):
    rows = sample(40)
    docs = vectors(rows, [*(c for c in CLASHING if c != "label"), "cluster"])
    found = centroids.assign(docs, centroids.fit(docs))
    assert [c for c in found.columns if c not in ("cluster", "distance", "measured")] == [c for c in docs.columns if c != "cluster"]
    assert all(r["size"] == "x" and r["vec_id"] == k for k, r in enumerate(sorted(found.collect(), key=lambda r: r["vec_id"])))


@pytest.mark.parametrize("seed", range(20))
def test_search_equals_full_comparison(seed):
    rng = np.random.default_rng(seed)
    wide = 10 ** rng.integers(0, 8)
    # Few distinct values give many ties; large ones try the rounding of the deviations.
    cents = rng.integers(-wide, wide + 1, (rng.integers(1, 40), 64))
    vectors = np.concatenate([rng.integers(-wide, wide + 1, (300, 64)), cents, np.repeat(cents[:1], 3, axis=0)])
    cents = np.concatenate([cents, cents[:5]])
    number, distance, measured = centroids.Search(cents).nearest(vectors)
    full = ((vectors[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (number == full.argmin(axis=1)).all()
    assert (measured >= 1).all() and (measured <= len(cents)).all()


def test_search_excludes_centroids():
    rng = np.random.default_rng(3)
    cents = np.arange(200)[:, None] * 50 + rng.integers(-5, 6, (200, 64))
    vectors = cents[rng.integers(0, 200, 1000)] + rng.integers(-5, 6, (1000, 64))
    assert centroids.Search(cents).nearest(vectors)[2].mean() < 3
