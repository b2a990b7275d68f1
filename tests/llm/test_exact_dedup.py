import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from forage.llm import exact_dedup
from tests.llm.conftest import CLASHING


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    found = []
    for text, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for k, m in enumerate(members):
            found.append((None if m[1] else m[2], keep, len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a", "b", "é", "😀"]) for _ in range(rng.randrange(6)))) for k in range(300)]
    rows += [(1000 + k, "the same\ttext" + " " * (k % 3)) for k in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n\v\f\r\t"), (None, "ab"), (None, "ab"), (7, "x y"), (7, "x y"), (8, "xy"), (9, "z" * 2_000_000), (10, "z" * 1_000_000 + " " + "z" * 1_000_000)]
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force(documents, mixed):
    assert result(exact_dedup.digest(documents(mixed, CLASHING))) == brute(mixed)


def test_partitions_and_order_do_not_matter(documents, mixed):
    assert result(exact_dedup.digest(documents(mixed[::-1]).repartition(9))) == brute(mixed)


def weak(text):
    """A hash of four values, so that most texts collide."""
    return F.unhex(F.concat(F.lit("0"), F.hex(F.pmod(F.xxhash64(text), F.lit(4)))))


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_bytes, weak])
def test_one_row_of_each_text_stays_with_all_columns(documents, mixed, content_hash):
    names = [*CLASHING, "_hash", "keep_id", "group_size", "_maybe"]
    docs = documents(mixed, names)
    kept = exact_dedup.keep_first(docs, content_hash)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r[c] == "x" for r in rows for c in names)
    want = sorted(((None if i is None else i, h) for i, _, _, k, h in brute(mixed) if k), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows), key=repr) == want


def test_collisions_are_told_apart_by_bytes(documents, mixed):
    groups = exact_dedup.find(documents(mixed), weak)
    assert groups.collided.count() == 4
    sizes = collections.Counter(normal(t) for _, t in mixed)
    assert sorted(r.group_size for r in groups.keepers.collect()) == sorted(sizes.values())


def test_a_full_bit_table_changes_nothing(documents, mixed, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64)
    assert result(exact_dedup.digest(documents(mixed))) == brute(mixed)


def test_empty_table(documents):
    assert exact_dedup.digest(documents([])).count() == 0
    assert exact_dedup.keep_first(documents([])).count() == 0


def test_plan_has_no_python(documents):
    plan = exact_dedup.digest(documents([(1, "a b"), (2, "ab")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
