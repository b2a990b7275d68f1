import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from forage.llm import scan

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.1漢", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(1, 60))
def test_words_of_slices_are_the_words_of_the_texts(values, size):
    found = []
    for part in scan.slices(pa.array(values, pa.string()), size):
        starts, ends, bounds = part.spans(scan.NON_BLANK[part.data])
        for i in range(part.last - part.first):
            found.append([part.data[a:b].tobytes().decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", v or "") for v in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB", min_size=1, max_size=6), min_size=1, max_size=20))
def test_folded_hashes_name_words_whatever_their_case_and_place(words):
    column = pa.array([" ".join(words), " ".join(reversed(words))])
    part = next(scan.slices(column))
    starts, ends, _ = part.spans(scan.NON_BLANK[part.data])
    names = part.hashes(part.prefix(True), starts, ends)
    seen = {}
    for word, name in zip(words + words[::-1], names.tolist()):
        assert seen.setdefault(word.lower(), name) == name
    assert len(set(seen.values())) == len(seen)


def test_shingles_stay_inside_texts():
    words, bounds = np.arange(1, 10, dtype=np.uint64), np.array([0, 4, 4, 9])
    keys, at = scan.shingle_hashes(words, bounds, 3)
    assert at.tolist() == [0, 1, 4, 5, 6]
    assert len(set(keys.tolist())) == 5


def test_sliced_columns_and_empty_ones():
    column = pa.array(["zero", "one two", None, "three"]).slice(1)
    assert [p.text(i) for p in scan.slices(column) for i in range(p.last - p.first)] == [b"one two", b"", b"three"]
    assert list(scan.slices(pa.array([], pa.string()))) == []
