"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (A-Z lowered; ASCII punctuation and blanks
separate) and put into one suffix automaton.  Training words stream through it;
at every word the automaton knows the longest suffix read so far that occurs in
some item.  A *window* is ``width`` consecutive words of an item, or a whole
item that is shorter; words inside any occurrence of a window are hit.

Only runs of words that occur in some item can hold a window, so other words
reset the automaton without a step.  Items are taken in blocks of a bounded
number of words: each block is one automaton, sent to the executors once, and
documents are scanned against one block after another.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.frames import set_aside
from forage.session import cut

WIDTH = 10
#: Words of test items in one automaton; larger benchmarks take several passes.
BLOCK_WORDS = 200_000
#: Spans of at least so many words are cut out of a text ...
MIN_SPAN = 10
#: ... and a text with more than this share of its words hit, in spans of any length, is dropped.
MAX_COVERAGE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


class SuffixAutomaton:
    """All substrings of the items' word sequences."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.width = width
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        ends: dict[int, list[tuple[int, str | None]]] = {}
        self.shortest = width
        for item, words in items:
            if not words:
                continue
            at, size = 0, min(width, len(words))
            self.shortest = min(self.shortest, size)
            for n, word in enumerate(words, 1):
                at = self._extend(at, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if n >= size:
                    ends.setdefault(at, []).append((size, item))
        self.windows: dict[int, dict[int, set[str | None]]] = {}
        for state, found in ends.items():
            for size, item in found:
                at = state
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                self.windows.setdefault(at, {}).setdefault(size, set()).add(item)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter strings of ``q`` that end with ``p`` and ``word``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, words: list[int]) -> Iterable[tuple[int, int, set[str | None]]]:
        """(end, size, items) of every window that ends after each word."""
        state, length = 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.step[state].get(word, 0)
            length = length + 1 if state else 0
            at = state
            while at > 0:
                for size, items in self.windows.get(at, {}).items():
                    if size <= length:
                        yield end, size, items
                at = self.link[at]


class Matcher:
    """Finds windows in slices of text by hashed vocabulary lookup and automaton steps."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        if not automaton.vocabulary:
            self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        column = pa.array([w.decode() for w in automaton.vocabulary])
        hashes = []
        for part in scan.slices(column):
            starts, ends, _ = part.spans(scan.ALPHANUMERIC[part.data])
            hashes.append(part.hashes(part.prefix(True), starts, ends))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, part: scan.Slice):
        """Word starts, ends, first word of each text, hit words, and the items found in each text."""
        starts, ends, bounds = part.spans(scan.ALPHANUMERIC[part.data])
        hit, items = np.zeros(len(starts), dtype=bool), {}
        if len(starts) == 0 or len(self.hashes) == 0:
            return starts, ends, bounds, hit, items
        words = part.hashes(part.prefix(True), starts, ends)
        known = np.zeros(len(words), dtype=bool)
        at = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
        same = self.hashes[place] == words[at]
        known[at[same]] = True
        ids = np.zeros(len(words), dtype=np.int64)
        ids[at[same]] = self.ids[place[same]]
        first, last = scan.runs(known, bounds)
        long = last - first >= self.automaton.shortest
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            row = int(np.searchsorted(bounds, a, side="right")) - 1
            for end, size, found in self.automaton.matches(ids[a:b].tolist()):
                hit[a + end - size : a + end] = True
                items.setdefault(row, set()).update(found)
        return starts, ends, bounds, hit, items


def blocks_of(items: DataFrame, words: int) -> list[DataFrame]:
    """Split test items by hash into blocks of about ``words`` words."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = sized.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, -(-total // words))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sized.filter(key == k) if n > 1 else sized for k in range(n)]


def match(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``n_words``, ``hits`` (merged spans of hit words: start, end, start, end ...) and ``item_ids``.

    With ``min_span``, also ``clean``, the text without hit spans of so many
    words, and ``n_lost``, the words that are gone.  Null texts have no words.
    An empty benchmark hits nothing.  Items that share an id count as one; an
    item with a null id hits words but is not listed.  Columns of ``docs`` with
    the added names are replaced.
    """
    integers = T.ArrayType(T.IntegerType())
    docs = docs.drop("n_words", "hits", "item_ids", "clean", "n_lost")
    names = docs.columns
    added = [T.StructField("hits", integers), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]
    added += [T.StructField("clean", T.StringType()), T.StructField("n_lost", T.LongType())] if min_span else []
    schema = T.StructType([*docs.schema.fields, *added])
    docs = docs.withColumn("hits", F.array().cast(integers)).withColumn("item_ids", F.array().cast("array<string>"))
    blocks = blocks_of(items, block_words)
    for k, block in enumerate(blocks):
        words = [(r.item_id, item_words(r.text)) for r in block.toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(words, width))

        def run(batches, sent=sent):
            matcher = Matcher(sent.value)
            for batch in batches:
                earlier, listed = batch.column("hits").to_pylist(), batch.column("item_ids").to_pylist()
                counts, hits, found, clean, lost = [], [], [], [], []
                for part in scan.slices(batch.column("text")):
                    starts, ends, bounds, hit, items = matcher.find(part)
                    counts += np.diff(bounds).tolist()
                    for i, row in enumerate(range(part.first, part.last)):
                        if earlier[row]:
                            for a, b in zip(earlier[row][::2], earlier[row][1::2]):
                                hit[bounds[i] + a : bounds[i] + b] = True
                    first, last = scan.runs(hit, bounds)
                    cut_at = np.searchsorted(first, bounds)
                    for i, row in enumerate(range(part.first, part.last)):
                        a, b = cut_at[i], cut_at[i + 1]
                        spans = list(zip(first[a:b].tolist(), last[a:b].tolist()))
                        hits.append([int(v - bounds[i]) for span in spans for v in span])
                        found.append(sorted({*(listed[row] or []), *(x for x in items.get(i, ()) if x is not None)}))
                        if min_span:
                            long = [(p, q) for p, q in spans if q - p >= min_span]
                            clean.append(_without(part, i, [(starts[p], ends[q - 1]) for p, q in long]) if long else None)
                            lost.append(sum(q - p for p, q in long))
                made = {"hits": pa.array(hits, pa.list_(pa.int32())), "item_ids": pa.array(found, pa.list_(pa.string())), "n_words": pa.array(counts, pa.int64())}
                if min_span:
                    made |= {"clean": pa.array(clean, pa.string()), "n_lost": pa.array(lost, pa.int64())}
                yield scan.with_columns(pa.RecordBatch.from_arrays([batch.column(c) for c in names], names), made)

        docs = docs.mapInArrow(run, schema)
        if k + 1 < len(blocks):
            docs = cut(docs, "matched")
    return docs


def _without(part: scan.Slice, row: int, spans: list[tuple[int, int]]) -> str:
    """A text without the given stretches of bytes."""
    begin, end = part.offsets[row], part.offsets[row + 1]
    edges = [begin, *(edge for span in spans for edge in span), end]
    return b"".join(part.data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode()


def _hit_words() -> F.Column:
    return F.aggregate(F.transform("hits", lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0), lambda a, b: a + b)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = match(docs.select("doc_id", "text"), items, width)
    return found.select(
        "doc_id", "n_words", _hit_words().cast("bigint").alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Cut hit spans of at least ``min_span`` words out of texts; drop texts with more than ``max_coverage`` of their words in hit spans of any length.

    Texts without such spans come back unchanged, null ones too, and so does
    every other column, whatever its name.
    """
    given, names = set_aside(docs, "hits", "item_ids", "n_words", "clean", "n_lost")
    found = match(given, items, width, min_span)
    kept = found.filter(_hit_words() <= F.col("n_words") * max_coverage)
    columns = {"text": F.coalesce("clean", "text")}
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_lost") > 0, length).otherwise(F.col("n_chars"))
    return kept.select(*[columns.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])
