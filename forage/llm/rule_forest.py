"""Quality rules: text statistics, fixed base rules and an isolation forest.

Statistics of every whole text come from one scan.  Ratios of them are the
coordinates in which random trees isolate documents from well rated ones: the
shorter the mean path to a document, the more unusual it is.  The trees grow on
a bounded sample of labelled rows inside the space that all rows span; the
limit beyond which a document is refused comes from all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.frames import extended, sampled
from forage.session import cut

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks"]
TREES, TREE_ROWS, DEPTH = 100, 256, 10
#: The bound of the sample that trees grow on.
SAMPLE_ROWS = 20_000
#: Share of well rated rows that the forest may refuse.
CLEAN_LOSS = 0.005
MIN_WORDS = 50
BINS = 2000

_SYMBOLS = scan.byte_class(lambda b: b in b"#*$%&|<>")
_FIRST = scan.byte_class(lambda b: b & 0xC0 != 0x80)  # bytes that begin a character
_UPPER = scan.byte_class(lambda b: 65 <= b <= 90)
_DIGIT = scan.byte_class(lambda b: 48 <= b <= 57)
_MARK = scan.byte_class(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_LINE = scan.byte_class(lambda b: b != 10)


def _later_copies(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text, entries that equal an earlier entry of the same text."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][same], minlength=n)


def _repeat_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, words inside three-word windows that occur twice or more in it."""
    keys, at = scan.shingle_hashes(words, bounds, 3)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(keys):
        owner = np.searchsorted(bounds, at, side="right") - 1
        mixed = keys ^ scan.mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def slice_statistics(part: scan.Slice) -> dict[str, np.ndarray]:
    data, n = part.data, part.last - part.first
    first = _FIRST[data]
    inside = scan.NON_BLANK[data]
    starts, ends, bounds = part.spans(inside)
    prefix = part.prefix(False)
    line_starts, line_ends, line_bounds = part.spans(_LINE[data])
    words_before = np.searchsorted(starts, line_starts)
    filled = np.searchsorted(starts, line_ends) > words_before
    owner = scan.owners(line_bounds)[filled]
    lines = part.hashes(prefix, line_starts[filled], line_ends[filled])
    return {
        "n_words": np.diff(bounds),
        "word_chars": part.totals(inside & first),
        "n_symbols": part.totals(_SYMBOLS[data]),
        "n_dup_lines": _later_copies(lines, owner, n),
        "n_repeat_words": _repeat_words(part.hashes(prefix, starts, ends), bounds),
        "n_chars": part.totals(first),
        "n_lines": np.bincount(owner, minlength=n),
        "n_upper": part.totals(_UPPER[data]),
        "n_digits": part.totals(_DIGIT[data]),
        "n_marks": part.totals(_MARK[data]),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """Add the statistics of ``text`` to every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            parts = [slice_statistics(p) for p in scan.slices(batch.column("text"))]
            kept = batch.select([c for c in batch.schema.names if c != "text"])
            yield scan.with_columns(kept, {
                c: pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in BASE + MORE
            })

    docs = docs.drop(*BASE, *MORE)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in BASE + MORE)]))


def ratios(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's coordinates."""
    c = {k: v.astype(float) for k, v in columns.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars,
    ], 1)


def _expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: at node i, rows with coordinate ``axis[i]`` below ``at[i]`` go to 2i+1, others to 2i+2; axis -1 ends a path."""

    axis: np.ndarray
    at: np.ndarray
    path: np.ndarray
    rows: int

    @staticmethod
    def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 11) -> Forest:
        """Random cuts of the ``box`` (lowest and highest of each coordinate) until usual rows ``x`` are alone."""
        rng = np.random.default_rng(seed)
        size = 2 ** (depth + 1) - 1
        axis, at, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
        rows = min(rows, len(x))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)], box[0], box[1])]
            while todo:
                node, level, part, low, high = todo.pop()
                open_axes = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(open_axes):
                    path[t, node] = level + _expected_path(len(part))
                    continue
                a = axis[t, node] = rng.choice(open_axes)
                cut_at = at[t, node] = rng.uniform(low[a], high[a])
                below = part[:, a] < cut_at
                middle = np.where(np.arange(len(low)) == a, cut_at, low), np.where(np.arange(len(low)) == a, cut_at, high)
                todo += [(2 * node + 1, level + 1, part[below], low, middle[1]), (2 * node + 2, level + 1, part[~below], middle[0], high)]
        return Forest(axis, at, path, rows)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0 to 1: the higher, the shorter the mean path."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for axis, at, path in zip(self.axis, self.at, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                a = axis[node]
                below = x[every, a] < at[node]
                node = np.where(a < 0, node, 2 * node + np.where(below, 1, 2))
            total += path[node]
        mean = total / len(self.axis)
        return 2.0 ** (-mean / max(_expected_path(self.rows), 1e-9))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _coordinates(rows: DataFrame) -> np.ndarray:
    found = rows.select(*BASE, *MORE).toPandas()
    found = found.sort_values(list(found.columns))
    return ratios({c: found[c].to_numpy() for c in found.columns})


def box(stats: DataFrame) -> np.ndarray | None:
    """Lowest and highest value of each coordinate over all rows; none without rows."""
    size = ratios({c: np.zeros(0) for c in BASE + MORE}).shape[1]
    names = [f"{side}_{k}" for side in ("low", "high") for k in range(size)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = ratios({c: batch.column(c).to_numpy() for c in BASE + MORE})
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x.min(0), *x.max(0))], names)

    ends = stats.select(*BASE, *MORE).mapInArrow(run, ", ".join(f"{n} double" for n in names))
    found = ends.agg(*(F.min(n) for n in names[:size]), *(F.max(n) for n in names[size:])).first()
    return None if found[0] is None else np.array(found, dtype=float).reshape(2, size)


def fit_forest(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Grow trees that isolate what is unlike well rated rows.

    Junk is so frequent that it is no rare point of its own, so the trees cut
    the space that all rows which pass the base rules span, and a path ends
    where no well rated rows remain.  These are a sample chosen by hash.  Where
    fewer than two rows are rated, a sample of all rows counts as usual; without
    rows there is no forest.
    """
    passed = stats.filter(~base_failed())
    space = box(passed)
    if space is None:
        return None
    usual = _coordinates(sampled(passed.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"), sample_rows, "doc_id", *BASE))
    if len(usual) < 2:
        usual = _coordinates(sampled(passed, sample_rows, "doc_id", *BASE))
    return Forest.grow(usual, space) if len(usual) > 1 else None


def anomaly(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Add ``anomaly``; 0 without a forest."""

    def run(batches):
        for batch in batches:
            x = ratios({c: batch.column(c).to_numpy() for c in BASE + MORE})
            found = forest.scores(x) if forest is not None else np.zeros(len(x))
            yield scan.with_columns(batch, {"anomaly": pa.array(found, pa.float64())})

    return extended(stats, run, anomaly=T.DoubleType())


def threshold(scored: DataFrame, labels: DataFrame, clean_loss: float = CLEAN_LOSS) -> float:
    """The lowest anomaly beyond which at most ``clean_loss`` of all well rated rows would be refused; 1 without such rows."""
    rated = labels.filter("quality = 1").select("doc_id").distinct()
    place = F.ceil(F.col("anomaly") * BINS).alias("bin")
    counts = scored.filter(~base_failed()).join(rated, "doc_id").groupBy(place).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    total, lost, limit = sum(r.n for r in counts), 0, BINS
    for r in counts:
        lost += r.n
        if lost > clean_loss * total:
            limit = r.bin
            break
    return limit / BINS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the anomaly of every document.

    Without labelled rows only the base rules refuse documents.
    """
    stats = cut(statistics(docs.select("doc_id", "text")), "statistics")
    scored = anomaly(stats, fit_forest(stats, labels))
    limit = threshold(scored, labels)
    return scored.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") <= limit)).alias("kept"), "anomaly")
