"""Quality scores from compression.

Two zstandard dictionaries are trained, one from well rated and one from badly
rated text.  A text is compressed with both, whole and in blocks of
``BLOCK`` bytes so that a dictionary helps the end of a long text as much as its
beginning.  The difference of the compressed sizes per byte of text, shrunk
towards the mean for short texts, becomes a probability by a logistic
regression fitted on labelled rows that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.frames import chance, extended, set_aside

BLOCK = 1024
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: The bound of the labelled sample: about so many rows of each class, chosen by a hash of doc_id.
ROWS_PER_CLASS = 2000
#: A longer text is no training row, so the sample's bytes are bounded too.
MAX_TRAINING_BYTES = 1 << 20
#: Bytes of mean evidence that a text's own evidence is weighed against.
SHRINK_BYTES = 100


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    order = np.random.default_rng(7).permutation(len(blocks))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [blocks[k] for k in order]).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its bytes serve as they are
        return b"".join(blocks[k] for k in order)[:DICTIONARY_BYTES]


@dataclass
class Model:
    """``good`` and ``bad`` are dictionaries; without both classes only the prior is known."""

    prior: float
    good: bytes = b""
    bad: bytes = b""
    mean: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def saved(self, text: bytes, compressors) -> float:
        """Bytes that the good dictionary saves over the bad one."""
        good, bad = compressors
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in _blocks(text))

    def evidence(self, text: bytes, compressors) -> float:
        return (self.saved(text, compressors) + SHRINK_BYTES * self.mean) / (len(text) + SHRINK_BYTES)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.intercept, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one variable by Newton steps, lightly regularised."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Model:
    """Learn from about ``rows`` labelled texts of each class that are not held out.

    Half of them make the dictionaries, the other half the calibration; class
    shares come from all labels that may be learnt from.  Labels other than 0
    and 1 are ignored, and so are labels without a document or with a null text.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    model = Model(prior=counts.get(1, 0) / total if total else 0.5)
    share = F.when(F.col("quality") == 1, rows / max(1, counts.get(1, 0))).otherwise(rows / max(1, counts.get(0, 0)))
    chosen = known.filter(chance("doc_id") < share).limit(4 * rows)
    eligible = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAINING_BYTES))
    sample = eligible.join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    sample = sorted(sample.limit(8 * rows).collect(), key=lambda r: (r.doc_id, r.text))
    texts = {(q, h): [r.text.encode() for r in sample if r.quality == q and r.half == h] for q in (0, 1) for h in (0, 1)}
    if not all(texts.values()):
        return model
    model.good, model.bad = _dictionary(texts[1, 0]), _dictionary(texts[0, 0])
    compressors = model.compressors()
    saved = {q: np.array([model.saved(t, compressors) for t in texts[q, 1]]) for q in (0, 1)}
    size = {q: np.array([len(t) for t in texts[q, 1]]) for q in (0, 1)}
    share = {1: model.prior, 0: 1 - model.prior}
    model.mean = sum(share[q] * saved[q].sum() / max(1, size[q].sum()) for q in (0, 1))
    x = np.concatenate([(saved[q] + SHRINK_BYTES * model.mean) / (size[q] + SHRINK_BYTES) for q in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(saved[0]), len(saved[1])])
    weight = np.concatenate([np.full(len(saved[q]), share[q] * len(x) / len(saved[q])) for q in (0, 1)])
    model.slope, model.intercept = _logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to every row; null and empty texts get the score of no evidence."""

    def run(batches):
        compressors = model.compressors() if model.good else None
        for batch in batches:
            found = []
            for part in scan.slices(batch.column("text")):
                found += [model.evidence(part.text(i), compressors) if compressors else 0.0 for i in range(part.last - part.first)]
            scores = model.scores(np.array(found)) if compressors else np.full(len(found), model.prior)
            yield scan.with_columns(batch, {"score": pa.array(scores, pa.float64())})

    return extended(docs, run, score=T.DoubleType())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose predicted label is 1, with their own columns."""
    given, names = set_aside(docs, "score")
    kept = score(given, fit(docs, labels)).filter("score >= 0.5")
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
