"""Word languages in mixed text by a linear-chain conditional random field.

Words are runs of letters.  A word's features are its character n-grams of two
to four bytes with word borders (so prefixes and suffixes are features of their
own) and, for words of the learned lexicon, the word itself; all are hashed to
rows of one weight table.  Labels follow each other with learned transition
weights.  Marginal probabilities of every word come from forward-backward over
the whole text, and their sums decide the text's language.

Texts are cut into blocks of ``BLOCK`` words only to run many of them side by
side: a block's product of transition matrices is exact, so the chain passes
through all blocks as it would word by word.  A very long text is worked on in
pieces between words; the products of its pieces carry the chain over their
borders in both directions, so its labels do not depend on the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.frames import chance, extended
from forage.llm.zstd_quality import is_held_out
from forage.session import cut

BITS = 16
LEXICON = 8192
BLOCK = 32
#: The bound of the training sample: about so many rows of each language, chosen by a hash of doc_id, whole texts of up to so many bytes.
ROWS_PER_LANGUAGE, MAX_TRAINING_BYTES = 300, 1 << 16
EPOCHS, RATE, DECAY = 3, 0.25, 1e-5
#: Training sequences change language after about so many words, so that transitions are learned.
SWITCH_WORDS = 24
BATCH = 128
UNKNOWN = "und"
#: Most training texts over all languages; with more than this many divided by ``ROWS_PER_LANGUAGE``, each has fewer.
TRAINING_ROWS = 20_000
#: Bytes of text worked on at once, and the length from which one text is worked on in pieces.
SLICE, LONG = 1 << 19, 1 << 22

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
_BORDER = np.uint64(1)
_FIRST = scan.byte_class(lambda b: b & 0xC0 != 0x80)
_PLAIN = scan.byte_class(lambda b: b < 0x80 and chr(b).isalpha())


def words_of(part: scan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all n-grams in word order, the first of each word, word hashes, first word of each text.

    Each word is laid out with a border on either side.
    """
    starts, ends, bounds = part.spans(scan.LETTERS[part.data])
    if len(starts) == 0:
        return np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), bounds, starts
    hashes = part.hashes(part.prefix(True), starts, ends)
    sizes = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    laid = np.full(int(sizes.sum()) + 3, _BORDER, dtype=np.uint64)
    inside = np.ones(len(laid), dtype=bool)
    inside[first] = False
    inside[first + sizes - 1] = False
    inside[-3:] = False
    laid[inside] = _FOLD[part.data[scan.LETTERS[part.data]]]
    n = len(laid) - 3
    two = laid[:n] * np.uint64(257) + laid[1 : n + 1]
    three = two * np.uint64(257) + laid[2 : n + 2]
    four = three * np.uint64(257) + laid[3 : n + 3]
    shift = np.uint64(64 - BITS)
    grams = np.stack([(scan.mix(g * np.uint64(8) + np.uint64(k)) >> shift).astype(np.int64) for k, g in ((2, two), (3, three), (4, four))])
    # An n-gram that reaches past the word's closing border would mix two words.
    to_end = np.repeat(first + sizes, sizes) - np.arange(n)
    for k in range(3):
        grams[k][to_end < k + 2] = 1 << BITS
    return grams, first, hashes, bounds, starts


def emissions(grams: np.ndarray, first: np.ndarray, hashes: np.ndarray, weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Label scores of every word."""
    if len(first) == 0:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    total = weights[grams[0]]
    total += weights[grams[1]]
    total += weights[grams[2]]
    return np.add.reduceat(total, first, axis=0) + weights[lexicon_rows(hashes, lexicon)]


def lexicon_rows(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Weight row of each word: its own for lexicon words, the empty row for others."""
    if len(lexicon) == 0:
        return np.full(len(hashes), 1 << BITS)
    place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[place] == hashes, place + (1 << BITS) + 1, 1 << BITS)


class _Chain:
    """Words of texts laid out in blocks; ``fresh``: the first word of a text has none before it."""

    def __init__(self, scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray, fresh: bool = True):
        n, labels = scores.shape
        sizes = np.diff(bounds)
        self.blocks = -(-sizes // BLOCK)
        self.bounds = np.concatenate([[0], np.cumsum(self.blocks)])
        self.count, self.labels = int(self.bounds[-1]), labels
        owner = scan.owners(bounds)
        offset = np.arange(n) - bounds[owner]
        self.spot = (self.bounds[owner] + offset // BLOCK) * BLOCK + offset % BLOCK
        filled, start = np.zeros((2, self.count * BLOCK), dtype=bool)
        filled[self.spot] = True
        start[self.spot[offset == 0]] = fresh
        power = np.ones((self.count * BLOCK, labels))
        power[self.spot] = np.exp(scores - scores.max(1, keepdims=True))
        self.power, self.going = power.reshape(-1, BLOCK, labels), (filled & ~start).reshape(-1, BLOCK)
        self.step = np.exp(transition - transition.max())

    def move(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Rows of ``vectors`` one word on; at a text's first word there is no transition, past its last nothing happens."""
        shape = (self.count,) + (1,) * (vectors.ndim - 1)
        moved = np.where(self.going[:, t].reshape(shape), vectors @ self.step, vectors) * self.power[:, t].reshape(shape[:-1] + (self.labels,))
        return moved / moved.reshape(self.count, -1).max(1).reshape(shape)

    def products(self) -> np.ndarray:
        """For each block, what a vector before it is multiplied with on its way through."""
        product = np.broadcast_to(np.eye(self.labels), (self.count, self.labels, self.labels)).copy()
        for t in range(BLOCK):
            product = self.move(product, t)
        return product


def across(scores: np.ndarray, transition: np.ndarray, fresh: bool) -> np.ndarray:
    """The product of one piece of a text."""
    total = np.eye(scores.shape[1])
    for product in _Chain(scores, np.array([0, len(scores)]), transition, fresh).products() if len(scores) else ():
        total = total @ product
        total /= total.max()
    return total


def marginals(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word given its whole text, and the summed probabilities of neighbouring label pairs.

    For one piece of a longer text, ``before`` and ``after`` are the forward
    vector at the last word before it and the backward vector at its own last word.
    """
    n, labels = scores.shape
    if n == 0:
        return scores, np.zeros((labels, labels))
    chain = _Chain(scores, bounds, transition, before is None)
    count, block_bounds, blocks, step, power = chain.count, chain.bounds, chain.blocks, chain.step, chain.power
    product = chain.products()
    into, out = np.ones((count, labels)), np.ones((count, labels))
    if before is not None:
        into[0] = before
    if after is not None:
        out[-1] = after
    most = int(blocks.max())
    order = np.argsort(-blocks, kind="stable")
    longer = np.searchsorted(-blocks[order], -np.arange(1, most), side="left")
    for k in range(1, most):
        at = block_bounds[order[: longer[k - 1]]] + k
        value = np.einsum("bi,bij->bj", into[at - 1], product[at - 1])
        into[at] = value / value.max(1, keepdims=True)
        back = block_bounds[order[: longer[k - 1]] + 1] - 1 - k
        value = np.einsum("bij,bj->bi", product[back + 1], out[back + 1])
        out[back] = value / value.max(1, keepdims=True)
    forward = np.empty((BLOCK, count, labels))
    vector = into
    for t in range(BLOCK):
        vector = chain.move(vector, t)
        forward[t] = vector
    found = np.empty((count, BLOCK, labels))
    pairs = np.zeros((labels, labels))
    vector = out
    for t in range(BLOCK - 1, -1, -1):
        joint = forward[t] * vector
        found[:, t] = joint / joint.sum(1, keepdims=True)
        going = chain.going[:, t]
        ahead = vector * power[:, t]
        if going.any():
            earlier = (forward[t - 1] if t else into)[going]
            pair = earlier[:, :, None] * step * ahead[going][:, None, :]
            pairs += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        vector = np.where(going[:, None], ahead @ step.T, ahead)
        vector = vector / vector.max(1, keepdims=True)
    return found.reshape(-1, labels)[chain.spot], pairs


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray

    def scores(self, part: scan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label scores of every word, the first word of each text, and where words begin."""
        grams, first, hashes, bounds, starts = words_of(part)
        return emissions(grams, first, hashes, self.weights, self.lexicon), bounds, starts

    def words(self, part: scan.Slice) -> Iterator[tuple[scan.Slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of the slice with the label probabilities of their words, the first word of each text and where words begin.

        There is one piece but for a very long text.
        """
        pieces = _pieces(part)
        labels = len(self.languages)
        before, after = [None] * len(pieces), [np.ones(labels)] * len(pieces)
        if len(pieces) > 1:
            products, vector = [], None
            for k, piece in enumerate(pieces):
                before[k] = vector
                scores = self.scores(piece)[0]
                products.append(across(scores, self.transition, vector is None))
                if len(scores):
                    vector = (np.ones(labels) if vector is None else vector) @ products[k]
                    vector = vector / vector.max()
            for k in range(len(pieces) - 1, 0, -1):
                vector = products[k] @ after[k]
                after[k - 1] = vector / vector.max()
        for k, piece in enumerate(pieces):
            scores, bounds, starts = self.scores(piece)
            yield piece, marginals(scores, bounds, self.transition, before[k], after[k] if len(pieces) > 1 else None)[0], bounds, starts

    def predict(self, part: scan.Slice, runs: list[list[dict]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text its words, and the summed label probabilities of them; ``runs`` gets each text's runs of equally labelled words."""
        n = part.last - part.first
        words, sums = np.zeros(n, np.int64), np.zeros((n, len(self.languages)))
        listed: list[list[dict]] = [[] for _ in range(n)]
        passed = 0
        for piece, found, bounds, starts in self.words(part):
            total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(found, axis=0)])
            words += np.diff(bounds)
            sums += total[bounds[1:]] - total[bounds[:-1]]
            if runs is not None:
                self._list_runs(listed, piece, found, bounds, starts, passed)
                passed += int(_FIRST[piece.data].sum())
        if runs is not None:
            runs.extend(listed)
        return words, sums

    def _list_runs(self, listed: list[list[dict]], piece: scan.Slice, found: np.ndarray, bounds: np.ndarray, starts: np.ndarray, passed: int) -> None:
        if not len(starts):
            return
        ends = piece.spans(scan.LETTERS[piece.data])[1]
        place = np.concatenate([[0], np.cumsum(_FIRST[piece.data])])
        best, owner = found.argmax(1), scan.owners(bounds)
        change = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
        for a, b in zip(change, [*change[1:], len(best)]):
            row = int(owner[a])
            shift = passed - int(place[piece.offsets[row]])
            run = {"start": int(place[starts[a]]) + shift, "end": int(place[ends[b - 1]]) + shift, "lang": self.languages[best[a]]}
            if listed[row] and listed[row][-1]["lang"] == run["lang"]:
                listed[row][-1]["end"] = run["end"]
            else:
                listed[row].append(run)


def _sequences(texts: list[str], labels: list[int], rng) -> tuple[pa.Array, list[np.ndarray]]:
    """Training texts spliced from pieces of the given ones, and the label of every word."""
    pieces = []
    for text, label in zip(texts, labels):
        words = text.split()
        at = 0
        while at < len(words):
            size = 1 + int(rng.exponential(SWITCH_WORDS))
            pieces.append((label, words[at : at + size]))
            at += size
    made, tags = [], []
    order = rng.permutation(len(pieces))
    for k in range(0, len(order), 4):
        chosen = [pieces[j] for j in order[k : k + 4]]
        made.append(" ".join(w for _, words in chosen for w in words))
        tags.append(np.concatenate([np.full(_runs(words), label) for label, words in chosen]))
    return pa.array(made), tags


def _runs(words: list[str]) -> int:
    part = next(scan.slices(pa.array([" ".join(words)]), 1 << 40))
    return len(part.spans(scan.LETTERS[part.data])[0])


def train(texts: list[str], languages: list[str], seed: int = 5) -> Model | None:
    """Fit weights by adaptive gradient steps on the likelihood of the label sequences."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    column, tags = _sequences(texts, [names.index(x) for x in languages], rng)
    part = next(scan.slices(column, 1 << 40))
    hashes = part.hashes(part.prefix(True), *part.spans(scan.LETTERS[part.data])[:2])
    seen, counts = np.unique(hashes, return_counts=True)
    lexicon = np.sort(seen[np.argsort(-counts, kind="stable")[:LEXICON]])
    empty = 1 << BITS
    weights = np.zeros((empty + 1 + len(lexicon), len(names)))
    transition = np.zeros((len(names), len(names)))
    squares, squares_t = np.full_like(weights, 1e-4), np.full_like(transition, 1e-4)
    batches = [column.slice(k, BATCH) for k in range(0, len(column), BATCH)]
    wanted = [np.concatenate(tags[k : k + BATCH]) for k in range(0, len(column), BATCH)]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            part, tag = next(scan.slices(batches[k], 1 << 40)), wanted[k]
            grams, first, hashes, bounds, _ = words_of(part)
            if len(first) == 0:
                continue
            found, pairs = marginals(emissions(grams, first, hashes, weights, lexicon), bounds, transition)
            gap = -found
            gap[np.arange(len(tag)), tag] += 1
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, grams.shape[1])))
            rows = np.concatenate([grams.ravel(), lexicon_rows(hashes, lexicon)])
            source = np.concatenate([word, word, word, np.arange(len(first))])
            slope = np.stack([np.bincount(rows, gap[source, j], len(weights)) for j in range(len(names))], 1) / len(tag) - DECAY * weights
            slope[empty] = 0
            squares += slope**2
            weights += RATE * slope / np.sqrt(squares)
            linked = np.ones(len(tag), dtype=bool)
            linked[bounds[bounds < len(tag)]] = False
            observed = np.zeros_like(pairs)
            np.add.at(observed, (tag[np.flatnonzero(linked) - 1], tag[linked]), 1)
            slope_t = (observed - pairs) / len(tag) - DECAY * transition
            squares_t += slope_t**2
            transition += RATE * slope_t / np.sqrt(squares_t)
    return Model(names, weights.astype(np.float32), lexicon, transition)


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from about ``rows`` texts of each language that are not held out; none where no language is given."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.filter(F.octet_length("text") <= MAX_TRAINING_BYTES)
    # a written table has a known size, so the join with it moves no text
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    rows = min(rows, TRAINING_ROWS / max(1, counts.count()))
    chosen = known.join(counts, "lang").filter(chance("doc_id", "text") < rows / F.col("n"))
    sample = sorted(chosen.select("lang", "doc_id", "text").distinct().collect())
    return train([r.text for r in sample], [r.lang for r in sample])


def _pieces(part: scan.Slice) -> list[scan.Slice]:
    """A slice as it is, or a very long text cut between words."""
    if part.last - part.first > 1 or len(part.data) <= LONG:
        return [part]
    gaps = np.flatnonzero(~scan.LETTERS[part.data])
    made, at = [], 0
    while at < len(part.data):
        k = np.searchsorted(gaps, at + LONG)
        end = int(gaps[k]) + 1 if k < len(gaps) else len(part.data)
        made.append(scan.Slice(part.first, part.last, part.data[at:end], np.array([0, end - at])))
        at = end
    return made


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def label(docs: DataFrame, model: Model | None, runs: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the mean probability of that language over the text's words.

    With ``runs``, also ``runs``: (start, end, lang) in characters of each run
    of words that are most likely of one language, in order.

    Null texts and texts without a letter are ``und`` with score 0 and no runs; so is every text without a model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        known = sent.value
        for batch in batches:
            names, scores, listed = [], [], []
            for part in scan.slices(batch.column("text"), SLICE):
                n = part.last - part.first
                plain = part.totals(_PLAIN[part.data]) > 0
                lettered = [bool(plain[i]) or _has_letter(part.text(i)) for i in range(n)]
                if known is None:
                    names += [UNKNOWN] * n
                    scores += [0.0] * n
                    listed += [[]] * n
                    continue
                found: list[list[dict]] | None = [] if runs else None
                words, sums = known.predict(part, found)
                best = sums.argmax(1)
                for i in range(n):
                    good = lettered[i] and words[i] > 0
                    names.append(known.languages[best[i]] if good else UNKNOWN)
                    scores.append(min(1.0, float(sums[i, best[i]] / words[i])) if good else 0.0)
                    listed.append(found[i] if runs and good else [])
            made = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            yield scan.with_columns(batch, made | ({"runs": pa.array(listed, kind)} if runs else {}))

    return extended(docs, run, lang_pred=T.StringType(), score=T.DoubleType(), **({"runs": RUNS} if runs else {}))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = label(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
