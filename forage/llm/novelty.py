"""Secrets: fixed patterns, and strings that no dictionary or neighbour explains.

A candidate is any run without blanks and quotes that is long enough and stands
after a sensitive word.  It is compressed behind the text around it and a
dictionary of identifiers, without copies of itself; the bytes that it adds, as
a share of what random strings of its alphabet and length add there, are its
novelty.  Words and identifiers cost little, random keys cost as much as random
strings and are reported, and so are their copies in the same text.

The dictionary holds the most frequent words of all texts that stand behind
several different words.  A key in copies of one text always stands behind the
same word, so however often a text is copied, its keys do not explain
themselves.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm import scan
from forage.llm.frames import chance, extended, set_aside
from forage.session import cut

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SENSITIVE = re.compile(rb"(?i)pass(word|wd|phrase|code)|secret|token|api.?key|credential|auth|bearer|private|access.?key|signature|pwd|login")
#: Addresses are no secrets.
ADDRESS = re.compile(rb"\W*[\w.+-]+@([\w-]+\.)+[A-Za-z]{2,}\W*")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: Letters, digits and symbols that a candidate must have, and those that one of letters alone must have.
CANDIDATE_LENGTH, LETTERS_LENGTH = 16, 20
#: Bytes before a candidate in which a sensitive word must stand, and bytes on either side that explain it.
CONTEXT, AROUND = 160, 2048
#: Share of the bytes that random strings add, or added bytes per character, from which a candidate is reported.
NOVELTY, PER_CHARACTER = 0.85, 0.9
#: Random strings that a candidate is compared with; long ones differ little, so one will do.
DRAWS, LONG = 9, 256
#: Size of the dictionary, bytes of a word in it, and the fewest different words (by 64 hash values) that it must stand behind.
DICTIONARY_BYTES, WORD_BYTES, BEHIND = 256 << 10, (4, 64), 8

_HEX = scan.byte_class(lambda b: chr(b) in "0123456789abcdef")
_TOKEN = scan.byte_class(lambda b: 0x20 < b < 0x7F and chr(b) not in "\"'`")
_LETTER = scan.byte_class(lambda b: b < 0x80 and chr(b).isalpha())
_SYMBOL = scan.byte_class(lambda b: 48 <= b <= 57 or chr(b) in "!#$%&*@^")
#: Marks that belong to the sentence around a candidate.
_OPENING, _CLOSING = b"([{<", b")]}>.,;:"
_SIGN = scan.byte_class(lambda b: chr(b) in ":=")
_FIRST = scan.byte_class(lambda b: b & 0xC0 != 0x80)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of assign and access matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    return found + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]


class Novelty:
    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        if known:
            known.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, before: bytes, candidate: bytes, after: bytes) -> float:
        """Bytes that ``candidate`` adds behind its neighbours, as a share of what random strings like it add, at least 1 if they reach ``PER_CHARACTER``; a line break keeps them apart."""
        around = without_copies(before, candidate)[-AROUND:] + b"\n" + without_copies(after, candidate)[:AROUND] + b"\n"
        alone = len(self.compressor.compress(around))
        added = len(self.compressor.compress(around + candidate)) - alone
        if added >= PER_CHARACTER * len(candidate):
            return max(1.0, added / len(candidate))
        random = [len(self.compressor.compress(around + r)) - alone for r in random_like(candidate)]
        return added / max(1.0, float(np.median(random)))


def without_copies(text: bytes, candidate: bytes) -> bytes:
    """The text without the candidate and without the values in it, as in ``key=value``."""
    for part in {candidate, *(p for p in candidate.split(b"=") if len(p) >= CANDIDATE_LENGTH)}:
        text = text.replace(part, b" ")
    return text


_KINDS = [np.frombuffer(k, np.uint8) for k in (b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"!#$%&*@^")]


def random_like(candidate: bytes) -> list[bytes]:
    """Random strings of the candidate's length over its kinds of characters, the same each time; other signs stay in their places."""
    given = np.frombuffer(candidate, np.uint8)
    used = [np.isin(k, given).any() for k in _KINDS]
    used[1], used[3] = used[1] or used[2], used[3] or used[4]
    alphabet = np.concatenate([k for k, u in zip(_KINDS, used) if u])
    drawn = np.isin(given, np.concatenate(_KINDS))
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(candidate, digest_size=8).digest(), "big"))
    out = []
    for _ in range(DRAWS if len(given) < LONG else 1):
        made = given.copy()
        made[drawn] = rng.choice(alphabet, int(drawn.sum()))
        out.append(made.tobytes())
    return out


def _words(part: scan.Slice) -> dict[str, pa.Array]:
    """Words of a slice, how often they occur, and which hash values the words before them have, as bits."""
    starts, ends, bounds = part.spans(scan.NON_BLANK[part.data])
    if not len(starts):
        return {"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "behind": pa.array([], pa.int64())}
    hashes = part.hashes(part.prefix(False), starts, ends)
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
    before[bounds[:-1][bounds[:-1] < len(before)]] = 0
    fits = np.flatnonzero((ends - starts >= WORD_BYTES[0]) & (ends - starts <= WORD_BYTES[1]))
    _, first, word, n = np.unique(hashes[fits], return_index=True, return_inverse=True, return_counts=True)
    behind = np.zeros(len(first), dtype=np.uint64)
    np.bitwise_or.at(behind, word, np.uint64(1) << (before[fits] & np.uint64(63)))
    raw = part.data.tobytes()
    return {
        "word": pa.array([raw[starts[k] : ends[k]] for k in fits[first]], pa.binary()),
        "n": pa.array(n, pa.int64()), "behind": pa.array(behind.view(np.int64), pa.int64()),
    }


def identifiers(docs: DataFrame) -> DataFrame:
    """word (binary) and n, over all texts, of words that stand behind at least ``BEHIND`` different words."""

    def run(batches):
        for batch in batches:
            for part in scan.slices(batch.column("text")):
                found = _words(part)
                yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    counted = docs.select("text").mapInArrow(run, "word binary, n long, behind long").groupBy("word")
    return counted.agg(F.sum("n").alias("n"), F.bit_or("behind").alias("behind")).filter(F.bit_count("behind") >= BEHIND).drop("behind")


def dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifiers up to ``size`` bytes, the most frequent last, without what the patterns find; empty where there are none.

    Bytes are counted by level of frequency first.  All words of the levels
    that fit are fetched, and of the next one the share that fits, by hash.
    """
    level, length = F.floor(8 * F.log2("n")), F.octet_length("word") + 1
    words = cut(identifiers(docs).withColumn("level", level), "identifiers")
    sizes = words.groupBy("level").agg(F.sum(length).alias("bytes")).orderBy(F.desc("level")).collect()
    wanted, room = F.lit(False), size
    for r in sizes:
        wanted = F.col("level") > r.level
        if r.bytes > room:
            wanted |= (F.col("level") == r.level) & (chance("word") < room / r.bytes)
            break
        wanted, room = F.col("level") >= r.level, room - r.bytes
    found = sorted(words.filter(wanted).collect(), key=lambda r: (-r.n, bytes(r.word)))
    words = [ACCESS.sub(" ", ASSIGN.sub(" ", bytes(r.word).decode())) for r in found]
    clean = [re.sub("[0-9a-f]{16,}", " ", w).encode() for w in words]
    total = np.cumsum([len(w) + 1 for w in clean])
    return b"\n".join(reversed(clean[: int(np.searchsorted(total, size, side="right"))]))


def slice_spans(part: scan.Slice, novelty: Novelty) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with findings: (start, kind number, end) in characters, in order."""
    data, offsets = part.data, part.offsets
    place = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_FIRST[data], out=place[1:])
    found: dict[int, list[tuple[int, int, int]]] = {}

    def characters(row: int, start: int, end: int) -> tuple[int, int]:
        return int(place[start] - place[offsets[row]]), int(place[end] - place[offsets[row]])

    starts, ends, bounds = part.spans(_HEX[data])
    for k in np.flatnonzero(ends - starts >= HEX_LENGTH):
        row = int(np.searchsorted(bounds, k, side="right")) - 1
        a, b = characters(row, starts[k], ends[k])
        found.setdefault(row, []).append((a, 2, b))
    raw = data.tobytes()
    rows = set(np.flatnonzero(part.totals(_SIGN[data])).tolist())
    at = raw.find(b"AKIA")
    while at >= 0:
        rows.add(int(np.searchsorted(offsets, at, side="right")) - 1)
        at = raw.find(b"AKIA", at + 1)
    for row in rows:
        spans = pattern_spans(part.text(row).decode())
        if spans:
            found.setdefault(row, []).extend(spans)
    starts, ends, bounds = part.spans(_TOKEN[data])
    letters, symbols = (np.concatenate([[0], np.cumsum(table[data])]) for table in (_LETTER, _SYMBOL))
    letters, symbols = letters[ends] - letters[starts], symbols[ends] - symbols[starts]
    tokens = []
    for k in np.flatnonzero(letters + symbols >= np.where(symbols > 0, CANDIDATE_LENGTH, LETTERS_LENGTH)):
        token = raw[starts[k] : ends[k]]
        start = int(ends[k]) - len(token.lstrip(_OPENING))
        end = max(start, int(starts[k]) + len(token.rstrip(_CLOSING)))
        tokens.append((int(np.searchsorted(bounds, k, side="right")) - 1, start, end))

    reach: dict[int, tuple[list[int], np.ndarray]] = {}

    def known(row: int, b: int) -> bool:
        """A pattern found a span that begins before ``b`` and holds the character before it."""
        if row not in found:
            return False
        if row not in reach:
            spans = sorted(found[row])
            reach[row] = [x for x, _, _ in spans], np.maximum.accumulate([y for _, _, y in spans])
        starts, ends = reach[row]
        at = bisect_left(starts, b)
        return at > 0 and ends[at - 1] >= b

    novel: dict[int, set[bytes]] = {}
    for row, start, end in tokens:
        low, high = int(offsets[row]), int(offsets[row + 1])
        if not SENSITIVE.search(raw[max(low, start - CONTEXT) : start]):
            continue
        if ADDRESS.fullmatch(raw, start, end) or raw[start:end] in novel.get(row, ()) or known(row, characters(row, start, end)[1]):
            continue
        # Copies leave the surroundings, so these are taken wider by one: a copy that is cut off at the border would explain its other half.
        wide = AROUND + end - start
        if novelty(raw[max(low, start - wide) : start], raw[start:end], raw[end : min(high, end + wide)]) >= NOVELTY:
            novel.setdefault(row, set()).add(raw[start:end])
    more: dict[int, list[tuple[int, int, int]]] = {}
    for row, start, end in tokens if novel else ():
        if raw[start:end] in novel.get(row, ()):
            a, b = characters(row, start, end)
            if not known(row, b):
                more.setdefault(row, []).append((a, 3, b))
    return {row: sorted(found.get(row, []) + more.get(row, [])) for row in found.keys() | more.keys()}


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(docs: DataFrame, mark: str | None = None) -> DataFrame:
    """Add ``secrets``: (start, kind, end) in characters, by start and kind (numbers in ``KINDS``).

    With ``mark``, also ``clean``: where there are secrets, the text with the
    mark in their place.  A null text has none.  Columns of the added names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        novelty = Novelty(sent.value)
        for batch in batches:
            rows, clean = [], []
            for part in scan.slices(batch.column("text")):
                found = slice_spans(part, novelty)
                for i in range(part.last - part.first):
                    spans = found.get(i, [])
                    rows.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    if mark is not None:
                        clean.append(_marked(part.text(i).decode(), spans, mark) if spans else None)
            made = {"secrets": pa.array(rows, kind)} | ({"clean": pa.array(clean, pa.string())} if mark is not None else {})
            yield scan.with_columns(batch, made)

    added = {"secrets": SPANS} | ({"clean": T.StringType()} if mark is not None else {})
    return extended(docs, run, **added)


def _marked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with ``mark`` in the place of spans; overlapping ones share one."""
    kept, at = [], 0
    for start, _, end in spans:
        if start >= at:
            kept += [text[at:start], mark]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Digest per document: n_assign, n_access, n_hex, base_sha256 of the pattern matches, and all spans as text."""
    found = find(docs.select("doc_id", "text")).drop("text")
    names = F.array(*map(F.lit, KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in the place of every span; overlapping spans become one mark.  Other texts and columns stay as they are."""
    given, names = set_aside(docs, "secrets", "clean")
    found = find(given, mark)
    columns = {"text": F.coalesce("clean", "text")}
    if "n_chars" in docs.columns:
        length = F.length("clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("clean").isNotNull(), length).otherwise(F.col("n_chars"))
    return found.select(*[columns.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])
