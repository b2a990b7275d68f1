import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import types as T

from forage.llm import turn_repair as tr
from tests.llm.conftest import CLASHING

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BLANKS = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows, extra=()):
        schema = T.StructType([*CONV.fields, *(T.StructField(n, T.StringType()) for n in extra)])
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], schema)

    return make


def in_order(initials):
    if not initials:
        return True
    rest = initials[1:] if initials[0] == "s" else initials
    return len(rest) >= 2 and len(rest) % 2 == 0 and all(c == "ua"[k % 2] for k, c in enumerate(rest))


def exhaustive(codes, most=2):
    """All edits of a few rows with up to ``most`` turns put in at each place."""
    row_ways = []
    for code in codes:
        extra = 5 if code & tr.SHORT else 0
        ways = [("D", 2, "")]
        if not code & tr.GONE:
            ways += [("K", extra, "sua?"[code & 3]), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        row_ways.append(ways)
    puts = [[("I" * n, 5 * n, "".join(p)) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]] * (len(codes) + 1)
    slots = [s for pair in itertools.zip_longest(puts, row_ways) for s in pair if s is not None]
    best = None
    for choice in itertools.product(*slots):
        if in_order("".join(c[2] for c in choice)):
            key = (sum(c[1] for c in choice), "".join(c[0] for c in choice))
            best = key if best is None or key < best else best
    return best


def forward(codes):
    """Least (cost, letters) for each state, from first to last."""
    inf = 10**9
    puts = lambda z: [z[0], z[1], min(z[2], *((z[k][0] + 5, z[k][1] + "I") for k in (0, 1, 3))), z[3]]

    def closed(z):
        z = puts(z)
        z[3] = min(z[3], (z[2][0] + 5, z[2][1] + "I"))
        return z

    z = closed([(0, ""), (inf, ""), (inf, ""), (inf, "")])
    for code in codes:
        ways = [[] for _ in range(4)]
        for q in range(4):
            for letter, cost, to in tr._edits(code, q):
                ways[to].append((z[q][0] + cost, z[q][1] + letter))
        z = closed([min(w, default=(inf, "")) for w in ways])
    return min(z[0], z[3])


CODES = [0, 1, 2, 3, 1 | tr.SHORT, 2 | tr.SHORT, 0 | tr.SHORT, 1 | tr.GONE]


def test_solve_equals_all_edits():
    for codes in itertools.chain([()], itertools.product(CODES, repeat=1), itertools.product(CODES, repeat=2)):
        assert tr.solve(bytes(codes)) == exhaustive(codes)
    rng = random.Random(2)
    for _ in range(25):
        codes = [rng.choice(CODES) for _ in range(3)]
        assert tr.solve(bytes(codes)) == exhaustive(codes)


def test_solve_equals_forward_search():
    rng = random.Random(1)
    for n in [*range(4, 60), 400, 401]:
        codes = [rng.choice(CODES) for _ in range(n)]
        assert tr.solve(bytes(codes)) == forward(codes)


def test_long_conversation_holds_few_vectors():
    codes = bytes(random.Random(4).choice(CODES) for _ in range(200_000))
    cost, audit = tr.solve(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost > 0
    assert tr.before.cache_info().currsize < 5000


def brute(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        out = damaged.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(kind, 1)
    found = []
    for conv, out in damaged.items():
        out.sort()
        seen, codes = set(), []
        for _, _, role, _, text in out:
            code, bare = "sua".find(role[:1]) % 4 if role else 3, text.strip(BLANKS)
            if not bare:
                code |= tr.GONE | tr.BLANK
            elif (role, text) in seen:
                code |= tr.GONE
            elif bare[-1] not in ".!?":
                code |= tr.SHORT
            seen.add((role, text))
            codes.append(code)
        cost, audit = forward(codes)
        rest, lines, kept = list(out), [], audit.replace("D", "")
        for letter in audit:
            row = None if letter == "I" else rest.pop(0)
            if letter != "D":
                own = ("assistant", "user")[(len(lines) + 1 - len(kept) % 2) % 2]
                lines.append(f"{row[2] if letter == 'K' else own}:{row[4] if row else ''}")
        turns = {t for d, t, *_ in out if d}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        count = lambda test: sum(map(test, codes))
        figures = (gaps, count(lambda c: c & tr.BLANK > 0), count(lambda c: c & tr.GONE and not c & tr.BLANK), count(lambda c: c & tr.SHORT > 0), illegal, cost)
        found.append((conv, *figures, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def result(frame):
    return sorted(((r.conv_id, *(r[c] for c in tr.FIGURES), r.audit, r.repaired_sha256) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(9)
    texts = ["Hello.", "Yes!", "no", "", " \n", "Why?", "Why? \t", None, "été.", "a\nb."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 12)):
            if rng.random() < 0.85:
                rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "User"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(None, k, ["user", "assistant"][k % 2], f"n{k}.") for k in range(6)] + [(500, None, "user", "a."), (500, None, "assistant", "b."), (500, None, None, None), (500, 3, "user", "a.")]
    rows += [(501, None, "user", "x.")] * 3 + [(502, 1, "user", "x.")] * 4 + [(502, 2, "user", "x.")] * 3
    rows += [(600, k, ["user", "assistant"][k % 2], f"turn {k % 700}.") for k in range(3000)] + [(601, 0, "user", "w " * 500_000 + "."), (601, 1, "assistant", "é" * 500_000)]
    rows += [(700, 10**12, "user", "far."), (700, -5, "assistant", "near.")]
    rng.shuffle(rows)
    return rows


def test_digest_equals_brute_force(conversations, mixed):
    assert result(tr.digest(conversations(mixed, CLASHING).repartition(6))) == brute(mixed)


def test_one_large_conversation_is_sorted_in_parts(spark, conversations, mixed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(tr.digest(conversations(mixed[::-1]).repartition(3))) == brute(mixed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_in_order(conversations, mixed):
    rows = conversations(mixed)
    found = {}
    for r in tr.repaired(rows, tr.audits(rows)).collect():
        found.setdefault(r.conv_id, []).append(r)
    for turns in found.values():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(1, len(turns) + 1))
        assert in_order("".join(r.role[:1] for r in turns))
        assert all((r.text == "" and r.turn is None) or r.edit in "KR" for r in turns)


def test_empty_table_and_dropped_conversation(conversations):
    assert tr.digest(conversations([])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(tr.digest(conversations([(gone, 0, "user", "a.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
