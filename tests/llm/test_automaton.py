import hashlib
import random
import re

from forage.llm import automaton
from forage.llm.automaton import SuffixAutomaton, item_words
from tests.llm.conftest import CLASHING


def brute(text, items, width=10):
    words = re.findall(automaton.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        w = re.findall(automaton.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in item_text or ""))
        n = min(width, len(w))
        if not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    ids = ",".join(sorted(str(x) for x in found if x is not None))
    return len(words), len(hit), len({x for x in found if x is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14, 25])))) for k in range(12)]
    items += [(100, ""), (101, None), (102, "Solo"), (3, items[5][1]), (None, "kl mn op qr st uv wx yz ab cd ef")]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "x SOLO, y"), (53, items[4][1].upper().replace(" ", "--")), (53, items[4][1]), (54, "kl mn op qr st uv wx yz ab cd tail"), (55, "é" * 10)]
    return docs, items


def check(spark, documents, block_words, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(automaton, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(automaton.match, "__defaults__", (automaton.WIDTH, None, block_words))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in automaton.contamination(documents(docs, CLASHING), table).collect())
    assert got == sorted((k, *brute(t, items)) for k, t in docs)


def test_contamination_equals_brute_force(spark, documents, monkeypatch):
    check(spark, documents, automaton.BLOCK_WORDS, monkeypatch)


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    check(spark, documents, 40, monkeypatch)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in automaton.contamination(documents([(1, "a b")]), none).collect()] == [False]
    assert automaton.contamination(documents([]), none).count() == 0


def test_spans_are_cut_and_covered_texts_dropped(spark, documents):
    item = " ".join(f"w{k}" for k in range(12))
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "Some, other words!\n" * 10
    docs = documents([(1, clean + item + " end."), (2, item), (3, clean), (4, None)], ["hits", "n_words"])
    rows = {r.doc_id: r for r in automaton.decontaminate(docs, table).collect()}
    assert set(rows) == {1, 3, 4}
    assert rows[1].text == clean + " end." and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text == clean and rows[3].hits == "x"
    assert rows[4].text is None


def test_automaton_knows_all_substrings_of_all_items():
    items = [("a", item_words("x y x y z")), ("b", item_words("y x y"))]
    machine = SuffixAutomaton(items, 2)
    ids = [machine.vocabulary[w] for w in item_words("z y x y")]
    assert sorted((end, size, tuple(sorted(found))) for end, size, found in machine.matches(ids)) == [(3, 2, ("a", "b")), (4, 2, ("a", "b"))]


def test_texts_of_short_items_are_dropped(spark, documents):
    table = spark.createDataFrame([("s", "what is the capital of france"), ("t", "name the longest river")], "item_id string, text string")
    texts = ["What is the capital of France?", "Name the longest river. What is the capital of France?", "so he asked what is the capital of france and then went on to speak of it"]
    rows = {r.doc_id: r.text for r in automaton.decontaminate(documents(list(enumerate(texts))), table).collect()}
    assert rows == {2: texts[2]}
