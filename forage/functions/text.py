"""Column functions for search text: language, tokens, synonyms, spelling.

Everything works inside one row on array columns, so a table of queries is
processed in a single narrow stage without exploding and regrouping.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from forage.functions import fixed

CJK = "一-鿿"
WORD_BREAK = r"[^\p{L}\p{N}]+"
QUERY_BREAK = r"[\s\-_,./]+"


def _strings(values) -> Column:
    """A literal array; one JSON constant that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _lookup(mapping: dict) -> Column:
    """A literal map of text to text, or to a list of texts."""
    kind = "array<string>" if any(isinstance(v, list) for v in mapping.values()) else "string"
    return F.from_json(F.lit(json.dumps(mapping)), f"map<string,{kind}>")


def squish(text: Column) -> Column:
    """Strip white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def detect_language(query: Column) -> Column:
    """``zh`` when more than 30 % of the characters are CJK, else ``en``."""
    share = F.regexp_count(query, F.lit(f"[{CJK}]")) / F.greatest(F.char_length(query), F.lit(1))
    return F.when(share > 0.3, F.lit("zh")).otherwise(F.lit("en"))


def latin_tokens(query: Column, stopwords=fixed.STOPWORDS_EN) -> Column:
    words = F.split(F.lower(query), QUERY_BREAK)
    return F.filter(words, lambda w: (w != "") & ~w.isin(list(stopwords)))


def bigrams(run: Column) -> Column:
    """Overlapping character pairs; a single character stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.char_length(run) < 2, F.array(run)).otherwise(pairs)


def _is_cjk(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]+$")


def cjk_tokens(query: Column, stopwords=fixed.STOPWORDS_ZH, dictionary=None) -> Column:
    """Dictionary forms found in the text by position, then character bigrams and other words."""
    if dictionary is None:
        dictionary = [f for forms in fixed.DIET_SYNONYMS.values() for f in forms if "一" <= f[0] <= "鿿"]
        dictionary += [c for name in fixed.CUISINE_NAMES.values() for c in name.split("/")]
        dictionary = list(dict.fromkeys(dictionary))
    found = F.filter(_strings(dictionary), lambda f: F.contains(query, f))
    placed = F.array_sort(
        F.transform(found, lambda f: F.struct(F.position(f, query).alias("at"), f.alias("form")))
    )
    forms = F.transform(placed, lambda p: p["form"])
    runs = F.regexp_extract_all(query, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    pieces = F.flatten(F.transform(runs, lambda r: F.when(_is_cjk(r), bigrams(r)).otherwise(F.array(r))))
    return F.filter(F.array_distinct(F.concat(forms, pieces)), lambda t: ~t.isin(list(stopwords)))


def query_tokens(query: Column) -> Column:
    text = squish(query)
    return F.when(detect_language(text) == "zh", cjk_tokens(text)).otherwise(latin_tokens(text))


def analyze(text: Column) -> Column:
    """Index-side terms: lower-case words, with CJK runs cut to bigrams."""
    words = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")
    spaced = F.filter(
        F.split(F.regexp_replace(F.lower(text), f"([{CJK}]+)", " $1 "), WORD_BREAK), lambda w: w != ""
    )
    mixed = F.flatten(F.transform(spaced, lambda w: F.when(_is_cjk(w), bigrams(w)).otherwise(F.array(w))))
    terms = F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(words)
    return F.coalesce(terms, F.array().cast("array<string>"))


# --- synonyms ---------------------------------------------------------------


def synonym_index(synonyms: dict[str, list[str]] = fixed.DIET_SYNONYMS) -> dict[str, str]:
    """Lower-case form -> canonical label; a later entry wins."""
    return {form.lower(): label for label, forms in synonyms.items() for form in [label, *forms]}


def canonical_label(token: Column, synonyms=fixed.DIET_SYNONYMS) -> Column:
    return F.try_element_at(_lookup(synonym_index(synonyms)), F.lower(token))


def detected_labels(tokens: Column, synonyms=fixed.DIET_SYNONYMS) -> Column:
    """Canonical labels in first-seen order."""
    return F.array_distinct(F.array_compact(F.transform(tokens, lambda t: canonical_label(t, synonyms))))


def expand_tokens(tokens: Column, synonyms=fixed.DIET_SYNONYMS) -> Column:
    """Replace a dictionary token by its label and every form; keep first-seen order.

    A second token of the same label adds nothing new, so plain order-keeping
    deduplication also covers the once-per-label rule.
    """
    forms = _lookup({label: [label, *others] for label, others in synonyms.items()})
    return F.array_distinct(
        F.flatten(
            F.transform(
                tokens,
                lambda t: F.coalesce(F.try_element_at(forms, canonical_label(t, synonyms)), F.array(t)),
            )
        )
    )


def merge_phrases(tokens: Column, synonyms=fixed.DIET_SYNONYMS) -> Column:
    """Join neighbouring tokens that form a two- or three-word dictionary form.

    Longest form first, left to right; optional step before synonym lookup so
    that ``gluten-free`` or ``low carb`` are recognised.
    """
    known = _lookup({f: f for f in synonym_index(synonyms)})

    def form(start: Column, width: int) -> Column:
        words = F.slice(tokens, start, F.lit(width))
        hit = F.coalesce(
            F.try_element_at(known, F.array_join(words, " ")), F.try_element_at(known, F.array_join(words, "-"))
        )
        return F.when(start + width - 1 <= F.size(tokens), hit)

    def step(state: Column, i: Column) -> Column:
        three, two = form(i, 3), form(i, 2)
        token = F.coalesce(three, two, F.get(tokens, i - 1))
        skip = F.when(three.isNotNull(), 2).when(two.isNotNull(), 1).otherwise(0)
        return F.when(
            state["skip"] > 0, F.struct((state["skip"] - 1).alias("skip"), state["out"].alias("out"))
        ).otherwise(F.struct(skip.alias("skip"), F.concat(state["out"], F.array(token)).alias("out")))

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))
    merged = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, lambda s: s["out"])
    return F.when(F.size(tokens) > 1, merged).otherwise(tokens)


def active_labels(requested: Column, detected: Column) -> Column:
    """Requested labels first, then those detected in the text."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(requested, empty), F.coalesce(detected, empty)))


# --- spelling ---------------------------------------------------------------


def suggest_word(token: Column, vocabulary=fixed.SPELL_VOCABULARY) -> Column:
    """Nearest vocabulary word within two edits; null for known words.  Ties go to list order."""
    word = F.lower(token)
    ranked = F.transform(
        _strings(vocabulary),
        lambda v, i: F.struct(
            F.levenshtein(word, v, fixed.SPELL_MAX_DISTANCE).alias("distance"), i.alias("place"), v.alias("word")
        ),
    )
    # the bounded distance is -1 beyond the bound
    near = F.filter(ranked, lambda r: r["distance"] >= 0)
    return F.when(~word.isin(list(vocabulary)), F.array_min(near)["word"])


def correct_query(query: Column, vocabulary=fixed.SPELL_VOCABULARY) -> Column:
    """Query with misspelt words replaced, or null when nothing changes.

    Alphabetic tokens only; replacements run in token order over whole words,
    ignoring case, each on the result of the one before.
    """
    words = F.filter(F.split(query, r"\s+"), lambda t: t.rlike(r"^\p{L}+$"))
    edits = F.filter(
        F.transform(words, lambda t: F.struct(t.alias("was"), suggest_word(t, vocabulary).alias("now"))),
        lambda e: e["now"].isNotNull(),
    )
    fixed_text = F.aggregate(
        edits,
        query,
        lambda text, e: F.regexp_replace(
            text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), e["was"], F.lit(r"(?![\p{L}\p{N}_])")), e["now"]
        ),
    )
    # a one-element array holds the text, so that it is worked out once
    changed = F.transform(F.array(fixed_text), lambda t: F.when(F.lower(t) != F.lower(query), t))
    return F.get(changed, F.lit(0))
