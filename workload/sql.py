"""Oracle SQL fragments for the text and score functions, written independently of the Spark columns."""

from __future__ import annotations

from forage.functions import fixed


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def strings(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def squish(q: str) -> str:
    return rf"regexp_replace({q}, '^\s+|\s+$', '', 'g')"


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def latin_tokens(q: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower({q}), '[\s\-_,./]+'), "
        f"lambda w: w <> '' AND w NOT IN {in_list(fixed.STOPWORDS_EN)})"
    )


def form_map() -> str:
    pairs = {f.lower(): label for label, forms in fixed.DIET_SYNONYMS.items() for f in [label, *forms]}
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in pairs.items()) + "}"


def forms_map() -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {strings([k, *v])}" for k, v in fixed.DIET_SYNONYMS.items()) + "}"


def canonical_list(tokens: str) -> str:
    return f"list_filter(list_transform({tokens}, lambda t: {form_map()}[lower(t)]), lambda l: l IS NOT NULL)"


def expanded_list(tokens: str) -> str:
    """All tokens with dictionary words replaced by their forms; duplicates still inside."""
    return f"flatten(list_transform({tokens}, lambda t: coalesce({forms_map()}[{form_map()}[lower(t)]], [t])))"


def analyze(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def analyze_mixed(text: str) -> str:
    """``analyze`` for text that may hold CJK runs, which become character pairs."""
    spaced = f"regexp_replace({text}, '([一-鿿]+)', ' \\1 ', 'g')"
    pairs = "list_transform(range(1, greatest(len(w), 2)), lambda k: substring(w, k, 2))"
    return f"flatten(list_transform({analyze(spaced)}, lambda w: CASE WHEN regexp_matches(w, '^[一-鿿]+$') THEN {pairs} ELSE [w] END))"


def words(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split({column}, ',') END"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"2 * 6371.0 * asin(least(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)), 1.0))"
    )


def diet_score(labels: str, allergens: str, free: str, wanted: str, avoided: str) -> str:
    hit = lambda a, b: f"len(list_filter({a}, lambda v: list_contains({b}, v)))"
    return f"greatest({hit(wanted, labels)} + 0.5e0 * {hit(avoided, free)} - 2e0 * {hit(avoided, allergens)}, -2e0)"


def rating_score(rating: str) -> str:
    return f"CASE WHEN {rating} IS NULL THEN 0.5e0 ELSE least(greatest({rating} / 5e0, 0e0), 1e0) END"


def distance_score(km: str) -> str:
    return f"CASE WHEN {km} IS NULL THEN 0.5e0 ELSE exp(-pow({km} / 2e0, 2) / 2) END"


def weights() -> str:
    rows = ", ".join(
        f"({quote(m)}, {w['text']}e0, {w['diet']}e0, {w['rating']}e0, {w['distance']}e0)" for m, w in fixed.SORT_MODES.items()
    )
    return f"(SELECT * FROM (VALUES {rows}) v(mode, w_text, w_diet, w_rating, w_dist))"


def nearest_word(token: str) -> str:
    """Best vocabulary word within two edits, as a scalar subquery over the literal vocabulary."""
    vocab = ", ".join(f"({quote(w)}, {i})" for i, w in enumerate(fixed.SPELL_VOCABULARY))
    return (
        f"CASE WHEN lower({token}) IN {in_list(fixed.SPELL_VOCABULARY)} THEN NULL ELSE "
        f"(SELECT word FROM (VALUES {vocab}) v(word, place) WHERE levenshtein(lower({token}), word) <= 2 "
        f"ORDER BY levenshtein(lower({token}), word), place LIMIT 1) END"
    )


def rule_list(text: str, rules) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {quote(p)}, 'i') THEN {quote(l)} END" for p, l in rules)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def to_fixed(value: str) -> str:
    """One decimal as text; exact quarter ties go up."""
    return f"printf('%.1f', CASE WHEN ({value}) * 4 % 2 = 1 THEN ({value}) + 0.01e0 ELSE ({value}) END)"
