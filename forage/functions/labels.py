"""Rule labels: which diet, allergen and allergen-free rules a text fires."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F



def _empty() -> Column:
    return F.array().cast("array<string>")


# A stricter alternative to the default allergen rules: whole words only, and a
# "-free" claim is not a mention of the allergen.
_NOT_FREE = r"(?![\s-]?free)"
STRICT_ALLERGEN_RULES = [
    (rf"花生|\bpeanuts?\b{_NOT_FREE}", "peanut"),
    (rf"(?<!无|含)坚果|核桃|腰果|杏仁|\b(tree[\s-]?)?nuts?\b{_NOT_FREE}", "tree_nut"),
    (rf"牛奶|奶酪|\b(cheese|dairy|milk|lactose)\b{_NOT_FREE}", "dairy"),
    (rf"(?<!无|含)(麸质|小麦)|面筋|\b(gluten|wheat)\b{_NOT_FREE}", "gluten"),
    (rf"海鲜|虾|蟹|(?<!无|含)贝类|\b(shellfish|shrimps?|crabs?)\b{_NOT_FREE}", "shellfish"),
    (rf"(?<!无|含)大豆|豆腐|\b(soy|tofu)\b{_NOT_FREE}", "soy"),
    (rf"鸡蛋|\beggs?\b{_NOT_FREE}", "egg"),
    (rf"芝麻|\bsesame\b{_NOT_FREE}", "sesame"),
]


def _is_cjk(text: str) -> bool:
    return all("一" <= c <= "鿿" for c in text)


def matches_rule(lowered: Column, has_cjk: Column, pattern: str) -> Column:
    """One rule as a predicate on lower-case text.

    Cheap tests come first: plain alternatives are substring tests, Chinese ones
    are tried only on text with Chinese characters, and an alternative with
    pattern characters runs only where its literal opening occurs.
    """
    if re.search(r"[()\[\]\\]", pattern):
        return lowered.rlike(_LINES + pattern)
    latin, cjk = [], []
    for part in pattern.split("|"):
        opening = re.match(r"[^.*+?^${}]*", part).group()
        if opening == part:
            (cjk if _is_cjk(part) else latin).append(F.contains(lowered, F.lit(part)))
        elif part[len(opening)] == "." and part[len(opening) + 1 : len(opening) + 2] not in ("*", "+", "?", "{"):
            latin.append(F.contains(lowered, F.lit(opening)) & lowered.rlike(_LINES + part))
        else:
            latin.append(lowered.rlike(_LINES + part))
    tests = latin + ([has_cjk & reduce(or_, cjk)] if cjk else [])
    return reduce(or_, tests)


# only a line feed ends a line, as in the rules' origin
_LINES = "(?d)"


def rule_labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all rules found in the text, ignoring case, in rule order."""
    return lowered_labels(F.lower(text), has_cjk(text), rules)


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def lowered_labels(lowered: Column, cjk: Column, rules: list[tuple[str, str]]) -> Column:
    """``rule_labels`` for text that is lower-case already."""
    fired = F.array(*[F.when(matches_rule(lowered, cjk, pattern), F.lit(label)) for pattern, label in rules])
    return F.array_distinct(F.array_compact(fired))


def labelling_text(name: Column, description: Column, cuisine: Column, tags: Column, item_names: Column) -> Column:
    """Non-empty parts joined by a space, then the name of every menu item."""
    blank = F.lit("")
    return F.concat_ws(
        " ",
        F.nullif(name, blank),
        F.nullif(description, blank),
        F.nullif(cuisine, blank),
        F.nullif(F.array_join(tags, " "), blank),
        item_names,
    )


def merge_labels(given: Column, inferred: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(given, _empty()), F.coalesce(inferred, _empty())))


def without(labels: Column, present: Column) -> Column:
    """Declared-free labels that are not contradicted by a present allergen."""
    return F.array_sort(F.array_except(labels, present))
