"""Restaurant search for a whole table of requests.

Requests that ask for the same thing (same terms, filters and place) form one
*need*.  Retrieval, filters, facets and totals run per need, so a query typed a
million times is scored once; paging, weights and personal allergens are then
applied per request.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forage.functions import fixed, scores, text
from forage.functions.display import page_number
from forage.operators import facets as facet_ops
from forage.operators import geo, retrieval
from forage.operators.topk import top_rows
from forage.operators.validate import check_requests, split_valid, with_problems
from forage.session import cut

ATTRIBUTES = [
    "restaurant_id", "cuisine_type", "price_level", "rating", "geo", "diet_labels", "allergens", "allergen_free",
]
NEED_COLUMNS = ["terms", "n_groups", "labels", "price_levels", "lat", "lng", "radius_km"]


class Search:
    """Answers to one table of requests; each result is planned when it is first asked for."""

    def __init__(self, requests: DataFrame, rejected: DataFrame, candidates: DataFrame, deepest: int, rerank_scope: str, cached: tuple[DataFrame, ...]):
        self.requests = requests
        #: Requests that are not answered, with their ``problems``.
        self.rejected = rejected
        self.candidates = candidates
        self._deepest, self._scope, self._cached = deepest, rerank_scope, cached

    @cached_property
    def hits(self) -> DataFrame:
        """The requested page of every request, in final order."""
        return page_and_rerank(self.requests, self.candidates, self._deepest, self._scope)

    @cached_property
    def facets(self) -> DataFrame:
        """(query_id, facet, key, n) over all hits of a request, not only its page."""
        counts = facet_ops.facet_counts(self.candidates)
        return self.requests.select("query_id", "need").join(counts, "need").drop("need", "position")

    @cached_property
    def summary(self) -> DataFrame:
        """One row per request: totals, pages and text analysis."""
        return summarise(self.requests, self.candidates)

    def release(self) -> None:
        """Drop cached rows once the results have been written."""
        for frame in self._cached:
            frame.unpersist()


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def parse_requests(requests: DataFrame, phrases: bool = False, synonyms=fixed.DIET_SYNONYMS) -> DataFrame:
    """Add language, tokens, labels, spelling and the need key to request rows."""
    raw = F.coalesce(F.col("q"), F.lit(""))
    tokens = text.query_tokens(raw)
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    # a radius of 0 or none means the default
    radius = F.coalesce(F.nullif("radius_km", F.lit(0.0)), F.lit(5.0))
    return (
        requests.withColumns(
            {
                "spell_suggestion": text.correct_query(raw),
                "has_text": raw != "",
                "language": text.detect_language(text.squish(raw)),
                "tokens": text.merge_phrases(tokens, synonyms) if phrases else tokens,
                "price_levels": F.coalesce(F.col("price_levels"), _empty("int")),
                "radius_km": F.when(placed, radius),
                "lat": F.when(placed, F.col("lat")),
                "lng": F.when(placed, F.col("lng")),
            }
        )
        .withColumns(
            {
                "detected_labels": text.detected_labels(F.col("tokens"), synonyms),
                "query_tokens": text.expand_tokens(F.col("tokens"), synonyms),
            }
        )
        .withColumns(
            {
                "labels": text.active_labels(F.col("diet_labels"), F.col("detected_labels")),
                "terms": _request_terms(synonyms),
            }
        )
        .withColumn("n_groups", F.size(F.array_distinct(F.col("terms.group"))))
        .withColumn("need", F.sha2(F.to_json(F.struct(*NEED_COLUMNS)), 256))
    )


def _request_terms(synonyms) -> Column:
    """Search terms with the number of the word group each came from.

    All forms of one label share a group, so that ``expansion="grouped"`` can
    count a synonym set once.
    """
    label_of = F.transform(
        F.col("query_tokens"),
        lambda t: F.struct(t.alias("token"), F.coalesce(text.canonical_label(t, synonyms), t).alias("word")),
    )
    return F.flatten(
        F.transform(
            label_of,
            lambda p: F.transform(
                text.analyze(p["token"]),
                lambda term: F.struct(
                    F.array_position(F.array_distinct(F.transform(label_of, lambda o: o["word"])), p["word"])
                    .cast("int")
                    .alias("group"),
                    term.alias("term"),
                ),
            ),
        )
    )


def page_end() -> Column:
    """Last rank that a request asks for; 0 for an empty page."""
    return F.when(F.col("limit") > 0, F.col("offset") + F.col("limit")).otherwise(0)


def deepest_page(parsed: DataFrame) -> int:
    """Last rank that any request asks for."""
    return int(parsed.agg(F.coalesce(F.max(page_end()), F.lit(0))).first()[0])


def distinct_needs(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("need").agg(*[F.first(c).alias(c) for c in NEED_COLUMNS])


def passes_filters(place_lat: Column, place_lng: Column) -> Column:
    """Any-of labels, price list and radius; an absent filter lets everything through."""
    labels = (F.size("labels") == 0) | F.arrays_overlap("labels", F.coalesce(F.col("diet_labels"), _empty("string")))
    price = (F.size("price_levels") == 0) | F.coalesce(F.array_contains(F.col("price_levels"), F.col("price_level")), F.lit(False))
    near = F.col("lat").isNull() | F.coalesce(
        geo.within(F.col("lat"), F.col("lng"), F.col("radius_km"), place_lat, place_lng), F.lit(False)
    )
    return labels & price & near


def match_all(needs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Needs without terms: every document that passes the filters, at score 1.

    Each need reaches its documents through its most selective filter: grid
    cells, then labels, then price levels, and only the one need without any
    filter through a key that all documents share, where there is such a need.  Identical needs are
    already merged, so the number of needs per key is bounded by the number of
    distinct filter combinations.
    """
    tagged = lambda mark, values: F.transform(values, lambda v: F.concat(F.lit(mark), v.cast("string")))
    access = (
        F.when(F.col("lat").isNotNull(), tagged("g", geo.cells_around(F.col("lat"), F.col("lng"), F.col("radius_km"))))
        .when(F.size("labels") > 0, tagged("l", F.col("labels")))
        .when(F.size("price_levels") > 0, tagged("p", F.array_distinct("price_levels")))
        .otherwise(F.array(F.lit("*")))
    )
    left = needs.filter(F.size("terms") == 0).withColumn("access", F.explode(access))
    place = geo.cells_of(F.col("geo.lat"), F.col("geo.lng"), F.col("_levels"))
    # documents offer keys of the kinds that some need uses, so often not the one they all share
    used = left.agg(F.collect_set(F.substring("access", 1, 1)).alias("kinds")).scalar()
    offered = [
        F.when(F.array_contains("_kinds", kind) & there, keys).otherwise(_empty("string"))
        for kind, there, keys in (
            ("g", F.col("geo.lat").isNotNull() & F.col("geo.lng").isNotNull(), tagged("g", place)),
            ("l", F.lit(True), tagged("l", F.array_distinct(F.coalesce(F.col("diet_labels"), _empty("string"))))),
            ("p", F.col("price_level").isNotNull(), tagged("p", F.array("price_level"))),
            ("*", F.lit(True), F.array(F.lit("*"))),
        )
    ]
    right = attributes.withColumns({"_kinds": used, "_levels": geo.levels_in(left)})
    right = right.withColumn("access", F.explode(F.concat(*offered))).drop("_kinds", "_levels")
    # a document reached through several wanted labels counts through the first one
    shared = F.array_intersect("labels", F.coalesce(F.col("diet_labels"), _empty("string")))
    once = ~F.col("access").startswith("l") | (F.col("access") == F.concat(F.lit("l"), F.get(shared, F.lit(0))))
    return (
        right.join(left, "access")
        .filter(once & passes_filters(F.col("geo.lat"), F.col("geo.lng")))
        .withColumn("text_score", F.lit(1.0))
    )


def find_candidates(
    needs: DataFrame,
    terms: DataFrame,
    found: DataFrame,
    catalog: DataFrame,
    expansion: str = "flat",
) -> DataFrame:
    """(need, document attributes, text_score, km) of every matching document."""
    attributes = catalog.select(*ATTRIBUTES)
    with_terms = needs.filter(F.size("terms") > 0)
    scores_by_field = retrieval.field_scores(terms, found, expansion)
    scored = retrieval.best_field(scores_by_field, len(retrieval.FIELDS), expansion)
    by_text = (
        scored.join(attributes, "restaurant_id")
        .join(with_terms, "need")
        .filter(passes_filters(F.col("geo.lat"), F.col("geo.lng")))
    )
    columns = ["need", *ATTRIBUTES, "text_score", "lat", "lng"]
    found = by_text.select(*columns).unionByName(match_all(needs, attributes).select(*columns))
    km = F.when(
        F.col("lat").isNotNull() & F.col("geo").isNotNull(),
        scores.haversine_km(F.col("lat"), F.col("lng"), F.col("geo.lat"), F.col("geo.lng")),
    )
    return found.withColumn("km", km).drop("lat", "lng")


def _diet_score(avoided: Column) -> Column:
    return scores.diet_score(F.col("diet_labels"), F.col("allergens"), F.col("allergen_free"), F.col("labels"), avoided)


def with_signals(rows: DataFrame) -> DataFrame:
    """Ranking signals, final score, distance and triggered allergens of (request, document) rows."""
    signals = rows.withColumns(
        {
            "diet_score": _diet_score(F.col("user_allergens")),
            "rating_score": scores.rating_score(F.col("rating")),
            "distance_score": scores.distance_score(F.col("km")),
            "distance_m": scores.distance_m(F.col("km")),
            "allergen_warning": scores.triggered_allergens(F.col("user_allergens"), F.col("allergens")),
        }
    )
    return signals.withColumn("final_score", _final(F.col("diet_score")))


def _final(diet: Column) -> Column:
    """Final score of rows with their other signals."""
    final = scores.final_score(F.col("sort_mode"), F.col("text_score"), diet, scores.rating_score(F.col("rating")), scores.distance_score(F.col("km")))
    return F.round(final, retrieval.SCORE_DIGITS)


def within_reach(candidates: DataFrame, rankings: DataFrame, deepest: int) -> DataFrame:
    """Candidates of each (need, sort_mode) that can be on a page of some ranking of it.

    ``rankings`` has need, sort_mode, labels, user_allergens and ``_end``.
    Allergens of a user are all that rankings of one need and mode differ in.
    With a of them a diet score lies between the one without users less 2a (-2
    at the least) and that plus a / 2, and the final score never falls as the
    diet score rises.  So the k-th best lower bound is reached by k candidates
    in every ranking, and one whose upper bound is below it is on no first k
    places.
    """
    modes = rankings.groupBy("need", "sort_mode").agg(F.first("labels").alias("labels"), F.max(F.size("user_allergens")).alias("_most"), F.max("_end").alias("_end"))
    modes = cut(modes, "modes")  # few rows, if few needs: their join then deals no candidates by need
    plain = _diet_score(_empty("string"))
    rows = candidates.join(modes, "need").withColumns(
        {"_low": _final(F.greatest(plain - 2.0 * F.col("_most"), F.lit(-2.0))), "_high": _final(plain + 0.5 * F.col("_most"))}
    )
    narrow = rows.select("need", "sort_mode", "restaurant_id", "_low", "_end")
    best = top_rows(narrow, ["need", "sort_mode"], [F.desc("_low"), F.asc("restaurant_id")], "_end", deepest, "restaurant_id")
    reached = cut(best.filter(F.col("position") == F.col("_end")).select("need", "sort_mode", F.col("_low").alias("_reached")), "reached")
    kept = rows.join(reached, ["need", "sort_mode"], "left").filter(F.col("_reached").isNull() | (F.col("_high") >= F.col("_reached")))
    return kept.drop("_low", "_high", "_most", "_end", "_reached", "labels")


def page_and_rerank(parsed: DataFrame, candidates: DataFrame, deepest: int, rerank_scope: str = "page") -> DataFrame:
    """The requested page of every request.

    ``page``: cut the page by text score, then order that page by final score.
    ``all``: order every candidate by final score, then cut the page.
    Every need and request is cut at its own last rank; ``deepest`` is the largest.
    """
    asked = parsed.select("query_id", "need", F.coalesce("sort_mode", F.lit("default")).alias("sort_mode"), "offset", "limit", "labels", "user_allergens", page_end().alias("_end"))
    by_final = [F.desc("final_score"), F.desc("text_score"), F.asc("restaurant_id")]
    if rerank_scope == "all":
        # requests of one need, mode and set of allergens have one ranking
        key = F.sha2(F.to_json(F.struct("need", "sort_mode", F.array_sort("user_allergens").alias("avoided"))), 256)
        asked = asked.withColumn("_ranking", key)
        rankings = asked.groupBy("_ranking", "need", "sort_mode").agg(F.first("labels").alias("labels"), F.first("user_allergens").alias("user_allergens"), F.max("_end").alias("_end"))
        rankings = cut(rankings.filter("_end > 0"), "rankings")
        rows = with_signals(within_reach(candidates, rankings, deepest).join(rankings, ["need", "sort_mode"]))
        ranked = top_rows(rows, ["_ranking"], by_final, "_end", deepest, "restaurant_id").drop("_end", "need", "sort_mode", "labels", "user_allergens")
        pages = ranked.join(asked, "_ranking").filter((F.col("position") > F.col("offset")) & (F.col("position") <= F.col("_end")))
        # each request names its user's allergens in the user's own order
        warning = scores.triggered_allergens(F.col("user_allergens"), F.col("allergens"))
        return pages.withColumn("allergen_warning", warning).drop("_end", "_ranking")
    by_text = [F.desc("text_score"), F.asc("restaurant_id")]
    # written before their join, whose size is known then: few needs are sent to the candidates, which are cut where they lie;
    # dealt by need, all candidates of a need would be sorted in one task
    ends = cut(asked.groupBy("need").agg(F.max("_end").alias("_end")), "ends")
    best = top_rows(candidates.join(ends, "need"), ["need"], by_text, "_end", deepest, "restaurant_id", rank="text_rank").drop("_end")
    # each request names the ranks of its page, so the join yields page rows only
    # an empty page (limit 0) names none
    ranks = F.explode(F.when(F.col("limit") > 0, F.sequence(F.col("offset") + 1, F.col("offset") + F.col("limit"))))
    rows = best.join(asked.withColumn("text_rank", ranks), ["need", "text_rank"])
    # a page holds at most ``limit`` rows per request
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_final)) + F.col("offset")
    return with_signals(rows).withColumn("position", position).drop("_end")


def summarise(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per request: total hits, page number, text analysis and the underserved test."""
    counted = parsed.join(facet_ops.totals(candidates), "need", "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    return counted.select(
        "query_id",
        total.alias("total"),
        "sort_mode", "offset", "limit", "language", "tokens", "query_tokens", "detected_labels", "labels",
        "spell_suggestion",
        page_number(F.col("offset"), F.col("limit")).alias("page"),
        F.ceil(total / F.col("limit")).alias("pages"),
        underserved(total, F.col("offset"), F.col("has_text")).alias("underserved"),
    )


def underserved(total: Column, offset: Column, has_text: Column) -> Column:
    return (total < fixed.UNDERSERVED_BELOW) & (offset == 0) & has_text


def attach_profiles(requests: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Allergens of the requesting user; anonymous users and users without a profile have none."""
    if profiles is None:
        return requests.withColumn("user_allergens", _empty("string"))
    known = profiles.select("user_id", F.col("allergens").alias("user_allergens"))
    return requests.join(known, "user_id", "left").withColumn(
        "user_allergens", F.coalesce("user_allergens", _empty("string"))
    )


def search(
    requests: DataFrame,
    catalog: DataFrame,
    profiles: DataFrame | None = None,
    rerank_scope: str = "page",
    expansion: str = "flat",
    phrases: bool = False,
    posting_rows: DataFrame | None = None,
    stage_path: str | None = None,
    check: bool = True,
) -> Search:
    """Answer all valid requests against the catalog; the others come back as ``rejected``.

    Without ``check`` all requests are taken to be valid.  ``posting_rows`` is a table of all its postings, if there is one.  ``stage_path`` writes the candidates once as a table that hits, facets and
    summary then share; without it they are kept in the block cache.
    """
    # the request rows are read by every later step; looking for the deepest page
    # fills their cache, after which the optimizer knows the size of the request
    # side and broadcasts it by that, or shuffles
    valid, rejected = split_valid(check_requests(requests) if check else with_problems(requests, {}))
    parsed = parse_requests(attach_profiles(valid, profiles), phrases).persist()
    deepest = deepest_page(parsed)
    needs = distinct_needs(parsed)
    terms = retrieval.need_terms(needs.filter(F.size("terms") > 0))
    # matching postings serve statistics, document frequencies and scores,
    # candidates serve page, facets and totals: the text is cut once for all
    found = retrieval.matching_postings(terms, catalog, posting_rows).persist()
    candidates = find_candidates(needs, terms, found, catalog, expansion)
    if stage_path is not None:
        candidates.write.mode("overwrite").parquet(stage_path)
        candidates = candidates.sparkSession.read.parquet(stage_path)
    else:
        candidates = candidates.persist()
    return Search(parsed, rejected, candidates, deepest, rerank_scope, (parsed, found, candidates))
