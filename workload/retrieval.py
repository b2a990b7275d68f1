"""Search over the bound catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from forage.functions import fixed, scores
from forage.operators import facets, filters, geo, retrieval, validate
from forage.plans import search as plan
from forage.session import cut
from workload import sql
from workload.bindings import RESTAURANTS, PROFILES, _plain, profiles, restaurants
from workload.registry import query
from workload.requests import PROBLEMS, requests, requests_cte

# --- oracle: the search pipeline as one chain of CTEs ------------------------

FIELD_ROWS = "\n  UNION ALL ".join(
    f"SELECT restaurant_id, {i} AS f, {sql.analyze(name)} AS words FROM restaurants"
    for i, name in enumerate(fixed.FIELD_BOOSTS)
)
BOOSTS = "CASE f " + " ".join(f"WHEN {i} THEN {b}e0" for i, b in enumerate(fixed.FIELD_BOOSTS.values())) + " END"

SEARCH = f"""WITH restaurants AS ({_plain(RESTAURANTS)}),
profiles AS ({_plain(PROFILES)}),
{requests_cte()},
r AS (SELECT restaurant_id, cuisine_type, price_level, rating, lat AS rlat, lng AS rlng,
   {sql.words('diet_labels')} AS diet_labels, {sql.words('allergens')} AS allergens, {sql.words('allergen_free')} AS allergen_free
   FROM restaurants),
q0 AS (SELECT q.query_id, coalesce(q.q, '') AS raw, {sql.squish("coalesce(q.q, '')")} AS q, {sql.words('q.labels')} AS wanted,
   list_transform({sql.words('q.prices')}, lambda x: CAST(x AS INT)) AS prices, q.lat, q.lng,
   coalesce(q.radius_km, 5e0) AS radius_km, q.sort_mode, q.page_offset, q.page_limit,
   {sql.words('p.allergens')} AS user_allergens
   FROM requests q LEFT JOIN profiles p ON q.user_id = p.user_id),
q1 AS (SELECT *, {sql.latin_tokens('q')} AS tokens FROM q0),
q2 AS (SELECT *, {sql.canonical_list('tokens')} AS canon, {sql.expanded_list('tokens')} AS expanded_all FROM q1),
q3 AS (SELECT *, {sql.ordered_distinct('canon')} AS detected, {sql.ordered_distinct('expanded_all')} AS expanded FROM q2),
q4 AS (SELECT *, list_concat(wanted, detected) AS labels_all,
   flatten(list_transform(expanded, lambda t: {sql.analyze_mixed('t')})) AS terms FROM q3),
qs AS (SELECT *, {sql.ordered_distinct('labels_all')} AS labels, len(terms) AS n_terms FROM q4),
terms AS (SELECT query_id, n_terms, term, count(*) AS mult FROM (SELECT query_id, n_terms, unnest(terms) AS term FROM qs) GROUP BY ALL),
toks AS ({FIELD_ROWS}),
stats AS (SELECT f, count(*) FILTER (len(words) > 0) AS n, sum(len(words)) / count(*) FILTER (len(words) > 0) AS avgdl FROM toks GROUP BY f),
post AS (SELECT restaurant_id, f, dl, term, count(*) AS tf FROM (SELECT restaurant_id, f, len(words) AS dl, unnest(words) AS term FROM toks)
   WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT f, term, count(*) AS df FROM post GROUP BY ALL),
fs AS (SELECT query_id, restaurant_id, f, n_terms, sum(mult) AS matched,
   {BOOSTS} * sum(mult * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) AS score
   FROM post JOIN terms USING (term) JOIN dfs USING (f, term) JOIN stats USING (f) GROUP BY query_id, restaurant_id, f, n_terms),
best AS (SELECT query_id, restaurant_id, round(max(score), 6) AS text_score FROM fs
   WHERE matched >= greatest(1, floor(n_terms * 60 / 100.0)) GROUP BY query_id, restaurant_id),
scored AS (SELECT * FROM best UNION ALL SELECT query_id, restaurant_id, 1e0 FROM qs, r WHERE n_terms = 0),
placed AS (SELECT s.query_id, s.text_score, r.*, qs.labels, qs.sort_mode, qs.page_offset, qs.page_limit, qs.user_allergens, qs.prices, qs.radius_km,
   CASE WHEN qs.lat IS NOT NULL THEN {sql.haversine('qs.lat', 'qs.lng', 'rlat', 'rlng')} END AS km
   FROM scored s JOIN r USING (restaurant_id) JOIN qs USING (query_id)),
cand AS (SELECT * FROM placed WHERE (len(labels) = 0 OR list_has_any(labels, diet_labels))
   AND (len(prices) = 0 OR list_contains(prices, price_level)) AND (km IS NULL OR km <= radius_km)),
signals AS (SELECT *, {sql.diet_score('diet_labels', 'allergens', 'allergen_free', 'labels', 'user_allergens')} AS diet_score,
   {sql.rating_score('rating')} AS rating_score, {sql.distance_score('km')} AS distance_score,
   list_filter(user_allergens, lambda a: list_contains(allergens, a)) AS warning,
   row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, restaurant_id) AS text_rank FROM cand),
finals AS (SELECT s.*, round(w_text * least(text_score / 10e0, 1e0) + w_diet * (diet_score + 2e0) / 4e0
   + w_rating * rating_score + w_dist * distance_score, 6) AS final_score
   FROM signals s JOIN {sql.weights()} w ON w.mode = CASE WHEN s.sort_mode IN {sql.in_list(fixed.SORT_MODES)} THEN s.sort_mode ELSE 'default' END),
paged AS (SELECT * FROM finals WHERE text_rank > page_offset AND text_rank <= page_offset + page_limit),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, text_score DESC, restaurant_id) + page_offset AS position FROM paged),
totals AS (SELECT query_id, count(*) AS total FROM cand GROUP BY 1),
fkeys AS (SELECT query_id, 'diet_labels' AS facet, unnest(diet_labels) AS key FROM cand
   UNION ALL SELECT query_id, 'price_level', CAST(price_level AS VARCHAR) FROM cand
   UNION ALL SELECT query_id, 'cuisine_type', cuisine_type FROM cand),
fcounts AS (SELECT query_id, facet, key, count(*) AS n FROM fkeys GROUP BY ALL),
facets AS (SELECT query_id, facet, key, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, key) AS rn FROM fcounts)
   WHERE rn <= CASE facet WHEN 'price_level' THEN 5 ELSE 20 END)
"""

HIT_COLUMNS = """query_id, CAST(position AS INT) AS position, restaurant_id, text_score, diet_score, round(rating_score, 6) AS rating_score,
 round(distance_score, 6) AS distance_score, final_score, CAST(round_even(km * 1000, 0) AS BIGINT) AS distance_m,
 array_to_string(warning, ',') AS allergen_warning"""


def _hits(frame):
    return frame.select(
        "query_id", "position", "restaurant_id", "text_score", "diet_score",
        F.round("rating_score", 6).alias("rating_score"), F.round("distance_score", 6).alias("distance_score"),
        "final_score", "distance_m", F.array_join("allergen_warning", ",").alias("allergen_warning"),
    )


def _search(spark, sf_dir, mode=None, personal=True, **options):
    asked = requests(spark, sf_dir)
    if mode is not None:
        asked = asked.withColumn("sort_mode", F.lit(mode))
    return plan.search(asked, restaurants(spark, sf_dir), profiles(spark, sf_dir) if personal else None, **options)


def _with_query(result, rows):
    return result.requests.select("query_id", "need").join(rows, "need").drop("need")


# --- corpus statistics and scores --------------------------------------------


@query(
    "bm25_stats",
    SEARCH + ", all_df AS (SELECT f, term, count(DISTINCT restaurant_id) AS df FROM (SELECT restaurant_id, f, unnest(words) AS term FROM toks) GROUP BY ALL) "
    "SELECT CAST(a.f AS INT) AS field, a.term, a.df, CAST(s.n AS BIGINT) AS n_docs, round(s.avgdl, 6) AS avgdl FROM all_df a JOIN stats s USING (f)",
)
def bm25_stats(spark, sf_dir):
    """Document frequency of every term of every field, with the field's size and mean length."""
    counted = retrieval.corpus_frequency(restaurants(spark, sf_dir))
    counted = cut(counted, "frequencies")
    size = counted.filter(F.col("term") == retrieval.MARK).select("field", F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avgdl"))
    # one row per field
    return counted.filter(F.col("term") != retrieval.MARK).join(F.broadcast(size), "field").select("field", "term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _field_scores(spark, sf_dir, expansion="flat"):
    catalog = restaurants(spark, sf_dir)
    asked, _ = validate.split_valid(validate.check_requests(requests(spark, sf_dir)))
    parsed = plan.parse_requests(plan.attach_profiles(asked, None))
    terms = retrieval.need_terms(plan.distinct_needs(parsed).filter(F.size("terms") > 0))
    found = cut(retrieval.matching_postings(terms, catalog), "postings")
    return parsed.select("query_id", "need"), retrieval.field_scores(terms, found, expansion)


def _per_request(asked, rows):
    """Rows of needs, once for each request that asks for the need; a need's requests come as a few lists, so rows meet lists and not single requests."""
    lists = asked.groupBy("need", F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("_part")).agg(F.collect_list("query_id").alias("_asked"))
    return lists.join(rows, "need").withColumn("query_id", F.explode("_asked")).drop("need", "_part", "_asked")


@query("bm25_search", SEARCH + "SELECT query_id, restaurant_id, text_score FROM best")
def bm25_search(spark, sf_dir):
    asked, found = _field_scores(spark, sf_dir)
    return _per_request(asked, retrieval.best_field(found, 4))


@query(
    "bm25_grouped",
    SEARCH + f""", gt AS (SELECT query_id, grp, unnest(ts) AS term FROM (SELECT query_id, coalesce({sql.form_map()}[lower(token)], token) AS grp,
      {sql.analyze_mixed('token')} AS ts FROM (SELECT query_id, unnest(expanded) AS token FROM qs))),
    ng AS (SELECT query_id, count(DISTINCT grp) AS n_groups FROM gt GROUP BY 1),
    gm AS (SELECT query_id, restaurant_id, f, count(DISTINCT grp) AS g FROM post JOIN gt USING (term) GROUP BY ALL)
    SELECT query_id, restaurant_id, round(max(score), 6) AS text_score FROM fs JOIN gm USING (query_id, restaurant_id, f) JOIN ng USING (query_id)
    WHERE g >= greatest(1, floor(n_groups * 60 / 100.0)) GROUP BY query_id, restaurant_id""",
)
def bm25_grouped(spark, sf_dir):
    """Minimum match with every synonym set counted once."""
    asked, found = _field_scores(spark, sf_dir, "grouped")
    return _per_request(asked, retrieval.best_field(found, 4, "grouped"))


@query(
    "bm25_multi_field",
    SEARCH + "SELECT query_id, restaurant_id, "
    + ", ".join(f"round(max(CASE WHEN f = {i} THEN score END), 6) AS score_{n}" for i, n in enumerate(fixed.FIELD_BOOSTS))
    + " FROM fs GROUP BY query_id, restaurant_id",
)
def bm25_multi_field(spark, sf_dir):
    asked, found = _field_scores(spark, sf_dir)
    columns = [F.round(f"score_{i}", 6).alias(f"score_{n}") for i, n in enumerate(fixed.FIELD_BOOSTS)]
    return _per_request(asked, found.select("need", "restaurant_id", *columns))


@query(
    "bm25_min_match",
    SEARCH + "SELECT query_id, restaurant_id, CAST(max(matched) AS BIGINT) AS matched, "
    "CAST(greatest(1, floor(n_terms * 60 / 100.0)) AS BIGINT) AS needed, "
    "max(matched) >= greatest(1, floor(n_terms * 60 / 100.0)) AS accepted FROM fs GROUP BY query_id, restaurant_id, n_terms",
)
def bm25_min_match(spark, sf_dir):
    asked, found = _field_scores(spark, sf_dir)
    matched = F.greatest(*[f"matched_{i}" for i in range(4)])
    needed = retrieval.required_matches(F.col("n_terms"))
    return _per_request(asked, found.select("need", "restaurant_id", matched.alias("matched"), needed.alias("needed"), (matched >= needed).alias("accepted")))


@query(
    "bm25_page",
    SEARCH + "SELECT query_id, CAST(text_rank AS INT) AS text_rank, restaurant_id, text_score FROM paged",
)
def bm25_page(spark, sf_dir):
    return _search(spark, sf_dir).hits.select("query_id", "text_rank", "restaurant_id", "text_score")


# --- filters -----------------------------------------------------------------

CATALOG = f"WITH restaurants AS ({_plain(RESTAURANTS)}) "


@query(
    "filter_diet_any",
    CATALOG + f"SELECT restaurant_id, diet_labels FROM restaurants WHERE list_has_any({sql.words('diet_labels')}, ['halal', 'keto', 'organic'])",
)
def filter_diet_any(spark, sf_dir):
    kept = filters.any_label(restaurants(spark, sf_dir), ["halal", "keto", "organic"])
    return kept.select("restaurant_id", F.array_join("diet_labels", ",").alias("diet_labels"))


@query("filter_price", CATALOG + "SELECT restaurant_id, price_level FROM restaurants WHERE price_level IN (1, 3)")
def filter_price(spark, sf_dir):
    return filters.price_in(restaurants(spark, sf_dir), [1, 3]).select("restaurant_id", "price_level")


@query(
    "filter_geo_radius",
    CATALOG + f"SELECT restaurant_id, round({sql.haversine('39.95e0', '116.4e0', 'lat', 'lng')}, 6) AS km FROM restaurants "
    f"WHERE {sql.haversine('39.95e0', '116.4e0', 'lat', 'lng')} <= 8e0",
)
def filter_geo_radius(spark, sf_dir):
    places = restaurants(spark, sf_dir).select("restaurant_id", "geo.lat", "geo.lng")
    near = geo.radius_filter(places, 39.95, 116.4, 8.0)
    km = scores.haversine_km(F.lit(39.95), F.lit(116.4), F.col("lat"), F.col("lng"))
    return near.select("restaurant_id", F.round(km, 6).alias("km"))




@query(
    "geo_join",
    CATALOG + f"""SELECT s.lat, s.lng, restaurant_id, round({sql.haversine('s.lat', 's.lng', 'r.lat', 'r.lng')}, 6) AS km
    FROM (SELECT DISTINCT 39.9e0 + (c_custkey % 10) / 100e0 AS lat, 116.3e0 + (c_custkey % 7) / 100e0 AS lng FROM customer) s, restaurants r
    WHERE {sql.haversine('s.lat', 's.lng', 'r.lat', 'r.lng')} <= 2e0""",
)
def geo_join(spark, sf_dir):
    from workload.bindings import table

    key = F.col("c_custkey")
    asked = (
        table(spark, sf_dir, "customer")
        .select((39.9 + (key % 10) / 100.0).alias("lat"), (116.3 + (key % 7) / 100.0).alias("lng"), F.lit(2.0).alias("radius_km"))
        .distinct()
    )
    places = restaurants(spark, sf_dir).select("restaurant_id", F.col("geo.lat").alias("place_lat"), F.col("geo.lng").alias("place_lng"))
    return geo.geo_join(asked, places).select("lat", "lng", "restaurant_id", F.round("km", 6).alias("km"))


@query(
    "search_match_all",
    SEARCH + "SELECT c.query_id, c.restaurant_id, c.text_score FROM cand c JOIN qs USING (query_id) WHERE n_terms = 0",
)
def search_match_all(spark, sf_dir):
    """Requests without terms; those with terms have no part in it, so no text is cut or scored."""
    asked, _ = validate.split_valid(validate.check_requests(requests(spark, sf_dir)))
    empty = cut(plan.parse_requests(plan.attach_profiles(asked, None)).filter(F.size("terms") == 0), "requests")
    needs = cut(plan.distinct_needs(empty), "needs")  # few rows, so their joins are planned by their size
    found = plan.match_all(needs, restaurants(spark, sf_dir).select(*plan.ATTRIBUTES))
    return _per_request(empty.select("query_id", "need"), found.select("need", "restaurant_id", "text_score")).select("query_id", "restaurant_id", "text_score")


@query("search_total", SEARCH + "SELECT query_id, coalesce(total, 0) AS total FROM qs LEFT JOIN totals USING (query_id)")
def search_total(spark, sf_dir):
    return _search(spark, sf_dir).summary.select("query_id", "total")


# --- facets ------------------------------------------------------------------


def _facet(name, facet):
    @query(name, SEARCH + f"SELECT query_id, key, n FROM facets WHERE facet = '{facet}'")
    def run(spark, sf_dir):
        result = _search(spark, sf_dir)
        counts = facets.facet_counts(result.candidates, sizes={facet: fixed.FACET_SIZES[facet]})
        return _with_query(result, counts).select("query_id", "key", "n")

    return run


_facet("facet_diet", "diet_labels")
_facet("facet_price", "price_level")
_facet("facet_cuisine", "cuisine_type")


def _map_text(column):
    entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.array_join(entries, ",")


@query(
    "facets_all",
    SEARCH + "SELECT query_id, "
    + ", ".join(
        f"coalesce(string_agg(key || '=' || CAST(n AS VARCHAR), ',' ORDER BY key || '=' || CAST(n AS VARCHAR)) FILTER (facet = '{f}'), '') AS {f}"
        for f in fixed.FACET_SIZES
    )
    + " FROM qs LEFT JOIN facets USING (query_id) GROUP BY query_id",
)
def facets_all(spark, sf_dir):
    result = _search(spark, sf_dir)
    maps = facets.facet_maps(result.facets, result.requests)
    return maps.select("query_id", *[_map_text(f).alias(f) for f in fixed.FACET_SIZES])


# --- ranked pages ------------------------------------------------------------


@query("search_reranked", SEARCH + f"SELECT {HIT_COLUMNS} FROM hits")
def search_reranked(spark, sf_dir):
    return _hits(_search(spark, sf_dir).hits)


def _mode(name, mode):
    oracle = SEARCH.replace("q.sort_mode, q.page_offset", f"'{mode}' AS sort_mode, q.page_offset")

    @query(name, oracle + f"SELECT {HIT_COLUMNS} FROM hits")
    def run(spark, sf_dir):
        return _hits(_search(spark, sf_dir, mode=mode).hits)

    return run


_mode("search_diet_first", "diet_first")
_mode("search_rating_first", "rating_first")
_mode("search_distance_first", "distance_first")


@query(
    "search_rerank_all",
    SEARCH + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, text_score DESC, restaurant_id) AS position FROM finals) "
    + f"SELECT {HIT_COLUMNS} FROM ranked WHERE position > page_offset AND position <= page_offset + page_limit",
)
def search_rerank_all(spark, sf_dir):
    return _hits(_search(spark, sf_dir, rerank_scope="all").hits)


@query("search_saved_postings", SEARCH + f"SELECT {HIT_COLUMNS} FROM hits")
def search_saved_postings(spark, sf_dir):
    """All postings written once as a plain table, then searched from it."""
    posting_rows = cut(retrieval.postings(restaurants(spark, sf_dir)), "postings")
    return _hits(_search(spark, sf_dir, posting_rows=posting_rows).hits)


@query("search_personal", SEARCH + f"SELECT {HIT_COLUMNS}, len(user_allergens) > 0 AS personal FROM hits")
def search_personal(spark, sf_dir):
    """Hits of every request; those of users with allergens may carry warnings."""
    hits = _search(spark, sf_dir).hits
    personal = hits.select("query_id", (F.size("user_allergens") > 0).alias("personal")).distinct()
    return _hits(hits).join(personal, "query_id")


@query("search_rejected", SEARCH + f"SELECT query_id, {PROBLEMS} AS problems FROM asked WHERE {PROBLEMS} <> ''")
def search_rejected(spark, sf_dir):
    """Requests that search refuses, with what is wrong with them."""
    return _search(spark, sf_dir).rejected.select("query_id", F.array_join("problems", ",").alias("problems"))


@query(
    "search_pages",
    SEARCH + "SELECT query_id, coalesce(total, 0) AS total, CAST(floor(page_offset / page_limit) + 1 AS BIGINT) AS page, "
    "CAST(ceil(coalesce(total, 0) / page_limit) AS BIGINT) AS pages FROM qs LEFT JOIN totals USING (query_id)",
)
def search_pages(spark, sf_dir):
    return _search(spark, sf_dir).summary.select("query_id", "total", "page", "pages")


@query(
    "underserved_queries",
    SEARCH + "SELECT query_id, coalesce(total, 0) AS total, coalesce(total, 0) < 5 AND page_offset = 0 AND raw <> '' AS underserved "
    "FROM qs LEFT JOIN totals USING (query_id)",
)
def underserved_queries(spark, sf_dir):
    return _search(spark, sf_dir).summary.select("query_id", "total", "underserved")


@query(
    "search_full",
    SEARCH + f"""SELECT qs.query_id, coalesce(total, 0) AS total, array_to_string(detected, ',') AS detected_labels,
    array_to_string(expanded, ',') AS query_tokens, coalesce(total, 0) < 5 AND qs.page_offset = 0 AND raw <> '' AS underserved,
    CAST(position AS INT) AS position, restaurant_id, text_score, final_score,
    CAST(round_even(km * 1000, 0) AS BIGINT) AS distance_m, array_to_string(warning, ',') AS allergen_warning
    FROM qs LEFT JOIN totals USING (query_id) LEFT JOIN hits ON qs.query_id = hits.query_id""",
)
def search_full(spark, sf_dir):
    """Every request with its summary and its page of hits; requests without hits keep one row."""
    result = _search(spark, sf_dir)
    summary = result.summary.select(
        "query_id", "total", F.array_join("detected_labels", ",").alias("detected_labels"),
        F.array_join("query_tokens", ",").alias("query_tokens"), "underserved",
    )
    hits = result.hits.select(
        "query_id", "position", "restaurant_id", "text_score", "final_score", "distance_m",
        F.array_join("allergen_warning", ",").alias("allergen_warning"),
    )
    return summary.join(hits, "query_id", "left")
