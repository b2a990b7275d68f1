import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from forage.operators import facets, filters, geo, retrieval
from forage.operators.topk import top_k, top_rows
from forage.plans import search as plan

REQUEST = (
    "query_id bigint, q string, diet_labels array<string>, price_levels array<int>, lat double, lng double, "
    "radius_km double, sort_mode string, offset int, limit int, user_id bigint"
)
PLACE = (
    "restaurant_id string, name string, description string, cuisine_type string, address string, price_level int, rating double, "
    "geo struct<lat:double,lng:double>, diet_labels array<string>, allergens array<string>, allergen_free array<string>"
)


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(3)
    words = "noodle soup rice bar grill garden lotus green river".split()
    rows = []
    for i in range(300):
        rows.append(
            (
                f"r{i:03d}", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=12)), rng.choice(["thai", "halal", None]),
                "street", rng.randint(1, 4), rng.choice([None, 2.0, 4.5]), (39.9 + rng.random() / 5, 116.3 + rng.random() / 5),
                rng.sample(["vegan", "halal", "keto"], k=rng.randint(0, 2)), rng.sample(["soy", "egg"], k=rng.randint(0, 2)), ["egg"],
            )
        )
    return spark.createDataFrame(rows, PLACE).cache()


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        (1, "noodle soup", [], [], None, None, 5.0, "default", 0, 20, 1),
        (2, "noodle  soup", None, None, None, None, 5.0, "diet_first", 5, 10, None),
        (3, "", ["vegan", "keto"], [1, 2], 40.0, 116.4, 8.0, "distance_first", 0, 50, 1),
        (4, None, [], [], None, None, None, "rating_first", 0, 300, 2),
        (5, "low-carb soup", [], [3], None, None, 5.0, "default", 0, 20, None),
        (6, "", ["vegan", "keto"], [], None, None, 5.0, "default", 0, 300, 2),
        (7, "", [], [4], None, None, 5.0, "default", 0, 300, 2),
    ]
    return spark.createDataFrame(rows, REQUEST)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(1, ["egg", "soy"]), (2, [])], "user_id bigint, allergens array<string>")


def search(*tables, **options):
    """Without checks, so that a page may hold more than a request may ask for."""
    return plan.search(*tables, check=False, **options)


def hits(result):
    return sorted((r["query_id"], r["position"], r["restaurant_id"], r["final_score"]) for r in result.hits.collect())


def test_same_text_is_one_need(catalog, requests, profiles):
    result = search(requests, catalog, profiles)
    needs = {r["query_id"]: r["need"] for r in result.requests.collect()}
    assert needs[1] == needs[2] and len(set(needs.values())) == 6


def test_shuffled_joins_give_the_same(spark, catalog, requests, profiles):
    small = search(requests, catalog, profiles)
    expected, facet_rows = hits(small), sorted(map(tuple, small.facets.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = search(requests, catalog, profiles)
        assert hits(big) == expected
        assert sorted(map(tuple, big.facets.collect())) == facet_rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_page_has_no_hits_whatever_is_asked_beside_it(catalog, requests, profiles):
    """Limit 0 gives nothing, also next to requests with hits."""
    alone = hits(search(requests.withColumn("limit", F.lit(0)), catalog, profiles))
    mixed = requests.withColumn("limit", F.when(F.col("query_id") == 1, 0).otherwise(F.col("limit")))
    beside = hits(search(mixed, catalog, profiles))
    assert [(r.query_id, r.problems) for r in plan.search(mixed, catalog, profiles).rejected.orderBy("query_id").collect()] == [(1, ["limit"]), *((k, ["limit"]) for k in (4, 6, 7))]
    assert not alone and beside and not [h for h in beside if h[0] == 1]


def test_page_is_part_of_all(catalog, requests, profiles):
    result = search(requests, catalog, profiles)
    found = {(r["query_id"], r["restaurant_id"]) for r in result.requests.join(result.candidates, "need").select("query_id", "restaurant_id").collect()}
    page = {(q, r) for q, _, r, _ in hits(result)}
    assert page and page <= found
    totals = {r["query_id"]: r["total"] for r in result.summary.collect()}
    assert totals[4] == 300 and all(sum(1 for q, _ in found if q == k) == n for k, n in totals.items())
    prices = result.facets.filter("facet = 'price_level'").groupBy("query_id").agg(F.sum("n").alias("n"))
    assert {r["query_id"]: r["n"] for r in prices.collect()} == {k: n for k, n in totals.items() if n}
    result.release()


def test_match_all_against_brute_force(catalog, requests, profiles):
    result = search(requests, catalog, profiles)
    got = result.requests.join(result.candidates, "need").select("query_id", "restaurant_id").collect()
    places = catalog.collect()
    near = {r["restaurant_id"] for r in geo.radius_filter(catalog.select("restaurant_id", "geo.*"), 40.0, 116.4, 8.0).collect()}
    for query, keep in {
        3: lambda p: {"vegan", "keto"} & set(p["diet_labels"]) and p["price_level"] in (1, 2) and p["restaurant_id"] in near,
        6: lambda p: {"vegan", "keto"} & set(p["diet_labels"]),
        7: lambda p: p["price_level"] == 4,
    }.items():
        found = [r["restaurant_id"] for r in got if r["query_id"] == query]
        assert sorted(found) == sorted(p["restaurant_id"] for p in places if keep(p))


def test_expansion_modes(catalog, requests, profiles):
    flat = search(requests.filter("query_id = 5"), catalog, phrases=True)
    grouped = search(requests.filter("query_id = 5"), catalog, phrases=True, expansion="grouped")
    row = grouped.requests.first()
    assert row["detected_labels"] == ["low-carb"] and row["n_groups"] == 2
    # one word of two groups is enough, while the flat count needs most synonyms
    assert flat.summary.first()["total"] == 0
    assert search(requests.filter("query_id = 5").withColumn("q", F.lit("soup carb")), catalog, expansion="grouped").summary.first()["total"] > 0


def test_rerank_scopes(catalog, requests, profiles):
    everything = search(requests.filter("query_id = 4"), catalog, profiles, rerank_scope="all")
    page = search(requests.filter("query_id = 4"), catalog, profiles)
    assert hits(everything) == hits(page)  # the page holds all rows


def test_staged_candidates(spark, catalog, requests, profiles):
    from forage.session import work_path

    staged = search(requests, catalog, profiles, stage_path=work_path(spark, "candidates"))
    assert hits(staged) == hits(search(requests, catalog, profiles))


def test_saved_postings(spark, catalog, requests, profiles):
    from forage.session import work_path

    path = work_path(spark, "postings")
    retrieval.postings(catalog).write.parquet(path)
    rows = spark.read.parquet(path)
    assert hits(search(requests, catalog, profiles, posting_rows=rows)) == hits(search(requests, catalog, profiles))


def test_geo_join_at_the_edges(spark):
    asked = spark.createDataFrame([(1, 0.0, 179.99, 5.0), (2, 89.9, 0.0, 30.0), (3, None, 1.0, 5.0)], "id int, lat double, lng double, radius_km double")
    places = spark.createDataFrame([("a", 0.0, -179.99), ("b", 89.9, 179.0), ("c", 0.0, 179.0)], "p string, place_lat double, place_lng double")
    got = geo.geo_join(asked, places).select("id", "p").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")]


def test_top_k_in_two_steps(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    got = top_k(df, ["k"], [F.desc("id")], 1200, "id").groupBy("k").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.min("id").alias("low"))
    assert sorted(map(tuple, got.collect())) == [(0, 1200, 1200, 4998 - 3 * 1199), (1, 1200, 1200, 4999 - 3 * 1199), (2, 1200, 1200, 4997 - 3 * 1199)]


def test_autocomplete(spark):
    names = spark.createDataFrame([("Lotus",), ("lotus bar",), ("Lot",), ("Lotus",), ("river",), ("",), (None,)], "name string")
    asked = spark.createDataFrame([("LOT",), ("lotus",), ("z",), ("",)], "prefix string")
    got = filters.autocomplete(asked, names, size=2).select("prefix", "position", "name").collect()
    assert sorted(map(tuple, got)) == [("LOT", 1, "Lot"), ("LOT", 2, "Lotus"), ("lotus", 1, "Lotus"), ("lotus", 2, "lotus bar")]


def test_facet_maps(spark):
    rows = spark.createDataFrame([(1, "price_level", "2", 5), (1, "diet_labels", "vegan", 3)], "query_id int, facet string, key string, n bigint")
    row = facets.facet_maps(rows).first()
    assert row["price_level"] == {"2": 5} and row["diet_labels"] == {"vegan": 3} and row["cuisine_type"] == {}


@pytest.mark.parametrize("deepest", [7, 1500])
def test_rows_per_key_as_asked(spark, deepest):
    df = spark.range(9000).select((F.col("id") % 3).alias("key"), "id").withColumn("k", F.element_at(F.array(F.lit(0), F.lit(5), F.lit(deepest)), (F.col("key") + 1).cast("int")))
    got = top_rows(df, ["key"], [F.desc("id")], "k", deepest, "id").groupBy("key").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.min("id").alias("low"))
    assert sorted(map(tuple, got.collect())) == [(1, 5, 5, 8998 - 3 * 4), (2, deepest, deepest, 8999 - 3 * (deepest - 1))]


def test_a_small_cut_is_one_window(spark):
    plan_text = top_k(spark.range(100).withColumn("k", F.lit(1)), ["k"], [F.asc("id")], 20, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("Window [") == 1


def test_text_is_scanned_once(spark, catalog, requests, profiles, tmp_path):
    """Statistics, frequencies and scores come from one pass over the text."""
    path = str(tmp_path / "catalog")
    catalog.write.parquet(path)
    found = retrieval.matching_postings(spark.createDataFrame([("tofu",)], "term string"), spark.read.parquet(path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    sizes = {r.field: (r.n, r.avgdl) for r in retrieval.corpus_stats(found).collect()}
    words = [[len(r[f].split()) for r in catalog.collect() if r[f]] for f in retrieval.FIELDS]
    plain = {i: (len(w), pytest.approx(sum(w) / len(w))) for i, w in enumerate(words) if w}
    assert {i: s[0] for i, s in sizes.items()} == {i: p[0] for i, p in plain.items()}
    result = search(requests, spark.read.parquet(path), profiles)
    text_scans = re.findall(r"FileScan parquet \[[^]]*description", result.candidates._jdf.queryExecution().executedPlan().toString())
    assert len(set(text_scans)) <= 1  # one kept relation, shown wherever it is read


def test_geo_join_of_any_radius_equals_brute_force(spark):
    import math
    import random

    rng = random.Random(8)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    points += [(40 + rng.gauss(0, 0.02), 116 + rng.gauss(0, 0.02)) for _ in range(200)] + [(90.0, 10.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (40.0, 116.0)]
    asked = [(k, *points[rng.randrange(len(points))], rng.choice([0.01, 0.3, 2.0, 40.0, 900.0, 7000.0, 20100.0])) for k in range(60)] + [(90, 89.99, 10.0, 30.0), (91, 0.0, 179.9999, 1.0), (92, None, 1.0, 5.0)]
    places = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(999, None, 1.0)], "p int, place_lat double, place_lng double")
    table = spark.createDataFrame(asked, "id int, lat double, lng double, radius_km double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    found = geo.geo_join(table, places)
    got = [(r.id, r.p) for r in found.collect()]
    sure = {(i, k) for i, a, b, r in asked if a is not None for k, (c, d) in enumerate(points) if km(a, b, c, d) <= r * (1 - 1e-9)}
    near = {(i, k) for i, a, b, r in asked if a is not None for k, (c, d) in enumerate(points) if km(a, b, c, d) <= r * (1 + 1e-9) + 1e-6}
    assert len(got) == len(set(got)) and sure <= set(got) <= near
    cells = table.filter("lat IS NOT NULL").select(F.size(geo.cells_around(F.col("lat"), F.col("lng"), F.col("radius_km"))).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 49


def test_bounds_keep_every_page_and_skip_candidates(spark):
    """Pages by threshold equal the full order, for users with and without allergens."""
    from forage.plans.search import page_and_rerank, with_signals, within_reach

    rng = random.Random(11)
    names = ["egg", "soy", "gluten", "peanut"]
    pick = lambda n: rng.sample(names, rng.randrange(n + 1))
    places = [(f"n{k % 2}", f"r{k}", rng.choice(["a", "b"]), rng.randrange(1, 5), round(rng.uniform(0, 5), 1), (40.0, 116.0), pick(2), pick(3), pick(2), round(rng.uniform(0, 12), 2), rng.choice([None, 1.5])) for k in range(400)]
    candidates = spark.createDataFrame(places, "need string, restaurant_id string, cuisine_type string, price_level int, rating double, geo struct<lat:double,lng:double>, diet_labels array<string>, allergens array<string>, allergen_free array<string>, text_score double, km double")
    asked = [(q, f"n{q % 2}", rng.choice(["default", "diet_first", "odd", None]), rng.choice([0, 3]), rng.choice([0, 4, 9]), ["egg"], rng.choice([[], ["egg"], ["soy", "egg"], ["egg", "soy"]])) for q in range(40)]
    parsed = spark.createDataFrame(asked, "query_id int, need string, sort_mode string, offset int, limit int, labels array<string>, user_allergens array<string>")
    shape = lambda rows: sorted((r.query_id, r.position, r.restaurant_id, r.final_score, tuple(r.allergen_warning)) for r in rows)
    by = {}
    for r in with_signals(candidates.join(parsed, "need")).collect():
        by.setdefault(r.query_id, []).append(r)
    want = []
    for rows in by.values():
        rows.sort(key=lambda r: (-r.final_score, -r.text_score, r.restaurant_id))
        want += [(r.query_id, k + 1, r.restaurant_id, r.final_score, tuple(r.allergen_warning)) for k, r in enumerate(rows) if r.offset <= k < r.offset + r.limit]
    assert shape(page_and_rerank(parsed, candidates, 12, "all").collect()) == sorted(want)
    alone = parsed.filter("size(user_allergens) = 0 and sort_mode is not null").withColumn("_end", F.lit(5))
    kept = within_reach(candidates, alone, 5).groupBy("need", "sort_mode").count().collect()
    assert kept and all(5 <= r["count"] < 50 for r in kept)  # of 200


def test_scores_are_counted_behind_their_shuffle(spark):
    """No task holds the rows of all needs that its terms are asked by."""
    terms = spark.createDataFrame([("n", 1, 1, "tofu", 1, [1])], "need string, n_terms int, n_groups int, term string, mult long, groups array<int>")
    found = spark.createDataFrame([("a", 0, 1, "tofu", 1), ("a", 0, 1, "", 1)], "restaurant_id string, field int, dl int, term string, tf long")
    plan = retrieval.field_scores(terms, found)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "keys=[need" in line or "REPARTITION_BY_COL" in line]
    assert lines and "REPARTITION_BY_COL" in lines[-1]


def test_rows_of_a_need_reach_all_its_requests(spark):
    from workload.retrieval import _per_request

    asked = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(200)] + [(900, "none")], "query_id long, need string")
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "need string, restaurant_id string, text_score double")
    got = sorted((r.query_id, r.restaurant_id, r.text_score) for r in _per_request(asked, rows).collect())
    assert got == sorted((k, *row) for k in range(200) for row in ([("x", 3.0)] if k % 2 else [("x", 1.0), ("y", 2.0)]))


@pytest.mark.parametrize("scope", ["page", "all"])
def test_candidates_are_cut_before_they_are_dealt_by_need(spark, scope):
    """However large the optimizer takes the requests to be, few needs are sent to the candidates."""
    candidates = "need string, restaurant_id string, cuisine_type string, price_level int, rating double, geo struct<lat:double,lng:double>, diet_labels array<string>, allergens array<string>, allergen_free array<string>, text_score double, km double"
    asked = [(1, "n", "default", 0, 5, ["egg"], ["soy"])]
    parsed = spark.createDataFrame(asked, "query_id int, need string, sort_mode string, offset int, limit int, labels array<string>, user_allergens array<string>").repartition(3)
    rows = [("n", f"r{k}", "a", 1, 4.0, (40.0, 116.0), [], [], [], float(k), None) for k in range(9)]
    found = plan.page_and_rerank(parsed, spark.createDataFrame(rows, candidates).repartition(3), 5, scope)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    first = min(k for k, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    below = itertools.takewhile(lambda k: depth[k] > depth[first], range(first + 1, len(lines)))
    assert not any("hashpartitioning(need" in lines[k] for k in below)
    assert [r.restaurant_id for r in found.orderBy("position").collect()] == ["r8", "r7", "r6", "r5", "r4"]


def test_scores_are_added_up_by_as_many_tasks_as_their_matches_ask_for(spark, monkeypatch):
    terms = spark.createDataFrame([(n, 1, 1, t, 1, [1]) for n in "abc" for t in ("tofu", "rice")], "need string, n_terms long, n_groups long, term string, mult long, groups array<long>")
    found = spark.createDataFrame([(f"r{k}", 0, 2, t, 1) for k in range(40) for t in ("tofu", "rice", "")], "restaurant_id string, field int, dl int, term string, tf long")
    assert retrieval.score_tasks(terms, found) is None
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 10)
    assert retrieval.score_tasks(terms, found) == 24  # 3 needs, 2 terms, 40 documents
    rows = retrieval.field_scores(terms, found)
    assert rows.rdd.getNumPartitions() == 24 and rows.count() == 120
    assert retrieval.score_tasks(terms.limit(0), found) is None
