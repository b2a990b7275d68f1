import json

from forage.sources import food, poi
from forage.session import work_path


def test_features(spark, tmp_path):
    lines = [
        {"type": "way", "id": 1, "center": {"lat": 1.5, "lon": 2.5}, "tags": {"name": "", "name:zh": "面馆", "cuisine": "vegan;thai", "diet:vegetarian": "only",
         "diet:organic": "yes", "diet:halal": "no", "level_of_price": "3", "contact:phone": "12", "addr:city": "B", "addr:street": "S", "opening_hours": "24/7"}},
        {"type": "node", "id": 2, "lat": 4.0, "tags": {"name": "Grill", "price_level": "2.5", "phone": "7", "contact:phone": "8"}},
        {"type": "node", "id": 3, "tags": {"amenity": "cafe"}},
    ]
    path = tmp_path / "features.json"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    a, b = poi.normalize_features(poi.read_features(spark, str(path))).orderBy("restaurant_id").collect()[::-1]
    assert (a["restaurant_id"], a["name"], a["cuisine_type"], a["price_level"]) == ("osm_way_1", "面馆", "纯素", 3)
    assert a["geo"].asDict() == {"lat": 1.5, "lng": 2.5} and a["address"] == "S B" and a["phone"] == "12"
    assert a["diet_labels"] == ["vegan", "vegetarian", "organic"] and a["business_hours"] == ["24/7"]
    assert (b["restaurant_id"], b["cuisine_type"], b["price_level"], b["phone"]) == ("osm_node_2", "餐厅", None, "7")
    assert b["geo"].asDict() == {"lat": 4.0, "lng": 0.0} and b["rating"] is None


def test_pois(spark, tmp_path):
    rows = [
        {"id": "A", "name": "x", "type": "a;b;面馆", "location": "116.3,39.9", "biz_ext": {"rating": "4.5", "cost": "120"}, "photos": [{"url": ""}] + [{"url": f"u{i}"} for i in range(6)]},
        {"id": "B", "name": "", "tag": "spicy", "biz_ext": {"rating": "[]", "cost": "[]"}},
    ]
    path = tmp_path / "pois.json"
    path.write_text("\n".join(json.dumps(x) for x in rows))
    raw = poi.read_pois(spark, str(path))
    official = {r["restaurant_id"]: r for r in poi.normalize_pois(raw, "official").collect()}
    web = poi.normalize_pois(raw, "web").collect()
    a, b = official["gaode_A"], official["gaode_B"]
    assert (a["cuisine_type"], a["price_level"], a["rating"], a["images"]) == ("面馆", 3, 4.5, ["u0", "u1", "u2", "u3", "u4"])
    assert (b["name"], b["cuisine_type"], b["rating"], b["price_level"], b["geo"]["lat"], b["images"]) == ("", "", None, None, 0.0, [])
    assert [(r["restaurant_id"], r["images"], r["source"]) for r in web] == [("amap_A", ["u0", "u1", "u2", "u3"], "amap_web")]


def test_first_seen_and_city(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), ("", 1, "z")], "id string, at int, v string")
    assert [tuple(r) for r in poi.first_seen(rows, "id", ["at"]).collect()] == [("a", 1, "y")]
    assert poi.city_box("ShangHai")[0] == 31.0 and poi.city_box("nowhere") == poi.city_box("beijing")


def test_dictionary_files(spark, tmp_path):
    synonyms = tmp_path / "s.json"
    synonyms.write_text(json.dumps({"vegan": ["Plant", "green"], "organic": ["green"]}))
    got = {r["form"]: (r["canonical"], r["forms"]) for r in food.read_synonyms(spark, str(synonyms)).collect()}
    assert got == {
        "vegan": ("vegan", ["vegan", "Plant", "green"]), "plant": ("vegan", ["vegan", "Plant", "green"]),
        "organic": ("organic", ["organic", "green"]), "green": ("organic", ["organic", "green"]),
    }
    stops = tmp_path / "w.txt"
    stops.write_text("The\n\n of \nthe\n")
    assert sorted(r["word"] for r in food.read_stopwords(spark, str(stops), "en").collect()) == ["of", "the"]


def test_read_catalog(spark, tmp_path):
    from forage.sources.catalog import read_catalog, union_sources

    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"restaurant_id": "a", "geo": {"lat": 1.0, "lng": 2.0}, "menu_items": [{"name": "x", "price": 3}], "other": 1}))
    docs = read_catalog(spark, str(path), "json")
    row = docs.first()
    assert row["geo"]["lng"] == 2.0 and row["menu_items"][0]["price"] == 3.0 and row["name"] is None
    stored = work_path(spark, "catalog")
    docs.write.parquet(stored)
    back = read_catalog(spark, stored)
    assert back.schema == docs.schema and back.first() == row
    assert union_sources(back, docs.select("restaurant_id")).count() == 2


def test_menu_listing(spark):
    from forage.operators.filters import any_label, lookup, meal_filter, menu_listing, price_in

    docs = spark.createDataFrame([("a", [("x", 1.0), ("y", 2.0)]), ("b", None)], "restaurant_id string, menu_items array<struct<name:string,price:double>>")
    assert sorted(map(str, menu_listing(docs).select("restaurant_id", "name").collect())) == [
        "Row(restaurant_id='a', name='x')", "Row(restaurant_id='a', name='y')", "Row(restaurant_id='b', name=None)",
    ]
    rows = spark.createDataFrame([("a", ["v"], 1, "lunch"), ("b", [], 2, "snack")], "restaurant_id string, diet_labels array<string>, price_level int, meal_type string")
    assert any_label(rows, ["v"]).count() == 1 and any_label(rows, []).count() == 2
    assert price_in(rows, [2]).count() == 1 and price_in(rows, []).count() == 2
    assert meal_filter(rows, "all").count() == 2 and meal_filter(rows, "lunch").count() == 1
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "restaurant_id string")
    assert [r["restaurant_id"] for r in lookup(rows, keys, "restaurant_id").collect()] == ["a"]


def test_seed(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps([{"name_zh": "米饭", "calories": 130, "diet_labels": ["vegan"]}, {"name_zh": "肉", "calories": 395, "fat_g": 34.2}]))
    rows = food.read_seed(spark, str(seed))
    empty = food.seed_rows(rows).limit(0)
    loaded = food.load_seed(empty, rows).orderBy("calories_per_100g").collect()
    assert [(r["protein_g"], r["fat_g"], r["sodium_mg"], r["diet_labels"], r["source"], r["verified"]) for r in loaded] == [
        (0.0, 0.0, None, '["vegan"]', "static", True), (0.0, 34.2, None, "[]", "static", True),
    ]
    target = food.seed_rows(rows).limit(1)
    assert food.load_seed(target, rows).count() == 1


def test_ingest_stream_over_files(spark):
    """Files taken one by one end in the catalog of one batch, and a replay changes nothing."""
    from forage.sources.catalog import label_catalog
    from forage.operators.state import upsert
    from forage.streaming import ingest
    from forage import schemas

    path = work_path(spark, "pois")
    schema = schemas.MAP_POI + ", seq int"
    for i in range(3):
        rows = [(str(k), f"tofu {k} {i}", "a;b", "", "", "", "116.3,39.9", ("4", "60"), [], i) for k in range(i, 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
    current = poi.normalize_pois(spark.createDataFrame([("0", "old", "", "", "", "", "", None, [], 0), ("9", "kept", "", "", "", "", "", None, [], 0)], schema))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    log = work_path(spark, "log")
    ingest.start_ingest(poi.normalize_pois(stream, keep=("seq",)), log, work_path(spark, "state")).awaitTermination()
    live = ingest.snapshot(spark, current, log, ["seq"])
    whole = upsert(current, label_catalog(poi.normalize_pois(spark.read.schema(schema).json(path), keep=("seq",))), ["seq"])
    key = lambda df: sorted((r["restaurant_id"], r["allergens"]) for r in df.collect())
    once = key(live)
    assert once == key(whole) and len(once) == 5
    ingest.start_ingest(poi.normalize_pois(stream, keep=("seq",)), log, work_path(spark, "state")).awaitTermination()
    assert key(ingest.snapshot(spark, current, log, ["seq"])) == once


def test_ways_are_selected_by_their_centre(spark):
    """A way comes with a centre and no place of its own."""
    schema = "type string, id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"
    rows = [
        ("way", 1, None, None, (39.9, 116.4), {"amenity": "restaurant", "name": "A"}),
        ("node", 2, 39.9, 116.4, None, {"amenity": "cafe", "name": "B"}),
        ("way", 3, None, None, (10.0, 10.0), {"amenity": "restaurant", "name": "C"}),
        ("way", 4, None, None, None, {"amenity": "restaurant", "name": "D"}),
    ]
    dump = spark.createDataFrame(rows, schema)
    ids = lambda found: sorted(r["id"] for r in found.collect())
    assert ids(poi.features_around(dump, 39.9, 116.4, 1000)) == [1, 2]
    assert ids(poi.features_in_box(dump, (39.0, 116.0, 40.0, 117.0))) == [1, 2]
    assert ids(poi.in_cities(dump, spark.createDataFrame([("beijing",)], "city string"))) == [1, 2]


def test_pages_around_equal_single_pages(spark):
    pois = spark.createDataFrame(
        [(k, f"n{k}", "food", "tofu" if k % 2 else "soup", f"{116.4 + k % 7 / 100},{39.9 + k % 5 / 100}") for k in range(60)],
        "arrival int, name string, type string, tag string, location string",
    )
    asked = [(1, 39.9, 116.4, 3.0, 2, 5, "TOFU"), (2, 39.95, 116.45, 5.0, 1, 7, None), (3, 0.0, 0.0, 5.0, 1, 7, "")]
    table = spark.createDataFrame(asked, "request_id int, lat double, lng double, radius_km double, page int, page_size int, keyword string")
    got = sorted((r["request_id"], r["position"], r["arrival"]) for r in poi.pages_around(pois, table).collect())
    want = []
    for key, lat, lng, km, page, size, word in asked:
        found = poi.around_page(pois, lat, lng, int(km * 1000), page, size, word).collect()
        want += [(key, (page - 1) * size + i + 1, r["arrival"]) for i, r in enumerate(found)]
    assert got == sorted(want) and got


def test_equally_far_places_of_a_page_come_in_arrival_order(spark, tmp_path):
    """Suppliers in turn at two places less than a millimetre apart in distance from the centre, against the query's SQL."""
    import duckdb

    import __spark_entry__ as entry_points

    path = str(tmp_path / "supplier.parquet")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT k * 600 + p AS s_suppkey, 's' AS s_name, 1 AS s_nationkey FROM range(40) r(k), (VALUES (299), (301)) v(p)) TO '{path}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    want = db.execute(entry_points.oracle_sql()["poi_around_page"]).fetchall()
    assert len(want) == 20 and len({a % 600 for a, _ in want}) == 2
    assert [tuple(r) for r in entry_points.queries()["poi_around_page"](spark, str(tmp_path)).collect()] == want


def test_equal_page_requests_are_answered_once(spark):
    pois = spark.createDataFrame([(k, "n", "food", "tofu", "116.4,39.9") for k in range(3)], "arrival int, name string, type string, tag string, location string")
    asked = "request_id int, lat double, lng double, radius_km double, page int, page_size int, keyword string"
    table = spark.createDataFrame([(k, 39.9, 116.4, 1.0, 1, 2, w) for k, w in enumerate(["tofu", "TOFU", "", None] * 25)], asked)
    found = poi.pages_around(pois, table)
    assert "Aggregate [_ask" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.request_id, r.position, r.arrival) for r in found.collect()) == [(k, p + 1, p) for k in range(100) for p in range(2)]
