import math

import pytest

from forage.operators import diary, evaluation, food, guard, validate
from forage.session import work_path
from forage.streaming import totals

FOODS = "food_id bigint, name_zh string, name_en string, name_pinyin string"


def test_food_prefixes(spark):
    foods = spark.createDataFrame(
        [(1, "白米饭", "Steamed White Rice", "bai mi fan"), (2, "黑米", "Black Rice", "hei mi"), (3, "白菜", "Chinese Cabbage", "bai cai"), (4, "蜂蜜", "Honey", "feng mi"),
         (5, "肉", "Lamb", "yang rou")], FOODS,
    )
    asked = spark.createDataFrame([(1, "白"), (2, "米"), (3, "ri black"), (4, "none"), (5, "Ri  BLACK ")], "query_id bigint, q string")
    got = {}
    for r in food.food_search(asked, foods).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["food_id"])
    # a Chinese prefix matches from the start of a run only
    assert set(got[1]) == {1, 3} and 2 not in got
    assert got[3] == [2, 1] and 4 not in got and got[5] == got[3]
    # score by hand: "black" in one food of five, five words against a mean of 25 / 5
    n, mean, words = 5, 25 / 5, 5
    idf = math.log((n - 1 + 0.5) / 1.5)
    score = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * words / mean))
    one = food.food_search(spark.createDataFrame([(1, "black")], "query_id bigint, q string"), foods).first()
    assert one["score"] == pytest.approx(score, abs=1e-6)


def test_words_of_foods_are_not_broadcast(spark, tmp_path):
    """A small file may hold very many words."""
    spark.range(2000).selectExpr("id AS food_id", "'rice' AS name_zh", "'black rice' AS name_en", "'hei mi' AS name_pinyin").write.parquet(str(tmp_path / "foods"))
    asked = spark.createDataFrame([(1, "ri"), (2, "hei")], "query_id bigint, q string")
    found = food.food_search(asked, spark.read.parquet(str(tmp_path / "foods")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [word" in plan and "BroadcastHashJoin [word" not in plan
    assert found.count() == 20


def test_estimates(spark):
    from forage.sources.food import estimates

    answers = spark.createDataFrame(
        [("Tofu ", '```json\n{"name_zh": "豆腐", "calories_per_100g": "76.5", "diet_labels": ["vegan"]}\n```'), ("x", '{"protein_g": 3}'), ("y", '{"protein_g": '), ("z", "sorry")],
        "food_name string, response string",
    )
    rows = {r["cache_key"]: r for r in estimates(answers).collect()}
    assert sorted(rows) == ["tofu", "x"]
    assert (rows["tofu"]["name_zh"], rows["tofu"]["calories_per_100g"], rows["tofu"]["fat_g"]) == ("豆腐", 76.5, 0.0)
    assert (rows["x"]["name_zh"], rows["x"]["protein_g"], rows["x"]["diet_labels"]) == ("x", 3.0, [])


def test_cascade(spark):
    foods = spark.createDataFrame([(1, "x", "rice", "")], FOODS)
    cached = spark.createDataFrame([("mooncake", "月饼")], "cache_key string, name_zh string")
    asked = spark.createDataFrame([(1, "rice"), (2, " Mooncake "), (3, "zzz")], "query_id bigint, q string")
    rows = food.food_cascade(asked, foods, cached).orderBy("query_id").collect()
    assert [(r["source"], r["requires_confirm"], r["food_id"], r["estimate_name"]) for r in rows] == [
        ("database", False, 1, None), ("llm_estimated", True, None, "月饼"), ("not_found", False, None, None),
    ]


LOG = "id int, user_id int, log_date date, calories_kcal double, protein_g double, fat_g double, carb_g double, created_at timestamp"


def test_totals_and_stream(spark):
    rows = spark.sql(
        "SELECT CAST(id AS int) id, CAST(id % 3 AS int) user_id, date_add(DATE '2024-01-01', CAST(id % 5 AS int)) log_date, "
        "1.0D * id calories_kcal, CAST(NULL AS double) protein_g, 2.0D fat_g, IF(id % 2 = 0, NULL, 1.0D) carb_g, TIMESTAMP '2024-01-01 00:00:00' created_at FROM range(200)"
    )
    path, out = work_path(spark, "log"), work_path(spark, "totals")
    rows.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    totals.start_totals(stream, out, work_path(spark, "state")).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("user_id", "log_date", "calories", "protein_g", "fat_g", "carb_g").collect()))
    assert key(totals.read_totals(spark, out)) == key(diary.daily_totals(rows))
    days = spark.sql("SELECT 7 user_id, DATE '2024-01-01' log_date")
    assert key(diary.daily_totals(rows, days)) == [(7, days.first()["log_date"], 0.0, 0.0, 0.0, 0.0)]
    view = diary.day_view(rows).collect()
    assert len(view) == 200 and [tuple(r[c] for c in ("user_id", "log_date", "id")) for r in view] == sorted(tuple(r[c] for c in ("user_id", "log_date", "id")) for r in view)


def test_diary_table_is_pruned_by_day(spark):
    from forage.sources.diary import append_food_log, read_food_log

    path = work_path(spark, "diary")
    entries = spark.sql(
        "SELECT id, id % 3 user_id, date_add(DATE '2024-01-01', CAST(id % 5 AS int)) log_date, 'lunch' meal_type, id food_id, 'x' food_name, 1.0D quantity_g, "
        "1.0D calories_kcal, 1.0D protein_g, 1.0D fat_g, 1.0D carb_g, TIMESTAMP '2024-01-01 00:00:00' created_at FROM range(60)"
    )
    append_food_log(entries, path)
    day = diary.day_entries(read_food_log(spark, path), 1, "2024-01-03")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert [r["id"] for r in day.collect()] == [i for i in range(60) if i % 3 == 1 and i % 5 == 2]


def test_metrics(spark):
    judged = spark.createDataFrame(
        [(1, 1, False), (1, 2, True), (1, 2, False), (1, 4, True), (1, 12, True), (2, 1, False)], "query_id int, rank_position int, is_relevant boolean"
    )
    keys = ["query_id"]
    p = {r["query_id"]: r["precision_10"] for r in evaluation.precision_at(judged, keys).collect()}
    assert p == {1: pytest.approx(2 / 3), 2: 0.0}
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    n = {r["query_id"]: r["ndcg_10"] for r in evaluation.ndcg_at(judged, keys).collect()}
    assert n == {1: pytest.approx(dcg / ideal), 2: 0.0}
    assert evaluation.mean_reciprocal_rank(judged, keys).first()["mrr"] == pytest.approx(0.25)
    pairs = spark.createDataFrame([(True, True), (True, False), (False, True)], "flagged boolean, warned boolean")
    assert evaluation.allergen_recall(pairs, []).first()["recall"] == 0.5


def test_guard_and_defaults(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "user_id bigint, restaurant_id string")
    catalog = spark.createDataFrame([("a", ["soy", "egg"]), ("b", None)], "restaurant_id string, allergens array<string>")
    profiles = spark.createDataFrame([(1, ["egg", "nuts", "soy"], [], 2), (3, ["egg"], [], 1)], "user_id bigint, allergens array<string>, diet_labels array<string>, price_pref int")
    got = {r["user_id"]: (r["triggered"], r["warning"]) for r in guard.allergen_guard(pairs, catalog, profiles).collect()}
    assert got == {1: (["egg", "soy"], "鸡蛋、大豆"), 2: ([], ""), 3: ([], "")}
    filled = {r["user_id"]: r["allergens"] for r in guard.profile_or_default(pairs.select("user_id").distinct(), profiles).collect()}
    assert filled[2] == [] and filled[3] == ["egg"]
    primary = spark.createDataFrame([("x", 1)], "area string, v int")
    fallback = spark.createDataFrame([("x", 2), ("y", 3)], "area string, v int")
    assert sorted(r["v"] for r in guard.primary_or_fallback(primary, fallback, "area").collect()) == [1, 3]


def test_validation(spark):
    rows = spark.createDataFrame([(0.0, "lunch"), (1.0, "brunch"), (None, None), (2.0, "snack")], "quantity_g double, meal_type string")
    good, bad = validate.split_valid(validate.check_diary(rows))
    assert good.count() == 1 and sorted(r["problems"] for r in bad.collect()) == [["meal_type"], ["quantity_g"], ["quantity_g", "meal_type"]]
    profiles = spark.createDataFrame([(["vegan"], 4), (["paleo"], 5), (None, None)], "diet_labels array<string>, price_pref int")
    assert [r["problems"] for r in validate.check_profiles(profiles).collect()] == [[], ["diet_labels", "price_pref"], []]


def test_portions(spark):
    foods = spark.createDataFrame([(1, 133.0, 24.6, 3.2, 0.0)], "food_id int, calories_per_100g double, protein_g double, fat_g double, carb_g double")
    eaten = spark.createDataFrame([(1, 150.0)], "food_id int, quantity_g double")
    row = diary.portions(foods, eaten).first()
    assert (row["calories"], row["protein_g"], row["fat_g"], row["carb_g"]) == (199.5, 36.9, 4.8, 0.0)
