import math

import pytest
from pyspark.sql import functions as F

from forage.functions import display, fixed, labels, nutrition, poi, scores
from forage.sources.catalog import label_catalog

X = None  # the input column, once a session exists


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_rules(values):
    lists = (fixed.ALLERGEN_RULES, fixed.ALLERGEN_FREE_RULES, fixed.DIET_RULES)
    got = [values(["Gluten-free noodle bar", "PEANUT sauce", "donut"], labels.rule_labels(X, r)) for r in lists]
    assert got[0] == [["gluten"], ["peanut", "tree_nut"], ["tree_nut"]]
    assert got[1] == [["gluten"], [], []]
    assert got[2] == [["gluten-free"], [], []]


def test_strict_rules(values):
    inputs = ["gluten-free noodles", "wheat noodles", "donut", "mixed nuts", "无麸质", "nut free, soy milk"]
    got = values(inputs, labels.rule_labels(X, labels.STRICT_ALLERGEN_RULES))
    assert got == [[], ["gluten"], [], ["tree_nut"], [], ["dairy", "soy"]]


def test_rules_keep_patterns(values):
    strict = [(r"\bnut(s)?\b", "tree_nut"), ("low.carb|keto", "low")]
    assert values(["donut", "mixed nuts", "low-carb", "ketone"], labels.rule_labels(X, strict)) == [[], ["tree_nut"], ["low"], ["low"]]


def test_label_catalog(spark):
    rows = spark.createDataFrame(
        [
            ("Gluten-free noodle bar", None, "", ["keto"], [], [], [("Egg roll",), (None,)]),
            (None, "plain", "x", [], ["soy"], ["soy", "egg"], []),
        ],
        "name string, description string, cuisine_type string, diet_labels array<string>, allergens array<string>, "
        "allergen_free array<string>, menu_items array<struct<name:string>>",
    )
    first, second = label_catalog(rows).orderBy(F.col("name").isNull()).collect()
    assert (first["diet_labels"], first["allergens"], first["allergen_free"]) == (["gluten-free", "keto"], ["egg", "gluten"], [])
    assert (second["allergens"], second["allergen_free"]) == (["soy"], ["egg"])


def test_price_bucket(values):
    assert values(["49.9", "50", "100", "199", "200", "n/a", "", None], poi.price_bucket(X)) == [1, 2, 3, 3, 4, None, None, None]


def test_location(values):
    got = values(["116.3,39.9", "bad", "x,39", "116,", None], poi.location(X))
    assert [(r["lat"], r["lng"]) for r in got] == [(39.9, 116.3), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_cuisine(values):
    got = values(["vegan;regional", "fusion;thai", "", None, " thai ;x"], poi.cuisine_name(X))
    assert got == ["纯素", "fusion;thai", "餐厅", "餐厅", "泰餐"]


def test_distance_score(values):
    got = values([2.0, None, 0.0], scores.distance_score(X), kind="double")
    assert got == [pytest.approx(math.exp(-0.5)), 0.5, 1.0]


def test_haversine(spark):
    row = spark.range(1).select(scores.haversine_km(*[F.lit(v) for v in (0.0, 0.0, 0.0, 180.0)]).alias("d")).first()
    assert row["d"] == pytest.approx(6371 * math.pi)


def test_diet_and_final_score(spark):
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    row = spark.range(1).select(
        scores.diet_score(arr("vegan"), arr("egg"), arr("soy"), arr("vegan"), arr("soy", "egg")).alias("a"),
        scores.diet_score(arr("a", "b", "c"), arr(), arr(), arr("a", "b", "c"), arr()).alias("open_top"),
        scores.diet_score(arr(), arr("a", "b"), arr(), arr(), arr("a", "b")).alias("floor"),
        scores.final_score(F.lit("default"), F.lit(5.0), F.lit(1.0), F.lit(0.8), F.lit(1.0)).alias("f"),
        scores.final_score(F.lit("unknown"), F.lit(5.0), F.lit(1.0), F.lit(0.8), F.lit(1.0)).alias("u"),
        scores.final_score(F.lit("diet_first"), F.lit(50.0), F.lit(3.0), F.lit(0.5), F.lit(0.5)).alias("d"),
    ).first()
    assert row["a"] == -0.5 and row["open_top"] == 3 and row["floor"] == -2
    assert row["f"] == pytest.approx(0.645) and row["u"] == row["f"]
    assert row["d"] == pytest.approx(0.2 + 0.6 * 5 / 4 + 0.05 + 0.025)


def test_display(values):
    got = values([999, 1000, 1250, 1449, 1450, None], display.distance_text(X), kind="bigint")
    assert got == ["999m", "1.0km", "1.3km", "1.4km", "1.4km", ""]
    assert values([["soy", "kelp"], []], display.allergen_text(X), kind="array<string>") == ["大豆、kelp", ""]
    assert values([0, 19, 20, 45], display.page_number(X, F.lit(20)), kind="int") == [1, 1, 2, 3]


def test_nutrition(values):
    assert values([2500.0, 1000.0], nutrition.reference_percent(X, "calories"), kind="double") == [100, 50]
    assert values([2500.0], nutrition.reference_share(X, "calories"), kind="double") == [125]
    # one decimal on the exact binary value; exact ties go up
    assert values([1.45, 0.25, 3.85, 2.0], nutrition.portion(X, F.lit(100.0)), kind="double") == [1.4, 0.3, 3.9, 2.0]
    assert values(['["a"]', "[", None, ""], nutrition.json_labels(X)) == [["a"], [], [], []]
    fenced = '```json\n{"name_zh": "x", "calories_per_100g": 12}\n```'
    got = values([fenced, '{"protein_g": 3.5}', "sorry", None], nutrition.parse_estimate(X))
    assert got[0]["name_zh"] == "x" and got[0]["calories_per_100g"] == "12"
    assert got[1]["protein_g"] == "3.5" and got[2] is None and got[3] is None
