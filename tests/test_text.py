import pytest
from pyspark.sql import functions as F

from forage.functions import text

X = None  # the input column, once a session exists


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_language(values):
    got = values(["素食 vegan", "素食餐厅 bj", "", "vegan"], text.detect_language(X))
    assert got == ["en", "zh", "en", "en"]


def test_latin_tokens(values):
    got = values(["Find the best Vegan-food, near me", " low_carb/keto.. ", "", "the of"], text.query_tokens(X))
    assert got == [["vegan"], ["low", "carb", "keto"], [], []]


def test_cjk_tokens(values):
    got = values(["附近的素食餐厅", "清真火锅 halal", "鱼"], text.query_tokens(X))
    assert got[0][:2] == ["素食", "餐厅"] or got[0][0] == "素食"
    assert "附近" not in got[0] and "的素" in got[0]
    assert got[1] == ["清真", "火锅", "真火", "halal"]
    assert got[2] == ["鱼"]


def test_detected_and_expanded(values):
    tokens = F.split(X, " ")
    assert values(["vegan halal vegan", "素食 ketogenic", "rice"], text.detected_labels(tokens)) == [
        ["vegan", "halal"], ["vegetarian", "keto"], [],
    ]
    expanded = values(["rice keto rice ketogenic"], text.expand_tokens(tokens))[0]
    assert expanded == ["rice", "keto", "ketogenic", "keto friendly", "keto diet", "生酮", "生酮饮食", "酮体"]


def test_phrases(values):
    tokens = F.split(X, " ")
    got = values(["cheap low carb food", "no salt added soup", "gluten free", "gluten", "low carb"], text.merge_phrases(tokens))
    assert got == [["cheap", "low carb", "food"], ["no salt added", "soup"], ["gluten free"], ["gluten"], ["low carb"]]
    # without the step the hyphen split hides the label
    assert values(["gluten-free"], text.detected_labels(text.query_tokens(X))) == [[]]
    assert values(["gluten-free"], text.detected_labels(text.merge_phrases(text.query_tokens(X)))) == [["gluten-free"]]


def test_suggestions(values):
    got = values(["vegn", "to", "for", "vegan", "pizza", "Halla"], text.suggest_word(X))
    assert got == ["vegan", "keto", "food", None, None, "halal"]


def test_correction(values):
    got = values(["Vegn pizza", "vegn-vegn VEGN x1", "pizza", "", "vegan", "vegn2"], text.correct_query(X))
    assert got == ["vegan pizza", "vegan-vegan vegan x1", None, None, None, None]


def test_active_labels(spark):
    row = spark.range(1).select(
        text.active_labels(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("l")
    ).first()
    assert row["l"] == ["b", "a", "c"]


def test_analyze(values):
    got = values(["Plant-based 素食餐厅 Café!", None, "", "a_b"], text.analyze(X))
    assert got == [["plant", "based", "素食", "食餐", "餐厅", "café"], [], [], ["a", "b"]]
