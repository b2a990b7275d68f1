from pyspark.sql import functions as F

from forage.operators.substring import containing


def test_stretches_of_places_are_not_sent_to_the_driver(spark):
    places = spark.range(200).select(F.concat(F.lit("p"), "id").alias("place_id"), F.concat(F.lit("place number "), "id").alias("name"), F.lit("x").alias("city"))
    needs = spark.createDataFrame([(1, "number 19", "x"), (2, "", "x"), (3, "er", "y")], "need long, word string, town string")
    met = containing(needs, "word", places, "name", "place_id", {"town": "city"})
    found = sorted((r.need, r.place_id) for r in met.collect())
    assert [p for n, p in found if n == 1] == sorted(["p19", *(f"p{k}" for k in range(190, 200))])
    assert len(found) == 11 + 200
    plan = met._jdf.queryExecution().executedPlan().toString()
    # below a broadcast lie needs or words, no exploded places: those are met by merging
    joins = [line for line in plan.splitlines() if "_key" in line and "Join" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)
