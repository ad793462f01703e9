"""Near names against the distances of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import names


@pytest.mark.parametrize("most", [0, 1, 2])
def test_near_names_equal_all_pairs(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice("abcé漢") for _ in range(r.choice([0, 1, 2, 3, 5, 8])))
    left, right = [word() for _ in range(60)] + [None, "same", "same"], [word() for _ in range(60)] + [None, "same", "sane", "smae"]
    a, b = (spark.createDataFrame([(x,) for x in v], "name string") for v in (left, right))
    pairs = a.distinct().crossJoin(b.distinct().withColumnRenamed("name", "other")).select("name", "other", F.levenshtein("name", "other").alias("d")).where(F.col("d") <= most)
    want = {(x["name"], x["other"], x["d"]) for x in pairs.collect()}
    assert {tuple(x) for x in names.near(a, b, most).collect()} == want and ("same", "same", 0) in want
    best = {}
    for n, o, d in want:
        best[n] = min(best.get(n, (d, o)), (d, o))
    assert {(x["name"], x["distance"], x["nearest"]) for x in names.closest(a, b, most).collect()} == {(n, *v) for n, v in best.items()}
    assert names.near(a.limit(0), b).count() == 0


def test_settings_from_the_environment(spark):
    from tracelake.sources import backends

    pair = "name string, value string"
    settings = spark.createDataFrame([("model", "a"), ("provider", "p"), ("seed", "1")], pair)
    variables = spark.createDataFrame([("LAKE_MODEL", "b"), ("LAKE_PROVIDER", None), ("LAKE_API_KEY", ""), ("LAKE_SEED", "2"), ("lake_base_url", "x"), ("MODEL", "c")], pair)
    found = backends.with_environment(settings, variables, "LAKE")
    assert sorted(map(tuple, found.collect())) == [("api_key", ""), ("model", "b"), ("provider", "p"), ("seed", "1")]
    over = spark.createDataFrame([("b", "seed", "9")], "model string, name string, value string")
    assert {r["name"]: r["value"] for r in backends.resolved(found, over, "b").collect()}["seed"] == "9"
    assert backends.with_environment(settings, variables.limit(0), "LAKE").count() == 3
