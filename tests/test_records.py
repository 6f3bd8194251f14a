"""Learners over arrays and scores of records, against the plain ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import linear


@pytest.fixture(scope="module")
def instances():
    rng = random.Random(2)
    rows = []
    for i in rng.sample(range(120), 120):  # not in their order
        rows.append((rng.choice("mn"), i, rng.choice([-1.0, 1.0]), {f"f{rng.randrange(15)}": rng.random() for _ in range(4)} | ({"bias": 7.0} if i == 3 else {})))
    return rows


@pytest.mark.parametrize("variant", [0, 1, 2])
def test_arrays_learn_as_dicts(spark, instances, variant):
    d = spark.createDataFrame(instances, "model string, seq int, label double, fields map<string,double>").repartition(3)
    got = {(r.model, r.feature): r.weight for r in linear.train(d, epochs=3, variant=variant, c=0.3).collect()}
    many = {(r.model, r["class"], r.feature): r.weight for r in linear.train_multiclass(d.select("model", "seq", F.array(F.lit("z").substr(F.lit(1), (F.col("label") > 0).cast("int"))).alias("labels"), "fields"), epochs=2, variant=variant).collect()}
    for m in "mn":
        own = sorted((s, x, y) for n, s, y, x in instances if n == m)
        plain, classes = linear.PassiveAggressive(variant=variant, c=0.3), linear.MulticlassPassiveAggressive(["", "z"], variant=variant)
        for _ in range(3):
            for _, x, y in own:
                plain.learn(x, y)
        for _ in range(2):
            for _, x, y in own:
                classes.learn(x, {"z" if y > 0 else ""})
        assert {f: w for (n, f), w in got.items() if n == m} == pytest.approx(plain.weights())
        assert {(c, f): w for (n, c, f), w in many.items() if n == m} == pytest.approx(classes.weights())


def test_instances_are_not_held(spark, instances):
    """A task's learner gets them one by one from the sorted table."""
    d = spark.createDataFrame(instances, "model string, seq int, label double, fields map<string,double>")
    plan = linear.train(d)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "Sort" in plan


def test_scores_and_bags(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (3, []), (4, None), (5, ["a", "x"]), (5, ["b", "bias"]), (None, ["b"])]
    d = spark.createDataFrame(rows, "key int, content array<string>")
    w = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [-3.0, 0.0]), ("q", [9.0, 9.0])], "feature string, weights array<double>")
    want = {1: [-1.0, 1.0], 2: [0.0, 0.0], 5: [-2.0, 0.5], None: [-3.0, 0.0]}
    got = linear.dot_records(d.repartition(4), w, 2).collect()
    assert {r.key: r.scores for r in got} == want and len(got) == 4
    assert {r.key: r.scores for r in linear.dot_records(d, w.limit(0), 2).collect()} == {k: [0.0, 0.0] for k in want}
    bags, ids, bias = linear.bags(d)
    name = {r.id: r.phrase for r in ids.collect()}
    assert name[bias] == "bias" and set(name.values()) == {"a", "b", "c", "x", "bias"}
    counts = {k: Counter() for k in want}
    for k, c in rows:
        if c:
            counts[k].update(c)
    assert {r.key: {name[i]: v for i, v in zip(r["ids"], r["values"], strict=True)} for r in bags.collect()} == counts


def test_a_frequent_word_is_sent_once(spark):
    """The model is asked for the different words of a part, so no task gets all
    occurrences of a word."""
    from glyphmill.operators import grams

    d = spark.createDataFrame([(i, ["the"] * 50 + [f"w{i}"]) for i in range(30)], "key int, content array<string>").coalesce(1)
    w = spark.createDataFrame([("the", [1.0])], "phrase string, weights array<double>")
    assert grams.Matches(d, w, 1, carry="weights").found.count() == 1
