import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import scalar, tokenize
from glyphmill.operators import linear, neighbors, ngrams, signature, sketch, stats
from glyphmill.streaming import state


def test_ngrams_and_matches(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, []), (3, None)], "key int, content array<string>")
    assert {r.ngram: r.freq for r in ngrams.term_frequency(d, 2).collect()} == {"a": 2, "b": 2, "a b": 2, "b a": 1}
    assert {r.ngram: r.freq for r in ngrams.document_frequency(d, 2).collect()} == {"a": 1, "b": 1, "a b": 1, "b a": 1}
    p = spark.createDataFrame([("a b",), ("b",), ("b a b",)], "phrase string")
    m = ngrams.phrase_matches(d, p, 3)
    assert sorted((r.phrase, r.start, r.end) for r in m.collect()) == [("a b", 0, 2), ("a b", 2, 4), ("b", 1, 2), ("b", 3, 4), ("b a b", 1, 4)]
    c = ngrams.contexts(m.where("phrase = 'a b'").join(d, "key"), 4)
    assert sorted(r.feature for r in c.collect()) == sorted(["R1a", "R2b", "L1b", "L2a"])
    n = ngrams.neighbours(spark.createDataFrame([("x y z", 2), ("x", 9), ("<unk> y", 5)], "ngram string, freq int"))
    assert sorted(map(tuple, n.collect())) == [("x y", "Rz", 2), ("y z", "Lx", 2)]


def test_pmi(spark):
    t = spark.createDataFrame([("k", "f", 2), ("k", "g", 2), ("l", "g", 4)], "key string, feature string, value int")
    got = {(r.key, r.feature): r.pmi for r in stats.pmi(t).collect()}
    assert math.isclose(got["k", "f"], math.log(2 * 8 / (4 * 2))) and math.isclose(got["l", "g"], math.log(4 * 8 / (4 * 6)))


def test_letters_round_trip(spark):
    data = [bytes(range(256)), b"", b"\x00"]
    d = spark.createDataFrame([(x,) for x in data], "b binary").select("b", scalar.letters(F.col("b")).alias("t"))
    for r in d.withColumn("back", scalar.unletters(F.col("t"))).collect():
        assert bytes(r.back) == bytes(r.b) and len(r.t) == 2 * len(r.b) and (r.t == "" or r.t.isalpha() and r.t.isupper())


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    d = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    b = sketch.bloom_build(d.where("id < 1000"), "k", 10_000, 7)
    got = {int(r.k): r.member for r in sketch.bloom_probe(d, "k", b, 10_000, 7).collect()}
    assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 2000)) < 30


def test_morris_is_unbiased(spark):
    d = spark.range(200 * 100).select((F.col("id") % 200).alias("k"), F.col("id").alias("o"))
    e = [r.estimate for r in sketch.morris(d, "k", "o").collect()]
    assert abs(np.mean(e) - 100) < 25


def test_morris_of_a_finer_base(spark):
    d = spark.range(100 * 200).select((F.col("id") % 100).alias("k"), F.col("id").alias("o"))
    e = [r.estimate for r in sketch.morris(d, "k", "o", base=1.1).collect()]
    assert abs(np.mean(e) - 200) < 15 and np.std(e) < 80


def test_reservoirs():
    rng = random.Random(2)
    votes = [rng.choice([1, 1, 1, -1]) for _ in range(5000)]
    for base, slack in ((0.0, 0.15), (1.02, 0.25)):
        errors = []
        for seed in range(8):
            r = sketch.Reservoir(512, seed, base)
            for v in votes:
                r.update(v)
            errors.append(r.total() - sum(votes))
        assert abs(np.mean(errors)) < slack * sum(votes)
    r = sketch.Reservoir(8, 0)
    assert r.total() == 0.0
    for v in (-2.0, 1.0, -1.0):
        r.update(v)
    assert r.total() == -2.0
    a = sketch.ReservoirAverage(2048, 1, bound=10)
    values = [rng.uniform(-2, 8) for _ in range(3000)]
    for v in values:
        a.update(v)
    assert abs(a.mean() - np.mean(values)) < 0.6


def test_tomb_counts_on_a_log_scale():
    t = sketch.Tomb(5000, 16)
    for i in range(50):
        t.increment(f"k{i}", 100)
    assert 40 < np.mean([t.get(f"k{i}") for i in range(50)]) < 250 and t.get("other") < 5
    t.set("z", 30)
    assert t.get("z") >= 15 and t.bits_required() == 16 * 5000


def test_signatures(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(0, base), (1, list(reversed(base))), (2, base[:150] + [rng.choice(vocabulary) for _ in range(50)]), (3, [f"z{i}" for i in range(200)])]
    d = spark.createDataFrame(rows, "key int, content array<string>")
    s = d.select("key", signature.of_tokens(F.col("content")).alias("bands"))
    bands = {r.key: r.bands for r in s.collect()}
    assert bands[0] == bands[1] and len(bands[0]) == 16
    t = d.select("key", F.explode("content").alias("feature")).groupBy("key", "feature").agg(F.count("*").alias("value"))
    assert {int(r.key): r.bands for r in signature.of_triples(t).collect()} == bands
    for digests, seed in ((2, "x"), (4, "")):  # another seed, another width
        other = {r.key: r.bands for r in d.select("key", signature.of_tokens(F.col("content"), digests, seed).alias("bands")).collect()}
        assert len(other[0]) == 8 * digests and (other[0] == other[1]) and (other[0][:16] == bands[0]) == (seed == "")
        assert {int(r.key): r.bands for r in signature.of_triples(t, digests=digests, seed=seed).collect()} == other
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["a"] * 70_000 + ["b"])], "key int, content array<string>")
    got = {r.key: r.bands for r in odd.select("key", signature.of_tokens(F.col("content")).alias("bands")).collect()}
    assert got[1] is None and got[2] == [0] * 16 and got[3] == signature.bands(signature.signs(["a"]))[0].tolist()
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 9)], "a int, b int")
    score = {r.b: r.score for r in signature.pair_scores(pairs, s).collect()}

    def cosine(x, y):
        x, y = Counter(x), Counter(y)
        return sum(x[w] * y[w] for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    assert score[1] == 1.0 and score[9] == -1.0
    assert abs(score[2] - cosine(rows[0][1], rows[2][1])) < 0.25 and abs(score[3]) < 0.3


@pytest.fixture(scope="module")
def signed(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 15, (30, 16))
    rows = []
    for i in range(120):
        b = base[i % 30].copy()
        for j in rng.integers(0, 16, i % 3):
            b[j] ^= 1 << int(rng.integers(0, 15))
        rows.append((i, b.tolist()))
    return rows, spark.createDataFrame(rows, "key int, bands array<int>")


def hamming(a, b):
    return sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def test_neighbours(spark, signed):
    rows, s = signed
    exact = neighbors.k_best(s.where("key < 10"), s, 4).collect()
    for q in range(10):
        want = sorted((hamming(rows[q][1], b), i) for i, b in rows)[:4]
        assert [(r.differing, r.key) for r in sorted((r for r in exact if r.query == q), key=lambda r: r.rank)] == want
    near = neighbors.beam(s.where("key < 10"), s, 4, 16, 6).collect()
    assert sum((r.query, r.key) in {(e.query, e.key) for e in exact} for r in near) >= 0.9 * len(exact)
    r = neighbors.ranked(s, 3).collect()
    assert sorted((x.perm, x.rank) for x in r) == [(p, i) for p in range(3) for i in range(120)]


def test_near_duplicates_are_those_of_all_pairs(signed):
    rows, s = signed
    got = {r.key: r.partners for r in neighbors.near_duplicates(s, 10).collect()}
    want = Counter()
    for i, a in rows:
        for j, b in rows:
            if i != j and hamming(a, b) < 10 and any(x == y for x, y in zip(a, b, strict=True)):
                want[i] += 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.9 * sum(want.values())
    assert neighbors.near_duplicates(s, 10, tolerance=1.0).count() == 0


def test_lazy_average_is_the_plain_average():
    rng = random.Random(0)
    learner = linear.PassiveAggressive(variant=1, c=0.5)
    total, n = Counter(), 0
    for _ in range(200):
        x = {f"f{rng.randrange(20)}": rng.random() for _ in range(4)}
        learner.learn(x, 1 if rng.random() < 0.5 + 0.3 * ("f1" in x) else -1)
        for f, w in learner.w.now.items():
            total[f] += w
        n += 1
    # the weights after each record count once
    assert all(math.isclose(w, total[f] / n, abs_tol=1e-9) for f, w in learner.weights().items())


@pytest.mark.parametrize("variant", [0, 1, 2])
def test_learners_learn(spark, variant):
    rng = random.Random(variant)
    rows = []
    for i in range(300):
        y = rng.choice([-1.0, 1.0])
        rows.append(("m", i, y, {"a" if y > 0 else "b": 1.0, f"n{rng.randrange(9)}": 0.3}))
    rows.append(("m", 999, None, {"a": 1.0}))
    d = spark.createDataFrame(rows, "model string, seq int, label double, fields map<string,double>")
    w = {r.feature: r.weight for r in linear.train(d, epochs=2, variant=variant, c=0.5).collect()}
    assert w["a"] > 0 > w["b"]
    many = linear.MulticlassPassiveAggressive(["x", "y", "z"], variant=variant)
    for _ in range(3):
        for c in "xyz":
            many.learn({f"f{c}": 1.0}, {c})
    many.learn({"fx": 1.0}, set())
    got = many.weights()
    assert all(max("xyz", key=lambda k: got.get((k, f"f{c}"), 0)) == c for c in "xyz")
    line = linear.PassiveAggressive(variant=variant, tolerance=0.1, average=False)
    for _ in range(50):
        for x in (1.0, 2.0, 3.0):
            line.learn({"x": x}, 2 * x + 1)
    assert abs(line.weights()["x"] * 2 + line.weights()["bias"] - 5) < 0.6


def test_consolidation_of_nothing_is_null(spark):
    f = spark.createDataFrame([("k", 1, "f", 2.0, 0.0), ("l", 1, "f", 2.0, 4.0), ("l", 2, "f", 1.0, 2.0)], "key string, seq int, feature string, value double, norm double")
    assert {r.key: r.value for r in linear.consolidate(f).collect()} == {"k": None, "l": 0.5}
    assert linear.consolidate(f, binary=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i, (i % 7 - 3) / 10) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "key string, seq bigint, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    batch = {(r.key, r.seq): r.probability for r in linear.running(spark.createDataFrame(rows, "key string, seq bigint, value double")).collect()}
    stream = spark.readStream.schema("key string, seq bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = state.running_classification(stream).writeStream.format("memory").queryName("ran").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.seq): r.probability for r in spark.table("ran").collect()}
    assert got.keys() == batch.keys() and all(math.isclose(got[k], batch[k]) for k in batch)


def test_windowed_stream(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), "a" if i % 2 else "b", 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = state.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, state.windowed_counts(d).collect()))


def test_signatures_take_little_memory():
    """The signs of a batch's different tokens are held as bits."""
    import tracemalloc

    import pyarrow as pa

    bags = pa.array([[f"t{i}" for i in range(j, j + 200)] for j in range(0, 100_000, 200)])
    tracemalloc.start()
    got = signature._of_bags(bags, 2, "")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and len(got) == 500
    assert got[3].as_py() == signature.bands(signature.signs([f"t{i}" for i in range(600, 800)]).sum(axis=0)[None])[0].tolist()


def test_repeats_equal_the_rules_one_by_one(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice([".", "?", "!", "¡", "h", "a", "e", "j", "m", "H", "M", "x", " ", "ü", "\n", "\ue001", chr(0xE000 + len(tokenize._RUNS))]) * rng.choice([1, 1, 2, 3, 5, 8, 20, 60]) for _ in range(30)),) for _ in range(200)] + [("",), (None,)]
    d = spark.createDataFrame(rows, "text string")
    plan = d.select(tokenize.repeats(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan
    assert d.where(~tokenize.repeats(F.col("text")).eqNullSafe(tokenize.rewrite(F.col("text"), tokenize.REPEATS))).count() == 0
