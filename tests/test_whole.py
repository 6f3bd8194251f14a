"""Whole jobs, without the bounds that the queries with SQL have."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from glyphmill.operators import neighbors

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not os.path.exists(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def signed(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 15, (20, 16))
    rows = []
    for i in range(90):
        b = base[i % 20].copy()
        for j in rng.integers(0, 16, i % 4 * 6):
            b[j] ^= 1 << int(rng.integers(0, 15))
        rows.append((i, b.tolist()))
    return rows, spark.createDataFrame(rows, "key bigint, bands array<int>")


def differing(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_k_best_against_brute_force(spark, signed, block):
    rows, s = signed
    for every in (1, 3):
        want = {(q, k, d, n + 1) for q, x in rows if q % every == 0 for n, (d, k) in enumerate(sorted((differing(x, y), k) for k, y in rows)[:5])}
        got = [tuple(r) for r in neighbors.k_best(s.where(f"key % {every} = 0"), s, 5, block=block).collect()]
        assert set(got) == want and len(got) == len(want)
    null = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1])], "key bigint, bands array<int>")
    assert {(r.query, r.key) for r in neighbors.k_best(null, null, 1).collect()} == {(None, None), (1, None)}
    assert neighbors.k_best(s.limit(0), s, 5).collect() == [] and neighbors.k_best(s, s.limit(0), 5).collect() == []


@there
def test_query_set_against_all(spark):
    sig = {r["key"]: r["bands"] for r in entry.queries()["doc_signature"](spark, DIR).collect()}
    want = {(q, k, n + 1) for q in sig if q % 50 == 0 for n, (_, k) in enumerate(sorted((differing(sig[q], y), k) for k, y in sig.items())[:10])}
    assert {(r["query"], r["key"], r["rank"]) for r in entry.queries()["kbest"](spark, DIR).collect()} == want and want
    q = entry.queries()["query_protocol"](spark, DIR).collect()
    assert {(r["query"], r["key"]) for r in q} == {(a, k) for a, k, n in want if n <= (3 if a % 200 == 0 else 10)}


@there
def test_recall_of_the_beam(spark):
    sf = DIR.replace("sf0.001", "sf0.01")
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    near = {(r["query"], r["key"]): r["differing"] for r in entry.queries()["beam_kbest"](spark, sf).collect()}
    best = {}
    for r in entry.queries()["kbest"](spark, sf).where("rank <= 5").collect():
        best[r["query"], r["key"]] = r["differing"]
    assert len(near) == len(best) and len(near.keys() & best.keys()) >= 0.9 * len(best)


@pytest.mark.parametrize("block", [7, 1 << 13])
def test_pairs_against_brute_force(spark, signed, block):
    rows, s = signed
    every = sorted((differing(x, y), a, b) for a, x in rows for b, y in rows if a < b)
    got = [(r.differing, r.a, r.b) for r in neighbors.pairs_within(s, 12, block=block).collect()]
    assert sorted(got) == [p for p in every if p[0] <= 12]
    best = [(r.differing, r.a, r.b) for r in neighbors.best_pairs(s, 150, block=block).collect()]
    assert best == every[:150]


@there
def test_graphs_are_of_all_pairs(spark):
    sig = [(r["key"], r["bands"]) for r in entry.queries()["doc_signature"](spark, DIR).collect()]
    every = sorted((differing(x, y), a, b) for a, x in sig for b, y in sig if a < b)
    best = entry.queries()["beam_graph"](spark, DIR).collect()
    assert [(r.differing, r.a, r.b) for r in best] == every[:200]
    first = {}
    for k, x in sorted(sig):
        first.setdefault(tuple(x), k)
    for name, most in (("threshold_graph", 48), ("near_duplicates", 39)):
        links = dict.fromkeys((k for k, _ in sig), 0)
        for d, a, b in every:
            if d <= most:
                links[a] += 1
                links[b] += 1
        got = entry.queries()[name](spark, DIR).collect()
        assert sorted((r.key, r.class_id, r.links) for r in got) == sorted((k, first[tuple(x)], links[k]) for k, x in sig)


@there
def test_coefficients_of_all_events(spark):
    used, want = {}, {}
    events = sorted(spark.read.parquet(f"{DIR}/events.parquet").collect(), key=lambda r: r.event_id)
    for r in events:
        before = used.get(r.user_id, 0)
        for k in (1, 2, 3):
            at = r.user_id, r.event_type, k
            want[at] = want.get(at, 0.0) + 0.5**before - 0.5 ** (before + k)
        used[r.user_id] = before + 1 + r.event_id % 2
    got = {(r.user_id, r.feature, r.k): r.coefficient for r in entry.queries()["allocation_coefficients"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in got)


@there
def test_features_of_all_ids(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    ids = {w: i + 1 for i, w in enumerate(sorted({w for _, t in texts for w in (t or "").split()}))}
    got = entry.queries()["instance_features"](spark, DIR)
    assert got.agg({"id": "max"}).first()[0] == got.select("id").distinct().count() >= 0.99 * len(ids)


@there
def test_no_customer_of_a_nation_goes(spark):
    customers = spark.read.parquet(f"{DIR}/customer.parquet").count()
    assert entry.queries()["weighted_projection"](spark, DIR).count() == customers


def test_tweets_with_tabs_stay(spark, tmp_path):
    rows = [(1, 0, "user", "one\ttwo #x"), (1, 1, "user", "three"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.content for r in entry.queries()["tweet_parse"](spark, str(tmp_path)).collect()}
    assert got[1, 0] == ["one", "two", "#x"] and got[1, 1] == ["three"] and not got[2, 0] and len(got) == 3


@there
def test_learners_take_every_document(spark):
    texts = spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()
    used = [set(r.text.split()) for r in texts if r.text and r.text.split()]
    got = entry.queries()["pa_multiclass"](spark, DIR).collect()
    assert sum(r.n for r in got) == len(used)
    w = [r.feature for r in entry.queries()["pa_regression"](spark, DIR).collect()]
    assert len(w) == len(set(w)) > 0.9 * len(set().union(*used))


@there
def test_weights_of_all_features_are_aligned(spark):
    got = entry.queries()["aligned_weights"](spark, DIR).collect()
    assert len(got) == len({r.id for r in got}) > 50
    assert [r.feature for r in sorted(got, key=lambda r: r.id)] == sorted(r.feature for r in got)


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_links_of_all_pairs(spark, signed, block):
    rows, s = signed
    copies = [*rows, *((1000 + i, rows[i % 3][1]) for i in range(50))]
    d = spark.createDataFrame([*copies, (None, rows[0][1])], "key bigint, bands array<int>")
    want = {a: sum(a != b and differing(x, y) <= 39 for b, y in copies) for a, x in copies}
    first = {}
    for k, x in sorted(copies):
        first.setdefault(tuple(x), k)
    got = neighbors.linked(d, 39, block=block).collect()
    assert {(r.key, r.class_id, r.links) for r in got} == {(k, first[tuple(x)], want[k]) for k, x in copies} and len(got) == len(copies)
    # no band is shared here, which the search by bands needs
    apart = spark.createDataFrame([(1, [0] * 16), (2, [1] * 16)], "key bigint, bands array<int>")
    assert neighbors.near_duplicates(apart, 40).count() == 0 and {r.links for r in neighbors.linked(apart, 40).collect()} == {1}


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_links_are_counted_without_pairs(spark, signed, block, monkeypatch):
    """No list of pairs is made; a key with several signatures isn't linked with itself."""
    monkeypatch.setattr(neighbors, "_met", None)
    monkeypatch.setattr(neighbors, "_TILE", (4, 16))
    rows = [(k % 60, b) for k, b in signed[0]]
    classes = {}
    for k, b in rows:
        classes.setdefault(tuple(b), []).append(k)
    known = [(min(ks), len(ks), b) for b, ks in classes.items()]
    want = {b: n - 1 + sum(m for other, m, c in known if other != k and differing(b, c) <= 40) for k, n, b in known}
    got = neighbors.linked(spark.createDataFrame(rows, "key bigint, bands array<int>").coalesce(1), 40, block=block).collect()
    by_class = {}
    for k, _, b in known:
        by_class.setdefault(k, []).append(want[b])
    assert sorted((r.class_id, r.links) for r in got if r.class_id not in {k for k, v in by_class.items() if len(v) > 1}) == sorted((min(classes[tuple(b)]), want[tuple(b)]) for _, b in rows if len(by_class[min(classes[tuple(b)])]) == 1)


def test_best_pairs_of_equal_signatures(spark, signed, monkeypatch):
    """Where enough pairs are equal, no others are compared."""
    copies = [(i, signed[0][i % 3 * 4][1]) for i in range(60)] + [(None, signed[0][0][1])]
    every = sorted((differing(x, y), a, b) for a, x in copies for b, y in copies if a is not None and b is not None and a < b)
    s = spark.createDataFrame(copies, "key bigint, bands array<int>")
    assert [(r.differing, r.a, r.b) for r in neighbors.best_pairs(s, 1000).collect()] == every[:1000]
    monkeypatch.setattr(neighbors, "_best", None)
    assert [(r.differing, r.a, r.b) for r in neighbors.best_pairs(s, 150).collect()] == every[:150]


def test_beam_against_brute_force(spark, signed):
    """From blocks of ranks, k of a permutation at most; a null key is only its own."""
    rows, s = signed
    near = {}
    for r in neighbors.ranked(s, 4).collect():
        near.setdefault(r.perm, []).append((r["rank"], r.key))
    of, want = dict(rows), set()
    for q in range(0, 90, 3):
        seen = {q}
        for places in near.values():
            at = {k: i for i, k in places}
            seen |= {k for k, i in at.items() if -5 <= i - at[q] <= 4}
        want |= {(q, k, d, n + 1) for n, (d, k) in enumerate(sorted((differing(of[q], of[k]), k) for k in seen)[:6])}
    d = neighbors.beam(s.where("key % 3 = 0"), s, 6, 10, 4)
    assert {tuple(r) for r in d.collect()} == want
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no row for each pair is sent
    null = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1])], "key bigint, bands array<int>")
    assert {tuple(r) for r in neighbors.beam(null, null, 3, 4, 2).collect()} == {(None, None, 0, 1), (1, 1, 0, 1)}
