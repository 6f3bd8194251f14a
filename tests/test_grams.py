"""n-grams and phrases in parts, against brute force; what is sent for them."""

from collections import Counter

import numpy as np
import pytest

from glyphmill.operators import grams, ngrams, signature


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 35, [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 40))) % 30]) for i in range(40)]  # keys 0 .. 4 twice
    rows += [(None, ["w1", "w2"]), (None, ["w1"]), (90, None), (91, []), (92, ["ü", "w1"] * 5)]
    return rows, spark.createDataFrame(rows, "key bigint, content array<string>")


def of(words, n):
    return [(" ".join(words[i : i + k]), i, i + k) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.fixture(params=[7, 1 << 20])
def chunks(request, monkeypatch):
    monkeypatch.setattr(grams, "TOKENS", request.param)


def test_frequent(texts, chunks):
    rows, d = texts
    n = Counter(g for _, c in rows if c for g, _, _ in of(c, 3))
    assert {r.ngram: r.freq for r in grams.frequent(d, 3, 4).collect()} == {g: v for g, v in n.items() if v >= 4}
    docs = Counter(g for _, c in rows if c for g in {g for g, _, _ in of(c, 3)})
    assert {r.ngram: r.freq for r in grams.frequent(d, 3, 3, distinct=True).collect()} == {g: v for g, v in docs.items() if v >= 3}
    weight = Counter()
    for k, c in rows:
        for g, _, _ in of(c or [], 2):
            weight[g] += k / 2 if k is not None else 1
    w = d.selectExpr("content", "key / 2 as w")
    assert {r.ngram: r.freq for r in grams.frequent(w, 2, 20, weight="w").collect()} == {g: v for g, v in weight.items() if v >= 20}


def test_phrases(spark, texts, chunks):
    rows, d = texts
    n = Counter(g for _, c in rows if c for g, _, _ in of(c, 3))
    known = {g for g, v in n.items() if v >= 6} | {"w1 w99", "none"}
    p = spark.createDataFrame([(g,) for g in known], "phrase string")
    want = Counter((k, *m) for k, c in rows if c for m in of(c, 3) if m[0] in known)
    assert Counter(tuple(r) for r in ngrams.phrase_matches(d, p, 3).collect()) == want
    sums = Counter()
    for (k, g, _, _), v in want.items():
        sums[k, g] += v
    norm = Counter()
    for (k, _), v in sums.items():
        norm[k] += v
    assert Counter(tuple(r) for r in ngrams.phrase_features(d, p, 3).collect()) == Counter((k, "N:" + g, v, norm[k]) for (k, g), v in sums.items())
    got = ngrams.phrase_features(d, p, 3, by_length=True, binary=True).collect()
    assert {(r.key, r.feature, r.value) for r in got} == {(k, "bN:" + g, 1) for k, g in sums} and {r.key: r.norm for r in got} == {q: sum(v * len(g) for (k, g), v in sums.items() if k == q) for q in norm}
    about = Counter()
    for _, c in rows:
        for g, s, e in of(c or [], 3):
            if g in known:
                about.update([(g, f"L{j}{c[s - j]}") for j in (1, 2) if s >= j] + [(g, f"R{j}{c[e + j - 1]}") for j in (1, 2) if e + j <= len(c)])
    m = grams.Matches(d, p, 3)
    assert {(r.phrase, r.feature): r.value for r in m.contexts(2, least=2).collect()} == {k: v for k, v in about.items() if v >= 2}
    sig = {r.key: (r.strength, r.bands) for r in m.signatures(2).collect()}
    for g in {g for g, _ in about}:
        own = [(f, v) for (x, f), v in about.items() if x == g]
        assert sig.pop(g) == (len(own), signature.bands((signature.signs([f for f, _ in own]) * np.array([[v] for _, v in own])).sum(axis=0)[None])[0].tolist())
    assert not sig
    none = d.limit(0)
    assert grams.Matches(none, p, 3).places().count() == 0 and grams.frequent(none, 3, 1).count() == 0 and grams.Matches(d, p.limit(0), 3).contexts(2).count() == 0


def test_classes(spark, texts, chunks):
    rows, d = texts
    d = d.selectExpr("key", "content", "case when key % 3 = 0 then 'x' when key % 3 = 1 then 'y' end as c").where("key > 4")
    own = {k: c for k, c in rows if k is not None and k > 4 and c}
    n = Counter(g for c in own.values() for g, _, _ in of(c, 2))
    known = {g for g, v in n.items() if v >= 4}
    kind = lambda k: ("x", "y", None)[k % 3]
    last = {g: kind(max(k for k, c in own.items() if g in {m[0] for m in of(c, 2)})) for g in known}
    cls = grams.last_class(d, spark.createDataFrame([(g,) for g in known], "ngram string"), 2, "key", "c")
    assert {r.phrase: r["class"] for r in cls.collect()} == last
    want = {k: Counter(last[m[0]] for m in of(c, 2) if m[0] in known) for k, c in own.items()}
    got = grams.Matches(d, cls, 2, carry="class").by_class().collect()
    assert {(r.key, r["class"]): (r.value, r.share) for r in got} == {(k, c): (v, v / w.total()) for k, w in want.items() for c, v in w.items()} and len(got) == sum(map(len, want.values()))


def test_little_is_sent(spark):
    """Phrases are asked for once a part; n-grams of rare words aren't sent."""
    d = spark.createDataFrame([(i, ["a", "b"] * 500 + [f"x{i}", f"y{i}"] * 3) for i in range(4)], "key bigint, content array<string>").coalesce(1)
    p = spark.createDataFrame([("a",), ("a b",), ("b a b",)], "phrase string")
    m = grams.Matches(d, p, 3)
    assert m.found.count() == 3 and m.places().count() == 4 * (500 + 500 + 499)
    words = grams.frequent(d, 1, 10)
    sent = {r.ngram for r in grams._order(d.select("content"), 2, grams._Bitmap(words), False, False).collect()}
    assert {"a b", "b a"} <= sent and len(sent) < 5
