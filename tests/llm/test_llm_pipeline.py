"""The pipeline's stages on a small corpus, each against what it should do."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from glyphmill.llm import bpe
from pyspark.sql import functions as F

from test_llm_operators import ALPHABETS, DOCS, contained, groups_by_hand, prose, rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(4)]
    data = []
    for i in range(120):
        lang = ("aa", "bb", "cc")[i % 3]
        data.append((i, " ".join(rng.choice(ALPHABETS[lang]) for _ in range(60)), lang, f"s{i % 2}"))
    data += [(200 + i, f"Subscribe now\n{prose(rng, 60)}\n", "dd", "s0") for i in range(30)]
    data += [(300, data[0][1], "aa", "s1"), (301, data[125][1] + " more", "dd", "s1"), (302, f"{prose(rng, 30)} {items[1][1]} {prose(rng, 30)}", "dd", "s1"), (303, "%%% 123 ###", "aa", "s0"), (304, None, "aa", "s0"), (305, "", None, None), (None, prose(rng, 40), "dd", "s0"), (306, "Subscribe now", "dd", "s0"), (5, data[5][1], "cc", "s1")]
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in data], DOCS)
    for c in ("extra", "accepted", "pred_lang", "judged", "lines_gone", "_lines_gone", "bad", "x", "tokens_", "a.b"):
        docs = docs.withColumn(c, F.lit(True) if c != "accepted" else F.lit("theirs"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), data, items


def test_stages(spark, corpus, tmp_path):
    d, data, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, after, codec = docs.columns, {}, bpe.Codec(bpe.VOCABULARY)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs
        if name != "bpe":
            assert docs.columns == columns and docs.where("accepted = 'theirs'").count() == docs.count()
        texts = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert {i for i, _ in texts} - set(kept) == {303, 304, 305}
        elif name == "line_dedup":
            assert {i for i, _ in texts} - set(kept) == {306}
            assert all(("Subscribe" not in r.text or r.source != "s0") and r.n_chars == len(r.text) for r in kept.values())
            assert all(kept[i].text == t for i, t in texts if i is not None and i < 200)
        elif name == "near_dedup":
            groups = groups_by_hand(texts, 3, 0.5)
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted((r[0] for r in groups if r[3]), key=repr)
            assert {r[0] for r in groups if not r[3]} >= {300, 301}
            assert docs.where("doc_id = 5").count() == 1
        elif name == "decontaminate":
            assert {i for i, _ in texts} - set(kept) == {x for x, _ in contained(texts, items, 3, 0.8)} == {302}
        else:
            assert all(codec.decode(r.tokens) == r.text.encode() for r in kept.values()) and len(kept) == len({i for i, _ in texts})
    assert rows(corpus_pipeline.run(spark, d).select("doc_id", "text", "tokens")) == rows(after["bpe"].select("doc_id", "text", "tokens"))


def test_empty_tables(spark, corpus, tmp_path):
    d, _, items = corpus
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tokens_are_decoded_in_every_row(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, "")
    assert {r.doc_id: r.round_trip for r in out.collect()} == {1: True, 2: None, 3: True}
