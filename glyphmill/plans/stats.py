"""Queries of n-grams, phrase matches and key/feature statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import tokenize
from glyphmill.operators import grams, ngrams, stats
from glyphmill.plans.parsing import SQL_TOKENS
from glyphmill.plans.registry import query, table
from glyphmill.storage import by_repeats, cut

D = f"d AS (SELECT doc_id, source, {SQL_TOKENS} AS t FROM documents)"
GRAM = "array_to_string(t[i:i + {k}], ' ')"


def _grams(n: int, distinct: bool = False) -> str:
    parts = [f"SELECT doc_id, array_to_string(t[i:i + {k - 1}], ' ') AS ngram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {k - 2})) AS i FROM d)" for k in range(1, n + 1)]
    return f"g AS ({' UNION ALL '.join(parts)})"


TRIPLES = f"{D}, tr AS (SELECT source AS key, tok AS feature, count(*) AS value FROM (SELECT source, unnest(t) AS tok FROM d) GROUP BY 1, 2)"


def content(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", tokenize.whitespace(F.col("text")).alias("content"))


def triples(spark, d):
    """Words by source, with counts."""
    return content(spark, d).select(F.col("source").alias("key"), F.explode("content").alias("feature")).groupBy("key", "feature").agg(F.count("*").alias("value"))


@query(f"WITH {D}, {_grams(2)} SELECT ngram, count(*) AS freq FROM g GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 100")
def ngram_termfreq(spark, d):
    """The hundred most frequent 1- and 2-grams."""
    return grams.frequent(content(spark, d), 2, 5).orderBy(F.desc("freq"), "ngram").limit(100)


@query(f"WITH {D}, {_grams(2)} SELECT ngram, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 3 = 1 THEN 1.0 ELSE 2.0 END) AS DOUBLE) AS freq FROM g GROUP BY 1 HAVING sum(CASE WHEN doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 3 = 1 THEN 1.0 ELSE 2.0 END) >= 10")
def weighted_wordlist(spark, d):
    w = F.when(F.col("doc_id") % 3 == 0, 0.5).when(F.col("doc_id") % 3 == 2, 2.0)
    return grams.frequent(content(spark, d).withColumn("w", w), 2, 10, weight="w")


@query(f"WITH {D}, {_grams(3)} SELECT ngram, count(DISTINCT doc_id) AS freq FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def ngram_docfreq(spark, d):
    return grams.frequent(content(spark, d), 3, 3, distinct=True)


@query(f"WITH {TRIPLES} SELECT key, CAST(sum(value) AS BIGINT) AS key_freq, sum(value) / (SELECT sum(value) FROM tr) AS probability FROM tr GROUP BY 1")
def key_probability(spark, d):
    t = triples(spark, d)
    return stats.keys(t).crossJoin(F.broadcast(stats.totals(t).select("total"))).select("key", "key_freq", (F.col("key_freq") / F.col("total")).alias("probability"))


@query(f"WITH {TRIPLES} SELECT feature, CAST(sum(value) AS BIGINT) AS feature_freq, count(DISTINCT key) AS n_keys, 1.0 / count(DISTINCT key) AS idf, sum(value) / (SELECT sum(value) FROM tr) AS probability FROM tr GROUP BY 1 HAVING sum(value) >= 2")
def keyfeature_stats(spark, d):
    t = triples(spark, d)
    f = stats.features(t).where("feature_freq >= 2").crossJoin(F.broadcast(stats.totals(t).select("total")))
    return f.select("feature", "feature_freq", "n_keys", (F.lit(1.0) / F.col("n_keys")).alias("idf"), (F.col("feature_freq") / F.col("total")).alias("probability"))


@query(f"WITH {TRIPLES} SELECT count(DISTINCT key) AS n_keys, count(DISTINCT feature) AS n_features, CAST(sum(value) AS BIGINT) AS total FROM tr")
def keyfeature_totals(spark, d):
    return stats.totals(triples(spark, d))


@query(f"WITH {TRIPLES}, f AS (SELECT feature, sum(value) AS ff, count(DISTINCT key) AS n FROM tr GROUP BY 1) SELECT key, feature, value / n AS value FROM tr JOIN f USING (feature) WHERE ff >= 3 AND key IN (SELECT key FROM tr GROUP BY 1 HAVING sum(value) >= 100)")
def tfidf(spark, d):
    t = triples(spark, d)
    return stats.tfidf(t, stats.keys(t).where("key_freq >= 100"), stats.features(t).where("feature_freq >= 3"))


@query(f"WITH {TRIPLES}, k AS (SELECT key, sum(value) AS kf FROM tr GROUP BY 1), f AS (SELECT feature, sum(value) AS ff FROM tr GROUP BY 1) SELECT key, feature, round(ln(value * (SELECT sum(value) FROM tr) / (kf * ff)), 9) AS pmi FROM tr JOIN k USING (key) JOIN f USING (feature) WHERE value >= 3")
def pmi(spark, d):
    t = triples(spark, d)
    return stats.pmi(t).join(t.where("value >= 3").select("key", "feature"), ["key", "feature"], "left_semi").select("key", "feature", F.round("pmi", 9).alias("pmi"))


@query(f"WITH {TRIPLES}, f AS (SELECT feature, sum(value) AS ff, count(DISTINCT key) AS n FROM tr GROUP BY 1), r AS (SELECT key, feature, value, row_number() OVER (PARTITION BY key ORDER BY value / n DESC, feature) AS rank FROM tr JOIN f USING (feature)) SELECT key, feature, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def top_features(spark, d):
    from pyspark.sql import Window

    t = triples(spark, d)
    scored = stats.tfidf(t, stats.keys(t), stats.features(t))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("value"), "feature"))).where("rank <= 5").select("key", "feature", "rank")


PHRASES = "ph AS (SELECT ngram AS phrase, count(*) AS freq FROM g GROUP BY 1 HAVING count(*) >= 20)"
MATCH = "m AS (SELECT doc_id, phrase, i AS start, i + k AS e FROM (" + " UNION ALL ".join(f"SELECT doc_id, array_to_string(t[i + 1:i + {k}], ' ') AS phrase, i, {k} AS k FROM (SELECT doc_id, t, unnest(range(0, len(t) - {k - 1})) AS i FROM d)" for k in (1, 2, 3)) + ") JOIN (SELECT phrase FROM ph) USING (phrase))"


def phrases(spark, d):
    """Frequent 1- to 3-grams, the phrase list of the matching queries."""
    return grams.frequent(content(spark, d), 3, 20).select(F.col("ngram").alias("phrase"), "freq")


@query(f"WITH {D}, {_grams(3)}, {PHRASES}, {MATCH} SELECT doc_id, phrase, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM m")
def phrase_match(spark, d):
    return ngrams.phrase_matches(content(spark, d), phrases(spark, d), 3, key="doc_id")


@query(f"WITH {D}, {_grams(3)}, {PHRASES}, {MATCH} SELECT doc_id, 'N:' || phrase AS feature, count(*) AS value, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS norm FROM m GROUP BY doc_id, phrase")
def ngram_feature(spark, d):
    return ngrams.phrase_features(content(spark, d), phrases(spark, d), 3, key="doc_id")


@query(f"WITH {D}, {_grams(3)}, {PHRASES}, {MATCH} SELECT doc_id, 'bN:' || phrase AS feature, 1 AS value, CAST(round(sum(sum(length(phrase))) OVER (PARTITION BY doc_id), 6) AS BIGINT) AS norm FROM m GROUP BY doc_id, phrase")
def weighted_ngram_feature(spark, d):
    """Binary features, normed by the summed weights of the matches."""
    return ngrams.phrase_features(content(spark, d), phrases(spark, d), 3, by_length=True, binary=True, key="doc_id")


@query(f"WITH {D}, {_grams(3)}, {PHRASES}, {MATCH}, c AS (SELECT doc_id, phrase, start, e, t FROM m JOIN d USING (doc_id)), f AS (SELECT phrase, 'L' || j || t[start + 1 - j] AS feature FROM c, (VALUES (1), (2)) v(j) WHERE start >= j UNION ALL SELECT phrase, 'R' || j || t[e + j] FROM c, (VALUES (1), (2)) v(j) WHERE e + j <= len(t)) SELECT phrase, feature, count(*) AS value FROM f GROUP BY 1, 2 HAVING count(*) >= 3")
def context_features(spark, d):
    """Tokens up to two places about each phrase, with side and distance."""
    return grams.Matches(content(spark, d), phrases(spark, d), 3, "doc_id").contexts(2, least=3)


@query(f"WITH {D}, {_grams(3)}, n AS (SELECT ngram, count(*) AS freq FROM g WHERE NOT contains(ngram, '<unk>') GROUP BY 1 HAVING count(*) >= 3), w AS (SELECT string_split(ngram, ' ') AS w, freq FROM n WHERE contains(ngram, ' ')), f AS (SELECT array_to_string(w[1:len(w) - 1], ' ') AS phrase, 'R' || w[len(w)] AS feature, freq FROM w UNION ALL SELECT array_to_string(w[2:len(w)], ' '), 'L' || w[1], freq FROM w) SELECT phrase, feature, CAST(sum(freq) AS BIGINT) AS value FROM f GROUP BY 1, 2")
def ngram_neighbours(spark, d):
    return ngrams.neighbours(grams.frequent(content(spark, d), 3, 3))


@query("SELECT c_custkey, r_name AS dst, 0.5::DOUBLE + (n_nationkey % 3) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def weighted_projection(spark, d):
    """Nations through a dictionary to regions; tokens without an entry go."""
    return _projection(spark, d, table(spark, d, "nation"))


def _projection(spark, d, nations):
    n = nations.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dictionary = n.select(F.col("n_nationkey").alias("src"), F.col("r_name").alias("dst"), (F.col("n_nationkey") % 3 + 0.5).alias("weight"))
    return ngrams.project(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("token")), dictionary).select("c_custkey", "dst", "weight")


@query(f"WITH {D}, {_grams(2)}, c AS (SELECT ngram AS phrase, arg_max(lang, hash) AS class FROM (SELECT g.ngram, x.lang, x.doc_id AS hash FROM g JOIN documents x USING (doc_id) WHERE ngram IN (SELECT ngram FROM g GROUP BY 1 HAVING count(*) >= 40)) GROUP BY 1) SELECT doc_id, 'Nc:' || class AS feature, count(*) AS value, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS share FROM g JOIN c ON ngram = phrase GROUP BY doc_id, class")
def classed_ngrams(spark, d):
    """Phrase matches by class; a phrase's last class holds; normed by the
    document's number of matches."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "lang", tokenize.whitespace(F.col("text")).alias("content"))
    frequent = cut(grams.last_class(docs, grams.frequent(docs, 2, 40), 2, "doc_id", "lang"))
    once, again = by_repeats(docs, "doc_id")
    out = grams.Matches(once, frequent, 2, "doc_id", carry="class").by_class().withColumnRenamed("key", "doc_id")
    if again is not None:
        counts = ngrams.phrase_matches(again, frequent, 2, "doc_id").join(frequent, "phrase").groupBy("doc_id", "class").agg(F.count("*").alias("value"))
        out = out.union(counts.select("doc_id", "class", "value", F.col("value") / F.sum("value").over(Window.partitionBy("doc_id"))))
    return out.select("doc_id", F.concat(F.lit("Nc:"), "class").alias("feature"), "value", "share")
