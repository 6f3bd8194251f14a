"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased and every run of other characters than letters is one space.
Each language has a model of order ``ORDER``: absolute discounts, continuation
counts below the highest order, every order interpolated with the next lower.
The models' n-grams stand in sorted arrays of 64-bit hashes, one per order, with
a column of log probabilities and one of back-off weights per language, so one
binary search scores a position in all languages. The language of the lowest
cross-entropy per character wins. It is rejected if that entropy lies beyond what
texts of this language and length show on held-out labelled documents, and beyond
the limit that best parts such texts, mixed ones too, from shuffled ones.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _text
from glyphmill.llm._shared import col, free_names
from glyphmill.ship import ship

ORDER = 4
_A = 0x9E3779B97F4A7C15
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        word, _ = _text._tables()
        out = word.copy()
        for i in np.flatnonzero(word):
            out[i] = unicodedata.category(chr(i))[0] != "N"
        _LETTER.append(out)
    return _LETTER[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of all texts, ORDER - 1 spaces before each, and
    the index where each text's scored characters begin, with one more for the end.
    A text of letters ends with one space that is scored as well."""
    _, lower = _text._tables()
    pad = ORDER - 1
    cps = _text.codepoints("".join("\n" * pad + t + "\n" for t in texts))
    lens = np.array([len(t) + pad + 1 for t in texts], np.int64)
    begin = np.cumsum(lens) - lens
    c = np.where(_letters()[cps], lower[cps], np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    for j in range(pad):
        keep[begin + j] = True
    at = np.cumsum(keep) - keep
    starts = np.append(at[begin] + pad, keep.sum())
    return c[keep], starts


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-grams to ORDER-grams that end at each character."""
    c = c.astype(np.uint64)
    out, power = [c], np.uint64(1)
    for k in range(1, ORDER):
        power = np.uint64((int(power) * _A) & (2**64 - 1))
        h = out[-1].copy()
        h[k:] += c[:-k] * power
        out.append(h)
    return out


def _scored(starts: np.ndarray, n: int) -> np.ndarray:
    ok = np.zeros(n, bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ok[a : b if b == n else b - (ORDER - 1)] = True
    return ok


class Model:
    """Sorted hash arrays of all languages: per order the n-grams' hashes, log
    probabilities and, as contexts, log back-off weights, a column a language."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.hashes: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.unknown = np.zeros(len(languages), np.float32)
        self.mean = np.zeros(len(languages))
        self.var = np.zeros((len(languages), 2))
        self.shuffled = np.zeros(len(languages))
        self.slack = 0.0

    def _find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.hashes[k]
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return at, table[at] == h

    def log_probs(self, g: list[np.ndarray], where: np.ndarray, k: int = ORDER - 1) -> np.ndarray:
        """Log probability of the characters at ``where`` in each language, given
        the k characters before each. ``g``: grams() of the whole array."""
        at, hit = self._find(k, g[k][where])
        out = self.logp[k][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if k == 0:
                out[miss] = self.unknown
            else:
                w = where[miss]
                lower = self.log_probs(g, w, k - 1)
                at, hit = self._find(k - 1, g[k - 1][w - 1])
                out[miss] = lower + np.where(hit[:, None], self.backoff[k - 1][at], np.float32(0))
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the mean negative log probability in each language, and
        the number of characters scored; 0 of a text without letters."""
        c, starts = characters(texts)
        ok = _scored(starts, len(c))
        where = np.flatnonzero(ok)
        total = np.zeros((len(where) + 1, len(self.languages)))
        np.cumsum(self.log_probs(grams(c), where), axis=0, dtype=np.float64, out=total[1:])
        count = np.concatenate(([0], np.cumsum(ok)))
        a = count[starts[:-1]]
        b = count[starts[1:]]
        n = b - a
        return -(total[b] - total[a]) / np.maximum(n, 1)[:, None], n

    def limit(self, language: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
        """The highest cross-entropy at which a text of n characters is accepted."""
        v = self.var[language]
        spread = z * np.sqrt(v[:, 0] + v[:, 1] / np.maximum(n, 1))
        return self.mean[language] + np.maximum(spread, self.slack * (self.shuffled[language] - self.mean[language]))


def _counts(texts: list[str]):
    """Of each order: hashes, Kneser-Ney counts, hashes of contexts and of the
    n-grams without their first character."""
    c, starts = characters(texts)
    ok = _scored(starts, len(c))
    g = grams(c)
    where = np.flatnonzero(ok)
    out = []
    for k in range(ORDER):
        if k == ORDER - 1:
            h, first, n = np.unique(g[k][where], return_index=True, return_counts=True)
        else:  # continuation count: in how many distinct longer n-grams it ends
            longer = np.unique(g[k + 1][where], return_index=True)[1]
            h, first, n = np.unique(g[k][where[longer]], return_index=True, return_counts=True)
            first = longer[first]
        w = where[first]
        out.append((h, n.astype(np.float64), g[k - 1][w - 1] if k else np.zeros(len(h), np.uint64), g[k - 1][w] if k else None))
    return out


def train(samples: dict[str, list[str]], hold_out: int = 4) -> Model:
    """A model of the sampled texts by language. Every ``hold_out``-th text is
    left out of the counts and calibrates rejection."""
    names = sorted(name for name, texts in samples.items() if any(len(t) > 1 for t in texts))
    model = Model(names)
    if not names:
        return model
    held = {n: [t for i, t in enumerate(samples[n]) if i % hold_out == hold_out - 1] or samples[n] for n in names}
    fit = {n: [t for i, t in enumerate(samples[n]) if i % hold_out != hold_out - 1] or samples[n] for n in names}
    counts = {n: _counts(fit[n]) for n in names}
    alphabet = len(np.unique(np.concatenate([counts[n][0][0] for n in names]))) + 1
    for k in range(ORDER):
        # contexts too, for their back-off weights: the spaces before a text end no n-gram
        contexts = [counts[n][k + 1][2] for n in names] if k + 1 < ORDER else []
        everything = np.unique(np.concatenate([*(counts[n][k][0] for n in names), *contexts]))
        model.hashes.append(everything)
        model.logp.append(np.zeros((len(everything), len(names)), np.float32))
        model.backoff.append(np.zeros((len(everything), len(names)), np.float32))
    # where each n-gram of the union has its context and its shorter n-gram
    link: list[dict[int, np.ndarray]] = []
    spaces = [g[-1] for g in grams(np.full(ORDER, 32, np.uint32))]
    for k in range(1, ORDER):
        ctx = np.full(len(model.hashes[k]), spaces[k - 1])
        short = ctx.copy()
        for n in names:
            at = np.searchsorted(model.hashes[k], counts[n][k][0])
            ctx[at], short[at] = counts[n][k][2], counts[n][k][3]
        link.append({0: ctx, 1: short})
    for number, n in enumerate(names):
        below = None
        for k in range(ORDER):
            h, count, ctx, _ = counts[n][k]
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, inv = np.unique(ctx, return_inverse=True)
            total = np.bincount(inv, count)
            types = np.bincount(inv)
            weight = d * types / total
            table = model.hashes[k]
            p = np.zeros(len(table))
            at = np.searchsorted(table, h)
            p[at] = (count - d) / total[inv]
            if k == 0:
                p += weight[0] / alphabet
                model.unknown[number] = np.log(weight[0] / alphabet)
            else:
                lam = np.ones(len(table))
                i = np.minimum(np.searchsorted(contexts, link[k - 1][0]), len(contexts) - 1)
                seen = contexts[i] == link[k - 1][0]
                lam[seen] = weight[i[seen]]
                i = np.minimum(np.searchsorted(model.hashes[k - 1], link[k - 1][1]), len(model.hashes[k - 1]) - 1)
                p += lam * below[i]
                i = np.minimum(np.searchsorted(model.hashes[k - 1], contexts), len(model.hashes[k - 1]) - 1)
                there = model.hashes[k - 1][i] == contexts
                model.backoff[k - 1][i[there], number] = np.log(weight[there])
            model.logp[k][:, number] = np.log(p)
            below = p
    for number, n in enumerate(names):
        ce, size = model.cross_entropies(held[n])
        ce, size = ce[size > 0, number], size[size > 0]
        if not len(ce):
            continue
        mean = np.average(ce, weights=np.sqrt(size))
        off, half = (ce - mean) ** 2, size >= np.median(size)
        model.mean[number] = mean
        model.var[number] = off[half].mean() + 1e-4, (off * size)[~half].mean() if (~half).any() else 1.0
        model.var[number, 1] = max(model.var[number, 1], 1.0)
        rng = np.random.default_rng(0)
        noise, size = model.cross_entropies(["".join(rng.permutation(list(t))) for t in held[n]])
        model.shuffled[number] = max(mean, np.average(noise.min(axis=1)[size > 0], weights=size[size > 0]))
    model.slack = _calibrated(model, held)
    return model


def _calibrated(model: Model, held: dict[str, list[str]]) -> float:
    """How far from typical texts of a language (0) to shuffled ones (1) a text may
    lie: the limit that parts held-out texts, and texts half in one language and
    half in another, best from the same with their characters shuffled; the middle
    of the gap if there is one."""
    names = model.languages
    good = [t for n in names for t in held[n]]
    for a, b in zip(names, names[1:] + names[:1], strict=True):
        good += [f"{x[: len(x) // 2]} {y[: len(y) // 2]}" for x, y in zip(held[a], held[b], strict=False)]
    rng = np.random.default_rng(1)
    far = []
    for texts in (good, ["".join(rng.permutation(list(t))) for t in good]):
        ce, size = model.cross_entropies(texts)
        best = ce.argmin(axis=1)
        span = model.shuffled[best] - model.mean[best]
        ok = (size > 0) & (span > 0)
        far.append(np.sort((ce[np.arange(len(best)), best] - model.mean[best])[ok] / span[ok]))
    if not len(far[0]) or not len(far[1]):
        return 0.0
    limits = np.concatenate(far)
    wrong = (1 - np.searchsorted(far[0], limits, side="right") / len(far[0])) + np.searchsorted(far[1], limits, side="right") / len(far[1])
    at = limits[wrong <= wrong.min() + 1e-12].min()
    above = far[1][far[1] > at]
    return float((at + above[0]) / 2) if len(above) else float(at)


def sample(docs: DataFrame, per_language: int = 400, longest: int = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Up to ``per_language`` labelled texts of each language, of at most
    ``longest`` characters each, those of the least hashed ids."""
    rows = docs.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("t"))
    ok = rows.where("id is not null and lang is not null and length(t) between 1 and " + str(int(longest)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = ok.select("id", "lang").withColumn("r", rank).where(F.col("r") <= per_language).select("id", "lang").distinct()
    got = ok.join(F.broadcast(chosen), ["id", "lang"], "left_semi").orderBy(F.xxhash64("id"), "id", "t").collect()
    out: dict[str, list[str]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def identify_language(docs: DataFrame, model: Model, text_col: str = "text", z: float = 6.0) -> DataFrame:
    """The documents with columns ``pred_lang, cross_entropy, accepted`` (any of
    these names already there is replaced).

    ``pred_lang`` is the language of the least cross-entropy in nats a character,
    the first by name in ties; ``accepted`` says whether that lies within ``z``
    calibrated standard deviations of held-out texts of the language and length,
    or within ``model.slack`` of the way from those to shuffled characters, which
    is calibrated too; texts half in one language and half in another are meant
    to be accepted.
    Null text, text without letters, and every text where no language could be
    learned have a null language and entropy and aren't accepted. Repeated rows
    are judged alike; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() not in ("pred_lang", "cross_entropy", "accepted")]
    [new] = free_names(docs.columns, "judged")
    return _with_verdict(docs, new, model, text_col, z).select(*map(col, kept), f"{new}.*")


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text", z: float = 6.0) -> DataFrame:
    """The documents whose language is accepted by ``identify_language``, all
    columns as they were."""
    [new] = free_names(docs.columns, "judged")
    return _with_verdict(docs, new, model, text_col, z).where(f"{new}.accepted").select(*map(col, docs.columns))


def _with_verdict(docs: DataFrame, name: str, model: Model, text_col: str, z: float) -> DataFrame:
    ship(docs.sparkSession)
    names = model.languages

    @F.pandas_udf("pred_lang string, cross_entropy double, accepted boolean")
    def judge(texts):
        import pandas as pd

        lang, ce, good = [], [], []
        for _, group in _text.pieces(texts.tolist()):
            if not names:
                lang, ce, good = lang + [None] * len(group), ce + [None] * len(group), good + [False] * len(group)
                continue
            e, n = model.cross_entropies(group)
            best = e.argmin(axis=1)
            low = e[np.arange(len(best)), best]
            ok = (n > 0) & (low <= model.limit(best, n, z))
            lang += [names[b] if m else None for b, m in zip(best.tolist(), n.tolist(), strict=True)]
            ce += [x if m else None for x, m in zip(low.tolist(), n.tolist(), strict=True)]
            good += ok.tolist()
        return pd.DataFrame({"pred_lang": lang, "cross_entropy": pd.Series(ce, dtype="float64"), "accepted": good})

    return docs.withColumn(name, judge(col(text_col)))
