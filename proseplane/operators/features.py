"""Statistical features of documents and the logistic model over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.functions.batches import of_texts
from proseplane.functions.segments import Segments, segmented
from proseplane.operators.lm import LanguageModel, Packed, hashes
from proseplane.operators.rules import band_key

WINDOW = 50
LEAST_WORDS = 30
#: Decimals that the model reads.
DECIMALS = {
    "perplexity": 2, "avg_log_prob": 3, "burstiness": 4, "entropy_cv": 4, "mean_entropy": 3, "transition_density": 2, "sentence_cv": 4, "short_frac": 4,
    "equal_mid_frac": 4, "word_mattr": 4, "comma_density": 2, "punct_density": 2,
}


def _by_first_letter(phrases: tuple[str, ...]) -> str:
    r"""(?iuUd)\b(?:...)\b of phrases of letters, which tries them only where a word begins with one's first letter.

    Letters that fold to others begin words too. Phrases of one first letter keep their order.
    """
    groups: dict[str, list[str]] = {}
    for p in phrases:
        groups.setdefault(p[0], []).append(re.escape(p[1:]))
    folded = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}
    begins = "".join(c + c.upper() + folded.get(c, "") for c in groups)
    body = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())
    return rf"(?Ud)(?<![a-z])(?=[{begins}])(?iu:\b(?:{body})\b)"


TRANSITION = _by_first_letter(book.TRANSITIONS)


def entropy(words: Column) -> Column:
    """Shannon entropy in bits of an array of tokens, from the runs of the sorted array."""
    zero = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    weigh = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(a: Column, w: Column) -> Column:
        same = a["w"].eqNullSafe(w)
        return F.struct(w.alias("w"), F.when(same, a["n"] + 1).otherwise(F.lit(1.0)).alias("n"), F.when(same, a["s"]).otherwise(a["s"] + weigh(a["n"])).alias("s"))

    total = F.size(words).cast("double")
    return F.when(total > 0, F.log2(total) - F.aggregate(F.sort_array(words), zero, step, lambda a: a["s"] + weigh(a["n"])) / total).otherwise(F.lit(0.0))


def mattr(words: Column, window: int = WINDOW) -> Column:
    """Mean share of distinct tokens over all windows; 0 for fewer tokens than one window.

    Each token counts in the windows in which it is the first of its kind, so sorting the tokens with their places
    gives the windows where counts change without walking the windows. The shares are added up window by window, as
    SQL's mean does: the model rounds the mean to four decimals, and means that lie on an edge go by the last bits.
    """
    n = F.size(words).cast("long")
    at = lambda s, kind: s * F.lit(4).cast("long") + F.lit(kind).cast("long")  # noqa: E731 - 0: one less, 1: one more, 3: the window's share

    def changes(placed: Column) -> Column:
        def of(x: Column, k: Column) -> Column:
            before = F.get(placed, k - 1)
            first = F.greatest(x["i"] - window + 1, F.when(before["w"].eqNullSafe(x["w"]), before["i"] + 1).otherwise(F.lit(0).cast("long")), F.lit(0).cast("long"))
            last = F.least(x["i"], n - window)
            return F.when(first <= last, F.array(at(first, 1), at(last + 1, 0))).otherwise(F.array().cast("array<bigint>"))

        return F.flatten(F.transform(placed, of))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))))
    shares = F.transform(F.sequence(F.lit(0).cast("long"), n - window), lambda s: at(s, 3))
    events = F.sort_array(F.concat(F.element_at(F.transform(F.array(placed), changes), 1), shares))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0.0).alias("s"))

    def step(a: Column, e: Column) -> Column:
        kind = F.pmod(e, F.lit(4))
        return F.struct(F.when(kind == 3, a["d"]).when(kind == 1, a["d"] + 1).otherwise(a["d"] - 1).alias("d"), F.when(kind == 3, a["s"] + a["d"] / F.lit(float(window))).otherwise(a["s"]).alias("s"))

    return F.when(n >= window, F.aggregate(events, zero, step, lambda a: a["s"]) / (n - window + 1)).otherwise(F.lit(0.0))


def _variation(of: np.ndarray, values: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, mean and population deviation of each group of values, added up in their order."""
    k = np.bincount(of, minlength=groups)
    mu = np.bincount(of, values, groups) / np.maximum(k, 1)
    return k, mu, np.sqrt(np.bincount(of, (values - mu[of]) ** 2, groups) / np.maximum(k, 1))


def _entropies(parts: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The text and the entropy of each paragraph of eight words at least."""
    sizes = np.bincount(parts.paragraph_of, minlength=len(parts.text_of_paragraph))
    own = sizes[parts.paragraph_of] >= 8
    keys, counts = np.unique(parts.paragraph_of[own] * len(parts.known) + parts.words[own], return_counts=True)
    long = np.flatnonzero(sizes >= 8)
    weighed = np.bincount(keys // max(len(parts.known), 1), counts * np.log2(counts), len(sizes))[long]
    return parts.text_of_paragraph[long], np.log2(sizes[long]) - weighed / sizes[long]


def _mattr(text_of: np.ndarray, words: np.ndarray, texts: int, window: int = WINDOW) -> np.ndarray:
    """mattr() of each text: a word counts in the windows in which it is the first of its kind, shares are added up window by window."""
    n, i = np.bincount(text_of, minlength=texts), np.arange(len(words))
    begin = (np.cumsum(n) - n)[text_of]
    last = begin + n[text_of] - window  # the last window of the word's text
    key = text_of * (words.max(initial=0) + 1) + words
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    before = begin - 1
    before[order[again + 1]] = order[again]
    low, high = np.maximum(np.maximum(i - window + 1, before + 1), begin), np.minimum(i, last)
    some = low <= high
    distinct = np.cumsum(np.bincount(low[some], minlength=len(i) + 1) - np.bincount(high[some] + 1, minlength=len(i) + 1))[:-1]
    starts = i <= last
    return np.bincount(text_of[starts], distinct[starts] / float(window), texts) / np.maximum(n - window + 1, 1)


_OWN = ("entropy_cv", "mean_entropy", "sentence_cv", "short_frac", "equal_mid_frac", "word_mattr", "comma_density", "punct_density")
_LM = ("perplexity", "avg_log_prob", "burstiness")


def own_statistics(parts: Segments) -> dict[str, np.ndarray]:
    """word_count and the features that need no language model, but transition_density."""
    texts, n = parts.texts, np.bincount(parts.text_of, minlength=parts.texts)
    per = lambda c: np.where(n > 0, c * 100.0 / np.maximum(n, 1), 0.0)
    k, mean, spread = _variation(*_entropies(parts), texts)
    two = k >= 2
    of, lengths = parts.text_of_sentence, np.bincount(parts.sentence_of, minlength=len(parts.text_of_sentence)).astype(np.float64)
    lines, mu, sd = _variation(of, lengths, texts)
    enough = (lines >= 3) & (n > 0)
    share = lambda test: np.where(enough, np.bincount(of[test], minlength=texts) / np.maximum(lines, 1), 0.0)
    ratio = lambda test, a, b: np.where(test & (b != 0), a / np.where(b != 0, b, 1.0), 0.0)
    return {
        "word_count": n,
        "entropy_cv": ratio(two, spread, mean),
        "mean_entropy": np.where(two, mean, 0.0),
        "sentence_cv": ratio(enough, sd, mu),
        "short_frac": share(lengths < 6),
        "equal_mid_frac": share((lengths >= 15) & (lengths <= 25)),
        "word_mattr": _mattr(parts.text_of, parts.words, texts),
        "comma_density": per(parts.commas),
        "punct_density": per(parts.commas + parts.marks),
    }


def lm_statistics(parts: Segments, model: Packed) -> dict[str, np.ndarray]:
    """perplexity, avg_log_prob and burstiness.

    Under five words perplexity and avg_log_prob are 0; burstiness needs three sentences of three words.
    """
    texts, doc, sent = parts.texts, parts.text_of, parts.sentence_of
    tokens, lines = np.bincount(doc, minlength=texts), np.bincount(parts.text_of_sentence, minlength=texts)
    lp = model.log_probabilities(hashes(parts.known), parts.words)
    together, own = doc[1:] == doc[:-1], sent[1:] == sent[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.bincount(doc[1:][together], lp[together], texts) / np.maximum(tokens - 1, 1)
        pairs = np.bincount(sent[1:][own], minlength=len(parts.text_of_sentence))
        means = np.bincount(sent[1:][own], lp[own], len(pairs)) / np.maximum(pairs, 1)
        long = pairs >= 2
        k, mu, sd = _variation(parts.text_of_sentence[long], means[long], texts)
        bursts = np.where((lines >= 3) & (k >= 3) & (mu != 0), np.abs(sd / mu), 0.0)
    known = tokens >= 5
    return dict(zip(_LM, (np.where(known, np.minimum(np.exp(-np.where(known, a, 0)), 1e6), 0.0), np.where(known, a, 0.0), bursts), strict=True))


def text_features(docs: DataFrame, text: str = "text", model: Packed | None = None) -> DataFrame:
    """docs with word_count and the features that need no language model; with a packed one, all of them, in one Arrow pass over the texts."""
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    names = _OWN if model is None else (*_OWN, *_LM)

    @F.arrow_udf("word_count int, " + ", ".join(f"{c} double" for c in names))
    def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in of_texts(batch):
                parts = segmented(part)
                found = own_statistics(parts) | ({} if shared is None else lm_statistics(parts, shared.value))
                yield pa.StructArray.from_arrays([pa.array(found["word_count"], pa.int32()), *[pa.array(found[c], pa.float64()) for c in names]], ["word_count", *names])

    docs = docs.withColumn("f_own", statistics(text)).withColumns({c: F.col(f"f_own.{c}") for c in ("word_count", *names)}).drop("f_own")
    n = F.col("word_count")
    marks = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TRANSITION))
    return docs.withColumn("transition_density", F.when(n > 0, marks * F.lit(1000.0) / n).otherwise(F.lit(0.0)))


def lm_features(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, perplexity, avg_log_prob, burstiness) by joins; one shuffle, of a row for each sentence.

    For models too large to send to the workers. Sentences hold all tokens in order, so one pass gives the pairs of
    the text and those within sentences.
    """
    docs = docs.select(key, T.once(F.transform(T.sentences(F.coalesce(F.col(text), F.lit(""))), T.tokens)).alias("f_sentences"))
    words = F.flatten(F.transform("f_sentences", lambda s, i: F.transform(s, lambda w: F.struct(w.alias("w"), i.alias("s")))))
    base = docs.select(key, F.size("f_sentences").alias("sents"), words.alias("t"))
    n = F.size("t")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a["w"].alias("w1"), b["w"].alias("w2"), b["s"].alias("s"), (a["s"] == b["s"]).alias("own"))

    pairs = F.when(n >= 2, F.zip_with(F.slice("t", 1, n - 1), F.slice("t", 2, n - 1), pair))
    rows = base.select(key, "sents", n.alias("n"), F.explode_outer(pairs).alias("p")).where("p is not null").select(key, "sents", "n", "p.*")
    rows = model.log_probabilities(rows)
    each = rows.groupBy(key, "sents", "n", "s").agg(F.sum("lp").alias("all_lp"), F.count("*").alias("all_n"), F.sum(F.when(F.col("own"), F.col("lp"))).alias("own_lp"), F.count(F.when(F.col("own"), F.lit(1))).alias("own_n"))
    mean = F.when(F.col("own_n") >= 2, F.col("own_lp") / F.col("own_n"))
    got = each.groupBy(key, "sents", "n").agg((F.sum("all_lp") / F.sum("all_n")).alias("a"), F.stddev_pop(mean).alias("sd"), F.avg(mean).alias("mu"), F.count(mean).alias("k"))
    known, zero = F.lit(model.available) & (F.col("n") >= 5), F.lit(0.0)
    bursts = F.lit(model.available) & (F.col("sents") >= 3) & (F.col("k") >= 3) & (F.col("mu") != 0)
    return got.select(
        key, F.when(known, F.least(F.exp(-F.col("a")), F.lit(1e6))).otherwise(zero).alias("perplexity"), F.when(known, F.col("a")).otherwise(zero).alias("avg_log_prob"),
        F.when(bursts, F.abs(F.col("sd") / F.col("mu"))).otherwise(zero).alias("burstiness"),
    )


def features(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' key and the columns `keep` with word_count and the twelve features, unrounded; keys are taken to be distinct.

    Where the model goes to the workers this is one pass over docs, and keys don't matter. Up to lm.PACKED_ROWS rows
    it does, and words are told apart by 64-bit hashes there; by themselves beyond that.
    """
    docs = docs.select(key, text, *keep)
    packed = model.packed() if model.available else None
    own = text_features(docs, text, packed).drop(text)
    if packed is not None:
        return own
    if not model.available:
        return own.withColumns({c: F.lit(0.0) for c in _LM})
    return own.join(lm_features(docs, model, key, text), key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in _LM})


def probability(calibration=book.CALIBRATION, intercept: float = book.INTERCEPT, rounded: bool = True) -> Column:
    """The logistic model over feature columns; features of deviation 0 are left out, the logit kept in +-10."""
    z = F.lit(intercept)
    for name, mean, sd, coef in calibration:
        if sd:
            x = F.round(F.col(name), DECIMALS[name]) if rounded else F.col(name)
            z = z + F.lit(coef) * (x - F.lit(mean)) / F.lit(sd)
    z = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z))
    return 1 / (1 + F.exp(-z))


def ngram_score(featured: DataFrame, calibration=book.CALIBRATION, intercept: float = book.INTERCEPT) -> DataFrame:
    """featured with ngram_probability (0 to 100, one decimal), ngram_level and too_short (under 30 words: 0)."""
    short = F.col("word_count") < LEAST_WORDS
    p = F.when(short, F.lit(0.0)).otherwise(F.round(probability(calibration, intercept) * 100, 1))
    return featured.withColumns({"ngram_probability": p, "too_short": short}).withColumn("ngram_level", F.when(F.col("too_short"), F.concat(band_key(F.lit(0.0)), F.lit(" (too short for ngram)"))).otherwise(band_key(F.col("ngram_probability"))))


def combined(rule: Column, ngram: Column, available: Column) -> Column:
    """The greater of both probabilities, the rules' alone without an n-gram score."""
    return F.when(available, F.greatest(rule, ngram)).otherwise(rule)


def fleschkincaid(text: str | Column) -> Column:
    """Flesch-Kincaid grade; 0 without words."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(T.TOKEN), F.lit(0))

    def syllables(w: Column) -> Column:
        w = F.lower(w)
        silent = F.endswith(w, F.lit("e")) & (F.length(w) > 2) & ~F.endswith(w, F.lit("le"))
        return F.greatest(F.regexp_count(F.when(silent, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w), F.lit("[aeiouy]+")), F.lit(1))

    def grade(ws: Column) -> Column:
        n = F.size(ws).cast("double")
        sentences = F.greatest(F.regexp_count(t, F.lit(r"(?U)[.!?]+(?:\s|\z)")), F.lit(1)).cast("double")
        total = F.aggregate(F.transform(ws, syllables), F.lit(0), lambda a, x: a + x).cast("double")
        return F.when(n > 0, F.lit(0.39) * (n / sentences) + F.lit(11.8) * (total / n) - F.lit(15.59)).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(words), grade), 1)
