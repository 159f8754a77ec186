"""Licence scans by a trained paragraph classifier, with DataFrame functions only on the scanning path.

A sparse multinomial logistic regression over word uni- and bigrams tells licence families, licences of no
family that it knows (`unknown`) and ordinary paragraphs from one another. It is trained here with numpy on
variants of the notices below (a fixed set) and a bounded sample of the corpus's own paragraphs, and its
probabilities are calibrated on held-back variants. A prediction counts when the paragraph's words also cover
enough of one of the family's notices. A paragraph is a run of words, over as many lines as they are wrapped: of each
notice the places of its word pairs are known, and from each place on as many words as the notice has, twice, are looked at.
So the work is in proportion to the text, and a notice is found wherever it stands in a line.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.llm.common import drawn
from proseplane.llm.licence_notices import TEMPLATES, UNKNOWN

#: Ordinary paragraphs.
NONE = "none"


@dataclass(frozen=True)
class Config:
    #: Variants of each notice, and the bound of the corpus paragraphs that stand for `unknown`.
    variants: int = 40
    paragraphs: int = 2_000
    #: Bound of the n-grams with weights, and of the words kept of a paragraph to fill variants with.
    features: int = 2_000
    filler: int = 40
    steps: int = 400
    rate: float = 0.5
    l1: float = 2e-4
    calibration: float = 0.25
    #: Share of held-back ordinary paragraphs that may reach the threshold of a family.
    false_alarms: float = 0.001
    #: Share of a notice's word pairs, repeats aside, that a paragraph must cover.
    coverage: float = 0.6


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    threshold: float
    coverage: float
    #: Words of which any paragraph holds one that covers a notice.
    anchors: tuple[str, ...]


_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(paragraph: Column) -> Column:
    """Lower-case words with digits read as 9, without empty ones."""
    return F.filter(F.split(F.regexp_replace(F.lower(paragraph), r"\p{N}+", "9"), _SPLIT), lambda w: w != "")


def pairs(words: Column) -> Column:
    """Distinct word pairs; a single word is its own pair."""
    n = F.size(words)
    two = F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.when(n == 1, words).otherwise(two))


def grams(words: Column) -> Column:
    return F.array_union(words, pairs(words))


def _tokens(s: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", re.sub(r"\d+", "9", s.lower())) if w]


def _pairs(words: list[str]) -> set[str]:
    return set(words) if len(words) == 1 else {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _examples(background: list[frozenset[str]], filler: list[str], config: Config) -> tuple[list[set[str]], np.ndarray]:
    """Feature sets and class numbers; class 0 is unknown. Variants lose words at an end or get others around."""
    rng = np.random.default_rng(19)
    xs: list[set[str]] = []
    ys: list[int] = []
    filler = filler or ["lorem"]

    def add(words: list[str], y: int) -> None:
        xs.append(set(words) | _pairs(words))
        ys.append(y)

    for y, notices in enumerate(TEMPLATES.values(), 1):
        for notice in notices:
            words = _tokens(notice)
            add(words, y)
            for _ in range(config.variants):
                own = [w for w in words if rng.random() > 0.08] if len(words) > 8 else list(words)
                around = [filler[i] for i in rng.integers(len(filler), size=int(rng.integers(0, 12)))]
                k = int(rng.integers(0, len(around) + 1))
                add(around[:k] + own + around[k:], y)
    shared = [w for ns in TEMPLATES.values() for n in ns for w in _tokens(n)]
    for p in background:
        xs.append(set(p))
        ys.append(0)
    for _ in range(20 * config.variants):  # ordinary paragraphs with some words of notices
        own = [filler[i] for i in rng.integers(len(filler), size=int(rng.integers(3, 30)))]
        for w in rng.choice(shared, size=int(rng.integers(1, 4))):
            own.insert(int(rng.integers(0, len(own) + 1)), str(w))
        add(own, 0)
    return xs, np.array(ys)


def known_grams(config: Config) -> list[str]:
    """Words and word pairs of notices, those of more notices first, as far as the bound goes."""
    seen: dict[str, int] = {}
    for ns in TEMPLATES.values():
        for n in ns:
            for g in {*_tokens(n), *_pairs(_tokens(n))}:
                seen[g] = seen.get(g, 0) + 1
    return sorted(sorted(seen, key=lambda g: (-seen[g], g))[: config.features])


def fit(paragraphs: list[str], config: Config = Config()) -> Model:
    """From the notices and whole ordinary paragraphs."""
    known = set(known_grams(config))
    words = [_tokens(p) for p in sorted(set(paragraphs))]
    return fit_reduced([frozenset({*w, *_pairs(w)} & known) for w in words], [x for w in words for x in w], config)


def fit_reduced(paragraphs: list[frozenset[str]], filler: list[str], config: Config = Config()) -> Model:
    """From paragraphs as their known n-grams, and other words of theirs; such as cover a notice are left out."""
    notices = [_pairs(_tokens(n)) for ns in TEMPLATES.values() for n in ns]
    ordinary = [p for p in sorted(paragraphs, key=sorted) if not any(len(n & p) >= 0.5 * len(n) for n in notices)]
    xs, ys = _examples(ordinary, filler, config)
    known = known_grams(config)
    number = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(xs), len(known)), np.float32)
    for i, grams_ in enumerate(xs):
        x[i, [number[g] for g in grams_ if g in number]] = 1
    k = len(TEMPLATES) + 1
    rng = np.random.default_rng(7)
    held = rng.random(len(ys)) < config.calibration
    xt, yt = x[~held], np.eye(k, dtype=np.float32)[ys[~held]]
    balance = (len(yt) / (k * np.maximum(yt.sum(axis=0), 1)))[ys[~held]][:, None].astype(np.float32)
    balance /= balance.mean()
    w, b = np.zeros((len(known), k), np.float32), np.zeros(k, np.float32)
    for _ in range(config.steps):
        s = xt @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - yt) * balance / len(yt)
        w -= config.rate * (xt.T @ p)
        w = np.sign(w) * np.maximum(np.abs(w) - config.rate * config.l1, 0)
        b -= config.rate * p.sum(axis=0)
    logits = x[held] @ w + b
    from proseplane.llm.language_id import temperature  # the same one-parameter calibration

    heat = temperature(logits.astype(np.float64), ys[held])
    s = logits / heat
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    ordinary_best = np.sort(p[ys[held] == 0][:, 1:].max(axis=1)) if (ys[held] == 0).any() else np.zeros(1)
    threshold = float(max(0.5, ordinary_best[min(len(ordinary_best) - 1, int(len(ordinary_best) * (1 - config.false_alarms)))]))
    weights = {g: tuple(map(float, w[i])) for g, i in number.items() if np.any(w[i])}
    return Model((NONE, *TEMPLATES), weights, tuple(map(float, b)), heat, min(threshold, 0.99), config.coverage, anchors(ordinary, config.coverage))


def anchors(ordinary: list[frozenset[str]], coverage: float) -> tuple[str, ...]:
    """For each notice the rarer words of its rarest pairs, of so many pairs that a covering can't miss all."""
    seen: dict[str, int] = {}
    for p in ordinary:
        for w in p:
            seen[w] = seen.get(w, 0) + 1
    rare = lambda w: (w.isdigit(), seen.get(w, 0), -len(w), w)
    out: set[str] = set()
    for notices in TEMPLATES.values():
        for n in notices:
            of = sorted((min(p.split(" "), key=rare) for p in _pairs(_tokens(n))), key=rare)
            least = int(np.ceil(coverage * len(of)))  # pairs that a covering holds
            out.update(of[: len(of) - least + 1])
    return tuple(sorted(out))


def fit_on(docs: DataFrame, text: str = "text", config: Config = Config()) -> Model:
    """fit with paragraphs of docs: one line each, at a place fixed by a hash, of about config.paragraphs documents.

    What is collected of a line, however long, is which n-grams of notices it holds and a few words drawn by a
    hash. Equal texts count once; null texts and lines without words give nothing.
    """
    rows = drawn(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")), "t", config.paragraphs, 31).distinct()
    lines = F.split(F.col("t"), r"\n+")
    words = _with(F.get(lines, F.pmod(F.xxhash64("t", F.lit(37)), F.size(lines)).cast("int")), tokens)
    known = F.split(F.lit("\n".join(known_grams(config))), "\n")
    some = lambda w: F.transform(F.slice(F.array_sort(F.transform(F.array_distinct(w), lambda x: F.struct(F.xxhash64(x, F.lit(41)), x.alias("w")))), 1, config.filler), lambda x: x["w"])
    got = rows.select(_with(words, lambda w: F.struct(F.array_intersect(grams(w), known).alias("known"), some(w).alias("filler"), F.size(w).alias("n"))).alias("p")).select("p.*").where("n > 0").collect()
    return fit_reduced([frozenset(r["known"]) for r in got], sorted({w for r in got for w in r["filler"]}), config)


#: Maps that the weights are dealt over by the CRC of the n-gram, for a map is searched from its beginning.
_MAPS = 1024


def _weights_of(model: Model) -> Column:
    """The model's weights as an array of maps, from one literal that the optimiser parses once."""
    maps: list[dict[str, tuple[float, ...]]] = [{} for _ in range(_MAPS)]
    for g, w in model.weights.items():
        maps[zlib.crc32(g.encode()) % _MAPS][g] = w
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<double>>>")


def _notices(coverage: float = 0.0) -> Column:
    """array<struct<family, pairs, need, reach>>, from one literal; need: pairs that a covering holds, reach: words it may span."""
    rows = []
    for family, notices in TEMPLATES.items():
        for n in notices:
            words = _tokens(n)
            own = sorted(_pairs(words))
            rows.append({"family": family, "pairs": own, "need": max(int(np.ceil(coverage * len(own))), 1), "reach": 2 * len(words)})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,pairs:array<string>,need:int,reach:int>>")


def gate(model: Model) -> str:
    """An expression that the lower case of every paragraph matches which covers a notice."""
    return r"(?<![\p{L}\p{N}])(?:" + "|".join("[0-9]+" if w == "9" else w.replace("9", "[0-9]+") for w in model.anchors) + r")(?![\p{L}\p{N}])"


def classified(words: Column, model: Model) -> Column:
    """struct<family, score, words, some> of a paragraph's words; some: the probability of any licence."""
    k = len(model.families)
    weights = _weights_of(model)

    def of(words: Column) -> Column:
        vectors = F.filter(F.transform(grams(words), lambda g: F.element_at(F.get(weights, F.pmod(F.crc32(g.cast("binary")), F.lit(_MAPS)).cast("int")), g)), lambda v: v.isNotNull())
        logits = F.aggregate(vectors, F.array(*map(F.lit, model.bias)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        scaled = F.transform(logits, lambda x: x / F.lit(model.temperature))
        # each step is bound to a name, for what is written out twice is worked out twice
        return _with(scaled, lambda z: _with(F.array_max(z), lambda top: _with(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)), lambda total: told(words, z, top, total))))

    def told(words: Column, z: Column, top: Column, total: Column) -> Column:
        best = F.array_max(F.slice(z, 2, k - 1))
        family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(F.slice(z, 2, k - 1), best).cast("int") + 1)
        some = 1 - F.exp(F.element_at(z, 1) - top) / total
        return F.struct(family.alias("family"), (F.exp(best - top) / total).alias("score"), words.alias("words"), some.alias("some"))

    return F.element_at(F.transform(F.array(words), of), 1)


def coverage_of(words: Column, family: Column) -> Column:
    """The greatest share of the pairs of one notice of the family that the words hold."""
    def share(own: Column) -> Column:
        held = F.transform(F.filter(_notices(), lambda t: t["family"] == family), lambda t: F.size(F.array_intersect(own, t["pairs"])) / F.size(t["pairs"]).cast("double"))
        return F.coalesce(F.array_max(held), F.lit(0.0))

    return _with(pairs(words), share)


def _with(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


#: A licence expression names several identifiers; each is read as if it stood behind the keyword itself.
_EXPRESSION = r"(?i)(?<=license-identifier[^\n]{0,200})[ \t]+(?:or|and)[ \t]+"


def _words(text: Column) -> Column:
    """array<struct<line, block, w>>: the words of a text with their lines; a line without words begins a new block."""
    lines = F.transform(F.split(F.regexp_replace(text, _EXPRESSION, " License-Identifier: "), "\n"), lambda x, i: F.struct(i.alias("line"), tokens(x).alias("ws")))
    full = F.filter(lines, lambda y: F.size(y["ws"]) > 0)
    return F.flatten(F.transform(full, lambda y, k: F.transform(y["ws"], lambda w: F.struct(y["line"].alias("line"), (y["line"] - k).alias("block"), w.alias("w")))))


def _places(words: Column) -> Column:
    """array<struct<at, block, pair>>: where two words in one block are a pair of some notice."""
    known = sorted({p for ns in TEMPLATES.values() for n in ns for p in _pairs(_tokens(n))})

    def place(x: Column, i: Column) -> Column:
        y = F.get(words, i + 1)
        return F.struct(i.alias("at"), x["block"].alias("block"), F.when(y["block"] == x["block"], F.concat(x["w"], F.lit(" "), y["w"])).alias("pair"))

    every = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), place)
    return F.filter(every, lambda h: F.coalesce(h["pair"].isin(known), F.lit(False)))


def _runs(places: Column, notice: Column) -> Column:
    """array<struct<first, last, share>>: the runs of words that cover enough of one notice, the best where they overlap.

    From each place of a pair the window of `reach` words is looked at; the run is the shortest in it with all its pairs.
    """
    reach = notice["reach"]

    def window(of: Column, h: Column) -> Column:
        """(pair, at) of the places in the window from h, by pair, then place."""
        inside = F.filter(F.slice(of, h["i"] + 1, reach), lambda x: (x["block"] == h["block"]) & (x["at"] < h["at"] + reach - 1))
        return F.sort_array(F.transform(inside, lambda x: F.struct(x["pair"], x["at"])))

    def tight(o: Column) -> Column:
        """The run that ends where the window has all its pairs first, and begins where it has them last."""
        new = F.filter(o, lambda x, k: (k == 0) | (F.get(o, k - 1)["pair"] != x["pair"]))

        def ended(new: Column) -> Column:
            def begun(upto: Column, last: Column) -> Column:
                old = F.filter(upto, lambda x, k: (k == F.size(upto) - 1) | F.coalesce(F.get(upto, k + 1)["pair"] != x["pair"], F.lit(True)))
                return F.struct(F.array_min(F.transform(old, lambda x: x["at"])).alias("first"), (last + 1).alias("last"), (F.size(new) / F.size(notice["pairs"])).alias("share"))

            end = lambda last: _with(F.filter(o, lambda x: x["at"] <= last), lambda upto: begun(upto, last))
            return F.when(F.size(new) >= notice["need"], _with(F.array_max(F.transform(new, lambda x: x["at"])), end))

        return _with(new, ended)

    def run(of: Column, h: Column) -> Column:
        near = F.size(F.array_distinct(F.transform(F.slice(of, h["i"] + 1, reach), lambda x: x["pair"])))  # no fewer than the window has
        return F.when(near >= notice["need"], _with(window(of, h), tight))

    def own(of: Column) -> Column:
        none = F.expr("cast(array() as array<struct<first:int,last:int,share:double>>)")
        # a place inside a run that has the whole notice begins none that covers more
        whole = lambda a, h: (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["share"] == 1) & (h["at"] <= F.get(a, F.size(a) - 1)["last"])
        step = lambda a, h: F.when(F.coalesce(whole(a, h), F.lit(False)), a).otherwise(_with(run(of, h), lambda r: F.when(r.isNull(), a).otherwise(_placed(a, r))))
        return F.when(F.size(of) >= notice["need"], F.aggregate(of, none, step)).otherwise(none)

    mine = F.filter(places, lambda h: F.array_contains(notice["pairs"], h["pair"]))
    return _with(F.transform(mine, lambda h, i: F.struct(i.alias("i"), h["at"].alias("at"), h["block"].alias("block"), h["pair"].alias("pair"))), own)


def _placed(a: Column, x: Column) -> Column:
    """Runs apart from one another, in order, with one more, which begins no earlier than the last: of two that share
    words the one of the greater share, then the shorter, stays."""
    last = F.get(a, F.size(a) - 1)
    better = (x["share"] > last["share"]) | ((x["share"] == last["share"]) & (x["last"] - x["first"] < last["last"] - last["first"]))
    return F.when(F.size(a) == 0, F.array(x)).when(x["first"] > last["last"], F.concat(a, F.array(x))).when(better, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a)


def _apart(entries: Column) -> Column:
    """Those of the entries that share no word, by _placed in order of `first`."""
    return _with(entries, lambda e: F.aggregate(F.array_sort(e), F.filter(e, lambda x: F.lit(False)), _placed))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the column `licences`: array of (paragraph number, family, score), in order.

    Lines of the whole text are numbered from 0. An entry is a run of words, numbered by its first line, that the classifier
    puts in a family above its threshold and that covers enough of one of the family's notices, or `unknown` for a
    licence of none. A line without letters and digits ends a run. Where runs overlap the one that covers most stays,
    a family before `unknown`; of two runs that cover alike the shorter, or the first where both have a whole notice. Null and empty texts have none; equal texts get
    equal entries, repeated rows stay, no rows give no rows. A column of that name is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def entry(run: Column, words: Column) -> Column:
        made = lambda family, share, score: F.struct(run["first"].alias("first"), run["last"].alias("last"), family.alias("family"), share.alias("share"), score.alias("score"))

        def judged(c: Column) -> Column:
            other = F.when(c["some"] >= model.threshold, _with(coverage_of(c["words"], F.lit(UNKNOWN)), lambda share: F.when(share >= model.coverage, made(F.lit(UNKNOWN), share, c["some"]))))
            return _with(coverage_of(c["words"], c["family"]), lambda share: F.when((c["score"] >= model.threshold) & (share >= model.coverage), made(c["family"], share, c["score"])).otherwise(other))

        own = F.transform(F.slice(words, run["first"] + 1, run["last"] - run["first"] + 1), lambda x: x["w"])
        return _with(classified(own, model), judged)

    def found(words: Column) -> Column:
        runs = _with(_places(words), lambda places: F.array_distinct(F.flatten(F.transform(_notices(model.coverage), lambda t: F.transform(_runs(places, t), lambda r: F.struct(r["first"], r["last"]))))))
        return _with(F.filter(F.transform(runs, lambda r: entry(r, words)), lambda e: e.isNotNull()), lambda entries: chosen(entries, words))

    def chosen(entries: Column, words: Column) -> Column:
        vague = F.filter(entries, lambda e: e["family"] == UNKNOWN)

        def both(named: Column) -> Column:
            alone = F.filter(vague, lambda e: ~F.exists(named, lambda x: (x["first"] <= e["last"]) & (e["first"] <= x["last"])))
            return F.array_sort(F.transform(F.concat(named, _apart(alone)), lambda e: F.struct(F.get(words, e["first"])["line"].alias("paragraph"), e["family"].alias("family"), e["score"].alias("score"))))

        return _with(_apart(F.filter(entries, lambda e: e["family"] != UNKNOWN)), both)

    none = F.expr("cast(array() as array<struct<paragraph:int,family:string,score:double>>)")
    return docs.withColumn("licences", F.when(F.rlike(F.lower(whole), F.lit(gate(model))), _with(_words(whole), found)).otherwise(none))
