"""Operators with exact results, held against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseplane.llm import chat, components, decontaminate, media, mixing, ngram_lm, queries, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables and returns their folder."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


# ---- chat ---------------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def digests(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    probe = r"\### Assistant: </turn> ok"
    by[-7] = [(True, 0, "user", probe), (True, 1, "assistant", probe)]
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


TRICKY = ["", None, "a\\", "\\", "#", "### user: x</turn>\n", "</turn>", "<\\/turn>", "\\h\\c", "é😀", "word " * 700, "a:b", "\n", "::", "x" * 3000, "\\\\#"]


def test_chat_round_trip(spark, tables):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "too: l#"]) if t else "system" if c % 2 else "user", rng.choice(TRICKY)) for c in range(6) for t in range(rng.choice([1, 5, 60]))]
    rows += [(None, 0, "user", "hi"), (None, None, "assistant", "null turn"), (7, 3, "user", "same"), (7, 3, "user", "same"), (8, 0, "system", "only system")]
    rows += [(9, t, "system" if t in (0, 1024) else "assistant" if t % 2 else "user", f"t{t} " * (t % 9)) for t in range(2100)]
    rows += [(10, t, "system" if t == 1030 else "assistant", f"t{t}") for t in range(1020, 1040)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op1_chat_windows(spark, tables(conversations=(rows, CONV))).collect()}
    assert got == digests(rows)


def test_chat_empty_table(spark, tables):
    got = queries.op1_chat_windows(spark, tables(conversations=([], CONV))).collect()
    assert [r["conv_id"] for r in got] == [-7] and got[0]["n_turns"] == 2


def test_chat_windows_keep_their_budget_and_context(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "assistant" if t % 2 else "user", "w " * (5 + t % 40)) for t in range(1, 200)]
    got = chat.format_windows(spark.createDataFrame(rows, CONV).withColumn("formatted", F.lit(1)), budget=200, history=50).withColumn("t", chat.parsed(F.col("formatted"))).orderBy("start").collect()
    assert len(got) > 10
    for k, r in enumerate(got):
        size = sum(len(x["text"].split()) + chat.OVERHEAD for x in r["t"])
        assert size <= 200 and r["t"][0]["role"] == "system" and r["n_turns"] == len(r["t"]) and (r["n_repeated"] >= 1) == (k > 0)
        spans = [r["formatted"][s["first"] : s["first"] + s["length"]] for s in r["loss_spans"]]
        assert spans == [x["text"] for x in r["t"][r["n_repeated"] :] if x["role"] == "assistant"]
    for a, b in zip(got, got[1:], strict=False):
        history = b["t"][1 : b["n_repeated"]]
        assert not history or a["t"][-len(history) :] == history
    assert any(r["n_repeated"] > 1 for r in got)


def test_chat_history_crosses_blocks(spark):
    """Windows go by the order of turns: numbers over several blocks, or sparse ones, change nothing."""
    texts = [(t, "system" if t == 0 else "assistant" if t % 2 else "user", f"t{t} " * (1 + t % 9)) for t in range(2100)]
    of = lambda number: chat.format_windows(spark.createDataFrame([(1, number(t), r, x) for t, r, x in texts], CONV), budget=200, history=50).orderBy("start").collect()
    got = of(lambda t: t)
    assert got == of(lambda t: 5000 * t) and len(got) > 50
    for a, b in zip(got, got[1:], strict=False):
        assert b["formatted"].startswith(chat.OPEN + "system") and b["n_repeated"] > 1 and b["start"] > a["start"]


def plain_windows(turns, budget, history):
    """Windows of one conversation (turn, role, text), as lists of (role, text, repeated)."""
    turns = sorted(((t is not None, t or 0, r, x) for t, r, x in turns))
    turns = [(r, x, len(x.split()) + chat.OVERHEAD) for _, _, r, x in turns]
    head = turns[0] if turns[0][0] == "system" else None
    own = turns[1:] if head else turns
    lead = head[2] if head else 0
    stride = max(budget - history - lead, budget // 4)
    cells, q = defaultdict(list), 0
    for r, x, t in own:
        cells[(q + t - 1) // stride].append((q, r, x, t))
        q += t
    out = []
    for k, cell in sorted(cells.items()):
        late = sum(t for *_, t in cell) > stride
        first = [y for y in cell if late and y[0] // stride < k]  # across the boundary and too much: a window of its own
        out += [w for w in (first, [y for y in cell if y not in first]) if w]
    got = []
    for i, w in enumerate(out):
        before = [(q, r, x) for q, r, x, _ in out[i - 1] if w[0][0] - q <= history] if i else []
        lead_in = [(*head[:2], i > 0)] if head else []
        got.append(lead_in + [(r, x, True) for _, r, x in before] + [(r, x, False) for _, r, x, _ in w])
    return got or [[(*head[:2], False)]]


@pytest.mark.parametrize("numbers", ["dense", "sparse", "negative", "many"])
def test_windows_equal_the_plain_ones(spark, numbers):
    rng = random.Random(len(numbers))
    rows = []
    for c in range(6 if numbers != "many" else 1):
        n = 11_000 if numbers == "many" else rng.choice([1, 30, 200])
        at = {"dense": range(n), "many": range(n), "sparse": sorted(rng.sample(range(10**9), n)), "negative": sorted(rng.sample(range(-(10**6), 10**6), n))}[numbers]
        rows += [(c, t, "system" if not i and c % 2 else "assistant" if i % 2 else "user", " ".join(["w"] * rng.choice([0, 3, 20, 60, 300])) + f" {i}") for i, t in enumerate(at)]
    got = defaultdict(list)
    for r in chat.format_windows(spark.createDataFrame(rows, CONV), budget=200, history=50).withColumn("t", chat.parsed(F.col("formatted"))).orderBy("start").collect():
        got[r["conv_id"]].append([(x["role"], x["text"], i < r["n_repeated"]) for i, x in enumerate(r["t"])])
    for c in {r[0] for r in rows}:
        want = plain_windows([r[1:] for r in rows if r[0] == c], 200, 50)
        if want[0][0][0] == "system" and got[c][0] == want[0][:1]:  # a system turn with nothing in the first cell
            got[c][0] = want[0]
        assert got[c] == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\#<>/:hc\nturn é", max_size=30), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, samples):
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for role in (False, True):
        for s, e, back in df.select("s", chat.escaped(F.col("s"), role).alias("e"), chat.unescaped(chat.escaped(F.col("s"), role)).alias("b")).collect():
            assert back == s and "#" not in e and "</" not in e and (not role or ":" not in e)


# ---- decontamination ----------------------------------------------------------------------------------------


def brute_hits(words, items, window=13):
    hit, found = set(), set()
    for key, w in items:
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(key)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([2, 3, 5, 13]))
def test_automaton_equals_brute_force(rng, window):
    alphabet = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
    items = [(str(i), [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 6, 20]))]) for i in range(rng.randint(0, 5))]
    words = [rng.choice([*alphabet, b"z"]) for _ in range(rng.randint(0, 50))]
    if items and rng.random() < 0.7:
        k = rng.randint(0, len(words))
        words = words[:k] + items[0][1] + words[k:]
    spans, found = decontaminate.SuffixAutomaton(items, window).hits(words)
    hit, want = brute_hits(words, items, window)
    assert {i for s, e in spans for i in range(s, e)} == hit and found == want


ITEM = "item_id long, text string"
LONG = "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen."


def test_decontamination_query(spark, tables):
    bench = [(10, LONG), (9, "tiny Item"), (9, "tiny Item"), (11, ""), (12, None), (None, "nameless thing")]
    texts = [LONG.lower().replace(" ", "--"), "x " * 300 + LONG, "x " * 20 + "a TINY item!", "", None, "...", "one two three", "nameless thing", "é tiny\nitem é " * 3000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, LONG, None, None, None), (0, LONG, "en", "s", 1)]
    sf = tables(documents=(rows, DOC), benchmark=(bench, ITEM))
    got = queries.op4_decontaminate(spark, sf).collect()
    assert len(got) == len(rows)
    items = [("" if k is None else str(k), decontaminate.normalised(t)) for k, t in bench]
    want = Counter()
    for k, t, *_ in rows:
        w = decontaminate.normalised(t)
        hit, found = brute_hits(w, items)
        want[(k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter(map(tuple, got)) == want


def test_several_automata_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 3 + LONG * (i % 3) + "tail words here") for i in range(12)], "doc_id long, text string").withColumn("contamination", F.lit("old"))
    bench = spark.createDataFrame([(i, f"w{i} w{i}") for i in range(5)] + [(9, LONG)], ITEM)
    one, many = ([tuple(r) for r in decontaminate.find_contamination(docs, bench, max_words=m).orderBy("doc_id").select("doc_id", "contamination").collect()] for m in (10_000, 4))
    assert one == many
    none = decontaminate.find_contamination(docs, bench.where("false")).select("contamination.*").collect()
    assert all(r["spans"] == [] and r["n_words"] > 0 for r in none)


def test_spans_are_cut_and_documents_dropped(spark):
    clean = "alpha beta " * 400
    docs = spark.createDataFrame([(0, clean + LONG + " Omega"), (1, LONG), (2, clean), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, LONG)], ITEM)).collect()}
    assert set(got) == {0, 2, 3} and got[0] == clean + ". Omega" and got[2] == clean and got[3] is None


# ---- SimHash ------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if shingles and 2 * bits[b] > len(shingles))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark, tables):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=150)) for _ in range(12)]
    texts = base + [b + " extra" for b in base[:6]] + [b.replace("w1", "W1", 1) for b in base] + [base[0]] * 50 + ["", None, " \t\n", "One", "one two", "ONE two", "é\x85à x y", "long " * 20000]
    rows = [(i * 3 % 101 + 1000 * (i // 101), t, "en", "s", 1) for i, t in enumerate(texts)] + [(5000, base[1], None, None, None), (5000, base[1], None, None, None)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, tables(documents=(rows, DOC))).collect()]
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = brute_components(fps)
    least = defaultdict(lambda: math.inf)
    for (k, *_), root in zip(rows, roots, strict=True):
        least[root] = min(least[root], k)
    assert Counter(got) == Counter((k, format(f, "016x"), least[r]) for (k, *_), f, r in zip(rows, fps, roots, strict=True))


def test_links_of_dense_balls_equal_brute_force(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)}
    fps = sorted(fps)
    edges = simhash.link_fingerprints(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.connected_components(edges).collect()}
    want = brute_components(fps)
    groups = lambda of: sorted(sorted(v) for v in of.values())
    a, b = defaultdict(list), defaultdict(list)
    for f, w in zip(fps, want, strict=True):
        a[w].append(f)
        b[roots.get(f, f)].append(f)
    assert groups(a) == groups(b) and edges.count() < 64 * len(fps)


def test_large_buckets_are_split_without_losing_links():
    rng = np.random.default_rng(5)
    other = rng.integers(0, 1 << 32, 3000, np.uint64)
    other[1500:] = other[:1500] ^ (np.uint64(1) << rng.integers(0, 32, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 1500).astype(np.uint64))
    for seg in (0, 1):  # all share one variant of this segment
        fps = np.unique((other << np.uint64(32 * (1 - seg))) | np.uint64(5 << (32 * seg)))
        edges = [(u, v) for b in simhash._bucket_edges(np.full(len(fps), (32 * seg) << 32), fps) for u, v in zip(*(np.array(c.to_pylist(), np.int64).view(np.uint64).tolist() for c in b.columns), strict=True)]
        assert all((u ^ v).bit_count() <= 3 for u, v in edges)
        root = {f: f for f in fps.tolist()}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[find(u)] = find(v)
        for i, f in enumerate(fps):
            for g in fps[np.flatnonzero(np.bitwise_count(fps ^ f) <= 3)].tolist():
                assert find(int(f)) == find(g), i


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "keep"), (2, "a b c d", "keep")], "fp long, text string, root string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, "fp").collect()} == {1: 1, 2: 1}
    assert [r["fp"] for r in simhash.one_of_each(docs, "fp").collect()] == [1]
    odd = spark.createDataFrame([("x", 3, "t")], "_packed string, media long, text string")
    assert media.store_text(odd).columns == ["_packed", "text", "n_bytes", "media"]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain + star + [(7, 7), (500, 400), (400, 500)], "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{100 + i: 100 for i in range(30)}, 400: 400, 500: 400}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(spark):
    rows = [(3, "same text here now"), (1, "same text here now"), (2, "other words entirely different"), (2, "other words entirely different"), (None, "same text here now"), (None, "null alone in its class"), (None, "null alone in its class"), (9, "nine words"), (9, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine"))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter({(1, "same text here now"): 1, (2, "other words entirely different"): 1, (None, "null alone in its class"): 1, (9, "nine words"): 1, (9, "quite another text"): 1})


# ---- mixing -------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] * (1 + 1e-12)]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("shape", ["even", "skewed", "repeated"])
def test_mix_query(spark, tables, shape):
    rng = random.Random(shape)
    names = ["b", "a", None, "ä", "c" * 300, ""] if shape != "even" else list("abcdefg")
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 40]) or " "), "en", names[0] if rng.random() < 0.4 else rng.choice(names), 1) for i in range(700)]
    if shape == "repeated":
        rows += [(None, "x y z", "en", "a", 1)] * 300 + [(5, "x y", None, None, None)] * 7
    rows += [(9000, None, "en", "a", 1), (9001, "", "en", "zero", 1)]
    sf = tables(documents=(rows, DOC))
    got = queries.op5_mix(spark, sf).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, size(t)) for k, t, *_ in rows)
    sizes, largest, mass = defaultdict(int), defaultdict(int), defaultdict(lambda: [0, 0.0])
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = plain_targets(sizes)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    by_target = {(sizes[s], round(want[s], 6)) for s in sizes}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == by_target
    for r in got:
        mass[(r["source_size"], round(r["target"], 6))][0] += r["taken"]
    for s in sizes:
        same = [x for x in sizes if (sizes[x], round(want[x], 6)) == (sizes[s], round(want[s], 6))]
        assert abs(mass[(sizes[s], round(want[s], 6))][0] - len(same) * want[s]) <= sum(largest[x] for x in same) + 1e-6
    again = queries.op5_mix(spark, sf).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_fold_equals_the_plain_fold(spark):
    """The pivotal steps, done again in Python with the same hashes."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 30), "s" if i % 3 else "t") for i in range(50)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.copies_of(docs, fan_in=64).collect()}
    hashes = docs.select("doc_id", F.xxhash64("doc_id", "source", F.size(F.split(F.trim("text"), " ")).cast("long"), F.lit(0)).alias("h")).collect()
    h = {r["doc_id"]: r["h"] for r in hashes}
    pairs = [(a, b) for a in h.values() for b in h.values()]
    u = {(r["a"], r["b"]): r["u"] for r in spark.createDataFrame(pairs, "a long, b long").withColumn("u", mixing._uniform(F.col("a"), F.col("b"), seed=2)).collect()}
    last = {r["a"]: r["u"] for r in spark.createDataFrame([(x,) for x in h.values()], "a long").withColumn("u", mixing._uniform(F.col("a"), seed=3)).collect()}
    for source in "st":
        own = sorted((h[k], k) for k, r in got.items() if r["source"] == source)
        rate = got[own[0][1]]["target"] / got[own[0][1]]["source_size"]
        whole, f = divmod(rate, 1)
        if f < 1e-9:
            continue
        copies, now = {}, None
        for x, k in own:
            b = [x, k, got[k]["size"], f]
            if now is None:
                now = b
                continue
            a = now
            ab, ba = min(a[3] * a[2], (1 - b[3]) * b[2]), min(b[3] * b[2], (1 - a[3]) * a[2])
            if u[(a[0], b[0])] * (ab + ba) < ba:
                if a[3] * a[2] <= (1 - b[3]) * b[2]:
                    copies[a[1]], now = 0, [*b[:3], b[3] + ab / b[2]]
                else:
                    copies[b[1]], now = 1, [*a[:3], a[3] - ab / a[2]]
            elif b[3] * b[2] <= (1 - a[3]) * a[2]:
                copies[b[1]], now = 0, [*a[:3], a[3] + ba / a[2]]
            else:
                copies[a[1]], now = 1, [*b[:3], b[3] - ba / b[2]]
        copies[now[1]] = int(last[now[0]] < now[3])
        assert {k: got[k]["copies"] for _, k in own} == {k: c + whole for k, c in copies.items()}


def test_mix_draws_without_bias(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 13 + 1).cast("int"))).alias("text"), F.lit("a").alias("source"))
    docs = docs.unionByName(spark.range(400).select((F.col("id") + 1000).alias("doc_id"), F.lit("x y").alias("text"), F.lit("b").alias("source")))
    total = Counter()
    for seed in range(12):
        for r in mixing.copies_of(docs, seed=seed, fan_in=8).where("source = 'a'").collect():
            total[r["size"] > 6] += r["copies"]
    rate = mixing.copies_of(docs).where("source = 'a'").select(F.col("target") / F.col("source_size")).first()[0]
    n = sum(1 for i in range(400) if i % 13 + 1 > 6)
    assert total[True] / (12 * n) == pytest.approx(rate, abs=0.06) and total[False] / (12 * (400 - n)) == pytest.approx(rate, abs=0.06)


def test_mixed_rows_and_empty_tables(spark, tables):
    docs = spark.createDataFrame([(i, "a b c", "s", "mine") for i in range(40)] + [(1, "a b c", "s", "mine")] * 5, "doc_id long, text string, source string, copy string")
    got = mixing.mix(docs)
    assert set(got.columns) == set(docs.columns)
    assert got.count() == pytest.approx(45 * 1.5, abs=1.01)
    assert queries.op5_mix(spark, tables(documents=([], DOC))).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_mix_of_repeated_rows(spark):
    """A third of the rows are one row; others share id, source and size with different texts."""
    rows = [(7, "a b c", "s", 0)] * 4000 + [(8, f"x y w{i % 300}", "s", 1) for i in range(3000)] + [(100 + i, "d e f g", "t", i) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long").repartition(8)
    got = mixing.mix(docs).groupBy("doc_id", "text", "source", "copy").count()
    once, again = ({tuple(r) for r in g.collect()} for g in (got, mixing.mix(docs.repartition(5)).groupBy("doc_id", "text", "source", "copy").count()))
    assert once == again
    taken = {r[0]: r[1] for r in mixing.copies_of(docs).groupBy("doc_id").agg(F.sum("copies")).collect()}
    found = Counter()
    for k, _, _, _, n in once:
        found[k] += n
    assert found == {k: v for k, v in taken.items() if v}
    for k, m in ((7, 4000), (8, 3000)):  # copies are dealt evenly
        at = {c: sum(r[4] for r in once if r[0] == k and r[3] == c) for c in {r[3] for r in once if r[0] == k}}
        assert all(n == m for c, n in at.items() if c <= taken[k] // m) and at.get(taken[k] // m + 1, 0) == taken[k] % m


# ---- media --------------------------------------------------------------------------------------------------


def test_media_query(spark, tables):
    texts = ["", None, "a", "x" * 576, "x" * 577, "é😀\n" * 5000, "y" * 300_000, "a"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "a", None, None, None)]
    got = queries.op7_media(spark, tables(documents=(rows, DOC))).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for k, t, *_ in rows:
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        stored = b"P5\n24 %d\n255\n" % (n // 24) + payload
        r = by[k][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert by[2][0]["feature"] == by[7][0]["feature"] == by[None][0]["feature"] and by[0][0]["feature"] == by[1][0]["feature"]
    assert queries.op7_media(spark, tables(documents=([], DOC))).count() == 0


def test_tiles_are_written(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (30, 40), np.uint8)
    images = spark.createDataFrame([(1, media.encode_pgm(pixels)), (2, b"no image"), (3, None)], "doc_id long, media binary")
    media.write_tiles(media.media_features(images), str(tmp_path / "tiles"))
    rows = spark.read.parquet(str(tmp_path / "tiles")).collect()
    assert [r["doc_id"] for r in rows] == [1]
    tile = media.read_tile(rows[0]["tile"])
    assert tile.shape == (9, 9) and np.allclose(tile, media.area_resize(pixels, 9, 9), rtol=1e-5) and rows[0]["dhash"] == media.difference_hash(media.area_resize(pixels, 9, 9))


def test_images_decode():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6\n# note\n7 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 # c\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P5 3 1 65535\n" + np.array([1, 256, 65535], ">u2").tobytes()) == [[1, 256, 65535]]).all()
    bits = rng.integers(0, 2, (3, 11), np.uint8)
    want = (1 - bits) * 255
    assert (media.decode(b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    assert (media.decode(b"P1\n11 3\n" + b"\n".join(" ".join(map(str, r)).encode() for r in bits)) == want).all()
    palette = b"".join(bytes([i, 255 - i, 7, 0]) for i in range(256))
    pad = bytes((4 - 7 % 4) % 4)
    bmp = b"BM" + (54 + 1024 + 40).to_bytes(4, "little") + bytes(4) + (54 + 1024).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (-5).to_bytes(4, "little", signed=True) + b"\x01\x00\x08\x00" + bytes(24) + palette + b"".join(bytes(r) + pad for r in grey)
    assert (media.decode(bmp) == np.stack([np.full_like(grey, 7), 255 - grey, grey], axis=2)).all()
    for bad in (b"", b"P9", b"P5\n9 9\n255\nxx", b"BM", b"P5\n0 3\n255\n"):
        assert media.features(bad)["error"] is not None
    assert media.features(None) == {}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 9), st.integers(1, 9))
def test_area_resize_equals_the_plain_mean(h, w, rows, columns):
    pixels = np.random.default_rng(h * 31 + w).integers(0, 256, (h, w)).astype(np.uint8)
    fine = np.repeat(np.repeat(pixels.astype(float), rows, axis=0), columns, axis=1)
    want = fine.reshape(rows, h, columns, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(pixels, rows, columns), want)


# ---- language model -----------------------------------------------------------------------------------------


def plain_discounts(counts):
    """Chen and Goodman's, of a Counter of counts; 0.5 where counts of 1 or 2 are missing."""
    n = [sum(v == i for v in counts) for i in range(5)]
    if not n[1] or not n[2]:
        return {1: 0.5, 2: 0.5, 3: 0.5}
    y = n[1] / (n[1] + 2 * n[2])
    d = {1: 1 - 2 * y * n[2] / n[1], 2: 2 - 3 * y * n[3] / n[2], 3: 3 - 4 * y * n[4] / n[3] if n[3] else 1.5}
    return {k: min(max(v, 0.05), k - 0.05) for k, v in d.items()}


def plain_kneser_ney(train, texts, order):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    uni, grams = Counter(), {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = tok(t)
        uni.update(w)
        line = ["<s>"] * (order - 1) + w
        grams[order].update(tuple(line[i : i + order]) for i in range(len(w)))
    for k in range(order - 1, 0, -1):  # how many words stand before; what begins with the mark keeps its count
        for g, n in grams[k + 1].items():
            grams[k][g[1:]] += n if g[:2] == ("<s>", "<s>") else 1
    counted = {k: [n for g, n in grams[k].items() if k < 3 or g[:2] != ("<s>", "<s>")] for k in grams}
    d = {k: plain_discounts(c) for k, c in counted.items()}
    follow = defaultdict(Counter)
    for k in range(2, order + 1):
        for g, n in grams[k].items():
            follow[g[:-1]][min(n, 3)] += 1
            follow[g[:-1]]["total"] += n
    N, V, P = sum(uni.values()), len(uni), sum(grams[1].values())
    rest = sum(d[1][min(v, 3)] for v in grams[1].values()) / P if P else 1.0

    def p(g):
        if len(g) == 1:
            n = grams[1][g]
            return (n - d[1][min(n, 3)] if n else 0) / max(P, 1) + rest / (V + 1)
        f = follow[g[:-1]]
        if not f["total"]:
            return p(g[1:])
        n = grams[len(g)][g]
        free = sum(d[len(g)][k] * f[k] for k in (1, 2, 3)) / f["total"]
        return (n - d[len(g)][min(n, 3)] if n else 0) / f["total"] + free * p(g[1:])

    out = []
    for t in texts:
        w = tok(t)
        line = ["<s>", *w]
        base = sum(math.log10((uni[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w)
        out.append((len(w), sum(uni[x] > 0 for x in w), N, base, sum(math.log10(p(tuple(line[max(0, i + 1 - order) : i + 1]))) for i in range(1, len(line)))))
    known = [*uni, b"\x00never"]
    for context in [g[:-1] for g in grams[order]][:4]:
        assert sum(p((*context, b)) for b in known) == pytest.approx(1)
    return out


def lm_texts():
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"W{i}" for i in range(30)] + ["é", "b"], weights=[1 / (i + 1) for i in range(32)], k=rng.choice([0, 1, 9, 60]))) for _ in range(120)]
    return texts + ["", None, " \t", "never seen before", "x" * 5000, texts[0], texts[0]]


@pytest.mark.parametrize(("fan", "numbered"), [(11, 1 << 20), (2, 1 << 20), (2, 8), (11, 0)])  # dealt at once, or in several passes
def test_language_model_query(spark, tables, monkeypatch, fan, numbered):
    monkeypatch.setattr(ngram_lm, "NUMBERED", numbered)
    monkeypatch.setattr(ngram_lm, "RANGE_BYTES", 600)  # several ranges
    monkeypatch.setattr(ngram_lm, "FAN", fan)
    texts = lm_texts()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "null id", None, None, None)]
    got = {r["doc_id"]: r for r in queries.op9_language_model(spark, tables(documents=(rows, DOC))).collect()}
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    want = plain_kneser_ney([t for k, t, *_ in rows if not held(k)], [t for _, t, *_ in rows], 3)
    for (k, *_), (n, known, total, base, score) in zip(rows, want, strict=True):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score) and r["perplexity"] == pytest.approx(10 ** (-score / n))


def local_model(folder, texts, order, bits, word_bits, named=0):
    """The model of texts by the tasks' own functions, without Spark; the first `named` words have numbers."""
    words = ngram_lm.hashed(pa.array([t or "" for t in texts], pa.large_string()))[0][::-1][:named]
    shared = SimpleNamespace(value=ngram_lm.Names(words))
    groups = max(0, bits - ngram_lm.SHARE)
    slots, word_slots = list(range(1 << groups)), list(range(1 << word_bits))
    first, last = ngram_lm._Deal(groups, groups, slots, shared), ngram_lm._Deal(word_bits, word_bits, word_slots, shared)
    batch = lambda ts: pa.RecordBatch.from_arrays([pa.array(ts, pa.string())], names=["t"])
    rows = [r for ts in (texts[::2], texts[1::2]) for r in ngram_lm._counter(order, first)(iter([batch(ts)]))]

    def grouped(rows, reduce):
        by = defaultdict(list)
        for r in rows:
            by[r.column(0)[0].as_py()].append(r)
        return [x for s, own in by.items() for x in reduce((pa.scalar(s),), iter(own))]

    for level in range(order, 1, -1):
        rows = grouped(rows, ngram_lm._reducer(level, folder, {s: s for s in slots}, bits, first if level > 2 else last))
    sums = [dict(zip(ngram_lm._SUMS, x, strict=True)) for b in grouped(rows, ngram_lm._word_reducer(folder, {s: s for s in word_slots})) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    total = lambda level, x: sum(s[x] for s in sums if s["level"] == level)
    d = tuple(ngram_lm.discounts([total(k, f"c{i}") for i in range(1, 5)]) for k in range(1, order + 1))
    c1, c2, pairs, distinct = total(1, "c1"), total(1, "c2"), total(1, "ahead"), total(1, "distinct")
    there = {k: np.array(sorted(s["part"] for s in sums if s["level"] == k)) for k in range(1, order + 1)}
    return ngram_lm.Model(folder, order, bits, word_bits, total(1, "tokens"), distinct, pairs, d, (d[0][0] * c1 + d[0][1] * c2 + d[0][2] * (distinct - c1 - c2)) / pairs, there)


@pytest.mark.parametrize(("order", "bits", "named"), [(2, 0, 0), (2, 12, 40), (3, 0, 10_000), (3, 12, 0), (3, 12, 40)])
def test_thousands_of_ranges_under_few_open_files(tmp_path, order, bits, named):
    import resource

    rng = random.Random(8)
    texts = lm_texts() + [" ".join(rng.choices([f"v{i}" for i in range(150)], k=40)) for _ in range(100)]
    model = local_model(str(tmp_path / "m"), texts, order, bits, bits // 2, named)
    files = sum(map(len, model.ranges.values()))
    assert files == len(list((tmp_path / "m").iterdir())) and (bits == 0 or files > 2000)
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = len(__import__("os").listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (used + 140, limits[1]))  # MAPS and little more, less than 256 for a worker
    try:
        scorer = ngram_lm.Scorer(model)
        got = scorer(pa.array([t or "" for t in texts], pa.large_string()))
        assert len(scorer.files.mapped) <= ngram_lm.MAPS
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    for i, (n, known, _, base, score) in enumerate(plain_kneser_ney(texts, texts, order)):
        assert (got["n_tokens"][i], got["n_known"][i]) == (n, known) and got["base_score"][i] == pytest.approx(base) and got["score"][i] == pytest.approx(score)


def test_a_task_opens_each_file_once(tmp_path, monkeypatch):
    opened = Counter()
    real = ngram_lm.Files._map
    monkeypatch.setattr(ngram_lm.Files, "_map", lambda self, name: opened.update([name]) or real(self, name))
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(400)], k=80)) for _ in range(120)]
    model = local_model(str(tmp_path / "m"), texts, 3, 9, 8)
    assert sum(map(len, model.ranges.values())) > 4 * ngram_lm.MAPS
    together, apart = ngram_lm.Scorer(model), ngram_lm.Scorer(model)
    batches = [pa.array(texts[i : i + 10], pa.large_string()) for i in range(0, len(texts), 10)]
    for b in batches:
        together.add(b)
    got = together.score()
    assert max(opened.values()) == 1 and not together.waiting and not together.tokens
    want = [apart(b) for b in batches]
    for name, x in got.items():
        assert np.array_equal(x, np.concatenate([w[name] for w in want]))


@pytest.mark.parametrize("gather", [1, 300, 1 << 22])
def test_scores_do_not_depend_on_what_is_looked_up_together(spark, gather):
    """Scores of many small Arrow batches, given out at once, after some batches or at the end of the task."""
    rows = [(i, t) for i, t in enumerate(lm_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    model = ngram_lm.train(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r["lm"] for r in ngram_lm.score(docs, model, gather=gather).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ngram_lm.forget(spark, model)
    texts = [t for _, t in rows]
    assert len(got) == len(rows)
    for i, (n, known, _, base, score) in enumerate(plain_kneser_ney(texts, texts, 3)):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known) and got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score)


def test_a_word_pair_that_is_not_there_is_hardly_ever_found():
    """24 bits of a hash are compared in a bucket of about 16 keys: once in a million; whole hashes never err."""
    rng = np.random.default_rng(5)
    keys, others = np.unique(rng.integers(0, 1 << 63, 200_000, np.uint64)), rng.integers(1 << 63, (1 << 64) - 1, 4_000_000, np.uint64, endpoint=True)
    keys = keys << np.uint64(1)  # over the whole line, like the others
    others = others << np.uint64(1) | np.uint64(1)
    n = np.ones(len(keys), np.int64)
    found = np.count_nonzero(ngram_lm._find(ngram_lm._section(keys, [n]), others, 1))
    assert found <= 16 and (ngram_lm._find(ngram_lm._section(keys, [n]), keys, 1) == 1).all()
    assert not ngram_lm._find(ngram_lm._section(keys, [n], whole=True), others, 1).any()


def test_short_words_are_hashed_as_arrays(monkeypatch):
    """XXH64 of words of every length, case and place; only words of 32 bytes and more are hashed one by one."""
    rng, real, alone = random.Random(11), xxhash.xxh64_intdigest, []
    letters = "aBZ@[`{é語😀\x00\x1c\x7f\xa0"
    words = ["".join(rng.choices(letters, k=k)) for k in range(1, 40) for _ in range(6)] + ["A" * k for k in range(1, 70)]
    texts = ["", *(rng.choice(" \t\n\v\f\r").join(rng.choices(words, k=rng.choice([1, 1, 2, 50]))) for _ in range(200)), "", " ", " x ", "x", "x"]
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed: alone.append(w) or real(w, seed))
    got, code, bounds = ngram_lm.hashed(pa.array([None, "gone", *texts], pa.large_string()).slice(2))
    lines = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    assert alone and min(map(len, alone)) >= 32 and len(alone) == len(set(alone))
    assert bounds.tolist() == np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist() and got[-1] == ngram_lm._END
    assert got[code].tolist() == [h for x in lines for h in [*(real(w, 1) for w in x), int(ngram_lm._END)]]
    none = ngram_lm.hashed(pa.array([], pa.large_string()))
    assert none[0].tolist() == [int(ngram_lm._END)] and len(none[1]) == 0 and none[2].tolist() == [0]


@pytest.mark.parametrize("bits", [0, 1, 2, 5])
def test_a_task_unpacks_each_row_once(tmp_path, monkeypatch, bits):
    """A task that takes several ranges in turn reads each range's section, not all rows again for each range."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(200)], k=60)) for _ in range(60)]
    packed, read = [], []
    pack, unpack = ngram_lm.Grams.packed, ngram_lm.Grams.unpacked
    monkeypatch.setattr(ngram_lm.Grams, "packed", lambda g, *more: packed.append(len(g.codes[0])) or pack(g, *more))

    def counted(*of):
        g = unpack(*of)
        read.append(len(g.codes[0]))
        return g

    monkeypatch.setattr(ngram_lm.Grams, "unpacked", staticmethod(counted))
    model = local_model(str(tmp_path / "m"), texts, 3, bits, 0, 20)
    assert sum(read) == sum(packed) > 0 and (bits < 2 or len(model.ranges[3]) > 1)
    monkeypatch.undo()
    got = ngram_lm.Scorer(model)(pa.array(texts, pa.large_string()))
    assert got["score"].tolist() == pytest.approx([x[4] for x in plain_kneser_ney(texts, texts, 3)])


@pytest.mark.parametrize("whole", [False, True])
def test_keys_of_one_beginning_are_found_apart(whole):
    """Up to 200 keys share the 16 bits that a search compares first; others lie before, between and behind."""
    rng = random.Random(13)
    keys = sorted({(a << 48) | (b << 40) for a, n in ((0, 3), (5, 200), (6, 1), (0xFFFF, 40)) for b in rng.sample(range(256), n)})
    values = [rng.randrange(1, 600) for _ in keys]
    section = ngram_lm._section(np.array(keys, np.uint64), [np.array(values), np.arange(len(keys))], whole=whole)
    want = {k: [v, i] for i, (k, v) in enumerate(zip(keys, values, strict=True))}
    asked = [(a << 48) | (b << 40) for a in (0, 4, 5, 6, 7, 0xFFFF) for b in range(256)] * 7
    rng.shuffle(asked)
    assert len(asked) > ngram_lm.BLOCK
    assert ngram_lm._find(section, np.array(asked, np.uint64), 2).tolist() == [want.get(k, [0, 0]) for k in asked]


def test_blank_texts_alone_are_scored_by_many_ranges(tmp_path):
    texts = ["a b c", "a b d", "", "b c"]
    model = local_model(str(tmp_path / "m"), texts, 3, 3, 1)
    got = ngram_lm.Scorer(model)(pa.array(["", " \t"], pa.large_string()))
    for i, (n, known, _, base, score) in enumerate(plain_kneser_ney(texts, ["", " "], 3)):
        assert (got["n_tokens"][i], got["n_known"][i]) == (n, known) and got["base_score"][i] == pytest.approx(base) and got["score"][i] == pytest.approx(score)


def test_a_missing_range_is_an_error(tmp_path):
    model = local_model(str(tmp_path / "m"), ["a b c", "a b d"], 3, 2, 0)
    (tmp_path / "m" / f"3-{model.ranges[3][0]}").unlink()
    with pytest.raises(FileNotFoundError):
        ngram_lm.Scorer(model)(pa.array(["a b c", "a b d"], pa.large_string()))


def test_long_texts_cross_flushes_and_slices(tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_lm, "FLUSH", 1000)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=700_000)), *(" ".join(rng.choices("abcd", k=50)) for _ in range(200)), "a b", "a b"]
    model = local_model(str(tmp_path / "m"), texts, 3, 2, 1)
    got = ngram_lm.Scorer(model)(pa.array(texts[1:], pa.large_string()))
    for i, (n, known, total, base, score) in enumerate(plain_kneser_ney(texts, texts[1:], 3)):
        assert model.train_tokens == total and got["n_tokens"][i] == n and got["base_score"][i] == pytest.approx(base) and got["score"][i] == pytest.approx(score)


def test_language_model_of_nothing(spark, tables):
    sf = tables(documents=([], DOC))
    assert queries.op9_language_model(spark, sf).count() == 0
    model = ngram_lm.train(spark.createDataFrame([], "text string"))
    row = ngram_lm.score(spark.createDataFrame([("a b",)], "text string"), model).select("lm.*").first()
    assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["score"] <= 0
    ngram_lm.forget(spark, model)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=50))
def test_packed_rows_come_back(keys):
    k = np.array(sorted(keys), np.uint64)
    v = np.arange(len(k), dtype=np.uint16)
    a, b = ngram_lm._unpack(ngram_lm._pack(k, v))
    assert (a == k).all() and (b == v).all() and b.dtype == v.dtype


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 30)] * 3), unique=True, min_size=1, max_size=60), st.sets(st.integers(0, 40)), st.sampled_from([1, 1 << 50]))
def test_grams_come_back_whatever_words_have_numbers(rows, named, scale):
    words = (np.arange(31, dtype=np.uint64) + np.uint64(1)) * np.uint64(scale)
    g = ngram_lm.Grams(words, [np.array(c, np.uint32) for c in zip(*rows, strict=True)], [np.arange(1, len(rows) + 1)])
    names = ngram_lm.Names(np.array([(i + 1) * scale for i in named], np.uint64))
    back = ngram_lm.Grams.unpacked(g.packed(names), names)
    read = lambda x: sorted(zip(*(x.words[c].tolist() for c in x.codes), x.values[0].tolist(), strict=True))
    assert read(back) == read(g)
