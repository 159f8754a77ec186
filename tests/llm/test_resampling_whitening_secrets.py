"""op11 to op13 against plain loops, round trips and planted cases."""

import base64
import gzip
import hashlib
import math
import os
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proseplane.llm import queries, resampling, secret_scan, whitening

SF = "/root/testdata/sf0.001"

# ---- resampling ---------------------------------------------------------------------------------------------


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_ranks(docs, target, longest, buckets, seed, least, share):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for text in docs:
        for f in runs(text[1], longest):
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, longest):
            t[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        fs = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * share[0] // share[1]]
    ranked = [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in out]
    for r in drawn:
        ranked.remove((*r, None))
    return sorted(ranked, key=repr)


TEXTS = ["Alpha beta gamma ALPHA", "beta, beta; 9 naïve Ünicode", None, "", "x " * 400, "a-b_c É é 中文", "!!! ???", "alpha beta " * 30]


@pytest.mark.parametrize("longest", [1, 3])
def test_ranks_equal_plain_loops(spark, longest):
    docs = [(k, f"{TEXTS[k % 8] or ''} w{k % 13} w{k % 7}" if k % 9 else TEXTS[k % 8]) for k in range(120)] + [(5, "same row alpha")] * 300 + [(None, "no id here"), (None, None), (-3, "alpha beta")]
    target = ["alpha beta gamma", "w3 w4 alpha", None]
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, score string")
    model = resampling.fit(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=97, seed=5)
    got = resampling.ranked(frame, model, least_words=2, share=(60, 100))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranks(docs, target, longest, 97, 5, 2, (60, 100))


def test_resample_keeps_whole_rows(spark):
    docs = [(k, f"alpha w{k % 11} " * (k % 5), k * 2, "x") for k in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _resampling long, weight string")
    target = spark.createDataFrame([("alpha w3",)], "text string")
    want = {r[0] for r in plain_ranks([d[:2] for d in docs], ["alpha w3"], 1, 10_000, 2024, 4, (25, 100)) if r[5]}
    got = resampling.resample(frame.withColumnRenamed("_resampling", "n"), target, least_words=4, share=(25, 100)).collect()
    assert {r["doc_id"] for r in got} == want and all(tuple(r) == docs[r["doc_id"]] for r in got)
    assert resampling.resample(frame.where("false"), target).count() == 0
    assert resampling.resample(frame, target.where("false"), least_words=10**6).count() == 0


def test_an_empty_table_and_a_full_dictionary(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.ranked(none, resampling.fit(none, none)).count() == 0
    monkeypatch.setattr(resampling, "KNOWN_WORDS", 2)
    import pyarrow as pa

    small, whole = resampling.Encoder(2, 50), resampling.Encoder(2, 50)
    monkeypatch.setattr(resampling, "KNOWN_WORDS", 10**6)
    for texts in (["a b c", "d"], ["e f a", None], ["b c d e"]):
        monkeypatch.setattr(resampling, "KNOWN_WORDS", 2)
        got = small(pa.array(texts))
        monkeypatch.setattr(resampling, "KNOWN_WORDS", 10**6)
        assert all(np.array_equal(x, y) for x, y in zip(got, whole(pa.array(texts)), strict=True))


# ---- whitening ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "deficient", "zero", "diagonal", "repeated"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr_equals_lapack(kind, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, max(1, n // 2) if kind == "deficient" else n))
    a = {"random": x @ x.T, "deficient": x @ x.T, "zero": np.zeros((n, n)), "diagonal": np.diag(rng.normal(size=n) ** 2), "repeated": np.eye(n) * 3}[kind]
    values, vectors = whitening.symmetric_qr(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, want, atol=1e-12 * max(1, abs(want).max()))
    assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-13)
    assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-12 * max(1, abs(want).max()))


def test_merged_parts_equal_the_whole():
    x = np.random.default_rng(3).integers(-500, 500, (301, 5)) + 1_000_000
    whole, parts = whitening.Welford(5), [whitening.Welford(5) for _ in range(4)]
    whole.update(x)
    for part, rows in zip(parts, (x[:0], x[:1], x[1:200], x[200:]), strict=True):
        part.update(rows)
    for part in parts[1:]:
        parts[0].merge(part)
    assert parts[0].n == whole.n and parts[0].sums == whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].m2, np.cov(x.T, bias=True) * 301, rtol=1e-12) and np.allclose(whole.m2, parts[0].m2, rtol=1e-12)


def plain_whitening(vectors, k=16):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(axis=0)
    c = f - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    own = (rng.normal(size=(500, 20)) @ rng.normal(size=(20, 20)) / 5).astype(np.float32)
    own[300:400] = own[7]  # a hot vector
    bad = [(900, None, 0), (901, [1.0] * 19 + [None], 0), (902, [1.0] * 19 + [float("nan")], 0), (903, [float("inf")] + [0.0] * 19, 0)]
    frame = spark.createDataFrame([(k, [float(c) for c in v], k) for k, v in enumerate(own)] + bad, "vec_id long, embedding array<float>, values long").repartition(7)
    model = whitening.fit(frame)
    got = sorted(whitening.whiten(frame, model).collect(), key=lambda r: r["vec_id"])
    n, deviations, whitened, explained = plain_whitening(own)
    assert [r["vec_id"] for r in got] == list(range(500)) == [r["values"] for r in got]
    w = np.array([r["whitening"]["values"] for r in got])
    assert {r["whitening"]["n"] for r in got} == {n} and [r["whitening"]["deviation"] for r in got] == deviations.tolist()
    assert np.allclose(np.abs(w), np.abs(whitened), atol=1e-9) and np.allclose(np.abs((w * whitened).mean(axis=0)), (whitened**2).mean(axis=0))
    assert np.allclose(got[0]["whitening"]["explained"], explained, rtol=1e-9) and model.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-0.5, 2.0]), (4, []), (5, [1.0, 2.0, 3.0]), (None, [0.5, 1.0]), (6, [1e300, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["whitening"] for r in whitening.whiten(frame, whitening.fit(frame)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and got[4]["values"] == [] and got[1] == got[2] == got[None]
    assert got[1]["n"] == 2 and np.isclose(abs(got[1]["values"][0]), 1) and got[1]["values"][1] == 0 and np.allclose(got[1]["explained"], [1, 0], atol=1e-14)
    assert got[1]["deviation"] == 64**2 * 2 and got[6]["deviation"] is None  # two ways of one length; beyond a long
    one = frame.where("vec_id = 1")
    assert [r["whitening"]["values"] for r in whitening.whiten(one, whitening.fit(one)).collect()] == [[0.0, 0.0]]
    none = frame.where("false")
    assert whitening.fit(none).by_length == {} and whitening.whiten(none, whitening.fit(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whitening_query(spark):
    got = queries.queries()["op12_whiten"](spark, SF).collect()
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(rows)
    n, deviations, whitened, explained = plain_whitening([rows[i] for i in ids])
    place = {i: k for k, i in enumerate(ids)}
    assert len(got) == 16 * len(ids) and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviations[k] and np.isclose(abs(r["whitened"]), abs(whitened[k, c]), atol=1e-8) and np.isclose(r["explained"], explained[c], rtol=1e-8)


# ---- secrets ------------------------------------------------------------------------------------------------


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda r: (r[1], secret_scan.KINDS.index(r[0])))


PIECES = ["password", "Token", "API_KEY", "secret=", '"', "'", " ", ":", "=", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "中", "ſecret=", "%41", "%3D", "\\u0041", "x^", "ab%2541", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_what_the_text_shows_is_the_base(text):
    found, complete = secret_scan.find_secrets(text)
    assert complete and [f[:3] for f in found if not f[3]] == plain_base(text)
    assert all(0 <= b < e <= len(text) for _, b, e, _ in found) and len({f[:3] for f in found}) == len(found)


SECRET = "password = hunter2hunter2"


def b64(x):
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


@pytest.mark.parametrize(
    "wrapped,via",
    [
        ("".join(f"%{b:02X}" for b in SECRET.encode()), "url"),
        (quote(quote(SECRET)), "url"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode"),
        (b64(SECRET), "base64"),
        ("é中" + b64(b64(SECRET)), "base64>base64"),
        (base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode().rstrip("="), "base64>gzip"),
        (quote(b64(zlib.compress(quote(SECRET * 3).encode()))), None),
        ("/path/" + b64(SECRET), "base64"),
        (b64("".join(f"\\x{ord(c):02x}" for c in SECRET)), "base64>unicode"),
        ("%1F%8B%08" + "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode())[3:]), "url>gzip"),
        (base64.encodebytes((SECRET + " plain words " * 20).encode()).decode(), "base64"),
    ],
)
def test_nested_layers_are_found_where_they_are(wrapped, via):
    text = f"before {wrapped} after"
    found, complete = secret_scan.find_secrets(text)
    hits = [f for f in found if f[0] == "assign"]
    assert complete and hits and (via is None or hits[0][3].startswith(via))
    assert all(7 <= b < e <= 7 + len(wrapped) for _, b, e, _ in hits)


def test_a_span_covers_the_characters_that_encode_the_secret():
    text = "see " + b64("some words first, then token: abcdefghij, and others")
    ((kind, begin, end, via),) = secret_scan.find_secrets(text)[0]
    inner = text[4 + (begin - 4) // 4 * 4 : end + (-(end - 4)) % 4]
    assert (kind, via) == ("assign", "base64") and b"token: abcdefghij" in base64.b64decode(inner) and len(inner) <= 28


def test_a_cycle_ends_and_a_bomb_is_told():

    layer = secret_scan.Layer("%25" * 50, None, None, ())
    assert secret_scan._replaced(layer, secret_scan._PERCENT, secret_scan._percent, "url").chars == "%" * 50
    assert secret_scan.find_secrets("%2525252541")[1]
    bomb = "token=abcdefgh " + b64(gzip.compress(b"0" * 10**7))
    found, complete = secret_scan.find_secrets(bomb, secret_scan.Config(times=2, besides=10**6))
    assert not complete and ("assign", 0, 14, "") in found
    assert secret_scan.find_secrets(bomb)[1]


def test_a_stream_that_unpacks_to_itself_ends(monkeypatch):
    monkeypatch.setattr(secret_scan, "_unpacked", lambda layer, most: iter([(secret_scan.Layer("\x1f\x8b\x08same", np.zeros(7, int), np.full(7, len("token=12345678")), (*layer.via, "gzip")), True)]))
    found, complete = secret_scan.find_secrets("token=12345678")
    assert complete and found == [("assign", 0, 14, "")]


def test_scan_keeps_rows_and_redacts(spark):
    rows = [(1, f"a {SECRET} z", "x"), (2, None, None), (3, "", "y"), (4, "aé中 " + b64(SECRET) + " end", "z"), (4, "plain " * 20_000 + "AKIA" + "B" * 12, "z"), (5, "plain", "z"), (5, "plain", "z"), (None, "f" * 32, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    found = secret_scan.scan(docs)
    assert found.columns == ["doc_id", "text", "secrets", "complete"] and found.count() == len(rows)
    clean = {(r["doc_id"], (r["text"] or "")[-30:]) for r in secret_scan.redacted(found).collect()}
    assert {(1, "a [secret] z"), (2, ""), (3, ""), (5, "plain"), (None, "[secret]")} <= clean and any(i == 4 and t == "aé中 [secret]== end" for i, t in clean)
    assert (4, "plain plain plain plain [secret]"[-30:]) in clean
    assert secret_scan.scan(docs.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_secret_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op13_secrets"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        base = plain_base(d["text"])
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[0] == k for b in base) for k in secret_scan.KINDS]
        joined = [f"{k}:{b}:{e}" for k, b, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r["spans"].split(",")) | {""}
