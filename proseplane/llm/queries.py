"""The queries op1 to op13 and the pipeline, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.llm import chat, decontaminate, language_id, licenses, media, mixing, ngram_lm, quality, resampling, secret_scan, simhash, toxicity, whitening
from proseplane.llm.common import cut, id_bucket, table, words_of
from proseplane.shipping import shipped
from proseplane.sources import tables


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.sql("select -7L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(probe)))
    windows = chat.format_windows(turns)
    # what the digests need of a conversation has to meet in one row: its windows as they are, read there
    parts = F.sort_array(F.collect_list(F.struct("start", "n_repeated", "formatted", "loss_spans")))
    whole = windows.groupBy("conv_id").agg(parts.alias("p"))
    own = lambda x: F.slice(chat.parsed(x["formatted"]), x["n_repeated"] + 1, F.greatest(F.size(chat.parsed(x["formatted"])) - x["n_repeated"], F.lit(0)))
    said = F.flatten(F.transform("p", own))
    loss = F.array_join(F.transform("p", lambda x: chat.under_loss(x["formatted"], x["loss_spans"])), "")
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x["formatted"]))
    read = whole.select("conv_id", said.alias("said"), loss.alias("loss"), chars.alias("formatted_chars"))
    lines = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _labels(spark: SparkSession, sf_dir: str, n: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(id_bucket("doc_id", n) != held)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_bucket("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held), _labels(spark, sf_dir, 4, 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_bucket("doc_id", 3) == 1
    model = quality.fit(docs.where(~held), _labels(spark, sf_dir, 3, 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))
    items = F.col("contamination.items")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("contamination.n_words"))).alias("contaminated"),
    )


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies_by_row(mixing.copies_of(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.media_features(media.store_text(docs))
    f = F.col("features")
    return found.select(
        "doc_id", "n_bytes", *[f[c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")],
        F.concat_ws(":", f["dhash"], F.sha2(f["tile"], 256)).alias("feature"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_bucket("doc_id", 3) == 1
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_bucket("doc_id", 5) == 1
    model = ngram_lm.train(docs.where(~held))
    lm = F.col("lm")
    scored = ngram_lm.score(docs, model).select(
        "doc_id", held.alias("held_out"), lm["n_tokens"].alias("n_tokens"), lm["n_known"].alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        lm["base_score"].alias("base_score"), lm["score"].alias("score"), ngram_lm.perplexity(lm).alias("perplexity"),
    )
    kept = cut(scored)  # numbers only, so that the model's files can go
    ngram_lm.forget(spark, model)
    return kept


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit_on(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_paragraphs"), F.array_join(families, ",").alias("families"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = resampling.fit(docs, table(spark, sf_dir, "benchmark"))
    return resampling.ranked(docs, model).select("doc_id", "n_features", "weight", "score", "rank")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = whitening.fit(vectors)
    w = F.col("whitening")
    each = whitening.whiten(vectors, model).select("vec_id", w["n"].alias("n"), w["deviation"].alias("deviation"), w["explained"].alias("e"), F.posexplode(w["values"]).alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("e", "k").alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["via"] == "")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"), "complete")


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12 that SQL can state: the number of distinct vectors and how far each row is from their mean."""
    vectors = tables.spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    w = F.col("whitening")
    return whitening.whiten(vectors, whitening.fit(vectors)).select("vec_id", w["n"].alias("n"), w["deviation"].alias("deviation"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op13 that SQL can state: how many secrets of each kind a text shows as it stands."""
    return op13_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can state: what each source has and is to give."""
    sizes = table(spark, sf_dir, "documents").select("source", words_of("text").alias("size"), F.lit(1).alias("m"))
    got = mixing.source_targets(sizes)
    return got.select("source", "source_size", F.round("target", 3).alias("target"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can state: the digests of what is read back."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_windows, op2_toxicity, op3_quality, op4_decontaminate, op5_mix, op6_simhash, op7_media, op8_language, op9_language_model, op10_licenses, op11_resample, op12_whiten, op13_secrets, mix_targets, media_payloads, vector_deviations, secret_counts)
    return {f.__name__: shipped(f) for f in own}


def _op1_sql() -> str:
    """op1 in DuckDB's SQL: the digests from the turns themselves, the windows by the same formulas."""
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\\\'), '#', '\\h'), '</', '<\\/')"
    width = f"length(replace({esc('role')}, ':', '\\c')) + length({esc('text')}) + {len(chat.OPEN) + len(chat.SEPARATOR) + len(chat.CLOSE)}"
    budget, history = chat.BUDGET, chat.HISTORY
    return rf"""WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
turns AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.OVERHEAD} AS t, {width} AS w FROM raw),
placed AS (
  SELECT *, row_number() OVER o = 1 AND role = 'system' AS is_lead, sum(t) OVER o AS upto, sum(t) OVER (PARTITION BY conv_id) AS total
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
sized AS (SELECT *, coalesce(sum(t) FILTER (is_lead) OVER (PARTITION BY conv_id), 0) AS lead, coalesce(sum(w) FILTER (is_lead) OVER (PARTITION BY conv_id), 0) AS lead_w FROM placed),
lined AS (SELECT *, upto - t - lead AS q, greatest({budget - history} - lead, {budget // 4}) AS stride FROM sized),
celled AS (SELECT *, CASE WHEN is_lead THEN -1 ELSE CAST(floor((q + t - 1) * 1.0 / stride) AS BIGINT) END AS cell FROM lined),
lone AS (SELECT *, NOT is_lead AND floor(q * 1.0 / stride) < cell AND sum(t) OVER (PARTITION BY conv_id, cell) > stride AS alone FROM celled),
ended AS (SELECT *, min(q) OVER v AS start, max(q + t) OVER v AS stop FROM lone WINDOW v AS (PARTITION BY conv_id, cell, alone)),
chars AS (
  SELECT conv_id, sum(c) AS formatted_chars FROM (
    SELECT conv_id, w AS c FROM ended
    UNION ALL SELECT conv_id, w FROM ended WHERE NOT is_lead AND stop - q <= {history} AND stop < total - lead
    UNION ALL SELECT conv_id, lead_w FROM (SELECT DISTINCT conv_id, start, lead_w FROM ended WHERE NOT is_lead AND start > 0)) GROUP BY conv_id)
SELECT raw.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(any_value(formatted_chars) AS BIGINT) AS formatted_chars
FROM raw JOIN chars ON raw.conv_id IS NOT DISTINCT FROM chars.conv_id GROUP BY raw.conv_id"""


def _op4_sql() -> str:
    """op4 by windows as lists of words, for tables that DuckDB can hold."""
    n = decontaminate.WINDOW
    words = lambda x: f"list_filter(string_split(regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return rf"""WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {n}) AS size, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes)),
hit AS (SELECT r, i, spot.size, item FROM spot JOIN win ON spot.size = win.size AND spot.g = win.g),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN spots USING (r) LEFT JOIN found USING (r)"""


def _mix_sql() -> str:
    """Sources with the least room for their weight stop first; the level of the others is what is left by weight."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
r AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w, {mixing.CAP} * source_size AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * {mixing.SHARE} - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
m AS (SELECT *, max(level) FILTER (level * w <= most) OVER () AS top FROM l)
SELECT source, source_size, round(least(most, coalesce(top * w, most)), 3) AS target FROM m"""


_MEDIA_SQL = """WITH p AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, greatest(1, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 576.0) AS BIGINT)) * 576 AS size, encode(coalesce(text, '')) AS raw FROM documents),
q AS (SELECT doc_id, n, size, raw || unhex(repeat('FF', CAST(size - n AS INTEGER))) AS payload FROM p),
f AS (SELECT *, encode('P5' || chr(10) || '24 ' || (size // 24) || chr(10) || '255' || chr(10)) || payload AS media FROM q)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(media) AS media_bytes, sha256(media) AS media_sha256 FROM f"""


def _op11_sql() -> str:
    """op11 with the CRC of each distinct word as a fold over its bytes by the usual table."""
    b = resampling.BUCKETS
    words = lambda x: f"list_filter(string_split(regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return rf"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
doc AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
each AS (SELECT r, unnest(w) AS w FROM doc),
target AS (SELECT unnest({words("text")}) AS w FROM benchmark),
word AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM each UNION SELECT w FROM target)),
hashed AS (SELECT w, xor(list_reduce(range(length(x) // 2), lambda c, k: xor(c >> 8, t[(xor(c, CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) % {b} AS bucket FROM word, crc),
s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + {b}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + {b})))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weight AS (SELECT r, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM each JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS rank, count(*) OVER () AS able FROM scored WHERE n >= {resampling.LEAST_WORDS})
SELECT doc_id, n AS n_features, weight, score, rank FROM scored LEFT JOIN (SELECT r, rank FROM placed WHERE rank <= {resampling.DRAWN[0]} * able // {resampling.DRAWN[1]}) USING (r)"""


_DEVIATIONS_SQL = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({whitening.SCALE} * CAST(c AS DOUBLE)) AS BIGINT) + {whitening.OFFSET}) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
f AS (SELECT DISTINCT x FROM v),
s AS (SELECT i, sum(x[i]) AS s FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM f) GROUP BY i),
m AS (SELECT list(s ORDER BY i) AS s, (SELECT count(*) FROM f) AS n FROM s)
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) ** 2)) AS BIGINT) AS deviation FROM v, m"""

_SECRETS_SQL = r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 32)) AS n_hex FROM documents""".replace("\\x20", "\x20")


def oracle_sql() -> dict[str, str]:
    """For what SQL can express; the fitted and the hash-drawn queries are held against brute force in tests."""
    return {"op1_chat_windows": _op1_sql(), "op4_decontaminate": _op4_sql(), "mix_targets": _mix_sql(), "media_payloads": _MEDIA_SQL, "op11_resample": _op11_sql(), "vector_deviations": _DEVIATIONS_SQL, "secret_counts": _SECRETS_SQL}
