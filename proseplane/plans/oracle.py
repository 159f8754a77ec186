"""The prose engine's queries in DuckDB's SQL, whose regular expressions have no look-around.

A text is encoded for the rules: every character that is no letter, digit, _ or ' stands between the marks
\\x02 and \\x01, the text begins with \\x01 and ends with \\x02. So \\x01 before a letter says that no word
character comes before it, and \\x02 after one that none follows; patterns are rewritten the same way.
"""

from __future__ import annotations

import re

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.operators import cleanup
from proseplane.sources import probe


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _char(c: str, last: bool = False) -> str:
    if c.isalnum() or c in "_'":
        return c
    return r"\x02" + re.escape(c) + ("" if last else r"\x01")


def _encoded(words: str, blanks: bool) -> str:
    parts = words.split(" ") if blanks else [words]
    sep = r"(?:\x02\s\x01)+"
    return sep.join("".join(_char(c, i == len(parts) - 1 and k == len(p) - 1) for k, c in enumerate(p)) for i, p in enumerate(parts))


def _rule_pattern(rule: book.ListRule, phrases: bool) -> str:
    ordered = sorted(rule.patterns, key=len, reverse=True) if phrases else sorted(rule.patterns, key=lambda p: len(re.escape(p)), reverse=True)
    alternatives = [_encoded(p, phrases) for p in ordered]
    tail = r"\x01\x02" if not (ordered[-1][-1].isalnum() or ordered[-1][-1] in "_'") else r"\x02"
    return r"(?i)\x01" + "|".join(alternatives) + tail


def _plain(p: str) -> str:
    """A pattern of the rulebook without what RE2 lacks; for \\b, which knows ASCII only, other letters are read as _."""
    return p.replace(r"(?!.*\b(?:studies|research|reports|data)\b)", "")


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def scaled(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.4987) AS BIGINT)"


def _probe(name: str, phrases: list[str], which: str = "lang = 'en'") -> str:
    items = ", ".join(map(q, phrases))
    nl, n = "chr(10)", len(phrases)
    return f"""{name}_tells AS (SELECT [{items}] AS l),
{name} AS (
  SELECT doc_id, source, lang, m || CASE doc_id % 6 WHEN 1 THEN {q(probe.APPEND_1)} WHEN 2 THEN {q(probe.APPEND_2)} WHEN 4 THEN {q(probe.APPEND_4)} ELSE '' END AS text
  FROM (SELECT doc_id, source, lang,
      CASE WHEN doc_id % 5 = 0 THEN replace(t, {nl}, {nl} || '- ') WHEN doc_id % 7 = 0 THEN replace(t, {nl}, {nl} || '## ')
           WHEN doc_id % 12 = 3 THEN replace(t, {nl} || {nl}, {nl} || {nl} || 'First, ') ELSE t END AS m
    FROM (SELECT doc_id, source, lang,
        replace(replace(CASE WHEN doc_id % 3 = 0 THEN replace(text, {nl}, {nl} || {nl}) ELSE text END, ' the ', ' ' || l[doc_id % {n} + 1] || ' '), ' of ', ' ' || l[(doc_id * 7 + 3) % {n} + 1] || ' ') AS t
      FROM documents, {name}_tells WHERE {which})))"""


def _norm(x: str) -> str:
    return f"replace({x}, {q(chr(92) + 'n')}, chr(10))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _split(x: str, marked: str) -> str:
    return f"list_filter(list_transform(string_split({marked.format(x=x)}, chr(3)), lambda z: {_strip('z')}), lambda z: z <> '')"


def sentences(x: str) -> str:
    inner = r"""regexp_replace(regexp_replace({x}, '([.!?])\s+([A-Z"''(\[])', '\1' || chr(3) || '\2', 'g'), '\n+', chr(3), 'g')"""
    return _split(_norm(x), inner)


def paragraphs(x: str) -> str:
    return _split(_norm(x), r"regexp_replace({x}, '\n\s*\n+', chr(3), 'g')")


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({_norm(x)}, {q(T.TOKEN)}), lambda w: lower(w))"


def cv(x: str) -> str:
    return f"(CASE WHEN len({x}) < 2 OR list_aggregate({x}, 'avg') = 0 THEN 0.0 ELSE list_aggregate({x}, 'stddev_pop') / list_aggregate({x}, 'avg') END)"


def ladder(c: str, rule: book.ListRule) -> str:
    return f"(CASE WHEN {c} <= {rule.soft} AND {c} <= {rule.hard} THEN {c} * {rule.weight} * 0.5 ELSE {c} * {rule.weight} * 1.0 END)"


def _levels(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {q(key)}" for least, key, _ in book.BANDS[:-1]) + f" ELSE {q(book.BANDS[-1][1])} END"


def _violations(pre: str) -> str:
    """One SELECT for each rule: doc_id, category, rule, place, hits, score."""
    out, place = [], 0
    for category, rules, phrases in (("blacklist_words", book.WORDS, False), ("blacklist_phrases", book.PHRASES, True)):
        for r in rules:
            out.append(f"SELECT doc_id, {q(category)} AS category, {q(r.name)} AS rule, {place} AS place, c AS hits, {ladder('c', r)} AS score FROM (SELECT doc_id, {count('e', _rule_pattern(r, phrases))} AS c FROM {pre}enc) WHERE c > 0")
            place += 1

    def gate(category: str, rule: str, hits: str, score: str, where: str) -> None:
        nonlocal place
        out.append(f"SELECT doc_id, {q(category)}, {q(rule)}, {place}, {hits}, ({score}) * 1.0 FROM {pre}shape WHERE {where}")
        place += 1

    w, least, top = book.HEADING_DENSITY
    gate("structural_rules", "heading_density", "headings", str(w), f"n >= {least} AND headings * 1000.0 / n > {top}")
    w, least, top = book.LIST_DENSITY
    gate("structural_rules", "list_density", "items", str(w), f"n >= {least} AND n_lines > 0 AND items * 1.0 / n_lines > {top}")
    w, least, top = book.SENTENCE_LENGTH_CV
    gate("rhythm_rules", "sentence_length_cv", "1", str(w), f"len(words) >= {least} AND {cv('words')} < {top}")
    w, chars, least, top = book.SHORT_SENTENCE_RATIO
    gate("rhythm_rules", "short_sentence_ratio", "1", str(w), f"len(words) >= {least} AND n >= {chars} AND len(list_filter(words, lambda x: x < 6)) * 1.0 / len(words) < {top}")
    w, least, top = book.PARAGRAPH_UNIFORMITY
    gate("rhythm_rules", "paragraph_uniformity", "1", str(w), f"len(lens) >= {least} AND {cv('lens')} < {top}")
    w, free, _ = book.PARA_OPENING_ENUMERATION
    gate("rhythm_rules", "para_opening_enumeration", "openers", f"(openers - {free}) * {w}", f"openers > {free}")
    for r in book.PRETENCE:
        total = " + ".join(count("regexp_replace(body, '(?mi)^.*\\b(?:studies|research|reports|data)\\b', '', 'g')" if "(?!" in p else "body", "(?i)" + _plain(p)) for p in r.patterns)
        out.append(f"SELECT doc_id, 'fake_human', {q(r.name)}, {place}, c, {r.weight} * c * 1.0 FROM (SELECT doc_id, {total} AS c FROM {pre}abody) WHERE c > 0")
        place += 1
    for r in book.SIGNALS:
        out.append(f"SELECT doc_id, 'soul_signals', {q(r.name)}, {place}, c, ({r.least} - c) * {r.weight} * 1.0 FROM (SELECT doc_id, length(body) AS n, {count('body', ('(?i)' if r.ignore_case else '') + r.pattern)} AS c FROM {pre}abody) WHERE n >= {r.min_length} AND c < {r.least}")
        place += 1
    return "\n  UNION ALL ".join(out)


def _scoring(pre: str, table: str, column: str) -> str:
    """The rules over one column of a table, as common table expressions whose names begin with pre."""
    opener = "(?i)" + book.PARA_OPENING_ENUMERATION[2]
    return f"""{pre}body AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace({column}, '(?s)```.*?```', '', 'g'), '`[^`\\n]+`', '', 'g') AS body FROM {table}),
{pre}abody AS (SELECT doc_id, regexp_replace(body, '[ªµºÀ-ÖØ-öø-ʯ\u0370-\u1fff]', '_', 'g') AS body FROM {pre}body),
{pre}enc AS (SELECT doc_id, chr(1) || regexp_replace(body, '([^\\p{{L}}\\p{{N}}_''])', chr(2) || '\\1' || chr(1), 'g') || chr(2) AS e FROM {pre}body),
{pre}shape AS (
  SELECT doc_id, length(body) AS n, {count("body", r"(?m)(?:^|\n)#{1,6}\s+\S")} AS headings, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*(?:[-*•]\\s+|\\d+[.)]\\s+)'))) AS items,
    list_filter(list_transform(ss, lambda s: len(regexp_extract_all({_norm("s")}, {q(T.TOKEN)}))), lambda x: x > 0) AS words, list_transform(ps, lambda p: length(p)) AS lens, len(list_filter(ps, lambda p: regexp_matches(p, {q(opener)}))) AS openers
  FROM (SELECT doc_id, body, {sentences("body")} AS ss, {paragraphs("body")} AS ps, list_filter(string_split(body, chr(10)), lambda x: {_strip("x")} <> '') AS lines FROM {pre}body)),
{pre}violations AS ({_violations(pre)}),
{pre}scores AS (
  SELECT b.doc_id, b.source, b.lang, length(body) AS n, least(100.0, coalesce(v.s, 0) / greatest(1.0, length(body) / 3000.0)) AS total, coalesce(v.c, 0) AS c,
    least(100.0, coalesce(v.s_notes, 0) / greatest(1.0, length(body) / 3000.0)) AS notes_total, coalesce(v.c_notes, 0) AS c_notes
  FROM {pre}body b LEFT JOIN (SELECT doc_id, sum(score) AS s, count(*) AS c, sum(score) FILTER (category <> 'fake_human') AS s_notes, count(*) FILTER (category <> 'fake_human') AS c_notes FROM {pre}violations GROUP BY doc_id) v USING (doc_id)),
"""


def prefix(rows: str | None = None) -> str:
    """Tables that the queries share; rows: what stands for the probe corpus where features of other documents are asked for."""
    lp = "CASE WHEN coalesce(u1.cnt, 0) > 0 THEN ln((coalesce(b.cnt, 0) + 1.0) / (u1.cnt + m.v)) ELSE ln((coalesce(u2.cnt, 0) + 1.0) / (m.n + m.v)) END"
    joins = "LEFT JOIN bi b ON b.w1 = p.w1 AND b.w2 = p.w2 LEFT JOIN uni u1 ON u1.token = p.w1 LEFT JOIN uni u2 ON u2.token = p.w2, meta m"
    changed = "text"
    for _, a, b in cleanup.ordered_pairs():
        changed = f"replace({changed}, {q(a)}, {q(b)})"
    return f"""WITH {f"probe AS ({rows})" if rows else _probe("probe", probe.tells())},
{_probe("cprobe", probe.cleanup_tells())},
{_scoring("", "probe", "text")}corpus AS (SELECT {tokens("text")} AS t FROM documents WHERE lang = 'en'),
uni_all AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(t) AS token FROM corpus) GROUP BY token),
bi_all AS (SELECT w1, w2, count(*) AS cnt FROM (SELECT t[i] AS w1, t[i + 1] AS w2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM corpus)) GROUP BY w1, w2),
uni AS (SELECT * FROM uni_all ORDER BY cnt DESC, token LIMIT 100000),
bi AS (SELECT * FROM bi_all ORDER BY cnt DESC, w1, w2 LIMIT 500000),
meta AS (SELECT sum(cnt) AS n, count(*) AS v FROM uni),
toks AS (SELECT doc_id, text, {tokens("text")} AS t, {sentences("text")} AS ss, {paragraphs("text")} AS ps FROM probe),
lp AS (SELECT p.doc_id, {lp} AS lp FROM (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks)) p {joins}),
ppl AS (SELECT doc_id, CASE WHEN len(t) >= 5 THEN least(exp(-a), 1e6) ELSE 0 END AS perplexity, CASE WHEN len(t) >= 5 THEN a ELSE 0 END AS avg_log_prob FROM toks LEFT JOIN (SELECT doc_id, avg(lp) AS a FROM lp GROUP BY doc_id) USING (doc_id)),
st AS (SELECT doc_id, k, {tokens("ss[k]")} AS t FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS k FROM toks)),
slp AS (SELECT p.doc_id, p.k, avg({lp}) AS a FROM (SELECT doc_id, k, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT doc_id, k, t, unnest(range(1, len(t))) AS i FROM st WHERE len(t) >= 3)) p {joins} GROUP BY 1, 2),
burst AS (SELECT doc_id, CASE WHEN len(ss) >= 3 AND k >= 3 AND mu <> 0 THEN abs(sd / mu) ELSE 0 END AS burstiness FROM toks LEFT JOIN (SELECT doc_id, count(*) AS k, avg(a) AS mu, stddev_pop(a) AS sd FROM slp GROUP BY doc_id) USING (doc_id)),
pt AS (SELECT doc_id, k, {tokens("ps[k]")} AS t FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM toks)),
pe AS (SELECT doc_id, k, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, k, w, count(*) * 1.0 AS c, any_value(n) AS n FROM (SELECT doc_id, k, len(t) AS n, unnest(t) AS w FROM pt WHERE len(t) >= 8) GROUP BY 1, 2, 3) GROUP BY 1, 2),
ent AS (SELECT doc_id, CASE WHEN c >= 2 AND mu <> 0 THEN sd / mu ELSE 0 END AS entropy_cv, CASE WHEN c >= 2 THEN mu ELSE 0 END AS mean_entropy FROM toks LEFT JOIN (SELECT doc_id, count(*) AS c, avg(h) AS mu, stddev_pop(h) AS sd FROM pe GROUP BY doc_id) USING (doc_id)),
sl AS (SELECT doc_id, list_transform(ss, lambda s: len(regexp_extract_all(s, {q(T.TOKEN)}))) AS l FROM toks),
sf AS (SELECT doc_id, CASE WHEN ok THEN {cv("l")} ELSE 0 END AS sentence_cv, CASE WHEN ok THEN len(list_filter(l, lambda x: x < 6)) * 1.0 / len(l) ELSE 0 END AS short_frac,
  CASE WHEN ok THEN len(list_filter(l, lambda x: x BETWEEN 15 AND 25)) * 1.0 / len(l) ELSE 0 END AS equal_mid_frac FROM (SELECT *, len(l) >= 3 AND list_sum(l) > 0 AS ok FROM sl)),
mt AS (SELECT doc_id, CASE WHEN len(t) < 50 THEN 0 ELSE list_aggregate(list_transform(range(1, len(t) - 48), lambda i: len(list_distinct(t[i:i + 49])) / 50.0), 'avg') END AS word_mattr FROM toks),
other AS (SELECT doc_id, len(t) AS word_count, CASE WHEN len(t) > 0 THEN {count("text", "(?i)" + chr(92) + "b(?:" + "|".join(map(re.escape, book.TRANSITIONS)) + ")" + chr(92) + "b")} * 1000.0 / len(t) ELSE 0 END AS transition_density,
  CASE WHEN len(t) > 0 THEN {count("text", ",")} * 100.0 / len(t) ELSE 0 END AS comma_density, CASE WHEN len(t) > 0 THEN {count("text", "[,;:—–()]")} * 100.0 / len(t) ELSE 0 END AS punct_density FROM toks),
feats AS (SELECT * FROM other JOIN ppl USING (doc_id) JOIN burst USING (doc_id) JOIN ent USING (doc_id) JOIN sf USING (doc_id) JOIN mt USING (doc_id)),
lr AS (SELECT doc_id, word_count, CASE WHEN word_count < 30 THEN 0.0 ELSE round(100 / (1 + exp(-greatest(-10.0, least(10.0, {_logit()})))), 1) END AS p FROM feats),
cl AS (SELECT doc_id, source, lang, text, {changed} AS after FROM cprobe),
{_scoring("before_", "cl", "text")}{_scoring("after_", "cl", "after")}labelled AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id)),
ltoks AS (SELECT doc_id, quality, text, {tokens("text")} AS t, {sentences("text")} AS ss FROM labelled)
"""


def _logit() -> str:
    from proseplane.operators.features import DECIMALS

    return " + ".join([repr(book.INTERCEPT), *(f"({c!r}) * (round({n}, {DECIMALS[n]}) - ({m!r})) / {s!r}" for n, m, s, c in book.CALIBRATION)])


def _grade(x: str) -> str:
    words = f"regexp_extract_all({x}, {q(T.TOKEN)})"
    syl = f"list_sum(list_transform({words}, lambda w: greatest(1, len(regexp_extract_all(CASE WHEN length(w) > 2 AND lower(w) LIKE '%e' AND lower(w) NOT LIKE '%le' THEN w[1:length(w) - 1] ELSE w END, '(?i)[aeiouy]+')))))"
    return f"(CASE WHEN len({words}) = 0 THEN 0.0 ELSE 0.39 * (len({words}) * 1.0 / greatest(1, {count(x, r'[.!?]+(?:\s|$)')})) + 11.8 * ({syl} * 1.0 / len({words})) - 15.59 END)"


def _mined(n: int) -> str:
    grams = f"list_distinct(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' ')))"
    side = lambda k: f"(SELECT phrase, count(*) AS df FROM (SELECT unnest({grams}) AS phrase FROM ltoks WHERE quality = {k} AND len(t) >= {n}) GROUP BY 1)"
    size = lambda k: f"(SELECT count(*) FROM ltoks WHERE quality = {k} AND length(text) > 0)"
    return f"SELECT phrase, a.df AS target_df, coalesce(b.df, 0) AS other_df, {scaled(f'(a.df * 100.0 / {size(0)}) / greatest(coalesce(b.df, 0) * 100.0 / {size(1)}, 0.05)')} AS ratio FROM {side(0)} a LEFT JOIN {side(1)} b USING (phrase) WHERE a.df >= 3"


def oracle_sql() -> dict[str, str]:
    p = prefix()
    out = {
        "strip_code": "SELECT doc_id, length(body) AS n, md5(body) AS body_md5 FROM body",
        "normalize": f"SELECT doc_id, length(x) AS n, md5(x) AS text_md5 FROM (SELECT doc_id, {_norm('replace(text, chr(10), ' + q(chr(92) + 'n') + ')')} AS x FROM probe)",
        "tokenize_counts": "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks",
        "sentence_stats": f"SELECT doc_id, len(ss) AS n_sentences, {scaled(cv('l'))} AS cv, md5(array_to_string(ss, '|')) AS sentences_md5 FROM toks JOIN sl USING (doc_id)",
        "paragraph_stats": f"SELECT doc_id, len(ps) AS n_paragraphs, {scaled(cv('l'))} AS cv FROM (SELECT doc_id, ps, list_transform(ps, lambda x: length(x)) AS l FROM toks)",
        "rule_hits_long": f"SELECT doc_id, category, rule, hits, {scaled('score')} AS score FROM violations",
        "rule_score": f"SELECT doc_id, {scaled('total')} AS total, {_levels('total')} AS level, c AS n_violations, n AS text_length FROM scores",
        "rule_score_with_notes": f"SELECT doc_id, {scaled('notes_total')} AS total, {_levels('notes_total')} AS level, c_notes AS n_violations FROM scores",
        "level_histogram": f"SELECT {_levels('total')} AS level, count(*) AS n FROM scores GROUP BY 1",
        "violations_by_category": "SELECT category, count(*) AS n, count(DISTINCT doc_id) AS documents FROM violations GROUP BY 1",
        "top_violations": f"SELECT doc_id, r AS place, rule, {scaled('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM violations) WHERE r <= 5",
        "lm_unigrams_topk": "SELECT token, cnt FROM uni_all ORDER BY cnt DESC, token LIMIT 500",
        "lm_bigrams_topk": "SELECT w1, w2, cnt FROM bi_all ORDER BY cnt DESC, w1, w2 LIMIT 500",
        "lm_mass": f"SELECT CAST(k AS BIGINT) AS kept, CAST(n AS BIGINT) AS total, {scaled('k / n')} AS share FROM (SELECT (SELECT sum(cnt) FROM (SELECT cnt FROM bi_all ORDER BY cnt DESC, w1, w2 LIMIT 500)) AS k, (SELECT sum(cnt) FROM bi_all) AS n)",
        "perplexity": f"SELECT doc_id, {scaled('perplexity')} AS perplexity, {scaled('avg_log_prob')} AS avg_log_prob FROM ppl",
        "burstiness": f"SELECT doc_id, {scaled('burstiness')} AS burstiness FROM burst",
        "entropy_uniformity": f"SELECT doc_id, {scaled('entropy_cv')} AS entropy_cv, {scaled('mean_entropy')} AS mean_entropy FROM ent",
        "transition_density": f"SELECT doc_id, {scaled('transition_density')} AS transition_density FROM other",
        "sentence_features": f"SELECT doc_id, {', '.join(f'{scaled(c)} AS {c}' for c in ('sentence_cv', 'short_frac', 'equal_mid_frac'))} FROM sf",
        "mattr": f"SELECT doc_id, {scaled('word_mattr')} AS word_mattr FROM mt",
        "punctuation_density": f"SELECT doc_id, {scaled('comma_density')} AS comma_density, {scaled('punct_density')} AS punct_density FROM other",
        "ngram_features": f"SELECT doc_id, {', '.join(f'{scaled(c[0])} AS {c[0]}' for c in book.CALIBRATION)} FROM feats",
        "lr_probability": f"SELECT doc_id, {scaled('p')} AS p, CASE WHEN word_count < 30 THEN 'LOW (too short for ngram)' ELSE {_levels('p')} END AS ngram_level, word_count < 30 AS too_short FROM lr",
        "combined_score": f"SELECT doc_id, {scaled('c')} AS combined, {_levels('c')} AS level, c >= 50 AS block FROM (SELECT doc_id, greatest(total, p) AS c FROM scores JOIN lr USING (doc_id))",
        "mine_words": f"""SELECT token, a.c AS target_count, coalesce(b.c, 0) AS other_count, {scaled("(a.c * 1e6 / (SELECT sum(len(t)) FROM ltoks WHERE quality = 0)) / greatest(coalesce(b.c, 0) * 1e6 / (SELECT sum(len(t)) FROM ltoks WHERE quality = 1), 1.0)")} AS ratio
FROM (SELECT token, count(*) AS c FROM (SELECT unnest(t) AS token FROM ltoks WHERE quality = 0) GROUP BY 1) a LEFT JOIN (SELECT token, count(*) AS c FROM (SELECT unnest(t) AS token FROM ltoks WHERE quality = 1) GROUP BY 1) b USING (token) WHERE a.c >= 5""",
        "mine_bigrams": _mined(2),
        "mine_trigrams": _mined(3),
        "rhythm_percentiles": f"""SELECT metric, quality, len(v) AS n, {", ".join(f"v[CAST(least(len(v) - 1, floor({x} * len(v))) AS BIGINT) + 1] AS p{round(x * 100)}" for x in (0.1, 0.25, 0.5, 0.75, 0.9))}
FROM (SELECT metric, quality, list(v ORDER BY v) AS v FROM ({_rhythm()}) GROUP BY metric, quality)""",
        "lr_parts": f"SELECT train, quality, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM labelled JOIN (SELECT doc_id, {_train()} AS train FROM labels) USING (doc_id) GROUP BY 1, 2",
        "balanced_sample": "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r FROM labels) WHERE r <= least(40, (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality)))",
        "stratified_split": "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.8) AS train FROM labels",
        "standardize": f"SELECT doc_id, {scaled('(comma_density - avg(comma_density) OVER ()) / stddev_pop(comma_density) OVER ()')} AS comma_density, {scaled('(word_mattr - avg(word_mattr) OVER ()) / stddev_pop(word_mattr) OVER ()')} AS word_mattr FROM other JOIN mt USING (doc_id)",
        "rank_auc": f"SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, {scaled('(sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))')} AS auc FROM (SELECT quality AS y, avg(rn) OVER (PARTITION BY s) AS r FROM (SELECT quality, length(text) AS s, row_number() OVER (ORDER BY length(text)) AS rn FROM labelled))",
        "cleanup": "SELECT doc_id, length(after) AS n, md5(after) AS after_md5 FROM cl",
        "cleanup_score_delta": f"SELECT doc_id, {scaled('b.total')} - {scaled('a.total')} AS dropped FROM before_scores b JOIN after_scores a USING (doc_id)",
        "cleanup_delta": "SELECT CAST(sum(length(text) - length(after)) AS BIGINT) AS chars_removed, CAST(sum(CASE WHEN text <> after THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) AS documents FROM cl",
        "leftover_tells": f"SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN ['none'] ELSE l END) AS old FROM (SELECT doc_id, list_filter([{', '.join(q(a) for _, a, _ in cleanup.ordered_pairs())}], lambda x: contains(after, x)) AS l FROM cl)",
        "fkgl": f"SELECT doc_id, {scaled(_grade('text'))} AS grade FROM probe",
        "readability_gate": f"SELECT 'readability' AS name, {scaled('m')} AS metric, CASE WHEN m <= 2 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT avg(abs({_grade('after')} - {_grade('text')})) AS m FROM cl)",
        "gate_summary": f"""SELECT 'readability' AS name, {scaled('m')} AS metric, CASE WHEN m <= 2 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT avg(abs({_grade('after')} - {_grade('text')})) AS m FROM cl)
UNION ALL SELECT 'external_score', {scaled('m')}, CASE WHEN m >= 0.8 THEN 'pass' ELSE 'fail' END FROM (SELECT avg(CASE WHEN (1 - a.total / 100) - (1 - b.total / 100) >= 0.3 THEN 1.0 ELSE 0.0 END) AS m FROM before_scores b JOIN after_scores a USING (doc_id))
UNION ALL SELECT 'meaning', {scaled('m')}, CASE WHEN m >= 0.85 THEN 'pass' ELSE 'fail' END FROM (SELECT avg(len(list_intersect(x, y)) * 1.0 / greatest(len(list_distinct(list_concat(x, y))), 1)) AS m FROM (SELECT list_distinct({tokens('text')}) AS x, list_distinct({tokens('after')}) AS y FROM cl))
UNION ALL SELECT 'meaning_without_scores', NULL, 'skipped'""",
        "cleanup_protected": f"SELECT doc_id, length(t) AS n, md5(t) AS after_md5 FROM (SELECT doc_id, {_protected('text')} AS t FROM cprobe)",
        "detect_json": f"""SELECT s.doc_id, s.n AS chars, {scaled('round(s.total, 1)')} AS rule, s.c AS violations, {scaled('lr.p')} AS ngram, 'true' AS available, {scaled('round(greatest(s.total, lr.p), 1)')} AS combined,
  CASE WHEN greatest(s.total, lr.p) >= 50 THEN 'BLOCK' ELSE 'PASS' END AS decision FROM scores s JOIN lr USING (doc_id)""",
        "stream_scores": f"SELECT doc_id, {scaled('total')} AS total, {_levels('total')} AS level FROM scores",
    }
    for phrases, rules in ((False, book.WORDS), (True, book.PHRASES)):
        for r in rules:
            out[f"rule_{r.name}"] = f"SELECT doc_id, c AS hits, {scaled(ladder('c', r))} AS score FROM (SELECT doc_id, {count('e', _rule_pattern(r, phrases))} AS c FROM enc)"
    for name in ["heading_density", "list_density", "sentence_length_cv", "short_sentence_ratio", "paragraph_uniformity", "para_opening_enumeration", *(r.name for r in (*book.PRETENCE, *book.SIGNALS))]:
        out[name] = f"SELECT doc_id, hits, {scaled('score')} AS score FROM violations WHERE rule = {q(name)}"
    filler = next(r for r in book.WORDS if r.name == "corporate_filler")
    out["sample_first_match"] = f"SELECT doc_id, replace(replace(regexp_extract(e, {q(_rule_pattern(filler, False))}), chr(1), ''), chr(2), '') AS sample FROM enc"
    out = {k: p + v for k, v in out.items()}
    # of one pass: the clean-up and the answer of a provider that replaces one word, scored
    once = f"""SELECT s.doc_id, {scaled('s.total')} AS before_total, {scaled('CASE WHEN s.total < 25 THEN s.total ELSE least(c.total, a.total) END')} AS after_total,
  CASE WHEN s.total < 25 THEN 'publishable' WHEN a.total < c.total THEN 'rewritten' ELSE 'cleaned' END AS status FROM scores s JOIN clean_scores c USING (doc_id) JOIN short_scores a USING (doc_id)"""
    kept = f"pcl AS (SELECT doc_id, source, lang, t AS clean, replace(t, 'utilize', 'use') AS short FROM (SELECT doc_id, source, lang, {_protected('text')} AS t FROM probe)),\n"
    out["polish_once"] = p.rstrip() + ",\n" + kept + (_scoring("clean_", "pcl", "clean") + _scoring("short_", "pcl", "short")).rstrip().rstrip(",") + "\n" + once
    out["windowed_scores"] = p.rstrip().rstrip(",") + _windowed()
    out["cleanup_once"], out["lm_bigrams_merged"] = out["cleanup"], out["lm_bigrams_topk"]
    out |= _asked()
    out["iterative_polish"] = _iterated()
    out["rule_hits_by_table"] = out["rule_hits_long"]
    out["profile_scores"] = _by_profile()
    out["rollup_scores"] = f"""WITH {_probe("probe", probe.tells(), "true")},
{_scoring("", "probe", "text")}rolled AS (SELECT lang, source, count(*) AS n, CAST(sum({scaled("total")}) AS BIGINT) AS total FROM scores GROUP BY ROLLUP (lang, source))
SELECT * FROM rolled"""
    out |= _calibrated()
    out["judge_parse"], out["judge_report"] = _judged()
    out |= _shown()
    return out


_SPAN = r"(?s)```.*?```|`[^`\n]+`|https?://[^\s)]+"


def _protected(x: str) -> str:
    """The clean-up between code and web addresses."""
    changed = "z"
    for _, a, b in cleanup.ordered_pairs():
        changed = f"replace({changed}, {q(a)}, {q(b)})"
    parts = f"list_transform(regexp_split_to_array({x}, {q(_SPAN)}), lambda z: {changed})"
    return f"array_to_string(list_transform(list_zip({parts}, regexp_extract_all({x}, {q(_SPAN)})), lambda y: coalesce(y[1], '') || coalesce(y[2], '')), '')"


def _train() -> str:
    return "row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.8)"


def _rhythm() -> str:
    """(metric, quality, v) of the documents long enough for a metric."""
    words = f"list_filter(list_transform(ss, lambda s: len(regexp_extract_all(s, {q(T.TOKEN)}))), lambda x: x > 0)"
    return f"""SELECT 'sentence_cv' AS metric, quality, {scaled(cv("l"))} AS v FROM (SELECT quality, {words} AS l FROM ltoks) WHERE len(l) >= 3
UNION ALL SELECT 'short_ratio', quality, {scaled("len(list_filter(l, lambda x: x < 6)) * 1.0 / len(l)")} FROM (SELECT quality, {words} AS l FROM ltoks) WHERE len(l) >= 3
UNION ALL SELECT 'paragraph_cv', quality, {scaled(cv("l"))} FROM (SELECT quality, list_transform({paragraphs("text")}, lambda x: length(x)) AS l FROM ltoks) WHERE len(l) >= 3"""


def _asked() -> dict[str, str]:
    """What providers of the catalogue say, and how often they are asked."""
    from proseplane.plans.catalogue import CONTEXT, FRAIL

    return {
        "stored_answers": "SELECT doc_id, md5('Answer: ' || replace(t, ' the ', ' a ')) AS answer_md5, CASE WHEN bool_or(doc_id % 2 = 0) OVER (PARTITION BY t) THEN 1 ELSE 2 END AS run, 1 AS askings FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "dispatch_outcomes": f"""SELECT doc_id, CASE WHEN n < {FRAIL} AND n % 7 = 3 THEN NULL ELSE md5(t) END AS answer_md5, CASE WHEN n < {FRAIL} AND n % 7 = 3 THEN 'AuthError' END AS error,
  CASE WHEN n > {CONTEXT} THEN NULL WHEN n >= {FRAIL} OR n % 7 = 3 THEN 1 WHEN n % 5 = 1 AND n % 11 = 4 THEN 6 WHEN n % 5 = 1 THEN 3 WHEN n % 11 = 4 THEN 2 ELSE 1 END AS calls, n > {CONTEXT} AS split
FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)""",
        "scheduled_scores": f"SELECT doc_id, {scaled("(length(text) - length(replace(text, ' ', ''))) * 1.0 / greatest(length(text), 1)")} AS score FROM documents",
    }


def _windowed() -> str:
    """Late rows told by the latest time that arrived before them at their source and shard."""
    from proseplane.plans.catalogue import HELD_BY, HELD_UP
    from proseplane.streaming import monitor

    return f""",
came AS (
  SELECT doc_id, coalesce(source, '') AS source, doc_id % {monitor.SHARDS} AS shard, epoch_us(ts) AS moment, {scaled("total")} AS total, doc_id + CASE WHEN doc_id % {HELD_UP} = 0 THEN {HELD_BY} ELSE 0 END AS arrival
  FROM scores JOIN events ON doc_id % (SELECT count(*) FROM events) = event_id),
told AS (SELECT *, coalesce(moment < max(moment) OVER (PARTITION BY source, shard ORDER BY arrival, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {monitor.LATE}, false) AS late FROM came),
counted AS (SELECT source, moment // {monitor.WINDOW} AS w, count(*) FILTER (NOT late) AS n, CAST(coalesce(sum(total) FILTER (NOT late), 0) AS BIGINT) AS total, count(*) FILTER (late) AS late FROM told GROUP BY 1, 2)
SELECT source, w AS slot, n, total, late, CASE WHEN n > 0 THEN {_levels("total / (n * 1e6)")} END AS level FROM counted"""


def _calibrated() -> dict[str, str]:
    """The logistic fit by the same steps: sums of products, and the small system solved by elimination."""
    from proseplane.plans.catalogue import STEPS

    names = [c[0] for c in book.CALIBRATION]
    n = len(names) + 1
    ctes = [
        f"split AS (SELECT doc_id, quality, {_train()} AS train FROM labels)",
        f"fit AS MATERIALIZED (SELECT doc_id, quality AS y, train, [{', '.join(names)}] AS f FROM feats JOIN split USING (doc_id))",
        "figures AS MATERIALIZED (SELECT list(m ORDER BY j) AS m, list(CASE WHEN s = 0 THEN 1.0 ELSE s END ORDER BY j) AS s FROM (SELECT j, avg(f[j]) AS m, stddev_pop(f[j]) AS s FROM fit, range(1, %d) r(j) WHERE train GROUP BY j))" % n,
        "xs AS MATERIALIZED (SELECT doc_id, y, train, list_concat([1.0::DOUBLE], list_transform(f, lambda v, j: (v - m[j]) / s[j])) AS x FROM fit, figures)",
        f"b0 AS (SELECT [{', '.join(['0.0::DOUBLE'] * n)}] AS b)",
    ]

    def step(k: int) -> None:
        ctes.append(f"g{k} AS MATERIALIZED (SELECT x, y, b, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xs, b{k - 1} WHERE train)")
        ctes.append(
            f"e{k}_0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, CASE WHEN j <= {n} THEN sum(p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END "
            f"ELSE sum((y - p) * x[i]) - CASE WHEN i > 1 THEN any_value(b[i]) ELSE 0 END END AS v FROM g{k}, range(1, {n + 1}) r(i), range(1, {n + 2}) c(j) GROUP BY i, j) GROUP BY i))"
        )
        for c in range(1, n + 1):
            ctes.append(f"e{k}_{c} AS MATERIALIZED (SELECT list_transform(m, lambda row, i: CASE WHEN i = {c} THEN list_transform(row, lambda v: v / row[{c}]) ELSE list_transform(row, lambda v, j: v - row[{c}] * m[{c}][j] / m[{c}][{c}]) END) AS m FROM e{k}_{c - 1})")
        ctes.append(f"b{k} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v + m[i][{n + 1}]) AS b FROM b{k - 1}, e{k}_{n})")

    for k in range(1, 9):  # the fit has come to rest long before
        step(k)
    from_ = prefix("SELECT doc_id, source, lang, text FROM documents JOIN labels USING (doc_id)").rstrip() + ",\n"
    head = lambda k: from_ + ",\n".join(c for c in ctes if not re.match(r"[geb](\d)", c) or int(c[1]) <= k) + "\n"
    aucs = "SELECT part, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM (SELECT part, y, avg(rn) OVER (PARTITION BY part, s) AS r FROM (SELECT part, y, s, row_number() OVER (PARTITION BY part ORDER BY s) AS rn FROM (SELECT CASE WHEN train THEN 'train' ELSE 'held_out' END AS part, y, list_dot_product(x, b) AS s FROM xs, b8))) GROUP BY part"
    return {
        "lr_steps": head(STEPS) + f"SELECT ['intercept', {', '.join(map(q, names))}][i] AS name, {scaled('b[i]')} AS weight FROM b{STEPS}, range(1, {n + 1}) r(i)",
        "lr_train": head(8) + f"SELECT part, n_pos, n_neg, {scaled('auc')} AS auc FROM ({aucs})",
        "lr_gate": head(8) + f"SELECT 'calibration' AS name, {scaled('auc')} AS metric, CASE WHEN auc >= 0.75 THEN 'pass' ELSE 'fail' END AS status FROM ({aucs}) WHERE part = 'held_out'",
    }


def _by_profile() -> str:
    """All rules for English, those that no word list stands behind for the others."""
    kept = ", ".join(map(q, ("heading_density", "list_density", "sentence_length_cv", "short_sentence_ratio", "paragraph_uniformity")))
    total = "least(100.0, coalesce(s, 0) / greatest(1.0, length(body) / 3000.0))"
    return f"""WITH {_probe("aprobe", probe.tells(), "true")},
{_scoring("all_", "aprobe", "text").rstrip().rstrip(",")}
SELECT doc_id, lang, {scaled(total)} AS total, {_levels(total)} AS level, coalesce(c, 0) AS n_violations FROM all_body
LEFT JOIN (SELECT v.doc_id, sum(score) AS s, count(*) AS c FROM all_violations v JOIN all_body b USING (doc_id) WHERE b.lang = 'en' OR v.rule IN ({kept}) GROUP BY 1) USING (doc_id)"""


def _iterated() -> str:
    """Three rounds: the writer cuts 40 characters off the clean-up, the judge's score is its prompt's length modulo 80."""
    from proseplane.operators import prompts

    extra = prompts.LOOP_LENGTH
    wrote = "CASE WHEN length(c) <= 40 THEN '.' ELSE left(c, length(c) - 40) END"
    text, rounds, out = "SELECT doc_id, text AS t FROM probe", [], []
    for r in (1, 2, 3):
        rounds.append(f"r{r} AS (SELECT doc_id, t, ({extra} + length(t)) % 80 AS ai_score FROM (SELECT doc_id, {wrote} AS t FROM (SELECT doc_id, {_protected('t')} AS c FROM ({text}))))")
        out.append(f"SELECT doc_id, {r} AS round, ai_score, CASE WHEN ai_score <= 30 THEN 'target' {'ELSE ' + q('exhausted') if r == 3 else ''} END AS stopped FROM r{r}")
        text = f"SELECT doc_id, t FROM r{r} WHERE ai_score > 30"
    return f"WITH {_probe('probe', probe.tells())},\n" + ",\n".join(rounds) + "\n" + "\nUNION ALL ".join(out)


def _judged() -> tuple[str, str]:
    """What is read back from each document's answer, and its report, by the answer's number."""
    from proseplane.plans.catalogue import ANSWERS, REVIEWED

    n, r = len(ANSWERS) + len(REVIEWED), book.REPORT
    # publishable, error, length of raw text
    read = [(True, None, None), (False, None, None), (True, None, None), (None, r["no_json"], 24), (None, r["no_json"], 9), (None, r["no_json"], 20), (None, None, None), (None, r["no_json"], 500), (False, None, None), (True, None, None), (True, None, None)]
    value = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else str(x)
    pick = lambda i, kind: "CASE k " + " ".join(f"WHEN {k} THEN CAST({value(x[i])} AS {kind})" for k, x in enumerate(read)) + " END"
    verdict = lambda ok: r["verdict"] + r["publishable" if ok else "revise"] + "\n"
    section = lambda key, lines, warn="": f"### {r[key]} ({len(lines)}){warn}\n" + "\n".join(f"- {x}" for x in lines) + "\n"
    failed = lambda a: r["parse_error"] + r["no_json"] + "\n\nraw:\n" + a[:500]
    reports = [
        verdict(True), verdict(False) + "\n" + section("best_theses", ["x"]), verdict(True), failed(ANSWERS[3]), failed(ANSWERS[4]), failed(ANSWERS[5]), verdict(False), failed(ANSWERS[7]),
        "\n".join([verdict(False), section("best_theses", ["t\x01", "u\x01"]), section("worst_ai_sections", ["“p\x01…” — r\x01", "“?…” — only"]), r["rewrite_brief"] + "again \x01"]),
        "\n".join([verdict(True), section("unsupported_claims", ["“c\x01” missing: m\x01"]), section("fake_human_details", ["f\x01"], r["risk"])]), "\n".join([verdict(True), section("template_smell", ["s\x01", "s"])]),
    ]
    rows = f"(SELECT doc_id AS id, coalesce(doc_id % {n}, 0) AS k FROM documents)"
    texts = "CASE k " + " ".join(f"WHEN {k} THEN {q(x)}" for k, x in enumerate(reports)) + " END"
    return (
        f"SELECT id, {pick(0, 'BOOLEAN')} AS publishable, {pick(1, 'VARCHAR')} AS parse_error, {pick(2, 'BIGINT')} AS raw_length FROM {rows}",
        f"SELECT id, replace({texts}, chr(1), CAST(id AS VARCHAR)) AS report FROM {rows}",
    )


def _fixed(x: str, digits: int) -> str:
    """A number with so many digits, halves away from zero."""
    return f"printf('%.{digits}f', floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def _formatted(template: str, *values: str) -> str:
    """A template of the rulebook with an expression in place of each %d and %.nf."""
    parts, left = [], list(values)
    for piece in re.split(r"(%d|%\.\df|%%)", template):
        if piece == "%%":
            parts.append("'%'")
        elif piece == "%d":
            parts.append(f"CAST({left.pop(0)} AS VARCHAR)")
        elif piece.startswith("%."):
            parts.append(_fixed(left.pop(0), int(piece[2])))
        elif piece:
            parts.append(q(piece))
    return " || ".join(parts)


def _samples() -> str:
    """One SELECT for each rule: doc_id, rule, and the sample that its violation shows."""
    plain = "replace(replace(regexp_extract(e, {}), chr(1), ''), chr(2), '')"
    out = [f"SELECT doc_id, {q(r.name)} AS rule, {plain.format(q(_rule_pattern(r, phrases)))} AS sample FROM enc" for phrases, rules in ((False, book.WORDS), (True, book.PHRASES)) for r in rules]
    words = "len(list_filter(words, lambda x: x < 6)) * 100.0 / nullif(len(words), 0)"
    shaped = {
        "heading_density": (book.HEADING_DENSITY[2], "headings", "headings * 1000.0 / greatest(n, 1)"), "list_density": (book.LIST_DENSITY[2], "items", "n_lines", "items * 100.0 / nullif(n_lines, 0)"),
        "sentence_length_cv": (book.SENTENCE_LENGTH_CV[2], cv("words")), "short_sentence_ratio": (book.SHORT_SENTENCE_RATIO[3], words),
        "paragraph_uniformity": (book.PARAGRAPH_UNIFORMITY[2], cv("lens")), "para_opening_enumeration": (book.PARA_OPENING_ENUMERATION[1], "openers"),
    }
    out += [f"SELECT doc_id, {q(name)}, {_formatted(book.SAMPLES[name].format(top=top), *values)} FROM shape" for name, (top, *values) in shaped.items()]
    bare = "regexp_replace(body, '(?mi)^.*\\b(?:studies|research|reports|data)\\b', '', 'g')"
    for r in book.PRETENCE:
        tried = ", ".join(f"nullif(regexp_extract({bare if '(?!' in p else 'body'}, {q('(?i)' + _plain(p))}), '')" for p in r.patterns)
        out.append(f"SELECT doc_id, {q(r.name)}, coalesce({tried}) FROM abody")
    for r in book.SIGNALS:
        out.append(f"SELECT doc_id, {q(r.name)}, {_formatted(book.SAMPLES['signals'].format(least=r.least), count('body', ('(?i)' if r.ignore_case else '') + r.pattern))} FROM abody")
    return "\n  UNION ALL ".join(out)


def _shown() -> dict[str, str]:
    """Prompts and payloads, which show each violation with its sample."""
    from proseplane.operators import prompts

    line = f"""'- ' || category || '.' || rule || ': hit ' || hits || 'x | sample: "' || left(sample, {prompts.MOST_SAMPLE}) || '"'"""
    head = prefix().rstrip().rstrip(",") + f""",
samples AS ({_samples()}),
shown AS MATERIALIZED (
  SELECT doc_id, string_agg({line}, chr(10) ORDER BY place) FILTER (nth <= {prompts.MOST_VIOLATIONS}) AS findings, list({{'category': category, 'rule': rule, 'count': hits, 'sample': sample}} ORDER BY place) AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM violations JOIN samples USING (doc_id, rule)) GROUP BY doc_id)
"""
    prompt = "SELECT doc_id, {} || coalesce(findings, {}) || {} || text || {} AS prompt FROM probe LEFT JOIN shown USING (doc_id)"
    out = {f"prompt_{s.value}": head + prompt.format(*map(q, (prompts.rewrite_head(strength=s), prompts.NOTHING_FOUND, prompts.BEFORE_ARTICLE, prompts.AFTER_ARTICLE))) for s in prompts.Strength}
    rule = f"{{'probability': round(total, 1), 'level': {_levels('total')}, 'violations': coalesce(found, [])}}"
    both = f"{{'probability': round(total, 1), 'level': {_levels('total')}, 'decision': CASE WHEN total >= 50 THEN 'BLOCK' ELSE 'PASS' END}}"
    ngram = "{'probability': 0.0::DOUBLE, 'level': 'UNAVAILABLE', 'available': false}"
    out["detect_payload"] = head + f"SELECT doc_id, CAST(to_json({{'file': doc_id, 'chars': n, 'rule': {rule}, 'ngram': {ngram}, 'combined': {both}}}) AS VARCHAR) AS payload FROM scores LEFT JOIN shown USING (doc_id)"
    return out
