"""Independent DuckDB SQL for each catalogue query (same column names/types).

DuckDB's RE2 has ASCII ``\\s``/``\\w``; the driver text only holds spaces and
newlines, so ``[^\\s]`` here and ``(?U)\\S`` in Spark agree on it; letters use
``\\p{L}`` / ``\\p{Lu}`` on both sides.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

PUNCT_SQL = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"

# helper SQL snippets -------------------------------------------------------
def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^\\s]+'))"


def clean_letters(x: str) -> str:
    y = f"lower({x})"
    y = f"regexp_replace({y}, 'http[^\\s]+|www.[^\\s]+', '', 'g')"
    y = f"regexp_replace({y}, '[^\\s]+@[^\\s]+', '', 'g')"
    y = f"regexp_replace({y}, '[^a-z\\s]', '', 'g')"
    return squeeze(y)


def remove_punct(x: str) -> str:
    y = f"regexp_replace({x}, '[‘’“”„–—]', ' ', 'g')"
    y = f"regexp_replace({y}, '&[\\p{{L}}\\p{{N}}_]+;', ' ', 'g')"
    y = f"translate({y}, '{PUNCT_SQL}', '')"
    return squeeze(y)


def normalize_quotes(x: str) -> str:
    y = f"translate({x}, '“”„‘’', '\"\"\"''''')"
    y = f"regexp_replace({y}, '\\s+', ' ', 'g')"
    y = f"regexp_replace({y}, '^\"+|\"+$', '', 'g')"
    y = f"regexp_replace({y}, '^''+|''+$', '', 'g')"
    return strip(y)


PSEUDO_SCORE = "(((doc_id * 37 + n_chars) % 201) - 100) / 100.0"
FIRST_LINE = "split_part(text, chr(10), 1)"

ORACLE["q01_text_lengths"] = f"""
WITH x AS (
  SELECT lang, length(text) AS review_length, {words('text')} AS review_word_count,
         length({FIRST_LINE}) AS title_length
  FROM documents)
SELECT lang, count(*)::BIGINT AS n_docs,
       round(avg(review_length), 4) AS mean_length,
       quantile_cont(review_length, 0.5)::DOUBLE AS median_length,
       min(review_length)::BIGINT AS min_length, max(review_length)::BIGINT AS max_length,
       round(avg(review_word_count), 4) AS mean_words,
       quantile_cont(review_word_count, 0.5)::DOUBLE AS median_words,
       min(review_word_count)::BIGINT AS min_words, max(review_word_count)::BIGINT AS max_words,
       round(avg(title_length), 4) AS mean_title_length
FROM x GROUP BY lang
"""

ORACLE["q02_normalize_text"] = f"""
WITH d AS (SELECT doc_id AS review_id, {strip(FIRST_LINE)} AS title, {strip('text')} AS reviews FROM documents),
n AS (SELECT review_id, {normalize_quotes('title')} AS title_clean, {normalize_quotes('reviews')} AS reviews_clean FROM d)
SELECT review_id, title_clean, reviews_clean, title_clean || '. ' || reviews_clean AS combined_text FROM n
"""

ORACLE["q03_clean_letters"] = f"""
WITH d AS (SELECT doc_id AS review_id, {clean_letters('text')} AS text_processed FROM documents)
SELECT review_id, text_processed, length(text_processed)::BIGINT AS char_count,
       {words('text_processed')}::BIGINT AS word_count FROM d
"""

ORACLE["q04_strip_punct"] = f"""
WITH d AS (SELECT doc_id AS review_id, text, {remove_punct('lower(text)')} AS no_punct FROM documents)
SELECT review_id, no_punct,
       round_even((length(text) - length(no_punct)) / greatest(length(text), 1), 4) AS removed_share
FROM d
"""

ORACLE["q05_numeric_features"] = f"""
WITH d AS (SELECT doc_id AS review_id, text, {clean_letters('text')} AS tp FROM documents),
f AS (SELECT review_id,
        length(tp)::BIGINT AS char_count, {words('tp')}::BIGINT AS word_count,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS exclamation_count,
        (length(text) - length(replace(text, '?', '')))::BIGINT AS question_count,
        round(len(regexp_extract_all(text, '\\p{{Lu}}')) / greatest(length(text), 1), 6) AS uppercase_ratio
      FROM d)
SELECT *, round(char_count / nullif(word_count, 0), 4) AS avg_word_length,
       exclamation_count::DOUBLE AS feat_exclamation, 0.0::DOUBLE AS feat_sentiment_score
FROM f
"""

_NP_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_NP_TYPES = {"doc_id": "bigint", "n_chars": "bigint", "quality": "int", "toxic": "int"}
ORACLE["q06_null_profile"] = """
WITH t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT count(*) AS total, """ + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS n_{c}" for c in _NP_COLS) + """ FROM t)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_NP_TYPES.get(c, 'string')}' AS data_type, n_{c}::BIGINT AS null_count, round(n_{c} * 100.0 / total, 2) AS null_pct, total::BIGINT AS total_rows FROM a"
    for c in _NP_COLS)

ORACLE["q07_label_rules"] = f"""
WITH d AS (
  SELECT d.doc_id AS review_id, l.quality, coalesce(d.text, '') AS text,
         {PSEUDO_SCORE.replace('doc_id', 'd.doc_id')} AS compound,
         CASE WHEN n_chars % 2 = 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS raw_label,
         (n_chars % 100) / 100.0 AS raw_confidence
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL),
e AS (
  SELECT *, (compound >= 0.05)::INTEGER AS satisfied_pred,
         CASE WHEN compound >= 0.05 THEN 'Positive' WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label3,
         CASE WHEN upper(raw_label) = 'NEGATIVE' THEN -raw_confidence ELSE raw_confidence END AS clf_score,
         CASE WHEN raw_confidence < 0.85 THEN 'Neutral' WHEN upper(raw_label) = 'POSITIVE' THEN 'Positive'
              WHEN upper(raw_label) = 'NEGATIVE' THEN 'Negative' ELSE 'Neutral' END AS clf_label
  FROM d),
g AS (
  SELECT *, CASE label3 WHEN 'Positive' THEN 1 WHEN 'Negative' THEN 0 ELSE -1 END AS label_bin,
         CASE label3 WHEN 'Positive' THEN 1 WHEN 'Negative' THEN 0 ELSE 0 END AS label_bin_cons,
         label3 = clf_label AS agree, label3 AS sentiment_label, compound AS sentiment_score,
         CASE WHEN quality = 1 THEN 'Satisfied' ELSE 'Not Satisfied' END AS satisfaction,
         substr(text, 1, 200) AS snippet
  FROM e)
SELECT review_id, quality, compound, satisfied_pred, label3, clf_score, clf_label, label_bin, label_bin_cons,
       agree, sentiment_label, sentiment_score, satisfaction, snippet,
       CASE WHEN label_bin <> -1 THEN label_bin = quality END AS correct
FROM g
"""

ORACLE["q08_select_existing"] = f"""
SELECT d.doc_id AS review_id, {words('d.text')}::BIGINT AS review_word_count,
       {PSEUDO_SCORE.replace('doc_id', 'd.doc_id')} AS compound, l.quality AS satisfied
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

ORACLE["q09_csv_round_trip"] = f"""
SELECT doc_id AS review_id, {FIRST_LINE} AS title, text AS reviews FROM documents
"""


# token helpers --------------------------------------------------------------
from .. import dims  # noqa: E402
from ..operators.tokens import LEMMA_DICTIONARY  # noqa: E402


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(ws) -> str:
    return "[" + ", ".join(sql_str(w) for w in ws) + "]"


def split_ws(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\s]+')"


def nlp_clean(x: str) -> str:
    y = f"lower({x})"
    y = f"regexp_replace({y}, 'https?://[^\\s]+', '', 'g')"
    y = f"regexp_replace({y}, 'www\\.[^\\s]+', '', 'g')"
    y = f"regexp_replace({y}, '[^\\s]+@[^\\s]+\\.[^\\s]+', '', 'g')"
    return remove_punct(strip(y))


def tokenize(x: str, min_len: int = 2) -> str:
    return f"[t for t in {split_ws(x)} if regexp_full_match(t, '\\p{{L}}+') and length(t) >= {min_len}]"


def serving_clean(x: str) -> str:
    y = f"lower({x})"
    y = f"regexp_replace({y}, 'https?://[^\\s]+|www\\.[^\\s]+|[^\\s]+@[^\\s]+', '', 'g')"
    y = f"translate({y}, '{PUNCT_SQL}', '')"
    return squeeze(y)


def lemma_case(w: str) -> str:
    parts = [f"CASE WHEN length({w}) <= 4 THEN {w}"]
    for suf, rep in dims.LEMMA_RULES:
        parts.append(f"WHEN suffix({w}, {sql_str(suf)}) AND length({w}) - {len(suf)} + {len(rep)} >= 3 "
                     f"THEN left({w}, length({w}) - {len(suf)}) || {sql_str(rep)}")
    parts.append(f"ELSE {w} END")
    return " ".join(parts)


def dict_lemma(w: str) -> str:
    whens = " ".join(f"WHEN {sql_str(a)} THEN {sql_str(b)}" for a, b in LEMMA_DICTIONARY)
    return f"CASE {w} {whens} ELSE ({lemma_case(w)}) END"


def bigrams(l: str) -> str:
    return f"[{l}[i] || ' ' || {l}[i + 1] for i in range(1, len({l}))]"


NLP_STOP = dims.stopwords("nlp")

ORACLE["q10_tokens"] = f"""
WITH d AS (SELECT doc_id AS review_id, {tokenize(nlp_clean('text'))} AS toks FROM documents)
SELECT review_id, array_to_string(toks, ' ') AS tokens, len(toks)::BIGINT AS n_tokens FROM d
"""

ORACLE["q11_stopword_filter"] = f"""
WITH d AS (SELECT doc_id AS review_id, {tokenize(nlp_clean('text'))} AS toks FROM documents),
e AS (SELECT review_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM d)
SELECT review_id, pos::BIGINT AS pos, token FROM e WHERE NOT list_contains({sql_list(NLP_STOP)}, token)
"""

ORACLE["q12_suffix_lemma"] = f"""
WITH d AS (SELECT {split_ws(serving_clean('text'))} AS ws FROM documents),
v AS (SELECT DISTINCT unnest([t for t in ws if regexp_full_match(t, '\\p{{L}}+')
        AND NOT list_contains({sql_list(dims.stopwords('frozen'))}, t) AND length(t) > 2]) AS token FROM d)
SELECT token, {lemma_case('token')} AS lemma FROM v
"""

ORACLE["q13_dict_lemma_pipeline"] = f"""
WITH d AS (SELECT doc_id AS review_id, {tokenize(nlp_clean('text'))} AS toks FROM documents),
s AS (SELECT review_id, [t for t in toks if NOT list_contains({sql_list(NLP_STOP)}, t)] AS toks FROM d),
l AS (SELECT review_id, [x for x in [{dict_lemma('t')} for t in toks]
                        if regexp_full_match(x, '\\p{{L}}+') AND length(x) > 1] AS lem FROM s),
o AS (SELECT review_id, array_to_string(lem, ' ') AS cleaned_review FROM l)
SELECT review_id, cleaned_review, {words('cleaned_review')}::BIGINT AS cleaned_word_count,
       length(cleaned_review)::BIGINT AS cleaned_char_count FROM o
"""

ORACLE["q14_top_bigrams_by_class"] = f"""
WITH d AS (SELECT l.quality AS satisfied, [t for t in {split_ws(clean_letters('d.text'))} if length(t) >= 2] AS toks
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT satisfied, unnest({bigrams('toks')}) AS term FROM d),
c AS (SELECT satisfied, term, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY satisfied ORDER BY n DESC, term ASC) AS rank FROM c)
SELECT satisfied, term AS bigram, n::BIGINT AS n, rank::BIGINT AS rank FROM r WHERE rank <= 15
"""

# The list of the word-frequency profile, written out on its own.
WORDFREQ_STOP = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
through during before after above below to from up down in out on off over under again further then once here there when
where why how all both each few more most other some such no nor not only own same so than too very s t can will just don
should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren
won wouldn flight ba british airways airline fly flew flying one would also us get got even much well told said really
could still back two make made time take took going went go come came like know think thing way say see give want tell
use find put try ask need let keep seem""".split()

ORACLE["q15_word_freq_by_class"] = f"""
WITH d AS (SELECT l.quality AS satisfied,
             [t for t in {split_ws(clean_letters('d.text'))} if NOT list_contains({sql_list(WORDFREQ_STOP)}, t)] AS toks
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT satisfied, unnest(list_concat(toks, {bigrams('toks')})) AS term FROM d),
c AS (SELECT satisfied, term, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY satisfied ORDER BY n DESC, term ASC) AS rank FROM c)
SELECT satisfied, term, n::BIGINT AS n, rank::BIGINT AS rank FROM r WHERE rank <= 150
"""

ORACLE["q16_vocabulary"] = f"""
WITH b AS (SELECT lang, count(DISTINCT w) AS vb FROM (SELECT lang, unnest({split_ws('lower(text)')}) AS w FROM documents) GROUP BY lang),
a AS (SELECT lang, count(DISTINCT w) AS va FROM (SELECT lang, unnest({tokenize(nlp_clean('text'))}) AS w FROM documents) GROUP BY lang)
SELECT b.lang, vb::BIGINT AS vocab_before, coalesce(va, 0)::BIGINT AS vocab_after,
       round((1 - coalesce(va, 0) / vb) * 100, 2) AS reduction_pct
FROM b LEFT JOIN a ON a.lang = b.lang
"""


# profiling -------------------------------------------------------------------
FEAT = f"""feat AS (
  SELECT doc_id, n_chars, length(tp)::BIGINT AS char_count, {words('tp')}::BIGINT AS word_count,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS exclamation_count,
         (length(text) - length(replace(text, '?', '')))::BIGINT AS question_count,
         len(regexp_extract_all(text, '\\p{{Lu}}')) / greatest(length(text), 1) AS uppercase_ratio,
         length(tp) / nullif({words('tp')}, 0) AS avg_word_length
  FROM (SELECT doc_id, n_chars, text, {clean_letters('text')} AS tp FROM documents))"""

_DESC = ["char_count", "word_count", "avg_word_length", "exclamation_count", "uppercase_ratio", "n_chars"]
ORACLE["q17_describe"] = f"WITH {FEAT}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c})::BIGINT AS count, round(avg({c}::DOUBLE), 3) AS mean,
       round(stddev_samp({c}::DOUBLE), 3) AS std, round(min({c})::DOUBLE, 3) AS min,
       round(quantile_cont({c}::DOUBLE, 0.25), 3) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 3) AS q50,
       round(quantile_cont({c}::DOUBLE, 0.75), 3) AS q75, round(max({c})::DOUBLE, 3) AS max FROM feat"""
    for c in _DESC)

ORACLE["q18_value_counts_filled"] = """
WITH cats AS (SELECT unnest([0, 1]) AS category),
cn AS (SELECT unnest(['quality', 'toxic']) AS column_name),
c AS (SELECT 'quality' AS column_name, quality AS category, count(*) AS n FROM labels GROUP BY ALL
      UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY ALL),
f AS (SELECT cn.column_name, cats.category, coalesce(c.n, 0) AS n FROM cn CROSS JOIN cats
      LEFT JOIN c ON c.column_name = cn.column_name AND c.category = cats.category)
SELECT column_name, category, n::BIGINT AS n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY column_name), 2) AS pct,
       round(min(n) OVER (PARTITION BY column_name) / max(n) OVER (PARTITION BY column_name), 2) AS balance
FROM f
"""

ORACLE["q19_group_stats"] = f"""
WITH t AS (SELECT l.quality AS satisfied, length(d.text)::DOUBLE AS review_length,
                  {words('d.text')}::DOUBLE AS review_word_count, length(split_part(d.text, chr(10), 1))::DOUBLE AS title_length
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT satisfied, count(*)::BIGINT AS n, """ + ", ".join(
    f"round(avg({c}), 1) AS {c}_mean, round(quantile_cont({c}, 0.5), 1) AS {c}_median, "
    f"round(stddev_samp({c}), 1) AS {c}_std, round(min({c}), 1) AS {c}_min, round(max({c}), 1) AS {c}_max"
    for c in ["review_length", "review_word_count", "title_length"]) + " FROM t GROUP BY satisfied"

ORACLE["q20_histogram"] = """
WITH b AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
x AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) END::INTEGER AS bin, lo, hi
      FROM documents, b)
SELECT bin, round(lo + bin * ((hi - lo) / 50), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 50), 6) AS bin_hi,
       count(*)::BIGINT AS n
FROM x GROUP BY bin, lo, hi
"""

ORACLE["q21_kde"] = """
WITH t AS (SELECT l.quality AS satisfied, d.n_chars::DOUBLE AS x FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT satisfied, count(x) AS n, stddev_samp(x) * pow(count(x), -0.2) AS h, min(x) AS lo, max(x) AS hi
      FROM t GROUP BY satisfied),
g AS (SELECT satisfied, n, h, i, lo - (hi - lo) / 2 + i * (2 * (hi - lo)) / 999 AS gx FROM s, range(0, 1000) r(i))
SELECT g.satisfied, g.i::BIGINT AS i, round(g.gx, 4) AS x,
       round(sum(exp(-pow((g.gx - t.x) / g.h, 2) / 2)) / (g.n * g.h * sqrt(2 * pi())) * 1e6, 4) AS density_e6
FROM g JOIN t ON g.satisfied = t.satisfied
GROUP BY g.satisfied, g.i, g.gx, g.n, g.h
"""

ORACLE["q22_box_stats"] = """
WITH t AS (SELECT l.quality AS satisfied, length(d.text)::DOUBLE AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
q AS (SELECT satisfied, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM t GROUP BY satisfied),
q2 AS (SELECT *, q3 - q1 AS iqr FROM q)
SELECT t.satisfied, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, round(iqr, 3) AS iqr,
       round(min(v) FILTER (WHERE v >= q1 - 1.5 * iqr), 3) AS whisker_lo,
       round(max(v) FILTER (WHERE v <= q3 + 1.5 * iqr), 3) AS whisker_hi,
       count(*) FILTER (WHERE v < q1 - 1.5 * iqr OR v > q3 + 1.5 * iqr)::BIGINT AS n_outliers
FROM t JOIN q2 ON t.satisfied = q2.satisfied GROUP BY t.satisfied, q1, median, q3, iqr
"""

FEAT_L = f"""{FEAT},
featl AS (SELECT f.*, l.quality AS satisfied, l.toxic FROM feat f JOIN labels l ON f.doc_id = l.doc_id)"""

_NLP_CTE = f"""d0 AS (SELECT doc_id AS review_id, text, {tokenize(nlp_clean('text'))} AS toks FROM documents),
s0 AS (SELECT review_id, [t for t in toks if NOT list_contains({sql_list(NLP_STOP)}, t)] AS toks FROM d0),
l0 AS (SELECT review_id, [x for x in [{dict_lemma('t')} for t in toks]
                        if regexp_full_match(x, '\\p{{L}}+') AND length(x) > 1] AS lem FROM s0),
clean AS (SELECT review_id, array_to_string(lem, ' ') AS cleaned_review FROM l0)"""

ORACLE["q25_text_comparison"] = f"""
WITH {_NLP_CTE},
st AS (
  SELECT 'original' AS stage, length(text) AS c, {words('text')} AS w FROM documents
  UNION ALL SELECT 'cleaned', length(cleaned_review), {words('cleaned_review')} FROM clean),
agg AS (SELECT stage, round(avg(c), 2) AS mean_chars, round(avg(w), 2) AS mean_words,
               round(avg(c / greatest(w, 1)), 3) AS mean_word_length, min(w)::BIGINT AS min_words,
               max(w)::BIGINT AS max_words, sum(w) AS total_words FROM st GROUP BY stage),
voc AS (
  SELECT 'original' AS stage, count(DISTINCT v) AS vocab FROM (SELECT unnest({split_ws('lower(text)')}) AS v FROM documents)
  UNION ALL SELECT 'cleaned', count(DISTINCT v) FROM (SELECT unnest({split_ws('cleaned_review')}) AS v FROM clean))
SELECT a.stage, mean_chars, mean_words, mean_word_length, min_words, max_words, vocab::BIGINT AS vocab,
       round(total_words * 100.0 / (SELECT total_words FROM agg WHERE stage = 'original'), 2) AS words_vs_original_pct
FROM agg a JOIN voc v ON a.stage = v.stage
"""

ORACLE["q26_word_reduction"] = f"""
WITH t AS (SELECT l.quality AS satisfied, {words('d.text')} AS before,
                  len([t for t in {split_ws(serving_clean('d.text'))} if regexp_full_match(t, '\\p{{L}}+')
                       AND NOT list_contains({sql_list(dims.stopwords('frozen'))}, t) AND length(t) > 2]) AS after
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT satisfied, (before - after) * 100.0 / nullif(before, 0) AS reduction_pct FROM t)
SELECT satisfied, count(*)::BIGINT AS n, round(avg(reduction_pct), 2) AS mean_reduction_pct,
       round(min(reduction_pct), 2) AS min_reduction_pct, round(max(reduction_pct), 2) AS max_reduction_pct
FROM r GROUP BY satisfied
"""

ORACLE["q27_seeded_sample"] = """
SELECT d.doc_id AS review_id, d.lang, md5(d.doc_id::VARCHAR || '|42') AS sample_key,
       (l.quality IS NULL)::INTEGER AS quality_is_null, (l.toxic IS NULL)::INTEGER AS toxic_is_null
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
ORDER BY sample_key LIMIT 200
"""


# sentiment -------------------------------------------------------------------
from .catalog import QUERY_BOOSTERS, QUERY_CONTRAST, QUERY_LEXICON, QUERY_NEGATIONS  # noqa: E402


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(sql_str(v) if isinstance(v, str) else repr(float(v)) for v in r) + ")" for r in rows)


STRIP_P = "regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"
UP = "(regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '\\p{{Ll}}'))"


def sentiment_sql(text_expr: str = "text", where: str = "TRUE", src_sql: str | None = None) -> str:
    """CTE chain ending in `scores(review_id, neg, neu, pos, compound)` over the documents."""
    steps = []
    for k, decay in zip((1, 2, 3), (1.0, 0.95, 0.9)):
        bs = f"(CASE WHEN v < 0 THEN -b{k} ELSE b{k} END)"
        s = (f"(CASE WHEN b{k} IS NULL THEN 0.0 ELSE (CASE WHEN up{k} AND cap_diff THEN "
             f"(CASE WHEN v > 0 THEN {bs} + 0.733 ELSE {bs} - 0.733 END) ELSE {bs} END) * {decay} END)")
        usable = f"(w{k} IS NOT NULL AND val{k} IS NULL)"
        steps.append(f"""v{k}a AS (SELECT * REPLACE (CASE WHEN {usable} THEN v + {s} ELSE v END AS v) FROM v{k - 1 if k > 1 else 0}),
v{k} AS (SELECT * REPLACE (CASE WHEN {usable} AND (list_contains({sql_list(QUERY_NEGATIONS)}, w{k}) OR contains(w{k}, 'n''t'))
                         THEN v * -0.74 ELSE v END AS v) FROM v{k}a)""")
    steps_sql = ",\n".join(steps)
    joins = "\n".join(f"LEFT JOIN wt t{k} ON t{k}.token = e.w{k}" for k in (1, 2, 3))
    return f"""lex(token, valence) AS (VALUES {_values(QUERY_LEXICON)}),
bst(token, delta) AS (VALUES {_values(QUERY_BOOSTERS)}),
wt AS (SELECT coalesce(l.token, b.token) AS token, l.valence, b.delta FROM lex l FULL OUTER JOIN bst b ON l.token = b.token),
sd AS ({src_sql or f"SELECT doc_id AS review_id, {text_expr} AS text FROM documents WHERE {where}"}),
sd1 AS (SELECT review_id, text, [CASE WHEN length({STRIP_P}) > 2 THEN {STRIP_P} ELSE t END
                                  for t in regexp_extract_all(text, '[^\\s]+')] AS ws,
               length(text) - length(replace(text, '?', '')) AS qn FROM sd),
dd AS (SELECT review_id, ws, len(ws) AS n_words,
              len([t for t in ws if {UP.format('t')}]) AS n_caps,
              coalesce(list_position([lower(t) for t in ws], {sql_str(QUERY_CONTRAST)}), 0) - 1 AS but_pos,
              least(length(text) - length(replace(text, '!', '')), 4) * 0.292
              + (CASE WHEN qn > 1 THEN (CASE WHEN qn <= 3 THEN qn * 0.18 ELSE 0.96 END) ELSE 0.0 END) AS amp
       FROM sd1),
ex AS (SELECT review_id, (n_caps > 0 AND n_caps < n_words) AS cap_diff, but_pos,
              generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS raw FROM dd),
e AS (SELECT *, lower(raw) AS w, {UP.format('raw')} AS up0,
             lower(lag(raw, 1) OVER win) AS w1, lower(lag(raw, 2) OVER win) AS w2, lower(lag(raw, 3) OVER win) AS w3,
             {UP.format('lag(raw, 1) OVER win')} AS up1, {UP.format('lag(raw, 2) OVER win')} AS up2,
             {UP.format('lag(raw, 3) OVER win')} AS up3
      FROM ex WINDOW win AS (PARTITION BY review_id ORDER BY pos)),
h AS (SELECT e.*, t0.valence AS val0, t1.valence AS val1, t1.delta AS b1, t2.valence AS val2, t2.delta AS b2,
             t3.valence AS val3, t3.delta AS b3
      FROM e JOIN wt t0 ON t0.token = e.w AND t0.valence IS NOT NULL AND t0.delta IS NULL
      {joins}),
v0 AS (SELECT *, CASE WHEN up0 AND cap_diff THEN (CASE WHEN val0 > 0 THEN val0 + 0.733 ELSE val0 - 0.733 END)
                 ELSE val0 END AS v FROM h),
{steps_sql},
sv AS (SELECT review_id, v * (CASE WHEN but_pos >= 0 AND pos < but_pos THEN 0.5
                                  WHEN but_pos >= 0 AND pos > but_pos THEN 1.5 ELSE 1.0 END) AS s FROM v3),
ag AS (SELECT review_id, sum(s) AS sum_s, coalesce(sum(CASE WHEN s > 0 THEN s + 1 END), 0.0) AS pos_sum,
              coalesce(sum(CASE WHEN s < 0 THEN s - 1 END), 0.0) AS neg_sum, count(*) FILTER (WHERE s <> 0) AS nz
       FROM sv GROUP BY review_id),
g AS (SELECT dd.review_id, dd.n_words, dd.amp, coalesce(ag.sum_s, 0.0) AS sum_s, coalesce(ag.pos_sum, 0.0) AS pos_sum,
             coalesce(ag.neg_sum, 0.0) AS neg_sum, coalesce(ag.nz, 0) AS nz
      FROM dd LEFT JOIN ag ON dd.review_id = ag.review_id),
g2 AS (SELECT review_id, n_words,
              CASE WHEN sum_s > 0 THEN sum_s + amp WHEN sum_s < 0 THEN sum_s - amp ELSE sum_s END AS x,
              CASE WHEN pos_sum > abs(neg_sum) THEN pos_sum + amp ELSE pos_sum END AS p,
              CASE WHEN pos_sum < abs(neg_sum) THEN neg_sum - amp ELSE neg_sum END AS q,
              (n_words - nz)::DOUBLE AS u FROM g),
scores AS (SELECT review_id,
       CASE WHEN n_words = 0 THEN 0.0 ELSE round_even(abs(q / (p + abs(q) + u)), 3) END AS neg,
       CASE WHEN n_words = 0 THEN 0.0 ELSE round_even(abs(u / (p + abs(q) + u)), 3) END AS neu,
       CASE WHEN n_words = 0 THEN 0.0 ELSE round_even(abs(p / (p + abs(q) + u)), 3) END AS pos,
       CASE WHEN n_words = 0 THEN 0.0 ELSE round_even(least(greatest(x / sqrt(x * x + 15), -1.0), 1.0), 4) END AS compound
       FROM g2)"""


ORACLE["q28_lexicon_sentiment"] = f"WITH {sentiment_sql()}\nSELECT * FROM scores"

_TWO = f"""WITH {sentiment_sql()},
{sentiment_sql("split_part(text, chr(10), 1) || '. ' || text").replace('scores AS', 'scores_b AS').replace('lex(token', 'lexb(token').replace('FROM lex ', 'FROM lexb ').replace('bst(token', 'bstb(token').replace('FULL OUTER JOIN bst ', 'FULL OUTER JOIN bstb ').replace('wt AS', 'wtb AS').replace('JOIN wt ', 'JOIN wtb ').replace('sd AS', 'sdb AS').replace('FROM sd)', 'FROM sdb)').replace('sd1 AS', 'sd1b AS').replace('FROM sd1)', 'FROM sd1b)').replace('dd AS', 'ddb AS').replace('FROM dd', 'FROM ddb').replace('dd.', 'ddb.').replace('ex AS', 'exb AS').replace('FROM ex ', 'FROM exb ').replace('e AS (', 'eb AS (').replace('FROM e JOIN', 'FROM eb e JOIN').replace('h AS', 'hb AS').replace('FROM h)', 'FROM hb)').replace('v0 AS', 'v0b AS').replace('FROM v0)', 'FROM v0b)').replace('v1a AS', 'v1ab AS').replace('FROM v1a)', 'FROM v1ab)').replace('v1 AS', 'v1b AS').replace('FROM v1)', 'FROM v1b)').replace('v2a AS', 'v2ab AS').replace('FROM v2a)', 'FROM v2ab)').replace('v2 AS', 'v2b AS').replace('FROM v2)', 'FROM v2b)').replace('v3a AS', 'v3ab AS').replace('FROM v3a)', 'FROM v3ab)').replace('v3 AS', 'v3b AS').replace('FROM v3)', 'FROM v3b)').replace('sv AS', 'svb AS').replace('FROM sv ', 'FROM svb ').replace('ag AS', 'agb AS').replace('JOIN ag ', 'JOIN agb ag ').replace('g AS (', 'gb AS (').replace('FROM g)', 'FROM gb)').replace('g2 AS', 'g2b AS').replace('FROM g2)', 'FROM g2b)')},
two AS (
  SELECT a.review_id,
         CASE WHEN a.compound >= 0.05 THEN 'Positive' WHEN a.compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS lexicon_label,
         a.compound AS lexicon_score,
         CASE WHEN b.compound >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS raw_label,
         abs(b.compound) AS confidence
  FROM scores a JOIN scores_b b ON a.review_id = b.review_id),
two2 AS (
  SELECT *, round(CASE WHEN raw_label = 'NEGATIVE' THEN -confidence ELSE confidence END, 4) AS model_score,
         CASE WHEN confidence < 0.85 THEN 'Neutral' WHEN raw_label = 'POSITIVE' THEN 'Positive'
              WHEN raw_label = 'NEGATIVE' THEN 'Negative' ELSE 'Neutral' END AS model_label
  FROM two)"""

ORACLE["q29_sentiment_labels"] = _TWO + """
SELECT *, lexicon_label AS sentiment_label, lexicon_score AS sentiment_score,
       round((lexicon_score + 1.0) / 2.0 * 100.0, 3) AS score_pct,
       CASE lexicon_label WHEN 'Positive' THEN 1 WHEN 'Negative' THEN 0 ELSE -1 END AS lexicon_bin,
       CASE model_label WHEN 'Positive' THEN 1 WHEN 'Negative' THEN 0 ELSE 0 END AS model_bin_cons,
       lexicon_label = model_label AS agree
FROM two2
"""

_GRID = "SELECT a.l AS lexicon_label, b.l AS model_label FROM (SELECT unnest(['Negative','Neutral','Positive']) AS l) a, (SELECT unnest(['Negative','Neutral','Positive']) AS l) b"
ORACLE["q30_model_agreement"] = _TWO + f""",
c AS (SELECT lexicon_label, model_label, count(*) AS n FROM two2 GROUP BY ALL),
f AS (SELECT g.lexicon_label, g.model_label, coalesce(c.n, 0) AS n FROM ({_GRID}) g
      LEFT JOIN c ON c.lexicon_label = g.lexicon_label AND c.model_label = g.model_label)
SELECT lexicon_label, model_label, n::BIGINT AS n,
       round(n * 100.0 / (SELECT count(*) FROM two2), 2) AS pct,
       round((SELECT avg((lexicon_label = model_label)::DOUBLE) FROM two2), 4) AS agreement_rate,
       (SELECT count(*) FILTER (WHERE lexicon_label <> model_label) FROM two2)::BIGINT AS disagreements
FROM f
"""

ORACLE["q31_disagreement_crosstab"] = _TWO + """
SELECT lexicon_label,
       count(*) FILTER (WHERE model_label = 'Negative')::BIGINT AS "Negative",
       count(*) FILTER (WHERE model_label = 'Neutral')::BIGINT AS "Neutral",
       count(*) FILTER (WHERE model_label = 'Positive')::BIGINT AS "Positive"
FROM two2 WHERE lexicon_label <> model_label GROUP BY lexicon_label
"""

ORACLE["q32_accuracy_coverage"] = _TWO + """,
j AS (SELECT t.*, l.quality FROM two2 t JOIN labels l ON l.doc_id = t.review_id),
lg AS (SELECT 'lexicon' AS scorer, lexicon_label AS label, quality FROM j UNION ALL SELECT 'model', model_label, quality FROM j),
b AS (SELECT scorer, quality, CASE label WHEN 'Positive' THEN 1 WHEN 'Negative' THEN 0 ELSE -1 END AS b FROM lg),
base AS (SELECT scorer, count(*)::BIGINT AS n, count(*) FILTER (WHERE b <> -1)::BIGINT AS covered,
                round(avg(CASE WHEN b <> -1 THEN (b = quality)::DOUBLE END), 4) AS accuracy,
                round(avg((b <> -1)::DOUBLE) * 100, 2) AS coverage_pct
         FROM b GROUP BY scorer),
cov AS (SELECT * FROM b WHERE b <> -1),
cls AS (SELECT scorer, quality AS c FROM cov UNION SELECT scorer, b FROM cov),
pc AS (SELECT cls.scorer, cls.c,
              count(*) FILTER (WHERE cov.quality = cls.c AND cov.b = cls.c) AS tp,
              count(*) FILTER (WHERE cov.quality = cls.c) AS support,
              count(*) FILTER (WHERE cov.b = cls.c) AS npred
       FROM cls JOIN cov ON cov.scorer = cls.scorer GROUP BY cls.scorer, cls.c),
pc2 AS (SELECT *, coalesce(tp / nullif(npred, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM pc),
wf AS (SELECT scorer, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0.0) * support) / nullif(sum(support), 0), 4) AS weighted_f1
       FROM pc2 GROUP BY scorer),
o AS (SELECT base.*, wf.weighted_f1 FROM base LEFT JOIN wf ON wf.scorer = base.scorer)
SELECT *, weighted_f1 = max(weighted_f1) OVER () AS is_winner FROM o
"""

ORACLE["q33_label_mix_by_class"] = _TWO + """,
j AS (SELECT t.*, l.quality FROM two2 t JOIN labels l ON l.doc_id = t.review_id),
lg AS (SELECT 'lexicon' AS scorer, quality AS actual, lexicon_label AS label FROM j
       UNION ALL SELECT 'model', quality, model_label FROM j),
c AS (SELECT scorer, actual, label, count(*) AS n FROM lg GROUP BY ALL),
grid AS (SELECT s.s AS scorer, a.a AS actual, l.l AS label FROM (SELECT unnest(['lexicon','model']) AS s) s,
         (SELECT unnest([0, 1]) AS a) a, (SELECT unnest(['Negative','Neutral','Positive']) AS l) l),
f AS (SELECT g.scorer, g.actual, g.label, coalesce(c.n, 0) AS n FROM grid g
      LEFT JOIN c ON c.scorer = g.scorer AND c.actual = g.actual AND c.label = g.label)
SELECT scorer, actual, label, n::BIGINT AS n,
       round(n * 100.0 / nullif(sum(n) OVER (PARTITION BY scorer, actual), 0), 2) AS pct_of_class
FROM f
"""


# topics / recommendations -------------------------------------------------------
from ..operators.recommend import PROMPT_TEMPLATE, SHORT_PROMPT_TEMPLATE  # noqa: E402


def topic_case(x: str, variant: str = "lambda") -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {sql_str(k)})" for k in kws) + f" THEN {sql_str(t)}"
        for t, kws in dims.TOPIC_KEYWORDS[variant])
    return f"CASE {whens} ELSE {sql_str(dims.DEFAULT_TOPIC)} END"


ORACLE["q34_detect_topic"] = f"""
SELECT 'doc' AS src, doc_id AS id, 0::BIGINT AS turn, {topic_case('text')} AS topic, {topic_case('text', 'app')} AS topic_app
FROM documents
UNION ALL
SELECT 'conv', conv_id, turn, {topic_case('text')}, {topic_case('text', 'app')} FROM conversations
"""

ORACLE["q35_topic_rollup"] = f"""
WITH c AS (SELECT {topic_case('text')} AS topic, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT topic, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, topic)::BIGINT AS rank FROM c)
SELECT * FROM r WHERE rank <= 10
"""

_prio = dict(dims.TOPIC_PRIORITY)
_REC_ROWS = [(t, a, _prio[t], k, o) for t, (a, o, k) in dims.RECOMMENDATION_TEXT.items()]
_DA, _DO, _DK = dims.DEFAULT_RECOMMENDATION_TEXT
REC_CTE = f"rec(topic, action, priority, kpi, owner) AS (VALUES {_values(_REC_ROWS)})"
REPLY_CTE = f"rep(topic, reply) AS (VALUES {_values(list(dims.REPLY_TEXT.items()))})"


def escalate_sql(p: str, s: str) -> str:
    p1 = f"(CASE WHEN {s} < -0.6 AND {p} = 'MEDIUM' THEN 'HIGH' ELSE {p} END)"
    return f"(CASE WHEN {s} < -0.8 AND {p1} = 'HIGH' THEN 'CRITICAL' ELSE {p1} END)"


_ALL = sentiment_sql(where="TRUE")
SCORED_TOPICS = f"""{_ALL},
st AS (SELECT d.doc_id AS review_id, d.text, {topic_case('d.text')} AS topic, s.compound AS sentiment_score
       FROM documents d JOIN scores s ON s.review_id = d.doc_id),
{REC_CTE},
recd AS (SELECT st.*, coalesce(rec.action, {sql_str(_DA)}) AS action, coalesce(rec.owner, {sql_str(_DO)}) AS owner,
                coalesce(rec.kpi, {sql_str(_DK)}) AS kpi,
                {escalate_sql("coalesce(rec.priority, 'MEDIUM')", 'st.sentiment_score')} AS priority,
                CASE WHEN st.sentiment_score >= 0.05 THEN 'Satisfied' ELSE 'Not Satisfied' END AS predicted_satisfaction
         FROM st LEFT JOIN rec ON rec.topic = st.topic)"""

ORACLE["q36_recommend"] = f"""WITH {SCORED_TOPICS}
SELECT review_id, topic, round_even(sentiment_score, 4) AS sentiment_score, predicted_satisfaction, action, priority, owner, kpi FROM recd
"""

_TOPIC_LIST = sql_list([t for t, _ in dims.TOPIC_PRIORITY])
ORACLE["q37_recommend_report"] = f"""WITH {_ALL},
{REC_CTE},
neg AS (SELECT review_id, compound AS sentiment_score, row_number() OVER (ORDER BY review_id) - 1 AS idx
        FROM scores WHERE compound <= -0.05),
rr AS (SELECT *, {_TOPIC_LIST}[(idx % 10) + 1] AS topic FROM neg),
r2 AS (SELECT rr.review_id, rr.topic, round_even(rr.sentiment_score, 4) AS sentiment_score, 'Not Satisfied' AS predicted_satisfaction,
              coalesce(rec.action, {sql_str(_DA)}) AS action, {escalate_sql("coalesce(rec.priority, 'MEDIUM')", 'rr.sentiment_score')} AS priority,
              coalesce(rec.owner, {sql_str(_DO)}) AS owner, coalesce(rec.kpi, {sql_str(_DK)}) AS kpi
       FROM rr LEFT JOIN rec ON rec.topic = rr.topic),
r3 AS (SELECT *, (CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END)::INTEGER AS prio_rank FROM r2)
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY prio_rank, review_id) = 1 AS is_topic_sample FROM r3
"""

_PT = PROMPT_TEMPLATE.replace("'", "''")
ORACLE["q38_prompt_table"] = f"""WITH {SCORED_TOPICS}
SELECT review_id, printf('{_PT}', substr(text, 1, 1000),
       CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative' ELSE 'Neutral' END,
       sentiment_score, predicted_satisfaction, topic, abs(sentiment_score) * 100) AS prompt,
       printf('{SHORT_PROMPT_TEMPLATE}', substr(text, 1, 800),
       CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative' ELSE 'Neutral' END,
       sentiment_score, predicted_satisfaction, topic, abs(sentiment_score) * 100) AS short_prompt
FROM recd
"""

ORACLE["q39_canned_reply"] = f"""WITH {SCORED_TOPICS},
{REPLY_CTE}
SELECT r.review_id, r.topic,
       coalesce(rep.reply, {sql_str(dims.DEFAULT_REPLY_TEXT)})
       || CASE WHEN r.sentiment_score < -0.7 AND r.predicted_satisfaction = 'Not Satisfied' THEN {sql_str(dims.URGENT_REPLY_SUFFIX)} ELSE '' END AS reply,
       {sql_str(dims.FALLBACK_PREFIX)} || r.action || {sql_str(dims.FALLBACK_SUFFIX)} AS fallback_text,
       'fallback' AS genai_source
FROM recd r LEFT JOIN rep ON rep.topic = r.topic
"""


# split / evaluation ---------------------------------------------------------------
ORACLE["q40_stratified_split"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, rn::BIGINT AS rn, CASE WHEN rn * 5 <= n * 4 THEN 'train' ELSE 'test' END AS split FROM r
"""

ORACLE["q41_folds"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
t AS (SELECT doc_id, quality FROM r WHERE rn * 5 <= n * 4),
f AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn FROM t)
SELECT doc_id, quality, ((rn - 1) % 5)::INTEGER AS fold FROM f
"""

RULE_PRED = f"""{_ALL},
rp AS (SELECT s.review_id, l.quality, s.compound, (s.compound >= 0.05)::INTEGER AS pred
       FROM scores s JOIN labels l ON l.doc_id = s.review_id)"""

ORACLE["q42_classification_report"] = f"""WITH {RULE_PRED},
cls AS (SELECT quality AS c FROM rp UNION SELECT pred FROM rp),
per AS (SELECT c::VARCHAR AS label,
               count(*) FILTER (WHERE quality = c AND pred = c) AS tp,
               count(*) FILTER (WHERE quality = c) AS support,
               count(*) FILTER (WHERE pred = c) AS n_pred
        FROM cls, rp GROUP BY c),
per2 AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM per),
per3 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f FROM per2),
tot AS (SELECT sum(support) AS total, sum(tp) AS tp, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
               sum(p * support) AS wp, sum(r * support) AS wr, sum(f * support) AS wf FROM per3)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support::BIGINT AS support FROM per3
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / total, 4), total::BIGINT FROM tot
UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), total::BIGINT FROM tot
UNION ALL SELECT 'weighted avg', round(wp / total, 4), round(wr / total, 4), round(wf / total, 4), total::BIGINT FROM tot
"""

ORACLE["q43_roc_auc"] = f"""WITH {RULE_PRED},
rg AS (SELECT compound AS threshold, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q
      FROM rp GROUP BY compound),
rc AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
                sum(q) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM rg),
t AS (SELECT sum(p) AS tot_p, sum(q) AS tot_n FROM rg),
c2 AS (SELECT c.*, tp / nullif(t.tot_p, 0) AS tpr, fp / nullif(t.tot_n, 0) AS fpr, t.tot_p, t.tot_n FROM rc c, t),
a AS (SELECT sum(p * ((tot_n - fp) + 0.5 * q)) / nullif(tot_p * tot_n, 0) AS auc FROM c2 GROUP BY tot_p, tot_n),
b AS (SELECT threshold FROM c2 ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)
SELECT threshold::DOUBLE AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(a.auc, 6) AS auc,
       threshold = (SELECT threshold FROM b) AS is_best
FROM c2, a
"""


# request edge / log / trend ------------------------------------------------------
from ..sources.requests import MISSING_REVIEW  # noqa: E402

REQ_SRC = ("SELECT conv_id * 1000 + turn AS review_id, " + strip("text") + " AS text FROM conversations "
           "WHERE (conv_id * 1000 + turn) % 12 < 8 AND length(" + strip("text") + ") > 0")


def scored_recs(src_sql: str) -> str:
    return f"""{sentiment_sql(src_sql=src_sql)},
st AS (SELECT s.review_id, sd.text, {topic_case('sd.text')} AS topic, s.compound AS sentiment_score,
              s.neg, s.neu, s.pos FROM scores s JOIN sd ON sd.review_id = s.review_id),
{REC_CTE},
recd AS (SELECT st.*, coalesce(rec.action, {sql_str(_DA)}) AS action, coalesce(rec.owner, {sql_str(_DO)}) AS owner,
                coalesce(rec.kpi, {sql_str(_DK)}) AS kpi,
                {escalate_sql("coalesce(rec.priority, 'MEDIUM')", 'st.sentiment_score')} AS priority,
                CASE WHEN st.sentiment_score >= 0.05 THEN 'Satisfied' ELSE 'Not Satisfied' END AS predicted_satisfaction,
                CASE WHEN st.sentiment_score >= 0.05 THEN 'Positive' WHEN st.sentiment_score <= -0.05 THEN 'Negative'
                     ELSE 'Neutral' END AS sentiment_label,
                round_even(abs(st.sentiment_score), 4) AS confidence
         FROM st LEFT JOIN rec ON rec.topic = st.topic)"""


def _j(k, v, num=False):
    return f"'\"{k}\":' || " + (f"printf('%.4f', {v} + 0.0)" if num else f"to_json({v})")


_core = " || ',' || ".join([_j("sentiment_label", "sentiment_label"), _j("sentiment_score", "sentiment_score", True),
                            _j("predicted_satisfaction", "predicted_satisfaction"), _j("confidence", "confidence", True),
                            _j("detected_topic", "topic")])
_rec = "'\"recommendation\":{' || " + " || ',' || ".join(_j(k, k) for k in ["action", "priority", "owner", "kpi"]) + " || '}'"
_ai = (f"',' || " + _j("ai_recommendation", f"{sql_str(dims.FALLBACK_PREFIX)} || action || {sql_str(dims.FALLBACK_SUFFIX)}")
       + " || ',\"genai_source\":\"fallback\"'")
ORACLE["q44_request_parse_respond"] = f"""WITH {scored_recs(REQ_SRC)},
req AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id * 1000 + turn) % 12 AS k, length(text) AS n FROM conversations)
SELECT r.request_id, 200 AS status_code,
       '{{' || {_core} || ',' || {_rec} || CASE WHEN r.k % 2 = 0 THEN {_ai} ELSE '' END || '}}' AS body
FROM req r JOIN recd ON recd.review_id = r.request_id WHERE r.k < 8
UNION ALL
SELECT r.request_id, 400, '{{"error":"{MISSING_REVIEW}"}}' FROM req r
WHERE r.k = 8 OR (r.k = 11 AND r.n = 0) OR (r.k < 8 AND r.request_id NOT IN (SELECT review_id FROM recd))
UNION ALL
SELECT r.request_id, 500, '{{"error":"Malformed request"}}' FROM req r
WHERE r.k IN (9, 10) OR (r.k = 11 AND r.n > 0)
"""

DOC_SRC = "SELECT doc_id AS review_id, text FROM documents"
ORACLE["q45_prediction_log"] = f"""WITH {scored_recs(DOC_SRC)}
SELECT md5(review_id::VARCHAR || '|' || text) AS prediction_id, substr(text, 1, 200) AS review_snippet,
       sentiment_label, round_even(sentiment_score, 4) AS sentiment_score, predicted_satisfaction, confidence,
       topic AS detected_topic, priority
FROM recd
"""

ORACLE["q46_topic_trend"] = f"""WITH {scored_recs(DOC_SRC)}
SELECT strftime(date_trunc('day', e.ts), '%Y-%m-%d') AS day, r.topic AS detected_topic, r.priority,
       count(*)::BIGINT AS n, sum(round_even(r.sentiment_score, 4)::DECIMAL(18,4))::DOUBLE / count(*) AS mean_score
FROM recd r JOIN events e ON e.event_id = r.review_id
GROUP BY ALL
"""


# features --------------------------------------------------------------------------
def vec_terms_cte(where: str = "TRUE", stop=None) -> str:
    toks = f"[t for t in {split_ws(clean_letters('text'))} if length(t) >= 2]"
    if stop:
        toks = f"[t for t in {toks} if NOT list_contains({sql_list(stop)}, t)]"
    return f"""vd AS (SELECT doc_id AS review_id, {toks} AS toks FROM documents WHERE {where}),
nd AS (SELECT count(*) AS n FROM vd),
tm AS (SELECT review_id, unnest(list_concat(toks, {bigrams('toks')})) AS term FROM vd),
tf AS (SELECT review_id, term, count(*) AS tf FROM tm GROUP BY ALL),
stt AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term)"""


ORACLE["q47_tfidf"] = f"""WITH {vec_terms_cte()},
v AS (SELECT term, df FROM stt, nd WHERE df >= 3 AND df <= floor(n * 0.95) ORDER BY total DESC, term ASC LIMIT 5000),
w AS (SELECT tf.review_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w
      FROM tf JOIN v ON v.term = tf.term, nd)
SELECT review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS tfidf FROM w
"""

ORACLE["q48_count_vectors"] = f"""WITH {vec_terms_cte(stop=dims.stopwords('general'))},
v AS (SELECT term FROM stt WHERE df >= 3 ORDER BY total DESC, term ASC LIMIT 3000)
SELECT tf.review_id, tf.term, tf.tf::BIGINT AS n FROM tf JOIN v ON v.term = tf.term
"""

_SC = ["char_count", "word_count", "avg_word_length", "exclamation_count", "uppercase_ratio"]
ORACLE["q49_scaled_features"] = f"""WITH {FEAT_L},
r AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM labels),
sp AS (SELECT doc_id, CASE WHEN rn * 5 <= n * 4 THEN 'train' ELSE 'test' END AS split FROM r),
j AS (SELECT f.doc_id, sp.split, char_count::DOUBLE AS char_count, word_count::DOUBLE AS word_count,
             coalesce(avg_word_length, 0.0) AS avg_word_length, exclamation_count::DOUBLE AS exclamation_count,
             uppercase_ratio FROM featl f JOIN sp ON sp.doc_id = f.doc_id),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _SC)} FROM j WHERE split = 'train')
SELECT doc_id AS review_id, split, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in _SC)} FROM j, st
"""


# batch plug-in scorer and stream ------------------------------------------------
ORACLE["q52_batch_model_score"] = """
WITH c AS (SELECT doc_id AS review_id, substr(coalesce(text, ''), 1, 1500) AS t FROM documents),
s AS (SELECT review_id, CASE WHEN length(t) % 2 = 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS raw_label,
             round((length(t) % 100) / 100.0, 4) AS confidence FROM c)
SELECT review_id, raw_label, confidence,
       round(CASE WHEN raw_label = 'NEGATIVE' THEN -confidence ELSE confidence END, 4) AS model_score,
       CASE WHEN confidence < 0.85 THEN 'Neutral' WHEN raw_label = 'POSITIVE' THEN 'Positive'
            WHEN raw_label = 'NEGATIVE' THEN 'Negative' ELSE 'Neutral' END AS model_label
FROM s
"""

ORACLE["q53_stream_score"] = ORACLE["q45_prediction_log"]


# serving and derived inputs ----------------------------------------------------------
_LOGIT = ("-0.2 + 1.5 * s.compound + 0.8 * s.pos - 1.1 * s.neg - 0.01 * f.exclamation_count + 0.5 * f.uppercase_ratio"
          " + 0.0001 * f.word_count")
ORACLE["q54_model_serving"] = f"""WITH {_ALL},
{FEAT},
{REC_CTE},
p AS (SELECT s.review_id, s.compound, 1 / (1 + exp(-({_LOGIT}))) AS p1, {topic_case('d.text')} AS topic
      FROM scores s JOIN feat f ON f.doc_id = s.review_id JOIN documents d ON d.doc_id = s.review_id)
SELECT p.review_id, CASE WHEN p1 >= 0.5 THEN 'Satisfied' ELSE 'Not Satisfied' END AS predicted_satisfaction,
       round_even(CASE WHEN p1 >= 0.5 THEN p1 ELSE 1 - p1 END, 4) AS confidence, p.topic,
       {escalate_sql("coalesce(rec.priority, 'MEDIUM')", 'p.compound')} AS priority
FROM p LEFT JOIN rec ON rec.topic = p.topic
"""

ORACLE["q55_confusion_row_pct"] = f"""WITH {RULE_PRED},
gq AS (SELECT a AS quality, b AS pred FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
nq AS (SELECT gq.quality, gq.pred, count(rp.review_id) AS n FROM gq LEFT JOIN rp ON rp.quality = gq.quality AND rp.pred = gq.pred GROUP BY ALL)
SELECT quality::INTEGER AS quality, pred::INTEGER AS pred, n::BIGINT AS n,
       round(n * 100.0 / nullif(sum(n) OVER (PARTITION BY quality), 0), 2) AS row_pct FROM nq
"""


def name_case(x: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({x}, {sql_str(k)})" for k in key.split()) + f" THEN {sql_str(name)}"
                     for key, name in dims.TOPIC_NAME_RULES)
    return f"CASE {whens} ELSE 'Unnamed' END"


ORACLE["q56_topic_names"] = f"""
WITH t AS (SELECT source, unnest([t for t in {split_ws(clean_letters('text'))} if length(t) >= 3]) AS term FROM documents
           WHERE source IS NOT NULL),
c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c),
w AS (SELECT source, string_agg(term, ' ' ORDER BY rank) AS top_words FROM r WHERE rank <= 40 GROUP BY source),
d AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT {name_case('w.top_words')} AS Business_Name, sum(d.n)::BIGINT AS total FROM w JOIN d ON d.source = w.source GROUP BY 1
"""

CLEANED = f"""cl AS (SELECT doc_id AS review_id, {tokenize(nlp_clean('text'))} AS toks FROM documents),
cs AS (SELECT review_id, [t for t in toks if NOT list_contains({sql_list(NLP_STOP)}, t)] AS toks FROM cl)"""
ORACLE["q57_top_cleaned_words"] = f"""WITH {CLEANED},
l AS (SELECT unnest([x for x in [{dict_lemma('t')} for t in toks] if regexp_full_match(x, '\\p{{L}}+') AND length(x) > 1]) AS word FROM cs)
SELECT word, count(*)::BIGINT AS n FROM l GROUP BY word ORDER BY n DESC, word LIMIT 20
"""

ORACLE["q58_head_and_rows"] = f"""
SELECT 'head' AS part, review_id, title FROM (SELECT doc_id AS review_id, {FIRST_LINE} AS title FROM documents ORDER BY doc_id LIMIT 5)
UNION ALL SELECT 'picked', doc_id, {FIRST_LINE} FROM documents WHERE doc_id IN (0, 42, 150)
"""

ORACLE["q59_tfidf_min2"] = f"""WITH {vec_terms_cte()},
v AS (SELECT term, df FROM stt, nd WHERE df >= 2 AND df <= n ORDER BY total DESC, term ASC LIMIT 5000),
w AS (SELECT tf.review_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w
      FROM tf JOIN v ON v.term = tf.term, nd)
SELECT review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS tfidf FROM w
"""

ORACLE["q60_top_features"] = f"""WITH {vec_terms_cte()}
SELECT tf.term AS feature, 'term' AS kind, abs(sum(CASE WHEN l.quality = 1 THEN 1 ELSE -1 END))::DOUBLE AS importance
FROM tf JOIN labels l ON l.doc_id = tf.review_id GROUP BY tf.term ORDER BY importance DESC, feature LIMIT 25
"""

ORACLE["q62_tfidf_vectors"] = ORACLE["q47_tfidf"]

ORACLE["q63_long_dictionary"] = f"""WITH {CLEANED},
d AS (SELECT token, substr(token, 1, 4) AS lemma FROM (SELECT unnest(toks) AS token FROM cl) WHERE length(token) > 4
      GROUP BY token HAVING count(*) >= 20),
e AS (SELECT review_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token FROM cs),
m AS (SELECT e.review_id, e.pos, coalesce(d.lemma, {lemma_case('e.token')}) AS lemma FROM e LEFT JOIN d ON d.token = e.token),
o AS (SELECT review_id, string_agg(lemma, ' ' ORDER BY pos) AS t FROM m
      WHERE regexp_full_match(lemma, '\\p{{L}}+') AND length(lemma) > 1 GROUP BY review_id)
SELECT cl.review_id, md5(coalesce(o.t, '')) AS cleaned_md5 FROM cl LEFT JOIN o ON o.review_id = cl.review_id
"""

ORACLE["q61_disagreement_sample"] = _TWO + """
SELECT review_id, lexicon_label, lexicon_score, model_label, model_score FROM two2
WHERE lexicon_label <> model_label ORDER BY md5(review_id::VARCHAR || '|42') LIMIT 8
"""

# correlations: length, lexicon and text features of the labelled reviews
_CORR = ["review_length", "review_word_count", "title_length", "neg", "neu", "pos", "compound", "satisfied",
         "char_count", "word_count", "avg_word_length", "exclamation_count", "question_count", "uppercase_ratio"]
def _corr_sql(a: str, b: str) -> str:
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"covar_pop({a}::DOUBLE, {b}::DOUBLE) / nullif(stddev_pop({a}::DOUBLE) {both} * stddev_pop({b}::DOUBLE) {both}, 0)")


FEAT_C = f"""{_ALL},
{FEAT},
featl AS (SELECT f.*, l.quality AS satisfied, length(d.text) AS review_length, {words('d.text')} AS review_word_count,
                 length(split_part(d.text, chr(10), 1)) AS title_length, s.neg, s.neu, s.pos, s.compound
          FROM feat f JOIN labels l ON f.doc_id = l.doc_id JOIN documents d ON d.doc_id = f.doc_id
          JOIN scores s ON s.review_id = f.doc_id)"""
ORACLE["q23_corr_matrix"] = f"WITH {FEAT_C}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr_sql(a, b)}, 6) AS corr FROM featl"
    for i, a in enumerate(_CORR) for b in _CORR[:i])

ORACLE["q24_target_corr"] = f"WITH {FEAT_C},\ncx AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature, round({_corr_sql(a, 'satisfied')}, 6) AS corr FROM featl"
    for a in _CORR if a != "satisfied") + """)
SELECT feature, corr, row_number() OVER (ORDER BY corr NULLS LAST, feature)::BIGINT AS rank FROM cx
"""


ORACLE["q65_keyword_automaton"] = """WITH k AS (
  SELECT keyword, ('0x' || substr(md5(keyword), 1, 8))::BIGINT AS ord, 'topic ' || substr(keyword, 1, 3) AS topic
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS keyword FROM documents)
  GROUP BY keyword HAVING count(*) >= 3)
SELECT c.conv_id * 1000 + c.turn AS request_id, coalesce(arg_min(k.topic, (k.ord, k.topic)), 'General Service Issue') AS topic
FROM conversations c LEFT JOIN k ON contains(lower(c.text), k.keyword)
GROUP BY c.conv_id, c.turn"""
