"""Independent SQL (DuckDB dialect) for the oracle check of each query.

The Spark side is written with the DataFrame API; this side is plain SQL
over the same driver tables, so the two only agree when the semantics do.
Shared pieces are CTE strings; the regex strings come from the same
constants as the Spark functions (Java regex and RE2 both accept them).
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.lexicon import (CLASS_NAMES, DIGIT_CLASS, ENGLISH_STOPWORDS)
from ..operators.features import test_key_limit


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


MSG_CTES = """
msg_email AS (
  SELECT d.doc_id AS message_id,
         CASE l.quality WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' END AS label,
         d.text AS original_text, 'email' AS source, 0 AS source_rank
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
msg_sms AS (
  SELECT 4611686018427387904 + conv_id * 16777216 + turn AS message_id,
         CASE WHEN role = 'user' THEN 'spam' ELSE 'ham' END AS label,
         text AS original_text, 'sms' AS source, 1 AS source_rank
  FROM conversations),
msg AS (SELECT * FROM msg_email UNION ALL SELECT * FROM msg_sms)"""

DEDUP_CTE = """
dedup AS (
  SELECT message_id, label, original_text, source, source_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY original_text
                                 ORDER BY source_rank, message_id) AS rn_
    FROM msg) WHERE rn_ = 1)"""


def length_sql(x: str) -> str:
    return f"CAST(length({x}) AS INTEGER)"


def upper_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(T.UPPER_CLASS_SQL)})) AS INTEGER)"


def digits_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(DIGIT_CLASS)})) AS INTEGER)"


def count_sql(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS INTEGER)"


def strip_urls_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(T.URL)}, '', 'g')"


def letters_only_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z]', ' ', 'g')"


def split_tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {q('(' + T.NON_SPACE_CLASS + '+)')}, 1)"


def stopword_list_sql(words=ENGLISH_STOPWORDS) -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(words))) + "]"


def drop_stopwords_sql(arr: str, words=ENGLISH_STOPWORDS) -> str:
    return f"list_filter({arr}, lambda t_: NOT list_contains({stopword_list_sql(words)}, t_))"


def keep_alnum_sql(arr: str) -> str:
    return f"list_filter({arr}, lambda t_: regexp_matches(t_, {q(T.ALNUM_TOKEN)}))"


def join_tokens_sql(arr: str) -> str:
    return f"array_to_string({arr}, ' ')"


def clean_browser_sql(x: str) -> str:
    return f"regexp_replace({strip_urls_sql(f'lower({x})')}, {q(T.BROWSER_DROP)}, ' ', 'g')"


def clean_package_sql(x: str, lemma_cte: str | None = None) -> str:
    toks = split_tokens_sql(f"lower({letters_only_sql(strip_urls_sql(x))})")
    return join_tokens_sql(drop_stopwords_sql(toks))


def clean_notebook_nostem_sql(x: str) -> str:
    toks = T.tokenize_words_sql(f"lower({x})")
    return join_tokens_sql(drop_stopwords_sql(keep_alnum_sql(toks)))


def notebook_stem_ctes(source: str, name: str = "stemmed") -> str:
    """CTEs: ``name`` (message_id, clean_text) of the rows of ``source`` that have
    tokens: T16 with every token stemmed."""
    from ..functions.porter import stem_ctes
    toks = drop_stopwords_sql(keep_alnum_sql(T.tokenize_words_sql("lower(original_text)")))
    return f"""
{name}_toks AS MATERIALIZED (SELECT message_id, unnest(arr_) AS tok, generate_subscripts(arr_, 1) AS pos
  FROM (SELECT message_id, {toks} AS arr_ FROM {source} WHERE original_text IS NOT NULL)),
{name}_vocab AS (SELECT DISTINCT tok FROM {name}_toks),
{stem_ctes(f"{name}_vocab", f"{name}_w")},
{name} AS (SELECT message_id, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(stem, ' ' ORDER BY pos) AS clean_text
  FROM {name}_toks JOIN {name}_w USING (tok) GROUP BY message_id)"""


CLEANERS_SQL = {"browser": clean_browser_sql, "package": clean_package_sql,
                "notebook_nostem": clean_notebook_nostem_sql}


def split_key_sql(seed: int, id_col: str = "message_id") -> str:
    return (f"CAST(('0x' || substr(md5('{seed}:' || CAST({id_col} AS VARCHAR)), 1, 8)) "
            f"AS BIGINT)")


def labelled_ctes() -> str:
    """msg -> dedup -> labelled (with T19 counts)."""
    return MSG_CTES + "," + DEDUP_CTE + f""",
labelled AS (
  SELECT * FROM (
    SELECT message_id, label, original_text, source, source_rank,
           CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label_num,
           {length_sql('original_text')} AS message_length,
           {upper_sql('original_text')} AS num_uppercase,
           {digits_sql('original_text')} AS num_digits
    FROM dedup WHERE original_text IS NOT NULL)
  WHERE label_num IS NOT NULL)"""


def prepared_ctes(seed: int = 42, cleaner: str = "browser", split: str = "threshold",
                  test_size: float = 0.2) -> str:
    base = labelled_ctes()
    if cleaner == "notebook":
        base += "," + notebook_stem_ctes("labelled")
    clean = "coalesce(stemmed.clean_text, '')" if cleaner == "notebook" else CLEANERS_SQL[cleaner]("original_text")
    base += f""",
keyed AS (
  SELECT message_id, label_num, message_length, num_uppercase, num_digits,
         {clean} AS clean_text,
         {split_key_sql(seed)} AS key_
  FROM labelled{" LEFT JOIN stemmed USING (message_id)" if cleaner == "notebook" else ""})"""
    if split == "threshold":
        return base + f""",
prepared AS (SELECT * EXCLUDE (key_), key_ < {test_key_limit(test_size)} AS is_test FROM keyed)"""
    return base + "," + quota_ctes(test_size, "keyed") + """,
prepared AS (
  SELECT k.* EXCLUDE (key_, rk_), k.rk_ <= qt.test_q AS is_test
  FROM (SELECT *, row_number() OVER (PARTITION BY label_num ORDER BY key_, message_id) AS rk_
        FROM keyed) k JOIN quotas qt USING (label_num))"""


def quota_ctes(test_size: float, src: str) -> str:
    return f"""
cls AS (SELECT label_num, count(*) AS n_c FROM {src} GROUP BY label_num),
tot AS (SELECT sum(n_c) AS n, sum(n_c) - ceil({test_size} * sum(n_c)) AS n_train FROM cls),
cont AS (SELECT label_num, n_c, n_c * n_train / n AS c_, floor(n_c * n_train / n) AS f_
         FROM cls, tot),
need AS (SELECT (SELECT n_train FROM tot) - sum(f_) AS need_ FROM cont),
quotas AS (
  SELECT label_num, n_c,
         CAST(n_c - (f_ + CASE WHEN row_number() OVER (ORDER BY c_ - f_ DESC, label_num)
                                  <= (SELECT need_ FROM need) THEN 1 ELSE 0 END) AS BIGINT)
           AS test_q
  FROM cont)"""


def nb_ctes(max_features: int | None = 3000) -> str:
    limit = f"ORDER BY total DESC, term ASC LIMIT {max_features}" if max_features else ""
    return f""",
tf AS (
  SELECT message_id, term, count(*) AS tf FROM (
    SELECT message_id, unnest(regexp_extract_all(lower(clean_text), {q('(' + T.VECTORIZER_TOKEN + ')')}, 1)) AS term
    FROM prepared) GROUP BY message_id, term),
ntrain AS (SELECT count(*) AS n FROM prepared WHERE NOT is_test),
vocab0 AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df
  FROM tf JOIN prepared p USING (message_id) WHERE NOT p.is_test
  GROUP BY term {limit}),
vocab AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocab0, ntrain),
wt AS (SELECT message_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
tfidf AS (
  SELECT message_id, term AS feature,
         w / sqrt(sum(w * w) OVER (PARTITION BY message_id)) AS value FROM wt),
mm AS (
  SELECT min(message_length)::DOUBLE AS lo1, max(message_length)::DOUBLE AS hi1,
         min(num_uppercase)::DOUBLE AS lo2, max(num_uppercase)::DOUBLE AS hi2,
         min(num_digits)::DOUBLE AS lo3, max(num_digits)::DOUBLE AS hi3
  FROM prepared WHERE NOT is_test),
scaled AS (
  SELECT message_id,
    (message_length - lo1) / CASE WHEN hi1 - lo1 = 0 THEN 1.0 ELSE hi1 - lo1 END AS v1,
    (num_uppercase - lo2) / CASE WHEN hi2 - lo2 = 0 THEN 1.0 ELSE hi2 - lo2 END AS v2,
    (num_digits - lo3) / CASE WHEN hi3 - lo3 = 0 THEN 1.0 ELSE hi3 - lo3 END AS v3
  FROM prepared, mm),
feats AS (
  SELECT message_id, feature, value FROM tfidf
  UNION ALL SELECT message_id, '#message_length', v1 FROM scaled
  UNION ALL SELECT message_id, '#num_uppercase', v2 FROM scaled
  UNION ALL SELECT message_id, '#num_digits', v3 FROM scaled),
sums AS (
  SELECT feature,
         sum(CASE WHEN p.label_num = 0 THEN value ELSE 0.0 END) AS f0,
         sum(CASE WHEN p.label_num = 1 THEN value ELSE 0.0 END) AS f1
  FROM feats JOIN prepared p USING (message_id) WHERE NOT p.is_test GROUP BY feature),
totals AS (SELECT sum(f0) + count(*) AS t0, sum(f1) + count(*) AS t1 FROM sums),
theta AS (SELECT feature, ln(f0 + 1.0) - ln(t0) AS lt0, ln(f1 + 1.0) - ln(t1) AS lt1
          FROM sums, totals),
prior AS (
  SELECT ln(count(*) FILTER (WHERE label_num = 0)) - ln(count(*)) AS lp0,
         ln(count(*) FILTER (WHERE label_num = 1)) - ln(count(*)) AS lp1
  FROM prepared WHERE NOT is_test),
jll AS (
  SELECT message_id, sum(value * lt0) + max(lp0) AS jll0, sum(value * lt1) + max(lp1) AS jll1
  FROM feats JOIN theta USING (feature) CROSS JOIN prior
  GROUP BY message_id),
nb_pred AS (
  SELECT p.message_id, p.label_num AS actual,
         coalesce(CAST(j.jll1 > j.jll0 AS INTEGER), 0) AS predicted,
         1.0 / (1.0 + exp(j.jll0 - j.jll1)) AS score
  FROM prepared p LEFT JOIN jll j USING (message_id) WHERE p.is_test)"""


def confusion_long_sql(src: str, keys: str = "run_id, model_name") -> str:
    """E1 + E2 over a predictions relation with run_id, model_name, actual, predicted."""
    h, s = (q(c) for c in CLASS_NAMES)
    return f"""
cc AS (
  SELECT {keys},
    CAST(count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS BIGINT) AS tp
  FROM {src} GROUP BY {keys})
SELECT {keys}, {h} AS actual_class, {h} AS predicted_class, tn AS count FROM cc
UNION ALL SELECT {keys}, {h}, {s}, fp FROM cc
UNION ALL SELECT {keys}, {s}, {h}, fn FROM cc
UNION ALL SELECT {keys}, {s}, {s}, tp FROM cc"""


def package_tokens_sql(x: str) -> str:
    return drop_stopwords_sql(split_tokens_sql(f"lower({letters_only_sql(strip_urls_sql(x))})"))


def package_prepared_ctes(seed: int = 42, test_size: float = 0.2) -> str:
    """Package variant: distinct (label, text) rows, words replaced by the
    corpus's plural lemmas, threshold split."""
    return MSG_CTES + f""",
labelled AS (
  SELECT min(message_id) AS message_id, original_text,
         CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label_num
  FROM msg WHERE label IS NOT NULL AND original_text IS NOT NULL
  GROUP BY label, original_text),
ptoks AS (
  SELECT message_id, unnest(arr_) AS tok, generate_subscripts(arr_, 1) AS pos
  FROM (SELECT message_id, {package_tokens_sql('original_text')} AS arr_ FROM labelled)),
pvocab AS (SELECT DISTINCT tok FROM ptoks),
plemmas AS (
  SELECT v.tok AS form, s.tok AS lemma FROM pvocab v JOIN pvocab s
    ON length(v.tok) > 3 AND v.tok LIKE '%s' AND v.tok NOT LIKE '%ss'
   AND s.tok = substr(v.tok, 1, length(v.tok) - 1)),
pclean AS (
  SELECT message_id, string_agg(coalesce(l.lemma, t.tok), ' ' ORDER BY t.pos) AS clean_text
  FROM ptoks t LEFT JOIN plemmas l ON t.tok = l.form GROUP BY message_id),
prepared AS (
  SELECT m.message_id, m.label_num, {length_sql('original_text')} AS message_length,
         {upper_sql('original_text')} AS num_uppercase, {digits_sql('original_text')} AS num_digits,
         coalesce(c.clean_text, '') AS clean_text,
         {split_key_sql(seed, 'm.message_id')} < {test_key_limit(test_size)} AS is_test
  FROM labelled m LEFT JOIN pclean c USING (message_id))"""


def package_variant_sql(seed: int = 42) -> str:
    return ("WITH " + package_prepared_ctes(seed) + nb_ctes(3000) + f""",
pred AS (SELECT 'run_01_seed{seed}' AS run_id, 'Naive Bayes' AS model_name, actual, predicted
         FROM nb_pred),""" + confusion_long_sql("pred"))


def flagship_sql(seed: int = 42, max_features: int | None = 3000, cleaner: str = "browser",
                 split: str = "threshold", run: int = 1) -> str:
    return ("WITH " + prepared_ctes(seed, cleaner, split) + nb_ctes(max_features) + f""",
pred AS (SELECT 'run_{run:02d}_seed{seed}' AS run_id, 'Naive Bayes' AS model_name, actual, predicted
         FROM nb_pred),""" + confusion_long_sql("pred"))


def naive_bayes_grid_sql(seeds) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({flagship_sql(s, run=i + 1)})"
                              for i, s in enumerate(seeds))
