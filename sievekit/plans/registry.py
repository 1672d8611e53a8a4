"""Registry of queries (Spark, DataFrame API) and their oracle SQL (DuckDB).

One entry per inventory operator with an exact SQL form; names are the
(through the stand-in views) and runs over whole tables and whole texts.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import experiments as X
from ..operators import features as FE
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import scoring as SC
from ..operators.naive_bayes import fit_naive_bayes, load_scorer, save_scorer
from ..schemas import CORRECTIONS
from ..session import shared_path
from ..sources import files as FI
from ..sources import standins as ST
from ..sources import tables as S
from ..sources.stage import checkpoint_stage
from . import oracle as O
from . import messages as PL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def with_(ctes: str, select: str) -> str:
    return "WITH " + ctes + "\n" + select


q = O.q

# ---------------------------------------------------------------------------------------
# flagship

@register("flagship_nb_confusion", O.flagship_sql(42))
def flagship_nb_confusion(spark, sf_dir):
    return PL.flagship(spark, sf_dir, 42)


@register("nb_confusion_package", O.flagship_sql(42, cleaner="package"))
def nb_confusion_package(spark, sf_dir):
    """The flagship's rows with the package's cleaner (T17 without lemmas)."""
    return PL.flagship(spark, sf_dir, 42, cleaner="package")


@register("nb_confusion_package_variant", O.package_variant_sql(42))
def nb_confusion_package_variant(spark, sf_dir):
    """Package variant as a whole: P6 + P7, T17 with lemmas, 3,000 terms."""
    return PL.package_variant(spark, sf_dir, 42)


@register("nb_grid", O.naive_bayes_grid_sql(ST.RUN_SEEDS))
def nb_grid(spark, sf_dir):
    """E16 + E2: the five-seed grid of the relational Naive Bayes."""
    return PL.naive_bayes_grid(spark, sf_dir, ST.RUN_SEEDS)


@register("nb_confusion_notebook", O.flagship_sql(42, cleaner="notebook_nostem"))
def nb_confusion_notebook(spark, sf_dir):
    """Notebook variant, stemming off (T16 without T14)."""
    return PL.flagship(spark, sf_dir, 42, cleaner="notebook_nostem")


@register("nb_confusion_exact_split", O.flagship_sql(42, split="exact"))
def nb_confusion_exact_split(spark, sf_dir):
    """Exact stratified split (F8 exact mode) feeding the same model."""
    return PL.flagship(spark, sf_dir, 42, split="exact")


@register("nb_confusion_unbounded", O.flagship_sql(42, max_features=None))
def nb_confusion_unbounded(spark, sf_dir):
    """Unlimited vocabulary (notebook TfidfVectorizer()): salted joins on term."""
    return PL.flagship(spark, sf_dir, 42, max_features=None)


# ---------------------------------------------------------------------------------------
# S: sources

@register("load_raw_table", with_(O.MSG_CTES, """
SELECT CAST(row_number() OVER (ORDER BY source_rank, message_id) - 1 AS BIGINT) AS id,
       label AS v1, original_text AS v2 FROM msg"""))
def load_raw_table(spark, sf_dir):
    m = S.msg(spark, sf_dir)
    return (P.assign_row_ids(m, ["source_rank", "message_id"], "id")
            .select("id", F.col("label").alias("v1"), F.col("original_text").alias("v2")))


@register("extract_raw", with_(O.MSG_CTES, """
SELECT label, original_text AS texto_original FROM msg"""))
def extract_raw(spark, sf_dir):
    return S.extract_raw(S.raw_table(spark, sf_dir))


@register("read_first_n", with_(O.MSG_CTES, """
SELECT * FROM msg ORDER BY source_rank, message_id LIMIT 1000"""))
def read_first_n(spark, sf_dir):
    """The first 1000 messages in (source, id) order (the limit is the feature)."""
    return FI.read_first_n(S.msg(spark, sf_dir), 1000, ["source_rank", "message_id"])


_LINES_SQL = f"""
lines0 AS (
  SELECT conv_id, turn, unnest(arr_) AS raw, CAST(generate_subscripts(arr_, 1) - 1 AS INTEGER) AS line_no
  FROM (SELECT conv_id, turn, string_split_regex(text, '\\r?\\n') AS arr_ FROM conversations)),
lines1 AS (
  SELECT conv_id, turn, line_no,
         regexp_replace(raw, {q('^' + FI.TRIM_CLASS + '+|' + FI.TRIM_CLASS + '+$')}, '', 'g') AS t
  FROM lines0),
lines AS (
  SELECT conv_id, turn, line_no,
         CASE WHEN t = '' OR lower(t) IN ('texto', 'v2') THEN NULL
              ELSE regexp_replace(t, '^"|"$', '', 'g') END AS texto
  FROM lines1)"""


@register("read_message_lines", with_(_LINES_SQL, """
SELECT conv_id, turn, line_no, texto FROM lines WHERE texto IS NOT NULL"""))
def read_message_lines(spark, sf_dir):
    conv = S.table(spark, sf_dir, "conversations")
    return FI.message_lines(conv, "text", ["conv_id", "turn"]).withColumn(
        "line_no", F.col("line_no").cast("int"))


def _metrics_log_spark(pred):
    c = E.confusion_counts(pred).where(F.col("run_id") == "run_01_seed42")
    w = F.greatest(*[F.length(F.col(x).cast("string")) for x in ("tn", "fp", "fn", "tp")])

    def pad(x):
        return F.lpad(F.col(x).cast("string"), w, " ")
    entry = F.concat(F.lit("Model: "), F.col("model_name"), F.lit("\nPrecision: "),
                     F.format_number(E.precision(), 4), F.lit(" | Recall: "),
                     F.format_number(E.recall(), 4), F.lit("\nConfusion Matrix:\n[["),
                     pad("tn"), F.lit(" "), pad("fp"), F.lit("]\n ["), pad("fn"), F.lit(" "),
                     pad("tp"), F.lit("]]\n\n"))
    return c.select("run_id", "model_ord", "model_name", entry.alias("entry"))


# ---------------------------------------------------------------------------------------
# P: prep

@register("union_sources", with_(O.MSG_CTES, "SELECT * FROM msg"))
def union_sources(spark, sf_dir):
    return S.msg(spark, sf_dir)


@register("dedup_text_keep_first", with_(O.MSG_CTES + "," + O.DEDUP_CTE, "SELECT * FROM dedup"))
def dedup_text_keep_first(spark, sf_dir):
    return P.dedup_text_keep_first(S.msg(spark, sf_dir))


@register("dedup_full_row", with_(O.MSG_CTES, """
SELECT DISTINCT label, original_text AS texto_original FROM msg"""))
def dedup_full_row(spark, sf_dir):
    return P.dedup_full_row(S.extract_raw(S.raw_table(spark, sf_dir)))


@register("drop_null_rows", with_(O.MSG_CTES, """
SELECT DISTINCT label, original_text AS texto_original FROM msg
WHERE label IS NOT NULL AND original_text IS NOT NULL"""))
def drop_null_rows(spark, sf_dir):
    d = P.dedup_full_row(S.extract_raw(S.raw_table(spark, sf_dir)))
    return P.drop_null_rows(d, ["label", "texto_original"])


@register("map_label_fixed", with_(O.MSG_CTES, """
SELECT message_id, label, CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label_num
FROM msg"""))
def map_label_fixed(spark, sf_dir):
    m = S.msg(spark, sf_dir)
    return m.select("message_id", "label", P.map_label_fixed("label").alias("label_num"))


_LABELLED = O.labelled_ctes()


@register("encode_label_sorted", with_(_LABELLED, """
SELECT l.message_id, l.label, CAST(c.code AS INTEGER) AS target FROM labelled l
JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
      FROM (SELECT DISTINCT label FROM labelled)) c USING (label)"""))
def encode_label_sorted(spark, sf_dir):
    m = PL.labelled_messages(spark, sf_dir).select("message_id", "label")
    return P.encode_label_sorted(m, "label", "target")


@register("label_code_pairs", with_(_LABELLED, """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS target
FROM (SELECT DISTINCT label FROM labelled)"""))
def label_code_pairs(spark, sf_dir):
    m = PL.labelled_messages(spark, sf_dir).select("message_id", "label")
    return P.label_code_pairs(P.encode_label_sorted(m, "label", "target"))


@register("cleaning_audit", with_(O.MSG_CTES + "," + O.DEDUP_CTE, """
SELECT 'notebook' AS stage, (SELECT count(*) FROM msg) AS rows_before,
       (SELECT count(*) FROM dedup WHERE original_text IS NOT NULL) AS rows_after,
       (SELECT count(*) FROM msg) - (SELECT count(*) FROM dedup WHERE original_text IS NOT NULL)
         AS rows_removed"""))
def cleaning_audit(spark, sf_dir):
    return P.dedup_audit(S.msg_texts(spark, sf_dir), "original_text", "notebook")


_PREP42 = O.prepared_ctes(42)


@register("preview_rows", with_(_LABELLED, """
SELECT message_id, label, message_length, num_uppercase, num_digits FROM labelled
ORDER BY message_id LIMIT 5"""))
def preview_rows(spark, sf_dir):
    """First five rows of the feature table (the limit is the feature)."""
    m = PL.labelled_messages(spark, sf_dir).select(
        "message_id", "label", "message_length", "num_uppercase", "num_digits")
    return P.preview_rows(m, ["message_id"], 5)


@register("class_balance", with_(_PREP42, """
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, label_num, count(*) AS n
FROM prepared GROUP BY ALL"""))
def class_balance(spark, sf_dir):
    m = FE.split_threshold(PL.labelled_messages(spark, sf_dir), 42)
    m = m.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return P.class_balance(m, ["split", "label_num"])


# ---------------------------------------------------------------------------------------
# T: text functions

@register("extract_features", with_(O.MSG_CTES, f"""
SELECT message_id, {O.length_sql('original_text')} AS message_length,
       {O.upper_sql('original_text')} AS num_uppercase,
       {O.digits_sql('original_text')} AS num_digits FROM msg"""))
def extract_features(spark, sf_dir):
    return T.extract_features(S.msg(spark, sf_dir)).select(
        "message_id", "message_length", "num_uppercase", "num_digits")


@register("message_length", with_(O.MSG_CTES, f"""
SELECT message_id, {O.length_sql('original_text')} AS message_length FROM msg"""))
def message_length(spark, sf_dir):
    return S.msg_texts(spark, sf_dir).select(
        "message_id", T.message_length("original_text").alias("message_length"))


@register("num_uppercase", with_(O.MSG_CTES, f"""
SELECT message_id, {O.upper_sql('original_text')} AS num_uppercase FROM msg"""))
def num_uppercase(spark, sf_dir):
    return S.msg_texts(spark, sf_dir).select(
        "message_id", T.num_uppercase("original_text").alias("num_uppercase"))


@register("num_digits", with_(O.MSG_CTES, f"""
SELECT message_id, {O.digits_sql('original_text')} AS num_digits FROM msg"""))
def num_digits(spark, sf_dir):
    return S.msg_texts(spark, sf_dir).select(
        "message_id", T.num_digits("original_text").alias("num_digits"))


@register("ascii_counts", with_(O.MSG_CTES, f"""
SELECT message_id, {O.count_sql('original_text', '[A-Z]')} AS upper_ascii,
       {O.count_sql('original_text', '[0-9]')} AS digits_ascii FROM msg"""))
def ascii_counts(spark, sf_dir):
    m = S.msg(spark, sf_dir)
    return m.select("message_id", T.ascii_upper("original_text").alias("upper_ascii"),
                    T.ascii_digits("original_text").alias("digits_ascii"))


@register("strip_urls", with_(O.MSG_CTES, f"""
SELECT message_id, {O.strip_urls_sql('original_text')} AS text_out FROM msg"""))
def strip_urls(spark, sf_dir):
    return S.msg(spark, sf_dir).select("message_id",
                                       T.strip_urls("original_text").alias("text_out"))


@register("letters_only", with_(O.MSG_CTES, f"""
SELECT message_id, {O.letters_only_sql(O.strip_urls_sql('original_text'))} AS text_out FROM msg"""))
def letters_only(spark, sf_dir):
    return S.msg(spark, sf_dir).select(
        "message_id", T.letters_only(T.strip_urls("original_text")).alias("text_out"))


def _tok_sql(arr: str) -> str:
    return f"CAST(len({arr}) AS INTEGER) AS n_tokens, array_to_string({arr}, ' ') AS tokens"


def _tok(arr):
    return [F.size(arr).cast("int").alias("n_tokens"), F.array_join(arr, " ").alias("tokens")]


_PKG_SPLIT_SQL = O.split_tokens_sql(f"lower({O.letters_only_sql(O.strip_urls_sql('original_text'))})")


def _pkg_split():
    return T.split_tokens(T.lower_text(T.letters_only(T.strip_urls("original_text"))))


@register("split_tokens", with_(O.MSG_CTES, f"""
SELECT message_id, {_tok_sql(_PKG_SPLIT_SQL)} FROM msg WHERE original_text IS NOT NULL"""))
def split_tokens(spark, sf_dir):
    return (S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
            .select("message_id", *_tok(_pkg_split())))


@register("drop_stopwords", with_(O.MSG_CTES, f"""
SELECT message_id, {_tok_sql(O.drop_stopwords_sql(_PKG_SPLIT_SQL))} FROM msg
WHERE original_text IS NOT NULL"""))
def drop_stopwords(spark, sf_dir):
    return (S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
            .select("message_id", *_tok(T.drop_stopwords(_pkg_split()))))


@register("keep_alnum_tokens", with_(O.MSG_CTES, f"""
SELECT message_id, {_tok_sql(O.keep_alnum_sql(O.split_tokens_sql('lower(original_text)')))} FROM msg
WHERE original_text IS NOT NULL"""))
def keep_alnum_tokens(spark, sf_dir):
    return (S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
            .select("message_id",
                    *_tok(T.keep_alnum_tokens(T.split_tokens(T.lower_text("original_text"))))))


@register("tokenize_words", with_(O.MSG_CTES, f"""
SELECT message_id, {_tok_sql(T.tokenize_words_sql('lower(original_text)'))} FROM msg
WHERE original_text IS NOT NULL"""))
def tokenize_words(spark, sf_dir):
    return (S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
            .select("message_id", *_tok(T.tokenize_words(T.lower_text("original_text")))))


@register("lemmatize_tokens", with_(O.MSG_CTES + f""",
toks AS (
  SELECT message_id, unnest(arr_) AS tok, generate_subscripts(arr_, 1) AS pos
  FROM (SELECT message_id, {O.drop_stopwords_sql(_PKG_SPLIT_SQL)} AS arr_ FROM msg
        WHERE original_text IS NOT NULL)),
vocab AS (SELECT DISTINCT tok FROM toks),
lemmas AS (
  SELECT v.tok AS form, s.tok AS lemma FROM vocab v JOIN vocab s
    ON length(v.tok) > 3 AND v.tok LIKE '%s' AND v.tok NOT LIKE '%ss'
   AND s.tok = substr(v.tok, 1, length(v.tok) - 1))""", """
SELECT message_id, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(coalesce(l.lemma, t.tok), ' ' ORDER BY t.pos) AS tokens
FROM toks t LEFT JOIN lemmas l ON t.tok = l.form GROUP BY message_id"""))
def lemmatize_tokens(spark, sf_dir):
    m = S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
    toks = checkpoint_stage(m.select("message_id", T.package_tokens("original_text").alias("tokens")),
                            "package_tokens")
    lem = P.plural_lemma_table(toks, "tokens")
    out = P.lemmatize_join(toks, "tokens", lem, id_col="message_id")
    return out.where(F.size("tokens") > 0).select("message_id", *_tok(F.col("tokens")))


@register("clean_text_notebook", with_(O.MSG_CTES, f"""
SELECT message_id, {O.clean_notebook_nostem_sql('original_text')} AS clean_text FROM msg"""))
def clean_text_notebook(spark, sf_dir):
    return S.msg(spark, sf_dir).select(
        "message_id", T.clean_text_notebook("original_text").alias("clean_text"))


@register("stem_tokens", with_(O.MSG_CTES + "," + O.notebook_stem_ctes("msg"), """
SELECT message_id, n_tokens, clean_text AS tokens FROM stemmed"""))
def stem_tokens(spark, sf_dir):
    """T14 over the vocabulary of the notebook's tokens."""
    m = S.msg(spark, sf_dir).where(F.col("original_text").isNotNull())
    toks = checkpoint_stage(m.select("message_id", T.notebook_tokens("original_text").alias("tokens")), "notebook_tokens")
    return P.stem_join(toks, "tokens").where(F.size("tokens") > 0).select("message_id", *_tok(F.col("tokens")))


@register("clean_text_notebook_stemmed", with_(O.MSG_CTES + "," + O.notebook_stem_ctes("msg"), """
SELECT message_id, coalesce(clean_text, '') AS clean_text FROM msg LEFT JOIN stemmed USING (message_id)"""))
def clean_text_notebook_stemmed(spark, sf_dir):
    """T16 as a whole, stems included; a null text is empty."""
    return PL.cleaned(S.msg(spark, sf_dir).select("message_id", "original_text"), "notebook")


@register("nb_confusion_notebook_stemmed", O.flagship_sql(42, max_features=None, cleaner="notebook"))
def nb_confusion_notebook_stemmed(spark, sf_dir):
    """Notebook variant as a whole: T16 with stems, unlimited vocabulary."""
    return PL.flagship(spark, sf_dir, 42, max_features=None, cleaner="notebook")


@register("clean_text_package", with_(O.MSG_CTES, f"""
SELECT message_id, {O.clean_package_sql('original_text')} AS clean_text FROM msg"""))
def clean_text_package(spark, sf_dir):
    return S.msg(spark, sf_dir).select(
        "message_id", T.clean_text_package("original_text").alias("clean_text"))


@register("clean_text_browser", with_(O.MSG_CTES, f"""
SELECT message_id, {O.clean_browser_sql('original_text')} AS clean_text FROM msg"""))
def clean_text_browser(spark, sf_dir):
    return S.msg(spark, sf_dir).select(
        "message_id", T.clean_text_browser("original_text").alias("clean_text"))


# ---------------------------------------------------------------------------------------
# F: features (prepared = seed 42, browser cleaner, threshold split)

_VEC_TOKENS_SQL = f"regexp_extract_all(lower(clean_text), {q('(' + T.VECTORIZER_TOKEN + ')')}, 1)"


@register("vectorizer_tokens", with_(_PREP42, f"""
SELECT message_id, {_tok_sql(_VEC_TOKENS_SQL)} FROM prepared"""))
def vectorizer_tokens(spark, sf_dir):
    m = PL.prepared(spark, sf_dir, materialize=False)
    return m.select("message_id", *_tok(T.vectorizer_tokens("clean_text")))


_NB = _PREP42 + O.nb_ctes(3000)


def _fitted(spark, sf_dir, max_features=3000):
    m = PL.prepared(spark, sf_dir)
    train = m.where(~F.col("is_test"))
    return m, train, FE.fit_features(train, "clean_text", max_features)


@register("term_counts", with_(_NB, "SELECT message_id, term, tf FROM tf"))
def term_counts(spark, sf_dir):
    return FE.term_counts(PL.prepared(spark, sf_dir), "clean_text")


@register("build_vocabulary", with_(_NB, "SELECT term, total, df FROM vocab0"))
def build_vocabulary(spark, sf_dir):
    m = PL.prepared(spark, sf_dir)
    tf = FE.term_counts(m.where(~F.col("is_test")), "clean_text")
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return stats.orderBy(F.desc("total"), F.asc("term")).limit(3000)


@register("inverse_doc_freq", with_(_PREP42 + O.nb_ctes(None), """
SELECT term, round(idf, 6) AS idf FROM vocab"""))
def inverse_doc_freq(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir, None)
    return fitted.vocab.select("term", r6("idf").alias("idf"))


@register("tfidf_weights", with_(_NB, """
SELECT message_id, feature AS term, round(value, 6) AS weight FROM tfidf"""))
def tfidf_weights(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir)
    tf = FE.term_counts(m, "clean_text")
    return FE.tfidf_weights(tf, fitted.vocab, 3000).withColumn("weight", r6("weight"))


@register("tfidf_weights_unbounded", with_(_PREP42 + O.nb_ctes(None), """
SELECT message_id, feature AS term, round(value, 6) AS weight FROM tfidf"""))
def tfidf_weights_unbounded(spark, sf_dir):
    """F5 with the unlimited vocabulary (notebook): salted join on term."""
    m, train, fitted = _fitted(spark, sf_dir, None)
    tf = FE.term_counts(m, "clean_text")
    return FE.tfidf_weights(tf, fitted.vocab, None).withColumn("weight", r6("weight"))


@register("minmax_scale", with_(_NB, """
SELECT message_id, round(v1, 6) AS message_length, round(v2, 6) AS num_uppercase,
       round(v3, 6) AS num_digits FROM scaled"""))
def minmax_scale(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir)
    s = FE.minmax_scale(m.select("message_id", *FE.NUMERIC_FEATURES), fitted.scale)
    return s.select("message_id", *[r6(c).alias(c) for c in FE.NUMERIC_FEATURES])


@register("assemble_features", with_(_NB, """
SELECT message_id, feature, round(value, 6) AS value FROM feats"""))
def assemble_features(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir)
    return fitted.transform(m, "clean_text").withColumn("value", r6("value"))


@register("fit_on_train_only", with_(_NB, """
SELECT f.message_id, f.feature, round(f.value, 6) AS value
FROM feats f JOIN prepared p USING (message_id) WHERE p.is_test"""))
def fit_on_train_only(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir)
    return fitted.transform(m.where(F.col("is_test")), "clean_text").withColumn("value", r6("value"))


@register("stratified_split", with_(_PREP42, "SELECT message_id, label_num, is_test FROM prepared"))
def stratified_split(spark, sf_dir):
    return FE.split_threshold(PL.labelled_messages(spark, sf_dir), 42).select(
        "message_id", "label_num", "is_test")


@register("stratified_split_exact", with_(O.prepared_ctes(42, split="exact"),
                                          "SELECT message_id, label_num, is_test FROM prepared"))
def stratified_split_exact(spark, sf_dir):
    # the refinement passes re-read their input: stage it once
    from ..sources.stage import checkpoint_stage
    n = PL.message_partitions(spark, sf_dir)
    m = checkpoint_stage(PL.labelled_messages(spark, sf_dir, num_partitions=n)
                         .select("message_id", "label_num"),
                         "split_in", key="message_id", buckets=n, prepartitioned=True)
    return FE.split_exact(m, 42).select("message_id", "label_num", "is_test")


@register("balanced_class_weights", with_(_PREP42, """
SELECT label_num, count(*) AS n_c,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM prepared WHERE NOT is_test GROUP BY label_num"""))
def balanced_class_weights(spark, sf_dir):
    m = PL.prepared(spark, sf_dir)
    return FE.balanced_class_weights(m.where(~F.col("is_test"))).withColumn("weight", r6("weight"))


# ---------------------------------------------------------------------------------------
# M: relational Naive Bayes

def _nb_model(spark, sf_dir):
    m, train, fitted = _fitted(spark, sf_dir)
    model = fit_naive_bayes(fitted.transform(train, "clean_text", keep=("label_num",)),
                            train.select("message_id", "label_num"), bound_rows=3003)
    return m, fitted, model


@register("train_naive_bayes", with_(_NB, """
SELECT feature, round(lt0, 6) AS lt0, round(lt1, 6) AS lt1 FROM theta"""))
def train_naive_bayes(spark, sf_dir):
    m, fitted, model = _nb_model(spark, sf_dir)
    return model.theta.select("feature", r6("lt0").alias("lt0"), r6("lt1").alias("lt1"))


@register("predict_batch", with_(_NB, """
SELECT message_id, actual, predicted, round(score, 6) AS score FROM nb_pred"""))
def predict_batch(spark, sf_dir):
    return (PL.naive_bayes_predictions(spark, sf_dir, 42)
            .withColumn("score", r6("score")))


# ---------------------------------------------------------------------------------------
# E: evaluation over pred_rule

def _rule_model_sql():
    parts = []
    for o, n, e, t in ST.RULE_MODELS:
        parts.append(f"SELECT {o} AS model_ord, {q(n)} AS model_name, CAST({e} AS DOUBLE) AS score,"
                     f" {t} AS thr_, message_id FROM labelled")
    return " UNION ALL ".join(parts)


_RUNS_SQL = " UNION ALL ".join(
    f"SELECT 'run_{i + 1:02d}_seed{s}' AS run_id, {s} AS seed, {i + 1} AS run_ord"
    for i, s in enumerate(ST.RUN_SEEDS))

_PRED = _LABELLED + f""",
runs AS ({_RUNS_SQL}),
rule AS ({_rule_model_sql()}),
pred AS (
  SELECT r.run_id, m.model_name, m.model_ord, l.message_id, l.label_num AS actual,
         CAST(m.score >= m.thr_ AS INTEGER) AS predicted, m.score
  FROM labelled l CROSS JOIN runs r JOIN rule m ON m.message_id = l.message_id
  WHERE CAST(('0x' || substr(md5(CAST(r.seed AS VARCHAR) || ':' || CAST(l.message_id AS VARCHAR)), 1, 8)) AS BIGINT)
        < {FE.test_key_limit(0.2)}),
cnt AS (
  SELECT run_id, model_name, model_ord,
    CAST(count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS BIGINT) AS tp
  FROM pred GROUP BY ALL),
met AS (
  SELECT *,
    round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
    round(coalesce(tp / nullif(tp + fn, 0), 0) - CAST(0.1 AS DOUBLE) * fp, 6) AS sel_score
  FROM cnt),
dsc AS (
  SELECT run_id, model_name, model_ord, score,
         count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg
  FROM pred GROUP BY ALL),
dsc2 AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id, model_name, model_ord ORDER BY score
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM dsc),
auc AS (
  SELECT run_id, model_name, model_ord,
         round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc
  FROM dsc2 GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sel_score DESC, model_ord) = 1
            AND sel_score > -999 AS is_best_model
  FROM met),
prod AS (
  SELECT model_name AS prod_model FROM met WHERE run_id = 'run_01_seed42'
  ORDER BY sel_score DESC, model_ord LIMIT 1),
results AS (
  SELECT b.*, a.auc, coalesce(b.model_name = p.prod_model, false) AS is_production_model
  FROM best b LEFT JOIN auc a USING (run_id, model_name, model_ord) CROSS JOIN prod p)"""


def _pred(spark, sf_dir):
    return ST.pred_rule(spark, sf_dir)


@register("confusion_counts", with_(_PRED, "SELECT run_id, model_name, model_ord, tn, fp, fn, tp FROM cnt"))
def confusion_counts(spark, sf_dir):
    return E.confusion_counts(_pred(spark, sf_dir))


@register("confusion_long", "WITH " + _PRED + "," + O.confusion_long_sql("pred"))
def confusion_long(spark, sf_dir):
    return E.confusion_long(E.confusion_counts(_pred(spark, sf_dir)))


for _name, _fn in (("accuracy", E.accuracy), ("precision", E.precision), ("recall", E.recall),
                   ("f1", E.f1)):
    _col = "f1_score" if _name == "f1" else _name

    def _mk(fn=_fn, col=_col):
        def run(spark, sf_dir):
            c = E.confusion_counts(_pred(spark, sf_dir))
            return c.select("run_id", "model_name", r6(fn()).alias(col))
        return run
    register(_name, with_(_PRED, f"SELECT run_id, model_name, {_col} FROM met"))(_mk())


@register("roc_auc", with_(_PRED, "SELECT run_id, model_name, model_ord, auc FROM auc"))
def roc_auc(spark, sf_dir):
    return E.roc_auc(_pred(spark, sf_dir))


@register("classification_report", with_(_PRED, """
SELECT run_id, model_name, '0' AS report_row,
       round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision,
       round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall,
       round(coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), 6) AS f1_score,
       tn + fp AS support FROM cnt
UNION ALL
SELECT run_id, model_name, '1', round(coalesce(tp / nullif(tp + fp, 0), 0), 6),
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6),
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), tp + fn FROM cnt
UNION ALL
SELECT run_id, model_name, 'accuracy', NULL, NULL,
       round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6), tp + tn + fp + fn FROM cnt
UNION ALL
SELECT run_id, model_name, 'macro avg',
       round((coalesce(tn / nullif(tn + fn, 0), 0) + coalesce(tp / nullif(tp + fp, 0), 0)) / 2, 6),
       round((coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2, 6),
       round((coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)
              + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 6),
       tp + tn + fp + fn FROM cnt
UNION ALL
SELECT run_id, model_name, 'weighted avg',
       round(coalesce((coalesce(tn / nullif(tn + fn, 0), 0) * (tn + fp)
                       + coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn)) / nullif(tp + tn + fp + fn, 0), 0), 6),
       round(coalesce((coalesce(tn / nullif(tn + fp, 0), 0) * (tn + fp)
                       + coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn)) / nullif(tp + tn + fp + fn, 0), 0), 6),
       round(coalesce((coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) * (tn + fp)
                       + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn))
                      / nullif(tp + tn + fp + fn, 0), 0), 6),
       tp + tn + fp + fn FROM cnt"""))
def classification_report(spark, sf_dir):
    return E.classification_report(_pred(spark, sf_dir))


@register("selection_score", with_(_PRED, "SELECT run_id, model_name, sel_score FROM met"))
def selection_score(spark, sf_dir):
    c = E.confusion_counts(_pred(spark, sf_dir))
    return c.select("run_id", "model_name", E.selection_score(6).alias("sel_score"))


def _scored(spark, sf_dir):
    c = E.confusion_counts(_pred(spark, sf_dir))
    return c.withColumn("sel_score", E.selection_score(6))


@register("best_in_run", with_(_PRED, "SELECT run_id, model_name, sel_score, is_best_model FROM best"))
def best_in_run(spark, sf_dir):
    return E.best_in_run(_scored(spark, sf_dir), -999.0).select(
        "run_id", "model_name", "sel_score", "is_best_model")


@register("best_in_run_floor", with_(_PRED, """
SELECT run_id, model_name, sel_score,
       row_number() OVER (PARTITION BY run_id ORDER BY sel_score DESC, model_ord) = 1
       AND sel_score > -1 AS is_best_model FROM met"""))
def best_in_run_floor(spark, sf_dir):
    """E10 with the phase-4/5 floor of -1 (a run may have no winner)."""
    return E.best_in_run(_scored(spark, sf_dir), -1.0).select(
        "run_id", "model_name", "sel_score", "is_best_model")


@register("production_flag", with_(_PRED, "SELECT run_id, model_name, is_production_model FROM results"))
def production_flag(spark, sf_dir):
    return E.production_flag(_scored(spark, sf_dir)).select(
        "run_id", "model_name", "is_production_model")


@register("rank_by_f1", with_(_PRED, """
SELECT run_id, model_name, f1_score,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY f1_score DESC, model_ord) AS INTEGER)
         AS f1_rank FROM met"""))
def rank_by_f1(spark, sf_dir):
    m = E.metrics(_pred(spark, sf_dir))
    return E.rank_by_f1(m).select("run_id", "model_name", "f1_score", "f1_rank")


@register("best_by_f1", with_(_PRED, """
SELECT run_id, model_name, f1_score FROM met
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY f1_score DESC, model_ord) = 1"""))
def best_by_f1(spark, sf_dir):
    m = E.metrics(_pred(spark, sf_dir))
    return E.best_by_f1(m).select("run_id", "model_name", "f1_score")


@register("hyperparams_wide", """
SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS model_name,
       json_extract_string(props, '$.k') AS hp_k,
       CASE WHEN event_type = 'error' THEN 'None' ELSE printf('%.2f', value) END AS hp_alpha,
       CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS hp_n_jobs
FROM events""")
def hyperparams_wide(spark, sf_dir):
    return X.hyperparams_wide(ST.props_kv(spark, sf_dir), ["k", "alpha", "n_jobs"])


@register("mean_by_model", with_(_PRED, """
SELECT model_name, round(avg(accuracy), 4) AS accuracy, round(avg(precision), 4) AS precision,
       round(avg(recall), 4) AS recall, round(avg(f1_score), 4) AS f1_score,
       round(avg(auc), 4) AS auc FROM results GROUP BY model_name"""))
def mean_by_model(spark, sf_dir):
    return X.mean_by_model(X.results_table(_pred(spark, sf_dir)))


@register("run_grid", with_(_LABELLED + f", runs AS ({_RUNS_SQL})", f"""
SELECT run_id, CASE WHEN CAST(('0x' || substr(md5(CAST(seed AS VARCHAR) || ':' || CAST(message_id AS VARCHAR)), 1, 8)) AS BIGINT)
                    < {FE.test_key_limit(0.2)} THEN 'test' ELSE 'train' END AS split,
       label_num, count(*) AS n
FROM labelled CROSS JOIN runs GROUP BY ALL"""))
def run_grid(spark, sf_dir):
    return X.run_grid_splits(PL.labelled_messages(spark, sf_dir), ST.RUN_SEEDS)


@register("results_table", with_(_PRED, """
SELECT run_id, model_name, accuracy, precision, recall, f1_score, auc, tp, fp, tn, fn,
       'v1.0' AS dataset_version, is_best_model, is_production_model FROM results"""))
def results_table(spark, sf_dir):
    r = X.results_table(_pred(spark, sf_dir))
    return r.drop("training_time_sec", "inference_time_sec", "date_trained", "hyperparameters")


@register("attach_columns", with_(_PRED, """
SELECT r.run_id, r.model_name, r.f1_score, c.spam_rows, c.mean_score
FROM results r LEFT JOIN (
  SELECT run_id, model_name, count(*) FILTER (WHERE predicted = 1) AS spam_rows,
         round(avg(score), 6) AS mean_score
  FROM pred WHERE model_ord < 2 GROUP BY run_id, model_name) c
  ON r.run_id = c.run_id AND r.model_name = c.model_name"""))
def attach_columns(spark, sf_dir):
    """Columns from another table; one model has no row there."""
    pred = _pred(spark, sf_dir)
    r = X.results_table(pred).select("run_id", "model_name", "f1_score")
    c = pred.where(F.col("model_ord") < 2).groupBy("run_id", "model_name").agg(
        F.count_if(F.col("predicted") == 1).alias("spam_rows"),
        r6(F.avg("score")).alias("mean_score"))
    return P.attach_columns(r, c)


_LOG_W = "CAST(greatest(length(CAST(tn AS VARCHAR)), length(CAST(fp AS VARCHAR)), length(CAST(fn AS VARCHAR)), length(CAST(tp AS VARCHAR))) AS INTEGER)"


def _lp(x):
    return f"lpad(CAST({x} AS VARCHAR), {_LOG_W}, ' ')"


@register("write_metrics_log", with_(_PRED, f"""
SELECT run_id, model_ord, model_name,
       'Model: ' || model_name || chr(10) || 'Precision: ' || printf('%.4f', coalesce(tp / nullif(tp + fp, 0), 0))
       || ' | Recall: ' || printf('%.4f', coalesce(tp / nullif(tp + fn, 0), 0)) || chr(10)
       || 'Confusion Matrix:' || chr(10) || '[[' || {_lp('tn')} || ' ' || {_lp('fp')} || ']' || chr(10)
       || ' [' || {_lp('fn')} || ' ' || {_lp('tp')} || ']]' || chr(10) || chr(10) AS entry
FROM cnt WHERE run_id = 'run_01_seed42'"""))
def write_metrics_log(spark, sf_dir):
    return _metrics_log_spark(_pred(spark, sf_dir))


# ---------------------------------------------------------------------------------------
# I: scoring service paths

@register("route_mailbox", """
SELECT event_id AS id, event_type AS texto, coalesce(event_type = 'error', false) AS "esSpam",
       CASE WHEN coalesce(event_type = 'error', false) THEN 'spam' ELSE 'inbox' END AS box
FROM events""")
def route_mailbox(spark, sf_dir):
    return SC.route_mailbox(ST.mailbox_t(spark, sf_dir))


@register("mailbox_view", """
SELECT CAST(row_number() OVER (ORDER BY box, id DESC) - 1 AS BIGINT) AS position, * FROM (
  SELECT event_id AS id, event_type AS texto, coalesce(event_type = 'error', false) AS "esSpam",
         CASE WHEN coalesce(event_type = 'error', false) THEN 'spam' ELSE 'inbox' END AS box
  FROM events)""")
def mailbox_view(spark, sf_dir):
    """I3 display order: each message's place, newest first within its box."""
    return SC.mailbox_view(ST.mailbox_t(spark, sf_dir))


BATCH_MS = 1_700_000_000_000


@register("assign_message_ids", with_(_LINES_SQL, f"""
SELECT {BATCH_MS} + CAST(row_number() OVER (ORDER BY conv_id, turn, line_no) - 1 AS BIGINT) AS id,
       conv_id, turn, line_no, texto
FROM lines QUALIFY texto IS NOT NULL"""))
def assign_message_ids(spark, sf_dir):
    conv = S.table(spark, sf_dir, "conversations")
    raw = conv.select("conv_id", "turn",
                      F.posexplode(F.split("text", "\r?\n")).alias("line_no", "raw"))
    lines = raw.select("conv_id", "turn", F.col("line_no").cast("int"),
                       FI.clean_message_line(F.col("raw")).alias("texto"))
    return SC.assign_message_ids(lines, BATCH_MS, ["conv_id", "turn", "line_no"])


@register("batch_count", with_(_LINES_SQL, """
SELECT count(*) AS procesados FROM lines WHERE texto IS NOT NULL"""))
def batch_count(spark, sf_dir):
    conv = S.table(spark, sf_dir, "conversations")
    return SC.batch_count(FI.message_lines(conv, "text", ["conv_id", "turn"]))


_FLIPS_SQL = """
parity AS (SELECT event_id % 100 AS id, count(*) % 2 AS flips_ FROM events WHERE value > 50 GROUP BY 1),
corrected AS (
  SELECT e.event_id AS id, e.event_type AS texto,
         CASE WHEN p.flips_ = 1 THEN NOT coalesce(e.event_type = 'error', false)
              ELSE coalesce(e.event_type = 'error', false) END AS "esSpam",
         coalesce(p.flips_ = 1, false) AS changed
  FROM events e LEFT JOIN parity p ON e.event_id = p.id)"""


@register("apply_corrections", with_(_FLIPS_SQL, "SELECT * FROM corrected"))
def apply_corrections(spark, sf_dir):
    return SC.apply_corrections(ST.mailbox_t(spark, sf_dir), ST.flips(spark, sf_dir))


@register("corrections_feed", with_(_FLIPS_SQL, """
SELECT id, texto AS texto_anonimizado, CAST("esSpam" AS INTEGER) AS etiqueta_correcta,
       'pendiente' AS estado FROM corrected WHERE changed"""))
def corrections_feed(spark, sf_dir):
    return SC.corrections_feed(SC.apply_corrections(ST.mailbox_t(spark, sf_dir),
                                                    ST.flips(spark, sf_dir)))


# ---------------------------------------------------------------------------------------
# sinks, each written to the shared folder and read back

@register("checkpoint_stage", """
SELECT event_id, user_id, event_type, value FROM events""")
def checkpoint_stage_query(spark, sf_dir):
    """The events staged by user and continued from."""
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return checkpoint_stage(e, "events", key="user_id")


@register("export_report_tables", with_(_PRED, """
SELECT run_id, model_name, tn, fp, fn, tp FROM cnt"""))
def export_report_tables(spark, sf_dir):
    """The confusion table as published CSV with a header."""
    keys = ["run_id", "model_name"]
    report = E.confusion_counts(_pred(spark, sf_dir), keys).select(*keys, "tn", "fp", "fn", "tp")
    out = shared_path(spark, "reports")
    FI.export_report_tables({"confusion": report}, out)
    return spark.read.schema(report.schema).option("header", True).csv(f"{out}/confusion")


@register("persist_mailbox", """
SELECT event_id AS id, event_type AS texto, coalesce(event_type = 'error', false) AS "esSpam" FROM events""")
def persist_mailbox(spark, sf_dir):
    """Spam and inbox appended one after the other, then loaded."""
    out = shared_path(spark, "mailbox")
    box = ST.mailbox_t(spark, sf_dir)
    for part in (F.col("esSpam"), ~F.col("esSpam")):
        FI.persist_mailbox(box.where(part), out)
    return FI.load_mailbox(spark, out)


@register("append_corrections", with_(_FLIPS_SQL, """
SELECT texto AS texto_anonimizado, CAST("esSpam" AS INTEGER) AS etiqueta_correcta,
       'pendiente' AS estado FROM corrected WHERE changed"""))
def append_corrections(spark, sf_dir):
    """The corrections feed appended to its table, then read."""
    out = shared_path(spark, "corrections")
    FI.append_corrections(corrections_feed(spark, sf_dir), out)
    return spark.read.schema(CORRECTIONS).parquet(out)


@register("bump_model_version", """
SELECT max(user_id) + n AS version FROM events CROSS JOIN (VALUES (0), (1), (2)) v(n) GROUP BY n""")
def bump_model_version(spark, sf_dir):
    """M9: a registry with the users' numbers as versions, raised twice; the
    last version before and the two after."""
    out = shared_path(spark, "versions")
    S.table(spark, sf_dir, "events").select(F.col("user_id").alias("version")).write.parquet(out)
    for _ in range(2):
        last = X.bump_model_version(spark, out)
    return spark.read.schema("version long").parquet(out).where(F.col("version") >= last - 2).distinct()


def _upload_lines(spark, sf_dir):
    """I4: the uploaded 'file' = every conversation text, line ids from BATCH_MS."""
    conv = S.table(spark, sf_dir, "conversations")
    raw = conv.select("conv_id", "turn",
                      F.posexplode(F.split("text", "\r?\n")).alias("line_no", "raw"))
    lines = raw.select("conv_id", "turn", F.col("line_no").cast("int"),
                       FI.clean_message_line(F.col("raw")).alias("texto"))
    return SC.assign_message_ids(lines, BATCH_MS, ["conv_id", "turn", "line_no"])


def _nb_fitted(spark, sf_dir):
    m = PL.prepared(spark, sf_dir)
    train = m.where(~F.col("is_test"))
    tf = PL.staged_term_counts(m).where(~F.col("is_test")).drop("is_test")
    fitted = FE.fit_features(train, "clean_text", 3000, tf=tf).staged()
    model = fit_naive_bayes(fitted.transform(train, "clean_text", keep=("label_num",), tf=tf),
                            train.select("message_id", "label_num"), bound_rows=3003)
    # saved and read back: the statistics are computed once, not by each scoring batch
    path = shared_path(spark, "nb_scorer")
    save_scorer(fitted, model, path)
    return load_scorer(spark, path)


_SCORE_SQL = with_(_NB + "," + _LINES_SQL + f""",
newmsg AS (
  SELECT {BATCH_MS} + CAST(row_number() OVER (ORDER BY conv_id, turn, line_no) - 1 AS BIGINT) AS id, texto
  FROM lines QUALIFY texto IS NOT NULL),
nm AS (
  SELECT id AS message_id, texto, {O.length_sql('texto')} AS message_length,
         {O.upper_sql('texto')} AS num_uppercase, {O.digits_sql('texto')} AS num_digits,
         {O.clean_browser_sql('texto')} AS clean_text FROM newmsg),
ntf AS (
  SELECT message_id, term, count(*) AS tf FROM (
    SELECT message_id, unnest({_VEC_TOKENS_SQL}) AS term FROM nm) GROUP BY message_id, term),
nwt AS (SELECT message_id, term, tf * idf AS w FROM ntf JOIN vocab USING (term)),
nfeats AS (
  SELECT message_id, term AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY message_id)) AS value
  FROM nwt
  UNION ALL SELECT message_id, '#message_length',
    (message_length - lo1) / CASE WHEN hi1 - lo1 = 0 THEN 1.0 ELSE hi1 - lo1 END FROM nm, mm
  UNION ALL SELECT message_id, '#num_uppercase',
    (num_uppercase - lo2) / CASE WHEN hi2 - lo2 = 0 THEN 1.0 ELSE hi2 - lo2 END FROM nm, mm
  UNION ALL SELECT message_id, '#num_digits',
    (num_digits - lo3) / CASE WHEN hi3 - lo3 = 0 THEN 1.0 ELSE hi3 - lo3 END FROM nm, mm),
njll AS (
  SELECT message_id, sum(value * lt0) + max(lp0) AS jll0, sum(value * lt1) + max(lp1) AS jll1
  FROM nfeats JOIN theta USING (feature) CROSS JOIN prior GROUP BY message_id)""", """
SELECT n.message_id AS id, n.texto, coalesce(j.jll1 > j.jll0, false) AS "esSpam",
       round(1.0 / (1.0 + exp(j.jll0 - j.jll1)), 6) AS score
FROM nm n LEFT JOIN njll j USING (message_id)""")


@register("score_table", _SCORE_SQL)
def score_table(spark, sf_dir):
    fitted, model = _nb_fitted(spark, sf_dir)
    new = _upload_lines(spark, sf_dir).select("id", "texto")
    return SC.score_table(new, fitted, model, T.clean_text_browser).withColumn("score", r6("score"))


@register("score_stream", _SCORE_SQL)
def score_stream(spark, sf_dir):
    """The same upload arriving as files, scored by a Structured
    Streaming query (availableNow) with the batch scorer per micro-batch."""
    from ..session import shared_path
    from ..streaming.scoring import read_sink, score_stream as start
    fitted, model = _nb_fitted(spark, sf_dir)
    src, sink, ck = (shared_path(spark, n) for n in ("score-src", "score-sink", "score-ckpt"))
    # three micro-batches, each of as many files as there are cores
    cores = spark.sparkContext.defaultParallelism
    _upload_lines(spark, sf_dir).select("id", "texto").repartition(3 * cores).write.parquet(src)
    q = start(spark, src, "id long, texto string",
              lambda b: SC.score_table(S.balance(b), fitted, model, T.clean_text_browser), sink, ck,
              max_files_per_trigger=cores)
    q.awaitTermination()
    return read_sink(spark, sink).select("id", "texto", "esSpam", r6("score").alias("score"))


@register("corrections_stream", with_(_FLIPS_SQL, """
SELECT id, texto AS texto_anonimizado, CAST("esSpam" AS INTEGER) AS etiqueta_correcta,
       'pendiente' AS estado FROM corrected WHERE changed"""))
def corrections_stream(spark, sf_dir):
    """I6 stream form: correction clicks arriving as files, click counts in
    the state store, changed labels emitted per micro-batch."""
    from ..session import shared_path
    from ..streaming.scoring import corrections_stream as start, latest_corrections
    src, sink, ck = (shared_path(spark, n) for n in ("clicks-src", "clicks-sink", "clicks-ckpt"))
    # four files, one per micro-batch: most ids are clicked in several of them
    ST.flips(spark, sf_dir).select("id").repartition(4).write.parquet(src)
    q = start(spark, src, ST.mailbox_t(spark, sf_dir), sink, ck, max_files_per_trigger=1)
    q.awaitTermination()
    return latest_corrections(spark, sink).select("id", "texto_anonimizado", "etiqueta_correcta", "estado")


# ---------------------------------------------------------------------------------------
# X: profiling (lineitem, customer, part)

def _lineitem(spark, sf_dir):
    return S.table(spark, sf_dir, "lineitem")


_LI_COLS = [f.name for f in S.DRIVER["lineitem"].fields]
_LI_TYPES = {f.name: f.dataType.simpleString() for f in S.DRIVER["lineitem"].fields}
_LI_NUM = [f.name for f in S.DRIVER["lineitem"].fields
           if isinstance(f.dataType, PR.NUMERIC)][:10]


def _union_per_col(cols, fn):
    return "\nUNION ALL ".join(fn(i, c) for i, c in enumerate(cols))


@register("table_info", _union_per_col(_LI_COLS, lambda i, c: (
    f"SELECT {q(c)} AS \"column\", {i} AS position, {q(_LI_TYPES[c])} AS type, "
    f"count({c}) AS non_null, count(*) AS \"rows\" FROM lineitem")))
def table_info(spark, sf_dir):
    return PR.table_info(_lineitem(spark, sf_dir))


_DISTINCT_SQL = _union_per_col(_LI_COLS, lambda i, c: (
    f"SELECT {q(c)} AS \"column\", {i} AS position, count(DISTINCT {c}) AS n_distinct FROM lineitem"))


@register("distinct_counts", _DISTINCT_SQL)
def distinct_counts(spark, sf_dir):
    return PR.distinct_counts(_lineitem(spark, sf_dir))


@register("plottable_columns", f"""
SELECT "column", position FROM ({_DISTINCT_SQL})
WHERE n_distinct > 1 AND n_distinct < 50 ORDER BY position LIMIT 10""")
def plottable_columns(spark, sf_dir):
    return PR.plottable_columns(_lineitem(spark, sf_dir))


@register("value_counts", """
SELECT c_mktsegment AS value, count(*) AS count FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def value_counts(spark, sf_dir):
    return PR.value_counts(S.table(spark, sf_dir, "customer"), "c_mktsegment")


@register("histogram", """
WITH st AS (
  SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)),
b AS (
  SELECT least(CAST(floor((CAST(l_extendedprice AS DOUBLE) - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin,
         count(*) AS cnt
  FROM lineitem, st WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT 'l_extendedprice' AS "column", CAST(g.bin AS INTEGER) AS bin,
       round(lo + g.bin * ((hi - lo) / 10), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 10), 6) AS hi,
       CAST(coalesce(b.cnt, 0) AS BIGINT) AS count
FROM st, (SELECT unnest(range(0, 10)) AS bin) g LEFT JOIN b ON g.bin = b.bin""")
def histogram(spark, sf_dir):
    h = PR.histogram(_lineitem(spark, sf_dir), "l_extendedprice", 10)
    return h.withColumns({"lo": r6("lo"), "hi": r6("hi")})


@register("null_free_columns", _union_per_col(_LI_COLS, lambda i, c: (
    f"SELECT {q(c)} AS \"column\", {i} AS position FROM lineitem HAVING count({c}) = count(*)")))
def null_free_columns(spark, sf_dir):
    return PR.null_free_columns(PR.table_info(_lineitem(spark, sf_dir)))


@register("varying_columns", f"""
SELECT "column", position FROM ({_DISTINCT_SQL}) WHERE n_distinct > 1""")
def varying_columns(spark, sf_dir):
    return PR.varying_columns(PR.distinct_counts(_lineitem(spark, sf_dir)))


# lineitem with derived columns: one with nulls, one constant, 12 numeric ones in all
_WIDE_SQL = """
wide AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS l_net,
         CASE WHEN l_linenumber > 1 THEN l_linenumber END AS l_gap, 7 AS l_const,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge,
         CAST(year(l_shipdate) AS INTEGER) AS l_year, CAST(month(l_shipdate) AS INTEGER) AS l_month
  FROM lineitem)"""
_WIDE_NUM = [f.name for f in S.DRIVER["lineitem"].fields if isinstance(f.dataType, PR.NUMERIC)] + [
    "l_net", "l_charge", "l_year", "l_month"]


def _wide(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _lineitem(spark, sf_dir).select(
        "*", net.alias("l_net"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("l_gap"),
        F.lit(7).alias("l_const"), (net * (1 + F.col("l_tax"))).alias("l_charge"),
        F.year("l_shipdate").alias("l_year"), F.month("l_shipdate").alias("l_month"))


def _usable(spark, sf_dir):
    return PR.drop_constant_columns(PR.drop_null_columns(_wide(spark, sf_dir)))


@register("drop_null_columns", with_(_WIDE_SQL, "SELECT * EXCLUDE (l_gap) FROM wide"))
def drop_null_columns(spark, sf_dir):
    return PR.drop_null_columns(_wide(spark, sf_dir))


@register("drop_constant_columns", with_(_WIDE_SQL, "SELECT * EXCLUDE (l_const) FROM wide"))
def drop_constant_columns(spark, sf_dir):
    return PR.drop_constant_columns(_wide(spark, sf_dir))


_HIST_COLS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_year", "l_month"]


@register("histograms", with_(_WIDE_SQL + "," + ",".join(f"""
h{i} AS (
  SELECT {q(c)} AS "column", b.bin, lo + b.bin * w AS lo, lo + (b.bin + 1) * w AS hi,
         (SELECT count(*) FROM wide
          WHERE least(CAST(floor((CAST({c} AS DOUBLE) - st.lo) / st.w) AS INTEGER), 9) = b.bin) AS count
  FROM (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 10 AS w FROM wide) st,
       (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS bin) b)""" for i, c in enumerate(_HIST_COLS)),
    " UNION ALL ".join(f'SELECT "column", bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count FROM h{i}'
                       for i in range(len(_HIST_COLS)))))
def histograms(spark, sf_dir):
    """X5 for the numeric columns of few values (X3) of the whole table."""
    h = PR.histograms(_wide(spark, sf_dir), _HIST_COLS, 10)
    return h.withColumns({"lo": r6("lo"), "hi": r6("hi")})


@register("numeric_columns", _union_per_col(_LI_NUM, lambda i, c: (
    f"SELECT {q(c)} AS \"column\", {i} AS position, count({c}) AS non_null FROM lineitem")))
def numeric_columns(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    cols = PR.numeric_columns(li)
    return PR.table_info(li.select(*cols)).select("column", "position", "non_null")


_CORR_PAIRS = [(a, b) for i, a in enumerate(_WIDE_NUM) for b in _WIDE_NUM[i + 1:]]


@register("correlation_matrix", with_(_WIDE_SQL, "\nUNION ALL ".join(
    f"SELECT {q(a)} AS col_a, {q(b)} AS col_b, "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM wide"
    for a, b in _CORR_PAIRS)))
def correlation_matrix(spark, sf_dir):
    """X8 over every numeric column that X6 and X7 leave."""
    df = _usable(spark, sf_dir)
    return PR.correlation_matrix(df, PR.numeric_columns(df, None)).withColumn("corr", r6("corr"))


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
_PART_PAIRS = [(a, b) for i, a in enumerate(_PART_NUM) for b in _PART_NUM[i + 1:]]


@register("scatter_pairs", "\nUNION ALL ".join(
    f"SELECT {q(a)} AS x_col, {q(b)} AS y_col, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, "
    f"round((SELECT corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FROM part), 6) AS corr FROM part"
    for a, b in _PART_PAIRS))
def scatter_pairs(spark, sf_dir):
    part = PR.drop_constant_columns(PR.drop_null_columns(S.table(spark, sf_dir, "part")))
    return PR.scatter_pairs(part, PR.numeric_columns(part)).withColumn("corr", r6("corr"))


KDE_GRID = 1000


@register("kernel_density", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", CAST({c} AS DOUBLE) AS x FROM part WHERE {c} IS NOT NULL"
    for c in _PART_NUM) + f"""),
st AS (SELECT "column", count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx
       FROM long GROUP BY 1),
g AS (SELECT "column", n, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, k,
             mn + k * (mx - mn) / {KDE_GRID - 1} AS gx
      FROM st, (SELECT unnest(range(0, {KDE_GRID})) AS k))
SELECT g."column", CAST(k AS INTEGER) AS k, round(gx, 6) AS x,
       round(sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM long JOIN g USING ("column") GROUP BY g."column", k, gx, n, h""")
def kernel_density(spark, sf_dir):
    part = PR.drop_constant_columns(PR.drop_null_columns(S.table(spark, sf_dir, "part")))
    d = PR.kernel_density(part, PR.numeric_columns(part), KDE_GRID)
    return d.withColumns({"x": r6("x"), "density": r6("density")})


# ---------------------------------------------------------------------------------------
# queries without an exact SQL form (rows-only check)

@register("experiment_run")
def experiment_run(spark, sf_dir):
    """E16-E18 for the five seeds with the four fitted candidates (iterative
    fits have no exact SQL form): the results table without the wall-clock columns."""
    from . import experiment as XP
    ex = XP.run_experiment(spark, sf_dir)
    return ex.results.drop("training_time_sec", "inference_time_sec", "date_trained")


@register("experiment_exports")
def experiment_exports(spark, sf_dir):
    """S9 of the three report tables of real fits (five seeds, the relational
    model, logistic regression and the SVM over the unlimited vocabulary of the
    notebook cleaner), exported, read back and counted."""
    from . import experiment as XP
    ex = XP.run_experiment(spark, sf_dir, models=("Logistic Regression", "Naive Bayes", "Support Vector Machine"), cleaner="notebook", max_features=None)
    out = shared_path(spark, "reports")
    tables = {"experiment_results": ex.results, "confusion_matrix": ex.confusion, "hyperparameters": ex.hyperparameters}
    FI.export_report_tables(tables, out)
    read = [spark.read.option("header", True).csv(f"{out}/{name}").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run_id").alias("runs"), F.count_distinct("model_name").alias("models"))
            .select(F.lit(name).alias("table"), "rows", "runs", "models") for name in tables]
    return read[0].unionByName(read[1]).unionByName(read[2])


@register("release_confusion", O.flagship_sql(42))
def release_confusion(spark, sf_dir):
    """End to end (M8, M9): the relational model trained on the split of seed 42 and
    published as a version; another session takes the newest version and scores
    the raw texts of the test messages."""
    from . import release as RL
    registry = shared_path(spark, "registry")
    RL.train_and_publish(spark, sf_dir, registry, cleaner="browser", models=("Naive Bayes",))
    # read three times: the dedup of the texts runs once for them
    n = PL.message_partitions(spark, sf_dir)
    raw = FE.split_threshold(PL.labelled_messages(spark, sf_dir, num_partitions=n), 42).where("is_test")
    raw = checkpoint_stage(raw.select("message_id", "label_num", "original_text"), "test_messages", key="message_id", buckets=n, prepartitioned=True)
    scored = RL.score_with_latest(spark.newSession(), registry, raw.select("message_id", "original_text"))
    pred = raw.select("message_id", F.col("label_num").alias("actual")).join(scored, "message_id")
    return PL.confusion(pred, 42)


@register("release_job")
def release_job(spark, sf_dir):
    """The whole job with the four candidates of the package variant: results,
    rank by F1, and the version that the best one was published under."""
    from . import release as RL
    done = RL.train_and_publish(spark, sf_dir, shared_path(spark, "registry"))
    return done.results.select("model_name", "accuracy", "precision", "recall", "f1_score", "auc", "f1_rank",
                               F.when(F.col("f1_rank") == 1, F.lit(done.version)).alias("version"))
