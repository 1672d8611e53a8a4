"""Quality rules: a threshold table compiled into one Spark projection of
length, symbol, stop-word and line ratios. Built-in functions only.

Cases: a null text has no words and fails; an empty text likewise; ratios of
an empty text are 0; columns of the input that clash with the measures are
replaced in the result; rows are judged one by one, so repeated rows get
equal verdicts and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was",
              "de", "la", "le", "et", "les", "des", "en", "un", "une", "du",
              "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "ein",
              "el", "que", "los", "del", "se", "las", "por", "con", "su", "para")

# (name, measure, comparison that must hold, threshold): the verdict of the method.
RULES = (
    ("enough_words", "n_words", ">=", 50),
    ("few_repeats", "repeat_ratio", "<=", 0.5),
    ("few_symbols", "symbol_ratio", "<=", 0.06),
    ("few_shouts", "bang_ratio", "<=", 0.3),
    ("mean_word_low", "mean_word", ">=", 2.0),
    ("mean_word_high", "mean_word", "<=", 14.0),
    ("few_dup_lines", "dup_line_ratio", "<=", 0.5),
    ("has_stop_words", "n_stop_words", ">=", 2),
)
CHECKS: dict[str, Callable[[Column, float], Column]] = {
    ">=": lambda c, t: c >= F.lit(t), "<=": lambda c, t: c <= F.lit(t)}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, as the variable of a
    one-element transform (an expression named in a lambda is otherwise
    computed again for each element)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text. Windows
    are sorted by hash, so equal ones are neighbours: n log n per text."""
    def covered(at: Column) -> Column:
        # at: sorted starts of repeated windows; each adds up to three words
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def from_sorted(s: Column) -> Column:
        repeated = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])))
        return covered(F.sort_array(F.transform(repeated, lambda x: x["p"])))

    def from_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.when(F.size(w) >= 4, let(F.sort_array(windows), from_sorted)).otherwise(F.lit(0))

    return let(words, from_words)


def measures(words: Column, text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        # every character that is not a separator belongs to a word
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_bangs": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        "n_stop_words": F.size(F.array_intersect(F.transform(F.slice(words, 1, 1 << 30), F.lower), F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def ratios(get: Callable[[str], Column]) -> dict[str, Column]:
    """The ratios of the measures that ``get`` names."""
    part = F.greatest(get("n_words"), F.lit(1))
    return {
        "repeat_ratio": get("n_repeat_words") / part,
        "symbol_ratio": get("n_symbols") / F.greatest(get("word_chars"), F.lit(1)),
        "bang_ratio": get("n_bangs") / part,
        "mean_word": get("word_chars") / part,
        "dup_line_ratio": get("n_dup_lines") / F.greatest(get("n_lines"), F.lit(1)),
    }


def base_failed(get: Callable[[str], Column]) -> Column:
    return (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the measures, base_failed, the names of the failed rules
    and kept."""
    found = measures(F.col("_words"), F.col("text"))
    failed = F.filter(F.array(*(F.when(~CHECKS[op](F.col(name), t), F.lit(rule)) for rule, name, op, t in rules)),
                      lambda x: x.isNotNull())
    return (docs.withColumn("_words", split_words(F.col("text"))).withColumns(found).drop("_words")
            .withColumns(ratios(F.col))
            .withColumns({"failed_rules": failed, "base_failed": base_failed(F.col)})
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def passes(text: Column, rules=RULES) -> Column:
    """``kept`` as one condition for a filter. Spark writes a filter's columns
    out wherever they are named; here each measure is taken once, as a field of
    a lambda's variable."""
    def judge(m: Column) -> Column:
        get = {**{name: m[name] for name in names}, **ratios(lambda c: m[c])}
        good = [CHECKS[op](get[name], t) for _, name, op, t in rules]
        return reduce(Column.__and__, good, ~base_failed(lambda c: m[c]))

    names = list(measures(F.array(), text))
    return let(split_words(text), lambda w: let(
        F.struct(*(c.alias(name) for name, c in measures(w, text).items())), judge))


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(*OUT)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that no rule rejects, columns unchanged."""
    return docs.where(passes(F.col("text")))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL_MEASURES = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS p, ws FROM w WHERE len(ws) >= 3),
tw AS (SELECT doc_id, p, (ws[p], ws[p + 1], ws[p + 2]) AS g FROM tri),
tc AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tw),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tc WHERE c >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        len(list_intersect(list_distinct(list_transform(ws, lambda x: lower(x))), [{_STOP}]))::BIGINT AS n_stop_words,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
q AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT *, NOT base_failed AND n_words >= 50 AND n_repeat_words / greatest(n_words, 1) <= 0.5
        AND n_symbols / greatest(word_chars, 1) <= 0.06 AND n_bangs / greatest(n_words, 1) <= 0.3
        AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 14
        AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_stop_words >= 2 AS kept FROM q)
"""
SQL = f"WITH {SQL_MEASURES} SELECT {', '.join(OUT)} FROM v"
