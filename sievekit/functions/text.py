"""Text scalar functions (T1-T19) as native column expressions.

Every function maps Column -> Column and stays inside whole-stage codegen
(regexes, array higher-order functions). Patterns avoid look-around so the
same strings run in Java regex (Spark) and RE2 (the DuckDB oracle);
``sql_replace`` turns a Spark replacement (``$1``) into RE2's (``\\1``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import (DIGIT_CLASS, ENGLISH_STOPWORDS, NON_SPACE_CLASS,
                      SPACE_CHARS, SPACE_CLASS, TREEBANK_SPLIT_WORDS)

WORD_CHAR = "[\\p{L}\\p{N}_]"
NON_WORD_CHAR = "[^\\p{L}\\p{N}_]"
ALNUM_TOKEN = "^[\\p{L}\\p{N}]+$"
# Token, URL and letter patterns of the cleaners.
VECTORIZER_TOKEN = "[\\p{L}\\p{N}_]{2,}"
URL = "http" + NON_SPACE_CLASS + "+"
BROWSER_DROP = "[^a-z" + SPACE_CHARS + "]"   # JS \\s is Unicode whitespace
UPPER_CLASS_SPARK = "\\p{IsUppercase}"   # Java: Lu + Other_Uppercase (Python isupper)
# Digits below U+00B2 are exactly 0-9, so ASCII text takes a cheap range test
# and only other characters are tried against the long Unicode class.
DIGIT_PATTERN_SPARK = "[0-9]|(?=[^\\x{0}-\\x{b1}])" + DIGIT_CLASS
UPPER_CLASS_SQL = "\\p{Lu}"              # RE2 has no Other_Uppercase property


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sql_replace(rep: str) -> str:
    """Spark ``$1`` replacement -> RE2 ``\\1``."""
    return re.sub(r"\$(\d)", r"\\\1", rep)


# -- T1-T4: character counts --------------------------------------------------

def message_length(x) -> Column:
    """Number of code points (Python ``len``)."""
    return F.length(_c(x)).cast("int")


def num_uppercase(x) -> Column:
    """Unicode uppercase characters (Python ``str.isupper`` per char)."""
    return F.regexp_count(_c(x), F.lit(UPPER_CLASS_SPARK)).cast("int")


def num_digits(x) -> Column:
    """Unicode digits incl. superscripts and circled digits (``isdigit``)."""
    return F.regexp_count(_c(x), F.lit(DIGIT_PATTERN_SPARK)).cast("int")


def ascii_upper(x) -> Column:
    """T4 (browser): ``[A-Z]`` count."""
    return F.regexp_count(_c(x), F.lit("[A-Z]")).cast("int")


def ascii_digits(x) -> Column:
    """T4 (browser): ``[0-9]`` count."""
    return F.regexp_count(_c(x), F.lit("[0-9]")).cast("int")


# -- T5-T12: cleaning steps -----------------------------------------------------

def strip_urls(x) -> Column:
    """T5: drop ``http`` followed by non-space characters (case-sensitive)."""
    return F.regexp_replace(_c(x), URL, "")


def letters_only(x) -> Column:
    """Every character that is not an ASCII letter becomes one space."""
    return F.regexp_replace(_c(x), "[^a-zA-Z]", " ")


def lower_text(x) -> Column:
    """T7."""
    return F.lower(_c(x))


def split_tokens(x) -> Column:
    """Whitespace split without empty edge tokens (``str.split()``)."""
    return F.filter(F.split(_c(x), SPACE_CLASS + "+"), lambda t: t != "")


def drop_stopwords(tokens, stopwords: Iterable[str] = ENGLISH_STOPWORDS) -> Column:
    """Drop tokens in the stop list. ``isin`` over >10 literals is turned
    into a hash-set lookup (InSet) by the optimizer."""
    words = sorted(set(stopwords))
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def keep_alnum_tokens(tokens) -> Column:
    """T11 (and T10, which is a no-op after it): fully alphanumeric tokens."""
    return F.filter(_c(tokens), lambda t: t.rlike(ALNUM_TOKEN))


def join_tokens(tokens) -> Column:
    """T12."""
    return F.array_join(_c(tokens), " ")


# -- T13: Treebank-style tokenizer (re-aimed as a regex chain) ----------------------

def _treebank_steps() -> list[tuple[str, str]]:
    ws = SPACE_CLASS
    return [
        # quotes of any kind, brackets and listed symbols, dot runs and double
        # dashes become separate tokens (one pass: the alternatives are disjoint)
        ('(["`«“‘„»”’;@#$%&?!*\\[\\](){}<>]|\\.\\.+|--)', " $1 "),
        # comma / colon unless followed by a digit
        ("([:,])([^\\p{Nd}])", " $1 $2"),
        ("([:,])$", " $1 "),
        # sentence-final period (period before space/end, closers allowed)
        ("([^.])\\.([\\])}>\"']*)(" + ws + "|$)", "$1 . $2$3"),
        # clitics need a following space; the text is space padded first
        ("([^' ])('s|'m|'d|'ll|'re|'ve|n't|')(" + ws + ")", "$1 $2$3"),
    ]


def _split_word_steps() -> list[tuple[str, str]]:
    steps = []
    for word, split in TREEBANK_SPLIT_WORDS:
        pat = "(^|" + NON_WORD_CHAR + ")" + re.escape(word).replace("\\'", "'") \
              + "(" + NON_WORD_CHAR + "|$)"
        steps.append((pat, "$1" + split + "$2"))
        steps.append((pat, "$1" + split + "$2"))   # adjacent repeats
    return steps


TREEBANK_STEPS = _treebank_steps()
SPLIT_WORD_STEPS = _split_word_steps()
# cheap literal pre-check (native substring search): a word's rule only
# runs on texts that contain the word
SPLIT_WORDS = tuple(w for w, _ in TREEBANK_SPLIT_WORDS)


def tokenize_words(x) -> Column:
    """Treebank-style word split; returns ARRAY<STRING>.

    Gap: no trained sentence/abbreviation model, so every period before a
    space counts as sentence-final (``mr.`` is split)."""
    s = F.concat(F.lit(" "), _c(x), F.lit(" "))
    for pat, rep in TREEBANK_STEPS:
        s = F.regexp_replace(s, pat, rep)
    return split_tokens(_let(s, _split_words))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform`` binds it to a lambda variable; without this the optimizer
    would inline the regex chain into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split_words(s: Column) -> Column:
    def split(word, steps):
        return lambda w: F.when(F.contains(w, F.lit(word)), _replaced(w, steps)).otherwise(w)
    for i, word in enumerate(SPLIT_WORDS):
        s = _let(s, split(word, SPLIT_WORD_STEPS[2 * i:2 * i + 2]))
    return s


def _replaced(s: Column, steps) -> Column:
    for pat, rep in steps:
        s = F.regexp_replace(s, pat, rep)
    return s


def tokenize_words_sql(x: str) -> str:
    s = f"(' ' || {x} || ' ')"
    for pat, rep in TREEBANK_STEPS:
        s = f"regexp_replace({s}, '{_sq(pat)}', '{_sq(sql_replace(rep))}', 'g')"
    w = s
    for pat, rep in SPLIT_WORD_STEPS:
        w = f"regexp_replace({w}, '{_sq(pat)}', '{_sq(sql_replace(rep))}', 'g')"
    guard = " OR ".join(f"contains({s}, '{_sq(word)}')" for word in SPLIT_WORDS)
    s = f"CASE WHEN {guard} THEN {w} ELSE {s} END"
    return f"regexp_extract_all({s}, '({_sq(NON_SPACE_CLASS)}+)', 1)"


def _sq(s: str) -> str:
    return s.replace("'", "''")


# -- T15: lemma lookup ----------------------------------------------------------

def lemmatize_tokens(tokens, lemma_map: Column | None) -> Column:
    """T15 column form: ``coalesce(lemma_map[token], token)``; for large
    dictionaries use ``operators.prep.lemmatize_join`` (broadcast/salted join)."""
    if lemma_map is None:
        return _c(tokens)
    return F.transform(_c(tokens), lambda t: F.coalesce(F.try_element_at(lemma_map, t), t))


# -- T16-T19: compositions ------------------------------------------------------------

def notebook_tokens(x, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """T16 before its stemming step: the words that are stemmed over the vocabulary."""
    return drop_stopwords(keep_alnum_tokens(tokenize_words(lower_text(x))), stopwords)


def clean_text_notebook(x, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """T16 without stemming: lower -> tokenize -> alnum -> stopwords -> join
    (``operators.prep.stem_join`` is the stemming step)."""
    return join_tokens(notebook_tokens(x, stopwords))


def package_tokens(x, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """T17 before its lemma step: the words that the lemma table is looked up for."""
    return drop_stopwords(split_tokens(lower_text(letters_only(strip_urls(x)))), stopwords)


def clean_text_package(x, stopwords: Sequence[str] = ENGLISH_STOPWORDS,
                       lemma_map: Column | None = None) -> Column:
    """Strip URLs -> letters only -> lower -> split -> stopwords -> lemma -> join."""
    return join_tokens(lemmatize_tokens(package_tokens(x, stopwords), lemma_map))


def clean_text_browser(x) -> Column:
    """Lower -> strip URLs -> ``[^a-z\\s]`` -> space (whitespace kept as is)."""
    return F.regexp_replace(strip_urls(lower_text(x)), BROWSER_DROP, " ")


def extract_features(df, text_col: str = "original_text"):
    """The three counts on the raw text (always before cleaning)."""
    return df.withColumns({
        "message_length": message_length(text_col),
        "num_uppercase": num_uppercase(text_col),
        "num_digits": num_digits(text_col),
    })


def vectorizer_tokens(x) -> Column:
    """words of two or more word characters, lowercased."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("(" + VECTORIZER_TOKEN + ")"), F.lit(1))
