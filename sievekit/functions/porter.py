"""Porter stemming (Porter 1980, "An algorithm for suffix stripping") as
column expressions, with the common toolkit extensions that the reference's
stemmer applies by default (short words kept, a few irregular forms, ``ies`` /
``ied`` on four-letter words, ``y -> i`` after any non-initial consonant, ``logi``,
``fulli``, ``lessli``, ``bli``).

The rules are a table compiled into ``CASE`` expressions over two columns: the
word, and its mask of consonants and vowels (``c`` / ``v``), in which the measure
of a stem is the number of ``vc``. They run on the distinct words that are found
often (``operators.prep`` joins their stems back) and on the others where they
stand. The expressions use functions that Spark and DuckDB share; only the mask is
written for each of them. Spark tests a step's endings first, so that a word has
its mask made in the few steps that can change it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
         ("lessli", "less"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# ---------------------------------------------------------------------------

_KIND = "CASE WHEN {c} IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN {c} = 'y' AND right({a}, 1) = 'c' THEN 'v' ELSE 'c' END"
# ``y`` is a vowel after a consonant; only in a run of them does one hang on the one before
_BY_LETTER = "aggregate(regexp_extract_all({w}, '(?s).', 0), '', (a, c) -> a || " + _KIND.format(a="a", c="c") + ")"
_PLAIN = "translate(regexp_replace({w}, '[^aeiouy]', 'c'), 'aeiou', 'vvvvv')"
SPARK_MASK = ("CASE WHEN NOT contains({w}, 'y') THEN " + _PLAIN + " WHEN contains({w}, 'yy') THEN " + _BY_LETTER
              + " ELSE replace(replace(regexp_replace(" + _PLAIN + ", '^y', 'c'), 'cy', 'cv'), 'y', 'c') END")
DUCK_MASK = "list_reduce(list_concat([''], regexp_extract_all({w}, '(?s).', 0)), lambda a, c: a || " + _KIND.format(a="a", c="c") + ")"


def _cut(n: int, of: str) -> str:
    return f"left({of}, length({of}) - {n})"


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _vc(mask: str) -> str:
    """Twice the measure of a stem with this mask."""
    return f"(length({mask}) - length(replace({mask}, 'vc', '')))"


def _short_end(word: str, mask: str) -> str:
    """The stem ends consonant, vowel, consonant (not w, x, y), or is vowel, consonant."""
    return f"((right({mask}, 3) = 'cvc' AND right({word}, 1) NOT IN ('w', 'x', 'y')) OR {mask} = 'vc')"


def _case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + " ELSE w END"


def _rewrites(table, least: int) -> list[tuple[str, str]]:
    """The first suffix that fits decides; it is rewritten if the stem's measure is ``least`` or more."""
    return [(_ends(s), f"CASE WHEN {_vc(_cut(len(s), 'm'))} >= {2 * least} THEN {_cut(len(s), 'w')} || '{r}' ELSE w END") for s, r in table]


def _after_1b(n: int) -> str:
    s, p = _cut(n, "w"), _cut(n, "m")
    return (f"CASE WHEN {p} NOT LIKE '%v%' THEN w WHEN right({s}, 2) IN ('at', 'bl', 'iz') THEN {s} || 'e' "
            f"WHEN length({s}) >= 2 AND right({s}, 1) = left(right({s}, 2), 1) AND right({p}, 1) = 'c' AND right({s}, 1) NOT IN ('l', 's', 'z') THEN {_cut(n + 1, 'w')} "
            f"WHEN {_vc(p)} = 2 AND {_short_end(s, p)} THEN {s} || 'e' ELSE {s} END")


def _step4() -> list[tuple[str, str]]:
    rules = []
    for s in sorted(STEP4, key=len, reverse=True):
        more = f" AND right({_cut(3, 'w')}, 1) IN ('s', 't')" if s == "ion" else ""
        rules.append((_ends(s), f"CASE WHEN {_vc(_cut(len(s), 'm'))} >= 4{more} THEN {_cut(len(s), 'w')} ELSE w END"))
    return rules


#: The steps in order: each is an expression of the word ``w`` and its mask ``m``.
STEPS = (
    _case([(f"{_ends('ies')} AND length(w) = 4", f"{_cut(3, 'w')} || 'ie'"), (_ends("sses"), _cut(2, "w")), (_ends("ies"), _cut(2, "w")), (_ends("ss"), "w"), (_ends("s"), _cut(1, "w"))]),
    _case([(f"{_ends('ied')} AND length(w) = 4", f"{_cut(3, 'w')} || 'ie'"), (_ends("eed"), f"CASE WHEN {_vc(_cut(3, 'm'))} > 0 THEN {_cut(1, 'w')} ELSE w END"),
           (_ends("ed"), _after_1b(2)), (_ends("ing"), _after_1b(3))]),
    _case([(f"{_ends('y')} AND length(w) > 2 AND left(right(m, 2), 1) = 'c'", f"{_cut(1, 'w')} || 'i'")]),
    _case([(f"{_ends('alli')} AND {_vc(_cut(4, 'm'))} > 0", f"{_cut(4, 'w')} || 'al'")]),
    _case([(f"{_ends('logi')} AND {_vc(_cut(3, 'm'))} > 0", _cut(1, "w")), *_rewrites(STEP2, 1)]),
    _case(_rewrites(STEP3, 1)),
    _case(_step4()),
    _case([(f"{_ends('e')} AND ({_vc(_cut(1, 'm'))} > 2 OR ({_vc(_cut(1, 'm'))} = 2 AND NOT {_short_end(_cut(1, 'w'), _cut(1, 'm'))}))", _cut(1, "w"))]),
    _case([(f"{_ends('ll')} AND {_vc(_cut(1, 'm'))} > 2", _cut(1, "w"))]),
)
#: The endings that a word needs for each step to change it.
STEP_ENDS = (("s",), ("ed", "ing"), ("y",), ("alli",), ("logi", *(s for s, _ in STEP2)), tuple(s for s, _ in STEP3), STEP4, ("e",), ("ll",))
#: The word's own rule: irregular forms, and words of one or two letters.
FINAL = "CASE " + " ".join(f"WHEN tok = '{k}' THEN '{v}'" for k, v in IRREGULAR.items()) + " WHEN length(tok) <= 2 THEN tok ELSE w END"


def _let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` bound to the value, computed once (columns built on
    each other would be written out in each other by the optimizer)."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _has_end(name: str, ends) -> str:
    return f"{name} RLIKE '(?:{'|'.join(ends)})$'"


def may_change(col: str):
    """False for words that no rule changes, by their length and last letter
    (that of an ending of the steps; the irregular forms have one each)."""
    last = {e[-1] for step in STEP_ENDS for e in step} | {w[-1] for w in IRREGULAR}
    return (F.length(col) > 2) & F.right(F.col(col), F.lit(1)).isin(sorted(last))


def stem_of(col: str):
    """The stem of a lower-case word."""
    value = "tok"
    for step, ends in zip(STEPS, STEP_ENDS):
        value = _let("w", value, f"CASE WHEN {_has_end('w', ends)} THEN {_let('m', SPARK_MASK.format(w='w'), step)} ELSE w END")
    return F.expr(_let("tok", f"`{col}`", _let("w", value, FINAL)))


def stem_words(words: DataFrame, col: str = "tok", out: str = "stem") -> DataFrame:
    """``words`` (one row per distinct lower-case word) with its stem."""
    return words.withColumn(out, stem_of(col))


def stem_ctes(source: str, name: str = "stems") -> str:
    """DuckDB CTEs: ``name`` (tok, stem) of the distinct words of ``source`` (tok)."""
    out, last = [], f"(SELECT tok, tok AS w FROM {source})"
    for i, step in enumerate(STEPS):
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT tok, {step} AS w FROM (SELECT tok, w, {DUCK_MASK.format(w='w')} AS m FROM {last}))")
        last = f"{name}_{i}"
    out.append(f"{name} AS (SELECT tok, {FINAL} AS stem FROM {last})")
    return ",\n".join(out)
