"""Fixed word lists and character classes.

Values here must equal the published behaviour for results to match, so they
are stated plainly, in natural order.
"""

from __future__ import annotations


# --- fixed values -----------------------------------------------------------
# English stop words (the classic 179-word list shipped with the common NLP
# toolkits). The reference loads its list at run time, so callers may pass
# their own; this is the default.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Python's string.punctuation (T10 tests a token for being a substring of it).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Labels of the long confusion table and the fixed label map.
CLASS_NAMES = ("ham (0)", "spam (1)")
LABEL_MAP = {"ham": 0, "spam": 1}

# Multi-word contractions the Treebank tokenizer splits in two.
TREEBANK_SPLIT_WORDS = (
    ("cannot", "can not"), ("d'ye", "d 'ye"), ("gimme", "gim me"),
    ("gonna", "gon na"), ("gotta", "got ta"), ("lemme", "lem me"),
    ("more'n", "more 'n"), ("wanna", "wan na"), ("'tis", "'t is"),
    ("'twas", "'t was"),
)
# ---------------------------------------------------------------------------


def _ranges(codepoints):
    """Compress sorted code points into regex class ranges (\\x{..} syntax works
    in both Java regex and RE2, so Spark and the DuckDB oracle share it)."""
    out, start, prev = [], None, None
    for cp in codepoints:
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            out.append((start, prev))
            start = prev = cp
    if start is not None:
        out.append((start, prev))
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"
                   for a, b in out)


def _non_decimal_digits():
    # Rule: characters that are digits but not decimal digits (superscripts,
    # circled and parenthesised digits, ...). Decimal digits are \p{Nd}.
    return [cp for cp in range(0x110000)
            if chr(cp).isdigit() and not chr(cp).isdecimal()]


def _unicode_space():
    # Rule: every character str.split() splits on.
    return [cp for cp in range(0x110000) if chr(cp).isspace()]


DIGIT_CLASS = "[\\p{Nd}" + _ranges(_non_decimal_digits()) + "]"
SPACE_CHARS = _ranges(_unicode_space())
SPACE_CLASS = "[" + SPACE_CHARS + "]"
NON_SPACE_CLASS = "[^" + SPACE_CHARS + "]"
