"""A table of hard cases, and brute-force helpers."""

import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, kept string, n_words string, "
          "label string, score string, id string, row string, x string, h string, full string, rest string")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    base = " ".join(f"word{i} other{i * 7 % 13} the of" for i in range(60))
    shared = "a passage that some of the documents share word for word " * 5
    long_ = " ".join(f"tok{i}" for i in range(30_000))
    texts = [None, "", "   \n\t", "one two three", "One TWO three", base, base, base + " extra tail", base.replace("word30", "changed"),
             long_, long_ + " end", shared + "x y z", "front " + shared, "a b c d e f g h " * 40, "Übergrößen été ﬁn Ⅰ 🙂 中文",
             "shared line here\nown line one\nshared line here\nSHARED LINE HERE  ", "shared line here\r\nsecond own", "tiny\ntiny", "q" * 450, "q" * 200, "12345 !!! ###"]
    out = [(i, t, ("en", None, "fr")[i % 3], (None, "s1", "s2", "s3")[i % 4], None if i % 5 == 0 else 1) for i, t in enumerate(texts)]
    out += [out[5], (None, base, None, None, None), (None, "null id text", "en", "s1", 3), (2, "second text of two", "en", "s2", 1)]
    return [r + ("c",) * 11 for r in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text, lower=True):
    t = text or ""
    return WORD.findall(t.translate(LOWER) if lower else t)


def shingles(w, n=5):
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
