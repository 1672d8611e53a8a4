"""Golden literals for the text functions."""

from pyspark.sql import functions as F

from sievekit.functions import text as T
from sievekit.functions.porter import stem_words
from sievekit.plans.messages import cleaned
from tests.conftest import SF_SMALL
from tests.porter_plain import stem_word
from sievekit.operators import prep as P
from sievekit.sources import files as FI

PROBE = "Ab\U0001F600É²9Ⅰǅİ٣"


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr(F.col("x")).alias("y")).first().y


def test_counts_on_probe_string(spark):
    assert one(spark, PROBE, T.message_length) == 10       # code points, not UTF-16 units
    assert one(spark, PROBE, T.num_uppercase) == 4         # A, É, Ⅰ, İ (str.isupper)
    assert one(spark, PROBE, T.num_digits) == 3            # ², 9, ٣ (str.isdigit)
    assert one(spark, PROBE, T.ascii_upper) == 1
    assert one(spark, PROBE, T.ascii_digits) == 1


def test_counts_match_python_on_every_char_class(spark):
    chars = "aA1²①⑴⒈❶➀٣߀ÉéǅⅠⅰⒶ ½"
    for c in chars:
        assert one(spark, c, T.num_digits) == int(c.isdigit()), c
        assert one(spark, c, T.num_uppercase) == int(c.isupper()), c


def test_empty_and_null(spark):
    assert one(spark, "", T.message_length) == 0
    assert one(spark, None, T.message_length) is None
    assert one(spark, "", T.clean_text_browser) == ""


def test_url_case_sensitivity(spark):
    # package: URLs stripped before lowering, so HTTP:// survives as letters
    assert one(spark, "HTTP://x y", T.clean_text_package) == "http x"
    assert one(spark, "http://x y", T.clean_text_package) == ""
    # browser: lowered first, so both forms are stripped
    assert one(spark, "HTTP://x y", T.clean_text_browser) == " y"
    assert one(spark, "see http://a.b/c?d=1 now", T.strip_urls) == "see  now"


def test_url_stops_at_unicode_space(spark):
    assert one(spark, "http://a b", T.strip_urls) == " b"


def test_split_tokens_has_no_empty_edges(spark):
    assert one(spark, "  a  b ", T.split_tokens) == ["a", "b"]
    assert one(spark, "", T.split_tokens) == []


def test_package_cleaner(spark):
    assert one(spark, "I'm NOT going to the 2 parties!!", T.clean_text_package) == "going parties"


def test_tokenizer_and_notebook_cleaner(spark):
    toks = one(spark, "hello, world! don't stop. e-mail me: now", T.tokenize_words)
    assert toks == ["hello", ",", "world", "!", "do", "n't", "stop", ".", "e-mail", "me", ":", "now"]
    assert one(spark, "Cannot STOP gonna win 3.5 prizes.",
               T.clean_text_notebook) == "stop gon na win prizes"
    df = spark.createDataFrame([(1, "Winning prizes, running fast!"), (2, None), (3, "the"), (4, "Running running")], "message_id long, original_text string")
    got = {r.message_id: r.clean_text for r in cleaned(df, "notebook").collect()}
    assert got == {1: "win prize run fast", 2: "", 3: "", 4: "run run"}


def _stems(spark, words):
    return {r.tok: r.stem for r in stem_words(spark.createDataFrame([(w,) for w in sorted(set(words))], "tok string")).collect()}


def test_porter_paper_examples(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file",
             "relational": "relat", "generalizations": "gener", "electrical": "electr",
             "adoption": "adopt", "controll": "control", "happy": "happi", "sky": "sky"}
    assert _stems(spark, pairs) == pairs


def test_stems_equal_the_plain_stemmer(spark):
    """Every rule's suffix on many beginnings, random words, and the corpus."""
    import random
    from tests.porter_plain import STEP2, STEP3, STEP4, IRREGULAR
    random.seed(11)
    ends = [s for s, _ in STEP2 + STEP3] + list(STEP4) + ["s", "sses", "ies", "ied", "eed", "ed", "ing", "y", "e", "ll", "logi", "alli", "ationalli", "yy", "ys"]
    words = {b + e for e in ends for b in ("", "a", "b", "tr", "y", "by", "yy", "hop", "hopp", "fall", "fizz", "rat", "tabl", "siz", "s", "roy", "ax", "generat", "über", "é", "1", "b2")}
    words |= {"".join(random.choice("aeiouybcdlstz") for _ in range(random.randint(1, 9))) + random.choice(ends) for _ in range(3000)} | set(IRREGULAR)
    words |= {w for r in spark.read.parquet(SF_SMALL + "/documents.parquet").select("text").collect() for w in (r.text or "").lower().split() if w.isalnum()}
    words.discard("")
    assert _stems(spark, words) == {w: stem_word(w) for w in words}


def test_stems_of_frequent_words_are_broadcast_and_rare_ones_made_in_place(spark):
    rows = [(1, ["running", "prizes", "the", "happy"]), (2, ["running", "skies", "prizes"]), (3, ["running", "boyyying", "x1"]), (4, [])]
    df = spark.createDataFrame(rows, "message_id long, tokens array<string>")
    table = {r.form: r.lemma for r in P.stem_table(df, "tokens", most=2).collect()}
    assert table == {"running": "run", "prizes": "prize"}
    want = {i: [stem_word(t) for t in ts] for i, ts in rows}
    for most in (0, 2, 100):
        out = P.stem_join(df, "tokens", most=most)
        assert {r.message_id: r.tokens for r in out.collect()} == want
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [form" in plan and "SortMergeJoin [form" not in plan   # tokens are not shuffled by word


def test_split_words_of_one_text(spark):
    assert one(spark, "I cannot, cannot go; gonna 'tis wannabe gotta more'n", T.tokenize_words) == [
        "I", "can", "not", ",", "can", "not", "go", ";", "gon", "na", "'t", "is", "wannabe", "got", "ta", "more", "'n"]


def test_vectorizer_tokens(spark):
    assert one(spark, "A bc DEF_1 é x9", T.vectorizer_tokens) == ["bc", "def_1", "x9"]


def test_label_map_is_case_sensitive(spark):
    df = spark.createDataFrame([("ham",), ("spam",), ("Ham",), (None,)], "label string")
    got = [r.c for r in df.select(P.map_label_fixed("label").alias("c")).collect()]
    assert got == [0, 1, None, None]


def test_message_lines(spark):
    text = ' texto \r\n"hello"\n\nV2\n"v2"\n  a "b" \n"'
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = [(r.line_no, r.texto) for r in FI.message_lines(df, "text", ["k"]).collect()]
    # blank/header test runs before the quote strip: a lone quote gives an empty message
    assert got == [(1, "hello"), (4, "v2"), (5, 'a "b'), (6, "")]


def test_dedup_keeps_first_and_full_row_keeps_both_labels(spark):
    rows = [(1, "spam", "same", "email", 0), (2, "ham", "same", "email", 0),
            (0, "ham", "same", "sms", 1), (3, "ham", "other", "email", 0)]
    df = spark.createDataFrame(rows, "message_id long, label string, original_text string, "
                                     "source string, source_rank int")
    first = {r.original_text: r for r in P.dedup_text_keep_first(df).collect()}
    assert first["same"].message_id == 1 and first["same"].label == "spam"
    full = P.dedup_full_row(df.select("label", "original_text"))
    assert full.where("original_text = 'same'").count() == 2
