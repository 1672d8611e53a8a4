"""Explicit schemas. Nothing in the library infers a schema."""

from pyspark.sql import types as T

S, L, I, D, B, TS = (T.StringType(), T.LongType(), T.IntegerType(),
                     T.DoubleType(), T.BooleanType(), T.TimestampType())


def struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Driver tables (read from parquet with these schemas).
DRIVER = {
    "documents": struct(("doc_id", L), ("text", S), ("lang", S), ("source", S),
                        ("n_chars", L)),
    "labels": struct(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": struct(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
    "events": struct(("event_id", L), ("ts", TS), ("user_id", L),
                     ("event_type", S), ("value", D), ("props", S)),
    "part": struct(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                   ("p_size", I), ("p_retailprice", D)),
    "customer": struct(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                       ("c_acctbal", D), ("c_mktsegment", S)),
    "lineitem": struct(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                       ("l_linenumber", I), ("l_quantity", D),
                       ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                       ("l_returnflag", S), ("l_linestatus", S),
                       ("l_shipdate", TS)),
    "orders": struct(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                     ("o_totalprice", D), ("o_orderdate", TS),
                     ("o_orderpriority", S)),
}

# Reference input files.
EMAILS_CSV = struct(("label", S), ("text", S))
SMS_TSV = struct(("v1", S), ("v2", S))

# Canonical message frame (all sources are mapped onto it).
MESSAGES = struct(("message_id", L), ("label", S), ("original_text", S),
                  ("source", S), ("source_rank", I))

# Input contract of the evaluation operators.
PREDICTIONS = struct(("run_id", S), ("model_name", S), ("model_ord", I),
                     ("message_id", L), ("actual", I), ("predicted", I),
                     ("score", D))

MAILBOX = struct(("id", L), ("texto", S), ("esSpam", B))
CORRECTIONS = struct(("texto_anonimizado", S), ("etiqueta_correcta", I),
                     ("estado", S))

EXPERIMENT_RESULTS = struct(
    ("run_id", S), ("model_name", S), ("accuracy", D), ("precision", D),
    ("recall", D), ("f1_score", D), ("auc", D), ("tp", L), ("fp", L), ("tn", L),
    ("fn", L), ("training_time_sec", D), ("inference_time_sec", D),
    ("dataset_version", S), ("date_trained", TS), ("is_best_model", B),
    ("is_production_model", B), ("hyperparameters", S))

CONFUSION_MATRIX = struct(("run_id", S), ("model_name", S), ("actual_class", S),
                          ("predicted_class", S), ("count", L),
                          ("date_trained", TS))
