"""Published outputs of the reference as goldens for the evaluation,
selection and report operators (E1-E12, E15, E18, S10)."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import evaluate as E
from sievekit.operators import experiments as X

MODELS = ["Logistic Regression", "Naive Bayes", "Support Vector Machine", "Random Forest"]

# Published experiment table (run, model, accuracy, precision, recall, f1, auc,
# tp, fp, tn, fn, is_best_model, is_production_model).
# The published result rows, means and log.
PUBLISHED = [
    ("run_01_seed42", "Logistic Regression", 0.94995, 0.856305, 0.996587, 0.921136, 0.996224, 292, 49, 657, 1, False, False),
    ("run_01_seed42", "Naive Bayes", 0.91992, 0.986301, 0.737201, 0.84375, 0.995548, 216, 3, 703, 77, True, True),
    ("run_01_seed42", "Support Vector Machine", 0.983984, 0.954098, 0.993174, 0.973244, 0.997665, 291, 14, 692, 2, False, False),
    ("run_01_seed42", "Random Forest", 0.963964, 0.924092, 0.955631, 0.939597, 0.995236, 280, 23, 683, 13, False, False),
    ("run_02_seed7", "Logistic Regression", 0.960961, 0.887195, 0.993174, 0.937198, 0.995707, 291, 37, 669, 2, False, False),
    ("run_02_seed7", "Naive Bayes", 0.930931, 0.986957, 0.774744, 0.868069, 0.996099, 227, 3, 703, 66, True, True),
    ("run_02_seed7", "Support Vector Machine", 0.977978, 0.941368, 0.986348, 0.963333, 0.996389, 289, 18, 688, 4, False, False),
    ("run_02_seed7", "Random Forest", 0.970971, 0.942953, 0.959044, 0.950931, 0.994192, 281, 17, 689, 12, False, False),
    ("run_03_seed13", "Logistic Regression", 0.962963, 0.892638, 0.993174, 0.940226, 0.996553, 291, 35, 671, 2, False, False),
    ("run_03_seed13", "Naive Bayes", 0.916917, 0.995283, 0.720137, 0.835644, 0.99666, 211, 1, 705, 82, True, True),
    ("run_03_seed13", "Support Vector Machine", 0.980981, 0.947712, 0.989761, 0.96828, 0.99707, 290, 16, 690, 3, False, False),
    ("run_03_seed13", "Random Forest", 0.963964, 0.935593, 0.94198, 0.938776, 0.994547, 276, 19, 687, 17, False, False),
    ("run_04_seed99", "Logistic Regression", 0.962963, 0.890244, 0.996587, 0.940419, 0.998323, 292, 36, 670, 1, False, False),
    ("run_04_seed99", "Naive Bayes", 0.901902, 0.994924, 0.668942, 0.8, 0.997477, 196, 1, 705, 97, True, True),
    ("run_04_seed99", "Support Vector Machine", 0.987988, 0.973064, 0.986348, 0.979661, 0.998874, 289, 8, 698, 4, False, False),
    ("run_04_seed99", "Random Forest", 0.974975, 0.952703, 0.962457, 0.957555, 0.995971, 282, 14, 692, 11, False, False),
    ("run_05_seed2024", "Logistic Regression", 0.96997, 0.907121, 1.0, 0.951299, 0.998414, 293, 30, 676, 0, False, False),
    ("run_05_seed2024", "Naive Bayes", 0.898899, 1.0, 0.65529, 0.791753, 0.997612, 192, 0, 706, 101, True, True),
    ("run_05_seed2024", "Support Vector Machine", 0.986987, 0.966667, 0.989761, 0.978078, 0.998675, 290, 10, 696, 3, False, False),
    ("run_05_seed2024", "Random Forest", 0.967968, 0.957895, 0.931741, 0.944637, 0.996548, 273, 12, 694, 20, False, False),
]

# Published means (4 decimals): accuracy, precision, recall, f1, auc.
MEANS = {
    "Logistic Regression": (0.9614, 0.8867, 0.9959, 0.9381, 0.9970),
    "Naive Bayes": (0.9137, 0.9927, 0.7113, 0.8278, 0.9967),
    "Support Vector Machine": (0.9836, 0.9566, 0.9891, 0.9725, 0.9977),
    "Random Forest": (0.9684, 0.9426, 0.9502, 0.9463, 0.9953),
}

# Published evaluation log (phase 4, seed 42).
METRICS_LOG = """--- Model Evaluation Log ---

Model: LogisticRegression
Precision: 0.8563 | Recall: 0.9966
Confusion Matrix:
[[657  49]
 [  1 292]]

Model: NaiveBayes
Precision: 0.9863 | Recall: 0.7372
Confusion Matrix:
[[703   3]
 [ 77 216]]

Model: SVM
Precision: 0.9541 | Recall: 0.9932
Confusion Matrix:
[[692  14]
 [  2 291]]

Model: RandomForest
Precision: 0.9241 | Recall: 0.9556
Confusion Matrix:
[[683  23]
 [ 13 280]]

"""


@pytest.fixture(scope="module")
def pred(spark):
    """Prediction rows rebuilt from the published confusion counts."""
    rows = []
    for run, model, *_m, tp, fp, tn, fn, _b, _p in PUBLISHED:
        for a, p, n in ((1, 1, tp), (0, 1, fp), (0, 0, tn), (1, 0, fn)):
            rows.append((run, model, MODELS.index(model), a, p, n))
    df = spark.createDataFrame(rows, "run_id string, model_name string, model_ord int, "
                                     "actual int, predicted int, n int")
    return (df.where("n > 0")   # sequence(1, 0) would count down
              .select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
              .select("run_id", "model_name", "model_ord",
                      F.monotonically_increasing_id().alias("message_id"), "actual", "predicted",
                      F.col("predicted").cast("double").alias("score")))


def test_metrics_follow_from_counts(pred):
    got = {(r.run_id, r.model_name): r for r in E.metrics(pred).collect()}
    for run, model, acc, prec, rec, f1, _auc, tp, fp, tn, fn, _b, _p in PUBLISHED:
        r = got[(run, model)]
        assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn)
        assert abs(r.accuracy - acc) < 1e-6 and abs(r.precision - prec) < 1e-6
        assert abs(r.recall - rec) < 1e-6 and abs(r.f1_score - f1) < 1e-6


def test_confusion_long_has_80_rows(pred):
    cl = E.confusion_long(E.confusion_counts(pred))
    assert cl.count() == 80
    assert cl.agg(F.sum("count")).first()[0] == 19980


def test_selection_reproduces_best_and_production_flags(pred):
    scored = E.confusion_counts(pred).withColumn("sel_score", E.selection_score(6))
    flagged = E.production_flag(E.best_in_run(scored, -999.0))
    got = {(r.run_id, r.model_name): (r.is_best_model, r.is_production_model)
           for r in flagged.collect()}
    for run, model, *_m, best, prod in PUBLISHED:
        assert got[(run, model)] == (best, prod)


def test_floor_minus_one_can_leave_no_winner(spark):
    df = spark.createDataFrame([("r", "a", 0, -2.0), ("r", "b", 1, -1.5)],
                               "run_id string, model_name string, model_ord int, sel_score double")
    assert E.best_in_run(df, -1.0).where("is_best_model").count() == 0


def test_best_by_f1_picks_svm_everywhere(pred):
    best = E.best_by_f1(E.metrics(pred)).collect()
    assert {r.model_name for r in best} == {"Support Vector Machine"}


def test_mean_by_model_matches_published(spark):
    res = spark.createDataFrame([(r[1], r[2], r[3], r[4], r[5], r[6]) for r in PUBLISHED],
                                "model_name string, accuracy double, precision double, "
                                "recall double, f1_score double, auc double")
    got = {r.model_name: r for r in X.mean_by_model(res).collect()}
    for model, vals in MEANS.items():
        r = got[model]
        for a, b in zip((r.accuracy, r.precision, r.recall, r.f1_score, r.auc), vals):
            assert abs(a - b) < 1e-9


def test_metrics_log_matches_published(spark, pred, scratch):
    from sievekit.plans.registry import _metrics_log_spark
    from sievekit.sources.files import write_metrics_log
    names = {"Logistic Regression": "LogisticRegression", "Naive Bayes": "NaiveBayes",
             "Support Vector Machine": "SVM", "Random Forest": "RandomForest"}
    p = pred.replace(names, subset=["model_name"])
    entries = _metrics_log_spark(p)
    text = "".join(r.entry for r in entries.orderBy("model_ord").collect())
    assert "--- Model Evaluation Log ---\n\n" + text == METRICS_LOG
    write_metrics_log(entries, scratch + "/log")
    written = spark.read.option("lineSep", "\n").text(scratch + "/log").collect()
    assert written[0].value == "--- Model Evaluation Log ---"


def test_classification_report_rows(pred):
    rep = E.classification_report(pred).where("run_id = 'run_01_seed42' AND model_name = 'Naive Bayes'")
    rows = {r.report_row: r for r in rep.collect()}
    assert rows["1"].support == 293 and rows["0"].support == 706
    assert abs(rows["1"].precision - 0.986301) < 1e-6
    assert abs(rows["accuracy"].f1_score - 0.91992) < 1e-5


def test_auc_exact_with_ties(spark):
    # scores with ties across classes: AUC = (pairs won + 0.5 ties) / (P*N)
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1), (0, 0.0)]
    df = spark.createDataFrame([("r", "m", 0, i, a, float(s)) for i, (a, s) in enumerate(rows)],
                               "run_id string, model_name string, model_ord int, message_id long, "
                               "actual int, score double")
    # positives 0.9 (beats 3 neg), 0.5 (beats 2, ties 1), 0.1 (beats 1, ties 1) -> (3+2.5+1.5)/9
    assert abs(E.roc_auc(df).first().auc - round(7 / 9, 6)) < 1e-9


def test_auc_null_when_one_class(spark):
    df = spark.createDataFrame([("r", "m", 0, 1, 1, 0.3)],
                               "run_id string, model_name string, model_ord int, message_id long, "
                               "actual int, score double")
    assert E.roc_auc(df).first().auc is None


def test_hyperparams_json_and_wide(spark):
    js = X.hyperparams_json({"C": 1.0, "class_weight": "balanced", "n_jobs": None, "dual": False})
    assert js == '{"C": "1.0", "class_weight": "balanced", "n_jobs": "None", "dual": "False"}'
    df = spark.createDataFrame([("r1", "LR", js), ("r1", "NB", '{"alpha": "1.0"}')],
                               "run_id string, model_name string, hyperparameters string")
    wide = {r.model_name: r for r in X.hyperparams_wide(df, ["C", "alpha", "n_jobs"]).collect()}
    assert wide["LR"].hp_C == "1.0" and wide["LR"].hp_alpha is None
    assert wide["LR"].hp_n_jobs == "None"        # the text None is a value, not a null
    assert wide["NB"].hp_alpha == "1.0" and wide["NB"].hp_C is None
