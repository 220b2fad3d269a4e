import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import metrics as M
from flowlake.operators import scoring as SC
from flowlake.operators import selection as SEL
from flowlake.session import new_folder


@pytest.fixture(scope="module")
def pairs(spark):
    y = ["a"] * 5 + ["b"] * 3 + ["c"] * 2
    p = ["a", "a", "a", "b", "x", "b", "b", "a", "a", "a"]
    return spark.createDataFrame(list(zip(y, p)), "y string, p string").cache()


def test_per_class_and_averages(pairs):
    cm = M.confusion(pairs, "y", "p")
    per = {r["label"]: r for r in M.per_class_metrics(cm).collect()}
    assert set(per) == {"a", "b", "c"}  # x is never true
    assert per["a"]["precision"] == pytest.approx(3 / 6) and per["a"]["recall"] == pytest.approx(3 / 5)
    assert per["c"]["precision"] == 0 and per["c"]["f1"] == 0 and per["c"]["support"] == 2
    s = M.summary_metrics(cm).first()
    assert s["accuracy"] == pytest.approx(0.5) and s["n"] == 10
    # Macro averages run over a, b, c and x.
    assert s["recall_macro"] == pytest.approx((3 / 5 + 2 / 3) / 4)
    assert s["precision_macro"] == pytest.approx((3 / 6 + 2 / 3) / 4)
    assert s["recall_weighted"] == pytest.approx(0.5)
    report = {r["label"]: r for r in M.classification_report(cm).collect()}
    assert report["macro avg"]["recall"] == pytest.approx((3 / 5 + 2 / 3) / 3)
    assert report["accuracy"]["f1"] == pytest.approx(0.5) and report["weighted avg"]["support"] == 10


def test_confusion_matrix(pairs):
    m = M.confusion_matrix(M.confusion(pairs, "y", "p"))
    rows = {r["y"]: r for r in m.collect()}
    assert set(rows) == {"a", "b", "c", "x"} and m.columns == ["y", "pred_a", "pred_b", "pred_c", "pred_x"]
    assert [rows["a"][f"pred_{c}"] for c in "abcx"] == [3, 1, 0, 1]
    assert sum(r[f"pred_{c}"] for r in rows.values() for c in "abcx") == 10


def test_auc_against_pair_counting(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([0.0, 0.5, 1.0, rng.random()])) for _ in range(200)]
    df = spark.createDataFrame(data, "y string, s double")
    got = {r["label"]: r["auc"] for r in
           M.roc_auc_ovr(df, "y", {"a": F.col("s"), "b": 1 - F.col("s"), "z": F.col("s")}).collect()}
    pos = [s for y, s in data if y == "a"]
    neg = [s for y, s in data if y == "b"]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx(want)
    assert got["b"] == pytest.approx(want)


def test_weights(spark, pairs):
    w = {r["y"]: r["weight"] for r in M.class_weights(pairs, "y").collect()}
    assert w["a"] == pytest.approx(10 / 15) and w["c"] == pytest.approx(10 / 6)
    assert M.attach_weights(pairs, "y").agg(F.sum("weight")).first()[0] == pytest.approx(10)


def test_folds(spark):
    s = M.fold_summary(spark.createDataFrame([(0, 0.2), (1, 0.6)], "fold int, score double")).first()
    assert (s["folds"], s["mean"], s["spread"]) == (2, pytest.approx(0.4), pytest.approx(0.4))
    df = spark.createDataFrame([(0, "a", "a"), (0, "b", "a"), (1, "a", "a")], "f int, y string, p string")
    got = {r["f"]: r["score"] for r in M.fold_f1(df, "f", "y", "p").collect()}
    assert got == {0: pytest.approx((2 / 3 + 0) / 2), 1: 1.0}


def table(spark, n=200):
    rng = np.random.RandomState(0)
    base = rng.normal(size=n)
    cols = {"a": base, "b": base * 2 + 1, "c": base + rng.normal(size=n) * 0.01,
            "d": rng.normal(size=n), "flat": np.ones(n), "ECE Flag Count": rng.normal(size=n),
            "Destination Port": rng.normal(size=n), "Fwd Header Length": rng.normal(size=n)}
    rows = [tuple(float(v[i]) for v in cols.values()) + ("x",) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols) + ", Label string")


def test_selector(spark):
    df = table(spark)
    model = SEL.FeatureSelector().fit(df)
    assert model.features == ["a", "d", "Destination Port", "Fwd Header Length"]
    s = model.summary(spark).first()
    assert (s["n_zero_var"], s["n_correlated"], s["n_irrelevant"], s["n_features_out"]) == (1, 2, 1, 4)
    hard = SEL.FeatureSelector(dropPort=True, dropEnv=True).fit(df)
    assert hard.features == ["a", "d"]
    assert hard.transform(df).columns == ["a", "d", "Label"]
    with pytest.raises(ValueError, match="missing"):
        model.transform(df.drop("d"))
    with pytest.raises(RuntimeError):
        SEL.FeatureSelectorModel().features
    path = new_folder(spark, "selector")
    model.write().save(path)
    assert SEL.FeatureSelectorModel.load(path).features == model.features


def test_correlation_edge(spark):
    # r of (1,1,1,1,-1,...) patterns is exact: 0.95 itself must not drop.
    x = [1.0] * 20 + [-1.0] * 20
    y = [1.0] * 19 + [-1.0] + [-1.0] * 20
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    r = SEL.correlation_pairs(df, ["x", "y"]).first()["r"]
    assert SEL.correlated(df, ["x", "y"], r) == [] and SEL.correlated(df, ["x", "y"], r - 1e-9) == ["y"]
    assert SEL.zero_variance(df.withColumn("n", F.lit(None).cast("double")), ["x", "n"]) == ["n"]


def test_scoring_helpers(spark):
    df = spark.createDataFrame([(float("nan"), None, "x", "L")], "a double, b long, `Src IP` string, Label string")
    out = SC.impute_scoring(SC.drop_for_scoring(df))
    assert out.columns == ["a", "b"] and tuple(out.first()) == (0.0, 0)
    with pytest.raises(ValueError, match="zz"):
        SC.align_features(out, ["a", "zz"])
    p = spark.createDataFrame([([0.25, 0.75], 1.0), ([0.5, 0.5], 7.0)], "p array<double>, i double")
    got = SC.prediction_columns(p, "p", [S.BENIGN_GROUP, "DoS"], "i").collect()
    assert got[0]["prediction"] == "DoS" and got[1]["prediction"] == "7"
    assert got[0]["confidence"] == 0.75 and got[0]["probabilities"] == {S.BENIGN_GROUP: 0.25, "DoS": 0.75}
    scored = SC.prediction_columns(p, "p", [S.BENIGN_GROUP, "DoS"])
    assert SC.alerts(scored, min_confidence=0.75).count() == 1
    assert SC.alerts(scored, only_non_benign=True).count() == 1
    wide = SC.probability_columns(p, "p", ["Web Attacks/X", "b"])
    assert wide.columns[-2:] == ["Probability_Web_Attacks_X", "Probability_b"]
    assert SC.prediction_counts(scored).agg(F.sum(name("n"))).first()[0] == 2
