import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import metrics as M
from flowlake.operators import modeling as MD
from flowlake.operators import splits, tuning
from flowlake.plans import train_job as J
from flowlake.session import new_folder
from tests.conftest import plan_of

SMALL = {"max_depth": 2, "n_estimators": 2, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def flows(spark):
    """Three classes told apart by two features; six files over two data sets."""
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    v = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0
    df = spark.range(600).select(
        u.alias("Idle Min"), v.alias("Active Max"), (u * 2).alias("twin"),
        (F.col("id") % 7).cast("double").alias("Destination Port"), F.lit(1.0).alias("flat"),
        F.when(u > 0.6, "DoS").when(v > 0.7, "Bot").otherwise("Normal Traffic").alias("Attack Type"),
        F.concat(F.lit("f"), F.col("id") % 6).alias("Source_File"),
        F.when(F.col("id") % 6 < 3, "2017").otherwise("2018").alias("Dataset"),
        F.col("id").alias(S.ROW_ORD))
    return df.cache()


def test_parameter_names(spark):
    rf = MD.build_model("forest", 3, {"colsample_bytree": 0.5, "reg_alpha": 1})
    assert rf.getNumTrees() == 200 and rf.getMaxDepth() == 30
    assert rf.getFeatureSubsetStrategy() == "0.5"
    two = MD.build_model("boosted", 2, MD.HARDENED)
    assert (two.getMaxDepth(), two.getMaxIter(), two.getStepSize()) == (4, 300, 0.05)
    assert (two.getSubsamplingRate(), two.getMinInstancesPerNode()) == (0.8, 10)
    assert MD.build_model("boosted", 3).getClassifier().getMaxIter() == 100
    with pytest.raises(ValueError):
        MD.build_model("other", 3)
    with pytest.raises(ValueError):
        MD.build_model("forest", 3, {"leaves": 1})


def test_boosted_classes(spark, flows):
    rows = M.attach_weights(flows, "Attack Type", MD.WEIGHT)
    clf = MD.fit_classifier(rows, ["Idle Min", "Active Max"], "Attack Type", "boosted", SMALL)
    assert clf.labels == ["Bot", "DoS", "Normal Traffic"]
    scored = clf.score(flows)
    assert scored.where(F.abs(F.aggregate(MD.PROBABILITIES, F.lit(0.0), lambda a, x: a + x) - 1)
                        > 1e-9).count() == 0
    assert scored.where(F.col("prediction") == F.col("Attack Type")).count() > 560
    folder = new_folder(spark, "model")
    clf.save(folder)
    again = MD.Classifier.load(spark, folder)
    assert again.labels == clf.labels and again.features == clf.features
    assert again.score(flows).select(S.ROW_ORD, "prediction").exceptAll(
        scored.select(S.ROW_ORD, "prediction")).count() == 0
    top = MD.feature_importance(clf).collect()
    assert sum(r["importance"] for r in top) == pytest.approx(1, abs=1e-6)
    effect = {(r["feature"], r["class"]): r["effect"] for r in MD.attribution(
        clf, flows.withColumn("noise", F.lit(0.0)), [S.ROW_ORD], n=100).collect()}
    assert len(effect) == 6 and effect[("Idle Min", "DoS")] > effect[("Active Max", "DoS")]
    with pytest.raises(ValueError, match="Active Max"):
        clf.score(flows.drop("Active Max"))
    table = J.score_table(clf, flows.withColumnRenamed("Idle Min", " Idle Min"))
    assert table.columns[0] == " Idle Min"
    assert table.columns[-4:] == ["Prediction", "Probability_Bot", "Probability_DoS",
                                  "Probability_Normal_Traffic"]


def test_one_versus_rest_is_scored_by_generated_code(flows):
    """The same classes and probabilities as from the model's own columns, without a lambda for each row."""
    clf = MD.fit_classifier(flows, ["Idle Min", "Active Max"], "Attack Type", "boosted", SMALL, weighted=False)
    rows = MD.assemble(flows, clf.features)
    out = MD.with_probabilities(clf.model, rows)
    assert out.columns == [*rows.columns, "prediction_index", MD.PROBABILITIES]
    raw = vector_to_array("rawPrediction")
    each = F.transform(raw, lambda r: 1.0 / (1.0 + F.exp(-2.0 * r)))
    whole = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    want = clf.model.transform(rows).select(S.ROW_ORD, "prediction", F.transform(each, lambda p: p / whole))
    assert out.select(S.ROW_ORD, "prediction_index", MD.PROBABILITIES).exceptAll(want).count() == 0 and out.count() == 600
    assert "lambda" not in plan_of(out) and "lambda" in plan_of(want)


def test_attribution_keeps_a_variant_in_one_row(flows):
    clf = MD.fit_classifier(flows, ["Idle Min", "Active Max"], "Attack Type", "boosted", SMALL, weighted=False)
    out = MD.attribution(clf, flows, [S.ROW_ORD], n=100)
    assert "lambda" not in plan_of(out)
    assert {(r["feature"], r["class"]) for r in out.collect()} == {(f, c) for f in clf.features for c in clf.labels}
    assert MD.attribution(clf, flows.limit(0), [S.ROW_ORD], n=100).count() == 0


def test_unseen_classes_do_not_count(flows):
    train = flows.where(F.col("Attack Type") != "Bot")
    clf = MD.fit_classifier(train, ["Idle Min"], "Attack Type", "forest",
                            {"max_depth": 2, "n_estimators": 2}, weighted=False)
    rows = MD.evaluate_rows(clf, flows, "Attack Type")
    assert rows.where("y = 'Bot'").count() == 0 and rows.count() == train.count()
    assert MD.unseen_labels(train, flows, "Attack Type").collect()[0]["Attack Type"] == "Bot"


def test_sample_is_stable(flows):
    a = MD.sample_rows(flows, 50, [S.ROW_ORD]).select(S.ROW_ORD).collect()
    b = MD.sample_rows(flows.repartition(7), 50, [S.ROW_ORD]).select(S.ROW_ORD).collect()
    assert sorted(a) == sorted(b) and len(set(a)) == 50


def test_draws():
    tries = tuning.draws(tuning.LISTED_SPACE, 30)
    assert tries == tuning.draws(tuning.LISTED_SPACE, 30) and len(tries) == 30
    assert all(t["max_depth"] in range(3, 9) for t in tries)
    for t in tuning.draws(tuning.RANGED_SPACE, 50):
        assert 3 <= t["max_depth"] <= 10 and t["n_estimators"] % 50 == 0
        assert 0.01 <= t["learning_rate"] <= 0.3 and 1e-3 <= t["gamma"] <= 5


def test_cross_validation_reencodes(flows):
    folded = splits.group_folds(flows, k=3)
    # One class lives in a single fold: it is unknown to the model that validates there.
    lone = folded.withColumn("Attack Type", F.when(
        (F.col("fold") == 0) & (name("Attack Type") == "Bot"), "Only").otherwise(name("Attack Type")))
    scores = tuning.cross_validate(lone, ["Idle Min", "Active Max"], "Attack Type", "fold", "forest",
                                   {"max_depth": 4, "n_estimators": 4}, weighted=False)
    assert [f for f, _ in scores] == [0, 1, 2] and all(0 < s <= 1 for _, s in scores)


def test_training_run(spark, flows):
    cfg = J.TrainConfig(kind="forest", strategy="file", params={"max_depth": 4, "n_estimators": 4},
                        folds=2)
    folder = new_folder(spark, "run")
    out = J.run(spark, flows, cfg, folder, "memory")
    assert out.classifier.features == ["Idle Min", "Active Max", "Destination Port"]
    assert out.metrics["f1_macro"] > 0.8 and out.metrics["roc_auc_macro"] > 0.9
    assert out.n_train + out.n_test == 600 and len(out.cv_scores) == 2
    record = spark.read.json(f"{folder}/experiments").first()
    assert record["split_strategy"] == "file" and len(record["dataset_hash"]) == 16
    assert record["feature_selection"]["correlated_cols"] == ["twin"]
    assert spark.read.csv(f"{folder}/feature_importance", header=True).count() == 3


def test_training_rows_are_cached_for_several_fits_only(flows, monkeypatch):
    """One fit stores its own vectors; a second store of the same rows only takes memory."""
    stored, persist = [], type(flows).persist
    monkeypatch.setattr(type(flows), "persist", lambda df, *level: stored.append(df.columns) or persist(df, *level))
    for cv in (False, True):
        stored.clear()
        out = J.train_model(flows, J.TrainConfig(kind="forest", strategy="file", params={"max_depth": 2, "n_estimators": 2}, folds=2, cv=cv))
        assert any("fold" in c for c in stored) is cv
        assert out.n_train == 500 and out.n_test == 100 and len(out.cv_scores) == 2 * cv


def test_listed_search_and_bad_mixes(spark, flows, monkeypatch):
    monkeypatch.setitem(tuning.LISTED_SPACE, "n_estimators", [2])
    monkeypatch.setitem(tuning.LISTED_SPACE, "max_depth", [2])
    binary = flows.withColumn("Attack Type", F.when(name("Attack Type") == "DoS", "DoS").otherwise("rest"))
    out = J.train_model(binary, J.TrainConfig(strategy="random", tune="listed", draws=1, cv=False))
    assert out.params["n_estimators"] == 2 and out.classifier.labels == ["DoS", "rest"]
    for bad in (J.TrainConfig(kind="forest", tune="listed"), J.TrainConfig(hardened=True, tune="ranged"),
                J.TrainConfig(kind="forest", hardened=True),
                J.TrainConfig(tune="tpe")):
        with pytest.raises(ValueError):
            J.train_model(binary, bad)


def test_fingerprint(flows):
    a = J.fingerprint(flows).first()
    assert a == J.fingerprint(flows.repartition(5)).first()
    assert a != J.fingerprint(flows.unionByName(flows.limit(1))).first()
    assert a != J.fingerprint(flows.withColumn("flat", F.lit(2.0))).first()


def test_halving(spark, flows, monkeypatch):
    """Scores come from a rule, so that rounds and survivors can be told in advance."""
    seen = []

    def scores(rows, features, label, fold, kind, params, weighted):
        seen.append((params["id"], params["n_estimators"]))
        return [(0, params["q"]), (1, params["q"] + 0.1)]

    monkeypatch.setattr(tuning, "cross_validate", scores)
    assert tuning.rungs(100, 25) == [25, 50, 100] and tuning.rungs(10, 25) == [10] and tuning.rungs(70, 30) == [30, 60, 70]
    tries = [{"id": i, "q": q, "n_estimators": n} for i, (q, n) in enumerate(((0.1, 200), (0.7, 30), (0.5, 400), (0.7, 300), (0.2, 50)))]
    out = tuning.halving(flows, [], "Attack Type", tries, first=25)
    assert [(p["q"], p["n_estimators"], n) for p, n, _ in out] == [
        (0.7, 30, 30), (0.7, 300, 100), (0.5, 400, 50), (0.2, 50, 25), (0.1, 200, 25)]
    assert [s for _, _, s in out] == pytest.approx([0.75, 0.75, 0.55, 0.25, 0.15])
    assert sorted(seen) == [(0, 25), (1, 25), (1, 30), (2, 25), (2, 50), (3, 25), (3, 50), (3, 100), (4, 25)]  # no step runs twice
    one = tuning.halving(flows, [], "Attack Type", tries[2:3], first=25)
    assert [(n, round(s, 2)) for _, n, s in one] == [(400, 0.55)]
    assert tuning.halving(flows, [], "Attack Type", []) == []
    with pytest.raises(ValueError):
        tuning.rungs(10, 0)


def test_scores_after_rows_were_observed(spark):
    """Once a session has observed rows it cannot travel with tasks, so a model must not hold it."""
    rows = spark.range(400).selectExpr("cast(id % 7 as double) as x", "if(id % 7 > 3, 'DoS', 'Bot') as l")
    assert rows.observe(Observation(), F.count("*").alias("n")).count() == 400
    clf = MD.fit_classifier(rows, ["x"], "l", "forest", {"max_depth": 2, "n_estimators": 2}, weighted=False)
    assert clf.score(rows).where("prediction = l").count() == 400
