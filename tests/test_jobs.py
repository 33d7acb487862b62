"""The jobs end to end on separable data, with their guarantees as properties."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import foldstack
from foldstack.operators import stacking, splits
from foldstack.operators.contract import ContractError
from foldstack.plans import audit as checks
from foldstack.plans import fitting, jobs
from foldstack.plans.fitting import cross_validate, fit_folds, fit_model, layout_partitions, training_frame
from foldstack.plans.models import BASE_MODELS, FitContext, get_model, list_models
from foldstack.queries import modelling
from foldstack.sources import artifacts, tables
from foldstack.sources.synthetic import normals

QUICK = {"size": "quick"}
LABELS = ("consolidation", "retracement", "reversal")


@pytest.fixture(scope="module")
def windows(spark):
    """120 windows of 3 steps x 4 channels; each class shifts the later steps its own way."""
    code = (F.col("id") % 3).cast("int")
    drift = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: (code - 1) * F.when(i >= 4, 3.0).otherwise(0.0) * F.when(i % 2 == 0, 1.0).otherwise(-1.0),
    )
    return spark.range(120).select(
        F.concat(F.lit("w"), F.col("id")).alias("window_id"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), code + 1).alias("label"),
        F.zip_with(normals(3, F.col("id"), 12), drift, lambda a, b: a + b).alias("features"),
    )


@pytest.fixture(scope="module")
def base(spark, windows, tmp_path_factory):
    """A base URI where every job has run."""
    uri = str(tmp_path_factory.mktemp("base"))
    jobs.ingest(spark, uri, windows)
    jobs.train(spark, uri, BASE_MODELS, **QUICK)
    cover = jobs.oof(spark, uri, BASE_MODELS, **QUICK).collect()
    assert {tuple(r) for r in cover} == {(name, 120, 0, 0, 0, 0) for name in BASE_MODELS}
    jobs.evaluate(spark, uri, "logreg", **QUICK)
    jobs.evaluate(spark, uri, "rf", git_sha="abc1234", **QUICK)
    jobs.stack_train(spark, uri, **QUICK)
    return uri


def test_version():
    assert foldstack.__version__


def test_registry():
    assert list_models() == [*BASE_MODELS, "stack"]
    with pytest.raises(ValueError, match="logreg, rf, xgb, rwkv_ts, cnn_transformer, stack"):
        get_model("svm", FitContext(["a", "b"], 10, 4))


def test_ingest_lands_a_valid_table(spark, base):
    landed = tables.read_windows(spark, base)
    assert landed.count() == 120
    assert [f.name for f in landed.schema] == ["window_id", "label", "features"]


def test_ingest_rejects_and_writes_nothing(spark, windows, tmp_path):
    with pytest.raises(ContractError, match="duplicate_window_id"):
        jobs.ingest(spark, str(tmp_path), windows.unionAll(windows))
    with pytest.raises(FileNotFoundError, match="run ingest first"):
        tables.read_windows(spark, str(tmp_path))


def test_ingest_without_source_makes_the_synthetic_table(spark, tmp_path):
    counts = {r["label"]: r["n"] for r in jobs.ingest(spark, str(tmp_path)).collect()}
    assert counts == {"class_A": 500, "class_B": 500}


@pytest.mark.parametrize("name", BASE_MODELS)
def test_oof_covers_every_window_once(spark, base, name):
    oof = tables.load_oof(spark, base, [name], splits.SEED)
    rows = oof.collect()
    assert len(rows) == len({r["window_id"] for r in rows}) == 120
    folds = {r["window_id"]: r["fold"] for r in tables.load_folds(spark, base, splits.SEED, 5).collect()}
    for r in rows:
        assert len(r["proba"]) == 3 and sum(r["proba"]) == pytest.approx(1.0, abs=1e-9)
        assert r["fold"] == folds[r["window_id"]]


@pytest.mark.parametrize("name", BASE_MODELS)
def test_models_learn_separable_classes(spark, base, name):
    oof = tables.load_oof(spark, base, [name], splits.SEED)
    actual = {r["window_id"]: r["label"] for r in tables.read_windows(spark, base).collect()}
    right = sum(LABELS[max(range(3), key=r["proba"].__getitem__)] == actual[r["window_id"]] for r in oof.collect())
    assert right / 120 > 0.6, right


def test_logistic_regression_solves_the_penalised_problem(spark, windows):
    """At the optimum of summed log-loss + ||W||^2 / 2 the gradient vanishes."""
    with training_frame(splits.assign_folds(windows)) as frame:
        model = fit_model(frame, "logreg", size="full").stages[1]
        rows = frame.rows.select("y", "features").collect()
    weights = model.coefficientMatrix.toArray()
    x = np.array([r["features"] for r in rows])
    y = np.array([int(r["y"]) for r in rows])
    logits = x @ weights.T + model.interceptVector.toArray()
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x + weights
    assert np.abs(gradient).max() < 0.02


def test_layout_depends_on_size_only():
    gib, tib = 1024**3, 1024**4
    assert layout_partitions(1) == 2
    assert layout_partitions(gib) == 64
    assert layout_partitions(tib) == 16384
    assert layout_partitions(10 * tib) == 16384
    assert layout_partitions(100 * tib) == 102400


@pytest.mark.parametrize("name", ["logreg", "xgb"])
def test_no_fold_model_sees_its_own_rows(spark, windows, name):
    """Other labels in a fold leave the model without this fold as it was, and change the others."""
    folded = splits.assign_folds(windows, k=3)
    poisoned = folded.withColumn("label", F.when(F.col("fold") == 1, F.lit("reversal")).otherwise(F.col("label")))
    found = []
    for rows in (folded, poisoned):
        with training_frame(rows) as frame:
            models = fit_folds(frame, name, [0, 1], **QUICK)
            found.append([{r["window_id"]: r["proba"] for r in m.transform(windows).collect()} for m in models])
    (first, same), (other, again) = found
    assert all(again[k] == pytest.approx(v, abs=1e-9) for k, v in same.items())
    assert any(other[k] != pytest.approx(v, abs=1e-3) for k, v in first.items())


@pytest.mark.parametrize("name", ["rf", "xgb", "cnn_transformer"])
def test_models_do_not_depend_on_input_partitioning(spark, windows, name):
    def probabilities(df):
        with training_frame(splits.assign_folds(df, k=2)) as frame:
            model = fit_model(frame, name, without=0, **QUICK)
            return {r["window_id"]: r["proba"] for r in model.transform(df).collect()}

    first = probabilities(windows)
    for n in (1, 7):
        again = probabilities(windows.repartition(n))
        for key, value in first.items():
            assert again[key] == pytest.approx(value, abs=1e-9)


def test_a_fold_without_a_class_still_yields_all_columns(spark, windows):
    rare = windows.where("label <> 'reversal'").unionAll(windows.where("window_id = 'w2'"))
    for name in ("logreg", "rf", "xgb"):
        with training_frame(splits.assign_folds(rare)) as frame:
            scored = cross_validate(frame, name, **QUICK)
            assert {len(r["proba"]) for r in scored.collect()} == {3}


@pytest.mark.parametrize("name", BASE_MODELS)
def test_two_classes_without_channels(spark, name):
    """Five features do not form channels; each model still gives two probabilities."""
    code = (F.col("id") % 2).cast("int")
    two = spark.range(60).select(
        F.col("id").cast("string").alias("window_id"),
        F.element_at(F.array(F.lit("class_A"), F.lit("class_B")), code + 1).alias("label"),
        F.transform(normals(1, F.col("id"), 5), lambda v: v + code * 4.0).alias("features"),
    )
    with training_frame(splits.assign_folds(two, k=2)) as frame:
        model = fit_model(frame, name, without=0, **QUICK)
        rows = model.transform(two).collect()
    assert sum(r["prediction"] == r["label"] for r in rows) > 50
    assert all(len(r["proba"]) == 2 and abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)


def test_ragged_features_stop_training(spark, windows):
    odd = windows.withColumn(
        "features", F.when(F.col("window_id") == "w5", F.array(F.lit(1.0))).otherwise(F.col("features"))
    )
    with pytest.raises(Exception, match="ragged features in window"):
        with training_frame(splits.assign_folds(odd)) as frame:
            fit_model(frame, "logreg", **QUICK)


def test_stored_split_is_reused_per_seed_and_k(spark, base):
    first = jobs.get_or_create_split(spark, base)
    assert jobs.get_or_create_split(spark, base) == first
    other = jobs.get_or_create_split(spark, base, seed=3, k=4)
    assert other.seed == 3 and other.parts == 4 and other != first


def test_train_reports_both_parts(spark, windows, tmp_path):
    jobs.ingest(spark, str(tmp_path), windows)
    rows = {r["part"]: r for r in jobs.train(spark, str(tmp_path), "logreg", **QUICK).collect()}
    assert rows["test"]["n"] == 24 and rows["train"]["n"] == 96
    assert 0.0 <= rows["test"]["accuracy"] <= 1.0


def test_evaluate_writes_metrics_runs_and_matrix(spark, base):
    record = tables.load_metrics(spark, base, ["rf"]).first()
    assert {"accuracy", "f1", "timestamp"} <= set(record.asDict())
    assert 0.0 <= record["accuracy"] <= 1.0 and 0.0 <= record["f1"] <= 1.0
    assert record["timestamp"].endswith("Z") and record["cv_folds"] == 5
    details = record["fold_details"]
    assert [d["fold"] for d in details] == [0, 1, 2, 3, 4]
    assert record["accuracy"] == pytest.approx(sum(d["accuracy"] for d in details) / 5)
    runs = {r["model"]: r for r in tables.read_runs(spark, base).collect()}
    assert runs["rf"]["git_sha"] == "abc1234" and runs["logreg"]["git_sha"] == "unknown"
    for path in (f"{base}/confusion", f"{base}/models/rf/confusion"):
        matrix = spark.read.option("header", True).option("inferSchema", True).csv(path)
        assert matrix.columns == ["actual", "pred_0", "pred_1", "pred_2"]
        assert [r["actual"] for r in matrix.collect()] == list(LABELS)
        assert sum(sum(r[f"pred_{i}"] for i in range(3)) for r in matrix.collect()) == 120


def test_evaluating_stored_rows_equals_refitting(spark, windows, tmp_path):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    jobs.oof(spark, base, "rf", **QUICK)
    stored = jobs.evaluate(spark, base, "rf", from_oof=True).drop("timestamp").first()
    fitted = jobs.evaluate(spark, base, "rf", **QUICK).drop("timestamp").first()
    assert stored == fitted


@pytest.mark.parametrize("rows", ["fewer", "more"])
def test_stack_train_stops_on_misaligned_rows(spark, windows, tmp_path, rows):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    jobs.get_or_create_split(spark, base)
    ids = tables.load_folds(spark, base, splits.SEED, 5).select("window_id", "fold")
    if rows == "fewer":
        ids = ids.where("window_id <> 'w7'")
    else:
        ids = ids.unionAll(spark.createDataFrame([("stranger", 0)], "window_id string, fold int"))
    for name in ("logreg", "rf"):
        tables.save_oof(
            ids.select(
                "*",
                F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("proba"),
                F.lit(name).alias("model"),
                F.lit(splits.SEED).cast("long").alias("seed"),
            ),
            base,
        )
    with pytest.raises(Exception, match="w7|stranger|NULL|null"):
        jobs.stack_train(spark, base, models=("logreg", "rf"), **QUICK)


def test_stack_metrics_and_manifest(spark, base):
    record = tables.load_metrics(spark, base, ["stack"]).first()
    assert 0 <= record["ece"] <= 1 and record["logloss"] > 0 and record["macro_f1"] == record["f1"]
    header, entries = artifacts.read_manifest(spark, base)
    head = header.first()
    assert head["models"] == [*BASE_MODELS, "stack"]
    assert float(head["metadata"]["stack_f1"]) == pytest.approx(record["f1"])
    assert entries.count() > 20
    assert artifacts.verify_manifest(spark, base).where("not ok").isEmpty()


def test_stack_train_needs_every_base_table(spark, base):
    with pytest.raises(FileNotFoundError, match="seed=99"):
        jobs.stack_train(spark, base, seed=99, **QUICK)
    with pytest.raises(ValueError, match="unknown model"):
        jobs.stack_train(spark, base, stacker="mean", **QUICK)


@pytest.mark.parametrize("name", ["logreg", "xgb", "rwkv_ts", "stack"])
def test_predictions_are_narrow_and_complete(spark, base, windows, name, tmp_path):
    out = str(tmp_path / "pred")
    pred = jobs.predict(spark, base, name, windows.drop("label"), out)
    assert pred.columns == ["window_id", "prediction", *[f"prob_class_{i}" for i in range(3)]]
    plan = pred._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    rows = spark.read.option("header", True).csv(out).collect()
    assert len(rows) == 120
    for r in rows[:20]:
        probs = [float(r[f"prob_class_{i}"]) for i in range(3)]
        assert r["prediction"] == LABELS[probs.index(max(probs))]


def test_out_of_bag_votes_of_a_stored_forest(spark, base):
    rows = jobs.out_of_bag(spark, base, "rf").collect()
    assert len(rows) == 96 and all((r["proba"] is None) == (r["trees"] == 0) == (r["prediction"] is None) for r in rows)
    assert sum(r["prediction"] == r["label"] for r in rows) > 70
    with pytest.raises(ValueError, match="no forest"):
        jobs.out_of_bag(spark, base, "logreg")


def test_scoring_accepts_the_wide_form_without_ids(spark, base, windows):
    wide = windows.select(*[F.col("features")[i].alias(f"x{i}") for i in range(12)])
    pred = jobs.predict(spark, base, "logreg", wide)
    assert pred.columns == ["prediction", *[f"prob_class_{i}" for i in range(3)]]
    assert pred.count() == 120


def test_predict_without_a_model(spark, windows, tmp_path):
    with pytest.raises(FileNotFoundError, match="run train"):
        jobs.predict(spark, str(tmp_path), "rf", windows)


def test_audit_passes_on_a_complete_base(spark, base):
    table = checks.audit(spark, base, "all")
    assert table.where("status = 'fail'").isEmpty()
    assert {r["section"] for r in table.collect()} == set(checks.SECTIONS)
    warned = {r["check"] for r in table.where("status = 'warn'").collect()}
    assert {"metrics xgb", "metrics rwkv_ts", "metrics cnn_transformer"} <= warned
    assert checks.verdict(table).first()["passed"] is True


def test_audit_fails_on_gaps(spark, windows, tmp_path):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    for section in ("base", "oof", "stack"):
        assert checks.verdict(checks.audit(spark, base, section)).first()["passed"] is False
    jobs.get_or_create_split(spark, base)
    partial = tables.load_folds(spark, base, splits.SEED, 5).where("fold > 0")
    tables.save_oof(
        partial.select(
            "window_id",
            "fold",
            F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("proba"),
            F.lit("rf").alias("model"),
            F.lit(splits.SEED).cast("long").alias("seed"),
        ),
        base,
    )
    rows = {r["check"]: r for r in checks.audit(spark, base, "oof").collect()}
    assert rows["coverage rf"]["status"] == "fail"
    assert rows["coverage rf"]["detail"] == "96 rows, 96 zero, 24 missing, 0 extra, 0 duplicate"


def test_audit_rejects_unknown_sections(spark, tmp_path):
    with pytest.raises(ValueError, match="base, oof, stack, all"):
        checks.audit(spark, str(tmp_path), "data")


def test_stored_tables_follow_the_training_table(spark, windows, tmp_path):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows.limit(60))
    first = {r["window_id"] for r in jobs.get_or_create_split(spark, base).assign(tables.read_windows(spark, base)).collect()}
    jobs.oof(spark, base, "logreg", **QUICK)
    jobs.evaluate(spark, base, "logreg", from_oof=True)
    jobs.ingest(spark, base, windows)
    with pytest.raises(tables.StaleTable):
        jobs.evaluate(spark, base, "logreg", from_oof=True)
    with pytest.raises(tables.StaleTable):
        jobs.stack_train(spark, base, models=["logreg"], **QUICK)
    rows = {r["check"]: r["status"] for r in checks.audit(spark, base, "oof", models=["logreg"]).collect()}
    assert rows["split version"] == rows["version logreg"] == rows["coverage logreg"] == "fail" or rows["version logreg"] == "fail"
    cover = jobs.oof(spark, base, "logreg", **QUICK).first()
    assert tuple(cover) == ("logreg", 120, 0, 0, 0, 0) and len(first) == 60
    sizes = tables.load_folds(spark, base, splits.SEED, 5).groupBy("label", "fold").count().collect()
    per_label = {}
    for r in sizes:
        per_label.setdefault(r["label"], []).append(r["count"])
    assert all(max(x) - min(x) <= 1 for x in per_label.values())
    assert jobs.evaluate(spark, base, "logreg", from_oof=True).first()["model"] == "logreg"


def test_evaluation_from_stored_rows_stops_at_any_mismatch(spark, windows, tmp_path):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    jobs.get_or_create_split(spark, base)
    folds = tables.load_folds(spark, base, splits.SEED, 5)
    rows = folds.select(
        "window_id",
        "fold",
        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("proba"),
        F.lit("rf").alias("model"),
        F.lit(splits.SEED).cast("long").alias("seed"),
    )
    foreign = rows.limit(1).withColumn("window_id", F.lit("stranger"))
    for bad, told in ((rows.where("fold > 0"), "no out-of-fold row"), (rows.unionAll(foreign), "unknown window"), (rows.unionAll(rows.limit(1)), "several")):
        tables.save_oof(bad, base)
        with pytest.raises(Exception, match=told):
            jobs.evaluate(spark, base, "rf", from_oof=True)
    tables.save_oof(rows, base)
    assert jobs.evaluate(spark, base, "rf", from_oof=True).count() == 1


@pytest.mark.parametrize("name", [*BASE_MODELS, "stack"])
def test_windows_of_another_width_stop_the_scoring(spark, base, windows, name):
    for change in (F.concat("features", F.array(*[F.lit(0.0)] * 4)), F.slice("features", 1, 8), F.lit(None).cast("array<double>")):
        bad = windows.where("window_id = 'w7'").withColumn("features", change)
        with pytest.raises(Exception, match="window w7: 12 values expected"):
            jobs.predict(spark, base, name, windows.limit(3).unionByName(bad)).collect()


def test_predictions_come_back_from_the_written_table(spark, base, windows, tmp_path):
    path = f"{tmp_path}/predictions.csv"
    written = jobs.predict(spark, base, "logreg", windows, path)
    assert written.inputFiles() and all(path in f for f in written.inputFiles())
    fresh = jobs.predict(spark, base, "logreg", windows)
    key = lambda df: sorted((r["window_id"], r["prediction"], round(r["prob_class_0"], 9)) for r in df.collect())
    assert written.schema.simpleString() == fresh.schema.simpleString() and key(written) == key(fresh)


def test_more_classes_than_a_boundary_table_holds(spark, windows, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "MAX_BOUNDS", 3)
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    split = jobs.get_or_create_split(spark, base)
    assert isinstance(split, splits.RankedSplit)
    assert isinstance(jobs.get_or_create_split(spark, base), splits.RankedSplit)
    ranked = {r["window_id"]: r["fold"] for r in split.assign(windows).collect()}
    monkeypatch.undo()
    assert ranked == {r["window_id"]: r["fold"] for r in splits.assign_folds(windows).collect()}


def test_the_stack_layout_shares_one_wide_shuffle(spark, base):
    oof = tables.load_oof(spark, base, list(BASE_MODELS), splits.SEED)
    folds = tables.load_folds(spark, base, splits.SEED, 5)
    rows = stacking.labelled_stack(oof, folds, BASE_MODELS, 3).repartition(3, "window_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and rows.count() == 120


def test_fit_rows_bounds_the_fit_and_not_the_scoring(spark, windows, tmp_path):
    base = str(tmp_path)
    jobs.ingest(spark, base, windows)
    with training_frame(splits.assign_folds(windows), fit_rows=60) as frame:
        fitted = frame.rows.count()
        assert 30 < fitted < 90 and frame.every.count() == 120
        assert sum(frame.class_sizes().values()) == fitted
    report = {r["part"]: r["n"] for r in jobs.train(spark, base, "logreg", fit_rows=60, **QUICK).collect()}
    assert report == {"test": 24, "train": 96}
    assert tuple(jobs.oof(spark, base, "rf", fit_rows=60, leaf=2, **QUICK).first()) == ("rf", 120, 0, 0, 0, 0)


def test_registered_stacks_take_every_base_model(spark, sf, monkeypatch):
    seen = []

    def noted(step):
        def run(*args, **rest):
            seen.append((step, tuple(rest.get("models") or args[1:])))
            raise StopIteration

        return run

    monkeypatch.setattr(modelling, "_landed", lambda *args: "base")
    monkeypatch.setattr(modelling, "_with_oof", lambda *args: seen.append(("oof", tuple(args[2]))))
    monkeypatch.setattr(modelling, "_with_stack", lambda *args: seen.append(("stack", tuple(args[2]))))
    monkeypatch.setattr(modelling.jobs, "stack_train", noted("train"))
    monkeypatch.setattr(modelling.jobs, "predict", noted("predict"))
    for query, steps in ((modelling.stack_train, "oof train"), (modelling.stack_predict, "stack predict"), (modelling.predicted_totals, "stack predict")):
        seen.clear()
        with pytest.raises(StopIteration):
            query(spark, sf)
        assert seen == [(step, BASE_MODELS) for step in steps.split()]


def test_boosting_runs_beside_the_other_models(spark):
    rows = spark.createDataFrame([(f"w{i}", "ab"[i % 2], i % 3, [float(i), 1.0]) for i in range(30)], "window_id string, label string, fold int, features array<double>")
    met, seen = threading.Barrier(2), []

    def run(name):
        seen.append(name)
        if name in ("xgb", "logreg"):
            met.wait(60)  # breaks if one waits for the other to end
        return name.upper()

    with fitting.training_frame(rows) as frame:
        assert fitting.each_model(frame, ["rf", "xgb", "logreg"], run) == ["RF", "XGB", "LOGREG"]
        assert seen[-1] == "rf"  # forests after those with short jobs

        def broken(name):
            raise ValueError(name)

        with pytest.raises(ValueError, match="xgb|rf"):
            fitting.each_model(frame, ["rf", "xgb"], broken)
