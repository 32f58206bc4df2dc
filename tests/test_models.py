"""Pipelines on small rows that any of them can tell apart, folds against plain loops, tuning against plain sums."""

from datetime import datetime, timedelta

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tideline.models import baselines
from tideline.models.prefixes import Known
from tideline.operators import metrics, reports, risk, tuning

START = datetime(2025, 2, 3)
SMALL = {"features": 20, "trees": 3, "epochs": 60, "steps": 15}


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"up": "growth boom rally", "down": "tariff war fire", "none": "thank you all"}
    rows = []
    for i in range(60):
        label = ("up", "down", "none")[i % 3]
        rows.append((f"e{i}", START + timedelta(hours=i), f"{words[label]} number {i % 7}", label, "up", 10 + i, 3, 0.1, 0, None, i % 2 == 0, None, 0.5))
    schema = "event_id string, received_at_utc timestamp, text_clean string, tradeability_label string, rule_tradeability_label string, post_length int, token_count int, all_caps_ratio double, exclamation_count int, question_mark_count int, has_image boolean, has_video boolean, rule_sentiment_confidence double"
    return spark.createDataFrame(rows, schema).coalesce(1).cache()


def test_context_and_labels(labelled):
    got = baselines.context_features(labelled, ["event_id"])
    assert got.columns == ["event_id", *baselines.CONTEXT] and tuple(got.orderBy("post_length").first()) == ("e0", 10.0, 3.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.5)
    assert sorted(map(tuple, baselines.label_index(labelled).collect())) == [("down", 0), ("none", 1), ("up", 2)]


@pytest.mark.parametrize("model", baselines.MODELS)
def test_models_learn_words(labelled, model):
    train, test = labelled.where("hour(received_at_utc) < 14"), labelled.where("hour(received_at_utc) >= 14")
    rows = baselines.predict(baselines.fit(train, model, **SMALL), test).collect()
    assert sum(r["predicted"] == r["tradeability_label"] for r in rows) >= 0.9 * len(rows)
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-6 and r["confidence"] == r["probabilities"][r["predicted"]] for r in rows)


def test_one_class_gives_the_majority(labelled):
    one = labelled.where("tradeability_label = 'up'")
    assert baselines.fit(one, "tfidf_logreg") is None
    assert {r["predicted"] for r in baselines.predictions(one, labelled, ["tfidf_logreg"], {}).where("model = 'tfidf_logreg'").collect()} == {"up"}


def test_status_and_digests(spark, labelled):
    one = baselines.compare(labelled.withColumn("tradeability_label", F.lit("up")), models=["tfidf_logreg"], **SMALL)
    assert {r["model"]: r["status"] for r in one.collect()} == {"naive": "trained", "rules": "trained", "tfidf_logreg": "majority"}
    none = spark.createDataFrame([(1, "naive", "trained", 3, 0.5, 0.4), (2, "m", "majority", 3, 0.9, 0.9), (3, "b", "trained", 3, 0.5, 0.4)], "position int, model string, status string, n long, accuracy double, macro_f1 double")
    assert tuple(reports.classifier_digest(none).first()) == ("naive", 3, 0.5, 0.4)
    folds = spark.createDataFrame([("b", 2, 9, 0.5, 0.4, 0.45, 0.1), ("a", 2, 9, 0.6, 0.5, 0.45, 0.2), ("c", 2, 9, 0.9, 0.9, 0.1, 0.0)], "model string, folds long, n long, accuracy double, macro_f1 double, macro_f1_mean double, macro_f1_std double")
    assert reports.walk_forward_digest(folds).first()["model"] == "a" and reports.walk_forward_digest(folds.where("false")).count() == 0


def test_comparison_and_save(labelled, tmp_path):
    rows = baselines.compare(labelled, models=["tfidf_logreg"], save=lambda name, m: m.write().overwrite().save(str(tmp_path / name)), **SMALL)
    got = {r["model"]: r for r in rows.collect()}
    assert set(got) == {"naive", "rules", "tfidf_logreg"} and all(r["n"] == 21 for r in got.values())
    assert got["rules"]["accuracy"] == round(7 / 21, 6) and got["tfidf_logreg"]["accuracy"] > 0.9
    assert reports.best_model(rows).first()["model"] == "tfidf_logreg"
    assert (tmp_path / "tfidf_logreg" / "metadata").exists()


def _folds(times, first, test, step, embargo, purge):
    out, end = [], first
    while end + embargo < len(times):
        start = end + embargo
        n = sum(t <= times[start] - timedelta(minutes=purge) for t in times[:end])
        if n >= first:
            out.append((len(out) + 1, start, min(start + test, len(times)), n))
        end += step
    return out


@pytest.mark.parametrize("args", [(3, 1, 1, 1, 30), (10, 7, 3, 2, 200), (5, 4, 9, 0, 0), (59, 1, 1, 1, 0), (3, 5, 2, 1, 600)])
def test_folds(spark, args):
    times = [START + timedelta(minutes=(i // 2) * 50 + (i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(99, None)], "event_id int, received_at_utc timestamp")
    first, test, step, embargo, purge = args
    times = sorted(times)
    folds, rows = metrics.walk_forward_folds(df, ["received_at_utc", "event_id"], "received_at_utc", first_train=first, test_rows=test, step=step, embargo_rows=embargo, purge_minutes=purge)
    want = _folds(times, *args)
    assert sorted((r["fold"], r["test_start"], r["test_end"], r["train_rows"]) for r in folds.collect()) == want
    tests = metrics.fold_tests(rows, folds, first_train=first, test_rows=test, step=step, embargo_rows=embargo)
    assert sorted((r["fold"], r["row_index"]) for r in tests.collect()) == [(k, i) for k, a, b, _ in want for i in range(a, b)]
    assert "NestedLoop" not in tests._jdf.queryExecution().toString()


def test_walk_forward_and_summary(labelled):
    options = {"first_train": 30, "test_rows": 10, "step": 10, "models": ("tfidf_logreg",)}
    found = baselines.walk_forward(labelled, **options, features=20)
    rows = {r["model"]: r for r in metrics.walk_forward_summary(found, ["down", "none", "up"]).collect()}
    assert set(rows) == {"naive", "rules", "tfidf_logreg"} and rows["tfidf_logreg"]["folds"] == 3 and rows["tfidf_logreg"]["n"] == 29
    assert rows["tfidf_logreg"]["macro_f1"] > 0.9 > rows["rules"]["macro_f1_max"] >= rows["rules"]["macro_f1_min"]
    with pytest.raises(ValueError):
        baselines.walk_forward(labelled, **options, max_folds=2)


def test_prefixes_know_what_a_fresh_fit_counts(spark, labelled):
    rows = labelled.withColumn("row_index", F.hour("received_at_utc").cast("long") + 24 * F.datediff("received_at_utc", F.lit(START)))
    odd = spark.createDataFrame([(11, None, "up"), (12, "thank thank thank you you", "none"), (13, "unlabelled words", None), (14, "", "down"), (None, "without a place", "up")], "row_index long, text_clean string, tradeability_label string")
    rows = rows.unionByName(odd, allowMissingColumns=True).cache()
    ends = [3, 15, 15, 47, 1_000]
    known = baselines.prefix_statistics(rows, ends, 10_000)
    for end, k in zip(ends, known, strict=True):
        train = rows.where(F.col("row_index") < end).where("tradeability_label is not null")
        fresh = Pipeline(stages=baselines.text_stages(10_000)).fit(train)
        assert dict(zip(k.terms, k.idf, strict=True)) == pytest.approx(dict(zip(fresh.stages[4].vocabulary, fresh.stages[5].idf.toArray(), strict=True)))
        assert k.labels == {r["tradeability_label"]: r["count"] for r in train.groupBy("tradeability_label").count().collect()}
    assert known[1] == known[2] and baselines.prefix_statistics(rows, []) == []
    few = baselines.prefix_statistics(rows, ends, 5)
    assert [k.terms for k in few] == [k.terms[:5] for k in known] and known[-1].terms[0] == "number"
    assert baselines.prefix_statistics(rows.where("false"), [5]) == [Known({}, [], [])]
    train = rows.where("row_index < 47")
    weights = lambda df: sorted((r["tradeability_label"], round(r["weight"], 9)) for r in df.collect())
    assert weights(baselines.weighted(train.where("tradeability_label is not null"), known[3])) == weights(baselines.weighted(train.where("tradeability_label is not null")))
    said = lambda k: {r["event_id"]: (r["predicted"], round(r["confidence"], 6)) for r in baselines.predict(baselines.fit(train, "tfidf_logreg", k, features=10_000), labelled).collect()}
    assert said(known[3]) == said(None)
    assert baselines.fit(train, "tfidf_logreg", Known({"up": 3}, ["a"], [1])) is None and baselines.fit(train, "mlp", Known({"up": 3, "down": 1}, [], [])) is None


def test_fits_pass_over_vectors_not_texts(labelled, monkeypatch):
    seen, fit_all = [], baselines.fit_all
    monkeypatch.setattr(baselines, "fit_all", lambda jobs, options: seen.extend(jobs) or fit_all(jobs, options))
    baselines.compare(labelled, models=["tfidf_logreg"], **SMALL)
    baselines.walk_forward(labelled, first_train=30, test_rows=10, step=10, models=("tfidf_logreg",), features=20)
    assert len(seen) == 4 and not any("text_clean" in job[0].columns for job in seen)
    # vectors of a fold are those that its own text stages give
    ends = [20, 50]
    rows = labelled.withColumn("row_index", F.expr("substring(event_id, 2)").cast("long"))
    known = baselines.prefix_statistics(rows, ends, 6)
    terms = sorted({*known[0].terms, *known[1].terms, "war"})
    counts = baselines.counted(rows, baselines.CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_all"))
    for k in known:
        found, text = baselines.fold_vectors(counts, terms, k)
        of = lambda df: {r["event_id"]: r["_tfidf"].toArray().tolist() for r in df.collect()}
        assert of(found) == of(text.transform(rows)) == of(baselines.vectors(rows, known=k)[0])


def test_the_walk_takes_only_what_its_models_read(spark, monkeypatch):
    from tideline.plans import model_queries

    monkeypatch.setattr(model_queries, "enrich", None)
    rows = model_queries._model_rows(spark, "/root/testdata/sf0.001", context=False)
    assert rows.columns == ["doc_id", "tradeability_label", "rule_tradeability_label", "text_clean", "received_at_utc"] and rows.count() == 87


def test_tuning(spark):
    rows = [(i, {c: ((i * (k + 3)) % 10) / 10 for k, c in enumerate(risk.COMPONENTS)}, i % 3 == 0) for i in range(80)]
    names = ", ".join(f"{c} double" for c in risk.COMPONENTS)
    df = spark.createDataFrame([(i, *v.values(), w, "train" if i < 52 else "test") for i, v, w in rows], f"i int, {names}, market_whipsaw_flag boolean, split string")
    trials = tuning.random_trials(20, 1)
    assert trials == tuning.random_trials(20, 1) and all(t.hard >= t.soft + 0.049 for t in trials)
    got = {r["trial"]: r for r in tuning.evaluate_trials(df, trials).collect()}
    for t in trials:
        scores = [round(min(1.0, sum(t.weights[c] * v[c] for c in risk.COMPONENTS)), 9) for _, v, _ in rows]
        assert (got[t.number]["soft_tp"], got[t.number]["hard_fp"]) == (sum(w and s >= t.soft for s, (_, _, w) in zip(scores, rows, strict=True)), sum(not w and s >= t.hard for s, (_, _, w) in zip(scores, rows, strict=True)))
    report, best = tuning.tune(df, n_trials=20, seed=1)
    out = {(r["split"], r["parameters"]): r for r in report.collect()}
    assert set(out) == {("train", "best"), ("test", "best"), ("test", "default")} and out["train", "best"]["trial"] == best.number
    trained = tuning.evaluate_trials(df.where("split = 'train'"), trials).collect()
    assert out["train", "best"]["objective"] == max(r["objective"] for r in trained)


def test_reports(spark):
    one = lambda schema, *row: spark.createDataFrame([row], schema)
    archive, few = one("row_count long, empty_text_rows long", 1000, 3), one("row_count long, unique_event_count long", 499, 400)
    gates = reports.readiness(archive, one("row_count long, valid_rows long, sources string", 5, 5, "vendor"), few).first()
    assert tuple(gates) == (True, True, False, False, "not_research_ready", "fixture_shadow_only")
    assert not reports.readiness(archive, one("sources string", "fixture_x,vendor"), few).first()["licensed_market_data_loaded"]
    many = one("row_count long, unique_event_count long", 500, 400)
    assert reports.readiness(archive, one("sources string", "vendor"), many).first()["status"] == "real_research_ready"
    skipped = spark.createDataFrame([("a", "r1"), ("b", "r1")], "post_id string, reason string")
    audit = reports.event_build_audit(many, one("is_valid_bar boolean", False), few, skipped)
    assert {r["measure"]: r["n"] for r in audit.collect()} == {"input_post_count": 1, "market_bar_count": 1, "market_valid_bar_count": 0, "event_count": 1, "skipped_post_count": 2, "skipped:r1": 2}
