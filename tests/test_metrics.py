"""Evaluation against brute force on small skewed predictions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytrace.operators import metrics


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 600
    run = np.where(rng.random(n) < 0.5, 7, rng.integers(1, 7, n))
    frame = pd.DataFrame({
        "run_id": run, "drone_id": rng.integers(1, 4, n), "window_index": np.arange(n),
        "y_prob": rng.choice(np.round(rng.random(60), 3), n),
    })
    frame["run_label"] = np.where(frame.run_id <= 2, "benign", "attack")
    frame["attack_type"] = np.where(frame.run_id <= 2, "none", np.where(frame.run_id % 2 == 0, "a", "b"))
    frame["y_true"] = np.where(frame.run_id <= 2, 0, (rng.random(n) < 0.7).astype(int))
    start = rng.integers(0, 10**7, n).astype(float)
    frame["window_start_timestamp"], frame["window_end_timestamp"] = start, start + 500
    return frame


@pytest.fixture(scope="module")
def pred(spark, pdf):
    return spark.createDataFrame(pdf)


def streak(misses):
    return max((sum(1 for _ in g) for v, g in itertools.groupby(misses) if v), default=0)


@pytest.mark.parametrize("width", [1000, 100_000, 10**9])
@pytest.mark.parametrize("by", [["run_id"], ["run_id", "drone_id"]])
def test_streaks(pred, pdf, by, width):
    got = {tuple(r)[:-1]: r["max_streak"] for r in metrics.fn_streak(pred, 0.5, by, width).collect()}
    attacks = pdf[pdf.y_true == 1].sort_values(["window_end_timestamp", "window_index"])
    want = {k if isinstance(k, tuple) else (k,): streak((g.y_prob < 0.5).tolist()) for k, g in attacks.groupby(by)}
    assert got == want


@pytest.mark.parametrize("width", [1000, 100_000, 10**9])
def test_onset_latency(pred, pdf, width):
    got = {(r["run_id"], r["drone_id"]): (r["windows_after_onset"], r["seconds_after_onset"]) for r in metrics.onset_latency(pred, 0.5, width).collect()}
    want = {}
    for key, g in pdf[pdf.y_true == 1].groupby(["run_id", "drone_id"]):
        g = g.sort_values(["window_end_timestamp", "window_index"])
        at = next((i for i, p in enumerate(g.y_prob) if p >= 0.5), None)
        ends = g.window_end_timestamp.to_list()
        want[key] = (None, None) if at is None else (at, (ends[at] - ends[0]) / 1000.0)
    assert got == want


@pytest.mark.parametrize("width", [1000, 10**9])
def test_positions(pred, pdf, width):
    got = {r["position"]: r["misses"] for r in metrics.fn_positions(pred, 0.5, width).collect()}
    want = dict.fromkeys(("onset", "middle", "end"), 0)
    for _, g in pdf[pdf.y_true == 1].groupby("run_id"):
        g = g.sort_values(["window_end_timestamp", "drone_id", "window_index"])
        for i, p in enumerate(g.y_prob):
            if p < 0.5:
                want[("onset", "middle", "end")[min(i * 3 // len(g), 2)]] += 1
    assert got == want


def test_percentiles_equal_numpy(pred, pdf):
    for r in metrics.prob_summary(pred, ["run_id"]).collect():
        p = pdf[pdf.run_id == r["run_id"]].y_prob.to_numpy()
        np.testing.assert_allclose(
            [r["prob_min"], r["prob_mean"], r["prob_p95"], r["prob_p99"], r["prob_max"]],
            [p.min(), p.mean(), np.percentile(p, 95), np.percentile(p, 99), p.max()], rtol=1e-12)


def test_approximate_percentiles_are_close(pred, pdf):
    r = metrics.prob_summary_approx(pred).first()
    assert abs(r["prob_p95"] - np.percentile(pdf.y_prob, 95)) < 0.05


def test_single_score(spark, pred):
    one = pred.withColumn("y_prob", F.lit(0.25))
    r = metrics.prob_summary(one).first()
    assert {r[c] for c in r.asDict()} == {0.25}


def test_best_threshold(pred, pdf):
    best = (-1.0, 0.0)
    for t in sorted(pdf.y_prob.unique()):
        hit = pdf.y_prob >= t
        tp = int((hit & (pdf.y_true == 1)).sum())
        p, r = tp / hit.sum(), tp / (pdf.y_true == 1).sum()
        f1 = 2 * p * r / (p + r + 1e-9)
        if f1 > best[0]:
            best = (f1, t)
    got = metrics.best_threshold(pred).first()
    assert got["threshold"] == best[1] and abs(got["f1"] - best[0]) < 1e-12


def test_confusion_adds_up_and_sweep_agrees(pred, pdf):
    cuts = [0.9, 0.2, 0.5, 0.5]
    rows = {r["threshold"]: r for r in metrics.threshold_sweep(pred, cuts).collect()}
    assert sorted(rows) == [0.2, 0.5, 0.9]
    for t, r in rows.items():
        cm = metrics.confusion(pred, t).first()
        assert {k: cm[k] for k in ("tp", "fp", "fn", "tn")} == {k: r[k] for k in ("tp", "fp", "fn", "tn")}
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(pdf) == r["windows"]


def test_empty_denominators(spark):
    schema = "run_id int, drone_id int, window_index int, window_start_timestamp double, window_end_timestamp double, y_true int, y_prob double, run_label string"
    df = spark.createDataFrame([(1, 1, 0, 5.0, 5.0, 0, 0.1, "benign"), (2, 1, 0, 0.0, 10.0, 1, 0.1, "attack")], schema)
    cm = {r["run_id"]: r for r in metrics.prf(metrics.confusion(df, 0.5, ["run_id"])).collect()}
    assert cm[1]["precision"] == cm[1]["recall"] == cm[1]["f1"] == 0.0
    worst = metrics.breakdown(df).collect()
    assert [r["level"] for r in worst] == ["run", "drone"] and np.isnan(worst[0]["f1"]) and worst[0]["recall"] == 0.0
    assert metrics.benign_rates(df).first()["fp_per_flight_hour"] is None
    runs = spark.createDataFrame([(1, "benign", 3), (2, "attack", 1), (9, "benign", 2)], "run_id int, run_label string, drones int")
    empty = metrics.run_metrics(df, runs).filter("run_id = 9").first()
    assert empty["windows"] == 0 and empty["skipped"] == 2 and empty["f1"] is None
    assert metrics.detection_summary(df).first()["undetected_runs"] == 1
    latency = metrics.onset_latency(df).first()
    assert latency["windows_after_onset"] is None and latency["seconds_after_onset"] is None
