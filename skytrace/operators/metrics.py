"""Detector evaluation over window predictions.

A prediction frame has one row per window: the window record plus ``y_true`` (0/1) and
``y_prob``. A window counts as detected when ``y_prob >= threshold``. All percentiles
and curves are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytrace.operators.ordered import HOUR_MS, order_by, ranked, running_totals, time_bucket
from skytrace.operators.selection import percentiles
from skytrace.session import stored

RUN, DRONE = "run_id", "drone_id"
SEQUENCE = ["window_end_timestamp", "window_index"]
QUANTILES = {"p95": 0.95, "p99": 0.99}


def _hit(threshold: float) -> Column:
    return F.col("y_prob") >= F.lit(float(threshold))


def _cell_counts(threshold: float) -> list[Column]:
    hit, real = _hit(threshold), F.col("y_true") == 1
    return [
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(pred: DataFrame, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    return pred.groupBy(*by).agg(*_cell_counts(threshold))


def prf(cm: DataFrame) -> DataFrame:
    """Adds precision, recall and F1; 0.0 where a denominator is empty."""
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.coalesce(_ratio(tp, tp + fp), zero)
    r = F.coalesce(_ratio(tp, tp + fn), zero)
    return cm.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    )


def score_counts(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Windows and positives per distinct score: the shuffle carries scores, not windows."""
    return pred.groupBy(*by, "y_prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos")
    )


def prob_summary(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Min, mean, p95, p99 and max of the scores, percentiles by linear interpolation.

    Exact at any group size: scores are counted, then ranked by prefix sums, instead of
    gathering a group's values in one buffer.
    """
    by = list(by)
    at = running_totals(score_counts(pred, by), by, "y_prob", ["n"])
    first, last = F.col("upto_n") - F.col("n"), F.col("upto_n") - 1
    place = lambda q: (F.col("total_n") - 1) * F.lit(q)
    value_at = lambda i: F.max(F.when((first <= i) & (last >= i), F.col("y_prob")))
    agg = [
        F.min("y_prob").alias("prob_min"), (F.sum(F.col("y_prob") * F.col("n")) / F.sum("n")).alias("prob_mean"),
        F.max("y_prob").alias("prob_max"), F.max("total_n").alias("_total"),
    ]
    for name, q in QUANTILES.items():
        agg += [value_at(F.floor(place(q))).alias(f"_{name}_lo"), value_at(F.ceil(place(q))).alias(f"_{name}_hi")]
    found = at.groupBy(*by).agg(*agg)
    part = lambda q: (F.col("_total") - 1) * F.lit(q) - F.floor((F.col("_total") - 1) * F.lit(q))
    exact = {
        f"prob_{name}": F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * part(q)
        for name, q in QUANTILES.items()
    }
    return found.withColumns(exact).select(*by, *[f"prob_{c}" for c in ("min", "mean", "p95", "p99", "max")])


def prob_summary_approx(pred: DataFrame, by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """The same from a quantile sketch: one aggregation, percentiles approximate."""
    q = F.percentile_approx("y_prob", list(QUANTILES.values()), accuracy)
    return pred.groupBy(*by).agg(
        F.min("y_prob").alias("prob_min"), F.avg("y_prob").alias("prob_mean"),
        q[0].alias("prob_p95"), q[1].alias("prob_p99"), F.max("y_prob").alias("prob_max"),
    )


def _span() -> Column:
    return (F.max("window_end_timestamp") - F.min("window_start_timestamp")).alias("_span")


def _hours() -> Column:
    """Hours of all drones' spans."""
    total = F.sum(F.when(F.col("_span") > 0, F.col("_span")).otherwise(0.0))
    return (F.coalesce(total, F.lit(0.0)) / 1000.0 / 3600.0).alias("flight_hours")


def flight_hours(win: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hours covered by windows, per drone from first start to last end, summed."""
    keys = list(dict.fromkeys([*by, RUN, DRONE]))
    return win.groupBy(*keys).agg(_span()).groupBy(*by).agg(_hours())


def _joined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Join aggregates of equal keys; without keys each part is one row."""
    if by:
        return reduce(lambda a, b: a.join(b, list(by), "left"), parts)
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def run_metrics(pred: DataFrame, runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One line per run, runs without windows too. ``runs`` needs run_id, run_label, drones."""
    # one shuffle for counts and hours: a row a drone
    counted = pred.groupBy(RUN, DRONE).agg(F.count(F.lit(1)).alias("n"), _span(), *_cell_counts(threshold))
    per_run = counted.groupBy(RUN).agg(
        F.sum("n").alias("windows"), F.count(DRONE).alias("_scored"), _hours(),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    rest = prf(per_run).join(prob_summary(pred, [RUN]), RUN, "left")
    benign = F.col("run_label") == "benign"
    return runs.join(rest, RUN, "left").select(
        RUN, "run_label", "drones",
        (F.col("drones") - F.coalesce("_scored", F.lit(0))).alias("skipped"),
        F.coalesce("windows", F.lit(0)).alias("windows"),
        "tp", "fp", "fn", "tn", "precision", "recall", "f1", "flight_hours",
        _ratio(F.col("tp") + F.col("fp"), F.col("windows")).alias("predicted_positive_rate"),
        F.when(benign, F.col("fp")).alias("false_positives"),
        F.when(benign, _ratio(F.col("fp"), F.col("windows"))).alias("false_positive_rate"),
        *[f"prob_{c}" for c in ("min", "mean", "p95", "p99", "max")],
    )


def benign_rates(pred: DataFrame, threshold: float = 0.5, drones: DataFrame | None = None) -> DataFrame:
    """False-alarm rates over all benign runs; per flight hour is NULL without hours.

    ``drones`` (run_id, drones) gives the files per run, so drones too short for a
    window count as well; without it the drones with windows do.
    """
    rows = pred.filter(F.col("run_label") == "benign")
    cm = rows.groupBy(RUN, DRONE).agg(F.count(F.lit(1)).alias("n"), _span(), *_cell_counts(threshold)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("windows"), F.count(DRONE).alias("drones"), _hours(),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    if drones is not None:
        cm = cm.drop("drones").crossJoin(F.broadcast(_files_of(rows, drones)))
    joined = _joined([cm, prob_summary(rows)], [])
    return joined.withColumn("threshold", F.lit(float(threshold))).withColumns(_alarm_rates()).filter("windows > 0")


def _alarm_rates() -> dict[str, Column]:
    fp, n, zero = F.col("fp"), F.col("windows"), F.lit(0.0)
    return {
        "fpr": F.coalesce(_ratio(fp, n), zero),
        "fp_per_10k_windows": F.coalesce(_ratio(fp, n) * 1e4, zero),
        "fp_per_drone": F.coalesce(_ratio(fp, F.col("drones")), zero),
        "fp_per_flight_hour": _ratio(fp, F.col("flight_hours")),
    }


def attack_metrics(pred: DataFrame, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """Confusion, precision, recall, F1 and scores of attack runs, overall or per attack type."""
    by = list(by)
    rows = pred.filter(F.col("run_label") == "attack")
    per_run = rows.groupBy(*by, RUN).agg(F.count(F.lit(1)).alias("n"), *_cell_counts(threshold))
    cm = per_run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("windows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    return _joined([prf(cm), prob_summary(rows, by)], by).withColumn("threshold", F.lit(float(threshold))).filter("windows > 0")


def threshold_sweep(pred: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """Confusion and P/R/F1 for every threshold from one pass over the windows.

    A window is reduced to the number of thresholds it passes. What is shuffled and
    expanded is one count per (group, number passed), never windows times thresholds.
    """
    by = list(by)
    cuts = sorted({float(t) for t in thresholds})
    passed = reduce(add, [(F.col("y_prob") >= F.lit(t)).cast("int") for t in cuts])
    counts = pred.groupBy(*by, passed.alias("_passed")).agg(
        F.count_if(F.col("y_true") == 1).alias("_pos"), F.count_if(F.col("y_true") == 0).alias("_neg")
    )
    above = lambda c, i: F.coalesce(F.sum(F.when(F.col("_passed") > i, F.col(c))), F.lit(0))
    below = lambda c, i: F.coalesce(F.sum(F.when(F.col("_passed") <= i, F.col(c))), F.lit(0))
    table = F.array(*[
        F.struct(F.lit(t).alias("threshold"), above("_pos", i).alias("tp"), above("_neg", i).alias("fp"),
                 below("_pos", i).alias("fn"), below("_neg", i).alias("tn"))
        for i, t in enumerate(cuts)
    ])
    rows = counts.groupBy(*by).agg(table.alias("_t")).select(*by, F.inline("_t"))
    return prf(rows.withColumn("windows", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def benign_sweep(pred: DataFrame, thresholds: list[float], drones: DataFrame | None = None) -> DataFrame:
    """False-alarm rates of benign runs at every threshold; ``drones`` as in ``benign_rates``."""
    rows = pred.filter(F.col("run_label") == "benign")
    table = threshold_sweep(rows, thresholds).drop("precision", "recall", "f1")
    scored = rows.select(RUN, DRONE).distinct().agg(F.count(F.lit(1)).alias("drones"))
    counted = scored if drones is None else _files_of(rows, drones)
    return _joined([table, counted, flight_hours(rows)], []).withColumns(_alarm_rates())


def _files_of(rows: DataFrame, drones: DataFrame) -> DataFrame:
    """Drone files of the runs that have windows, as one row."""
    used = drones.join(rows.select(RUN).distinct(), RUN, "left_semi")
    return used.agg(F.coalesce(F.sum("drones"), F.lit(0)).alias("drones"))


def breakdown(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Attack-class scores per run and per drone in one pass, worst first.

    Only groups with a positive window show. Undefined scores are NaN and lead the list.
    """
    sets = pred.groupingSets([[RUN], [RUN, DRONE]], RUN, DRONE)
    level = F.when(F.grouping(DRONE) == 1, "run").otherwise("drone")
    cm = sets.agg(level.alias("level"), *_cell_counts(threshold)).withColumn("support", F.col("tp") + F.col("fn"))
    nan = F.lit(float("nan"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = cm.filter("support > 0").withColumns({
        "precision": F.coalesce(_ratio(tp, tp + fp), nan), "recall": F.coalesce(_ratio(tp, tp + fn), nan),
    })
    f1 = F.when(tp > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(nan)
    return (
        scored.withColumn("f1", f1)
        .select("level", RUN, DRONE, "precision", "recall", "f1", "support")
        .orderBy(F.col("level").desc(), F.isnan("f1").desc(), F.col("f1"), RUN, DRONE)
    )


# --- report ---------------------------------------------------------------
def report(pred: DataFrame, runs: DataFrame, thresholds: list[float], primary: float, excluded: DataFrame) -> dict[str, DataFrame]:
    """All sections of an evaluation: ``per_run``, ``aggregate_primary``, ``threshold_sweep``,
    ``per_attack_type_primary``, ``per_attack_type_sweep`` and ``excluded_runs``.

    ``runs`` as in :func:`run_metrics`; ``excluded`` names the runs left out (run_name). One pass over the windows counts
    them by run, class, type, truth and number of thresholds passed; grouping sets over these counts and the threshold levels
    give every table of rates at once. Flight hours and percentiles of scores come from their own operators.
    """
    cuts = sorted({float(t) for t in [*thresholds, primary]})
    passed = reduce(add, [(F.col("y_prob") >= F.lit(t)).cast("int") for t in cuts])
    cells = stored(pred.groupBy(RUN, "run_label", "attack_type", "y_true", passed.alias("_passed")).agg(F.count(F.lit(1)).alias("_n")), "cells")
    level = F.posexplode(F.array(*[F.lit(t) for t in cuts])).alias("_i", "threshold")
    hit, real = F.col("_passed") > F.col("_i"), F.col("y_true") == 1
    total = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0))
    rates = (
        cells.select("*", level)
        .groupingSets([["run_label", "threshold"], ["run_label", "attack_type", "threshold"]], "run_label", "attack_type", "threshold")
        .agg(
            F.grouping("attack_type").alias("_all"), F.count_distinct(RUN).alias("n_runs"), F.sum("_n").alias("windows"),
            total(hit & real).alias("tp"), total(hit & ~real).alias("fp"), total(~hit & real).alias("fn"), total(~hit & ~real).alias("tn"),
        )
    )
    rates = stored(prf(rates).withColumn("false_positive_rate", _ratio(F.col("fp"), F.col("fp") + F.col("tn"))), "rates")
    sweep = rates.filter("_all = 1").drop("_all", "attack_type")
    types = rates.filter("_all = 0 AND run_label = 'attack'").drop("_all", "run_label")
    at_primary = F.col("threshold") == F.lit(float(primary))
    asked = F.col("threshold").isin([float(t) for t in thresholds])
    return {
        "per_run": run_metrics(pred, runs, primary),
        "aggregate_primary": sweep.filter(at_primary),
        "threshold_sweep": sweep.filter(asked),
        "per_attack_type_primary": types.filter(at_primary),
        "per_attack_type_sweep": types.filter(asked),
        "excluded_runs": excluded.select("run_name"),
    }


# --- timing ---------------------------------------------------------------
def _attacks(pred: DataFrame, threshold: float) -> DataFrame:
    return pred.filter(F.col("y_true") == 1).withColumn("_hit", _hit(threshold).cast("int"))


def detection_delay(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per run: first detected window's end minus the first attack window's start, NULL if never."""
    found = _attacks(pred, threshold).groupBy(RUN).agg(
        F.min("window_start_timestamp").alias("_onset"),
        F.min(F.when(F.col("_hit") == 1, F.col("window_end_timestamp"))).alias("_first"),
    )
    return found.select(RUN, (F.col("_first") - F.col("_onset")).alias("delay_ms"))


def detection_summary(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean and median delay over detected runs (one value per run) and the undetected count."""
    delays = stored(detection_delay(pred, threshold), "delays")  # a row a run
    none = delays.agg(F.count_if(F.col("delay_ms").isNull()).alias("undetected_runs"))
    found = percentiles(delays, "delay_ms", {"median": 0.5})
    return found.crossJoin(F.broadcast(none)).select(  # one row each
        F.col("mean").alias("mean_delay_ms"), F.col("median").alias("median_delay_ms"), "undetected_runs")


def _buckets(rows: DataFrame, by: list[str], width_ms: int) -> DataFrame:
    """Per (group, time bucket): windows, hits, and the misses before, between and after hits.

    Windows are sorted only within a bucket, so no group is ever sorted whole.
    """
    placed = rows.withColumn("_bucket", time_bucket("window_end_timestamp", width_ms))
    tie = [c for c in (DRONE,) if c not in by]
    within = Window.partitionBy(*by, "_bucket").orderBy(*order_by([*SEQUENCE, *tie]))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    islands = (
        placed.withColumn("_island", F.sum("_hit").over(upto))
        .groupBy(*by, "_bucket", "_island").agg(
            F.count_if(F.col("_hit") == 0).alias("_misses"),
            F.min("window_end_timestamp").alias("_from"),
            F.min(F.when(F.col("_hit") == 1, F.col("window_end_timestamp"))).alias("_hit_at"),
        )
    )
    return islands.groupBy(*by, "_bucket").agg(
        F.max("_island").alias("_hits"), F.max("_misses").alias("_best"), F.sum("_misses").alias("_missed"),
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("_misses"))), F.lit(0)).alias("_lead"),
        F.max_by("_misses", "_island").alias("_trail"),
        F.min("_from").alias("_from"), F.min("_hit_at").alias("_hit_at"),
    )


def fn_streak(pred: DataFrame, threshold: float = 0.5, by: list[str] | None = None, width_ms: int = HOUR_MS) -> DataFrame:
    """Longest run of consecutive missed attack windows per group.

    What crosses bucket borders is joined from each bucket's leading and trailing misses.
    """
    by = [RUN] if by is None else list(by)
    buckets = _buckets(_attacks(pred, threshold), by, width_ms)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.sum((F.col("_hits") > 0).cast("long")).over(earlier), F.lit(0))
    placed = buckets.withColumn("_id", breaks)
    # A bucket with a hit ends one streak and begins the next; one without only adds.
    ends = F.when(F.col("_hits") > 0, F.array(
        F.struct(F.col("_id").alias("id"), F.col("_lead").alias("len")),
        F.struct((F.col("_id") + 1).alias("id"), F.col("_trail").alias("len")),
    )).otherwise(F.array(F.struct(F.col("_id").alias("id"), F.col("_trail").alias("len"))))
    joined = (
        placed.select(*by, "_best", F.explode(ends).alias("e"))
        .groupBy(*by, "e.id").agg(F.sum("e.len").alias("_len"), F.max("_best").alias("_best"))
    )
    return joined.groupBy(*by).agg(F.max(F.greatest("_len", "_best")).alias("max_streak"))


def fn_positions(pred: DataFrame, threshold: float = 0.5, width_ms: int = HOUR_MS) -> DataFrame:
    """Missed attack windows by third of their run's attack windows."""
    placed = ranked(
        _attacks(pred, threshold), [RUN], ["window_end_timestamp", DRONE, "window_index"],
        time_bucket("window_end_timestamp", width_ms), "_rn", "_n",
    )
    third = F.least(F.floor((F.col("_rn") - 1) * 3 / F.col("_n")), F.lit(2)).cast("int")
    misses = placed.filter("_hit = 0").groupBy(third.alias("_third")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda i: F.coalesce(F.sum(F.when(F.col("_third") == i, F.col("n"))), F.lit(0))
    row = misses.agg(*[at(i).alias(n) for i, n in enumerate(("onset", "middle", "end"))])
    total = (F.col("onset") + F.col("middle") + F.col("end")).cast("double")
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("position"), F.col(c).alias("misses"), share(c).alias("pct"))
        for c in ("onset", "middle", "end")
    ])).alias("p")).select("p.*")


def onset_latency(pred: DataFrame, threshold: float = 0.5, width_ms: int = HOUR_MS) -> DataFrame:
    """Per drone: windows and seconds from its first attack window to the first detected one.

    The window count is what precedes the first hit: whole buckets before it and the
    leading misses of its own bucket.
    """
    buckets = _buckets(_attacks(pred, threshold), [RUN, DRONE], width_ms)
    earlier = Window.partitionBy(RUN, DRONE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum("_hits").over(earlier), F.lit(0)) == 0
    ahead = F.when(F.col("_hits") > 0, F.col("_lead")).otherwise(F.col("_missed"))
    found = buckets.withColumn("_ahead", F.when(open_, ahead).otherwise(0)).groupBy(RUN, DRONE).agg(
        F.sum("_ahead").alias("_n"), F.min("_from").alias("_onset"), F.min("_hit_at").alias("_first")
    )
    return found.select(
        RUN, DRONE,
        F.when(F.col("_first").isNotNull(), F.col("_n")).alias("windows_after_onset"),
        ((F.col("_first") - F.col("_onset")) / 1000.0).alias("seconds_after_onset"),
    )


def onset_summary(latency: DataFrame) -> DataFrame:
    """Mean and median over detected drones (one value per drone)."""
    latency = stored(latency, "latency")
    counted = percentiles(latency, "windows_after_onset", {"median": 0.5})
    timed = percentiles(latency, "seconds_after_onset", {"median": 0.5})
    return counted.select(F.col("mean").alias("mean_windows"), F.floor("median").alias("median_windows")).crossJoin(
        F.broadcast(timed.select(F.col("mean").alias("mean_seconds"), F.col("median").alias("median_seconds"))))


# --- curve ----------------------------------------------------------------
def pr_curve(pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    at = running_totals(score_counts(pred), [], "y_prob", ["n", "pos"], descending=True)
    p = _ratio(F.col("upto_pos"), F.col("upto_n"))
    r = F.coalesce(_ratio(F.col("upto_pos"), F.col("total_pos")), F.lit(1.0))
    curve = at.select(F.col("y_prob").alias("threshold"), p.alias("precision"), r.alias("recall"))
    f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(1e-9))
    return curve.withColumn("f1", f1)


def best_threshold(pred: DataFrame) -> DataFrame:
    """The threshold of highest F1, the lowest one on ties."""
    return pr_curve(pred).orderBy(F.desc("f1"), "threshold").limit(1)
