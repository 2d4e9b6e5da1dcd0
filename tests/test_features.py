"""Feature kernels and window expressions against straightforward pandas series."""

import numpy as np
import pandas as pd
import pytest

from skytrace import fixed_values as fixed
from skytrace.operators import features
from skytrace.operators.features import HALO, _compute, engineer, feature_names


def by_hand(kind: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """One series, one row at a time: each feature from the explicit list of its last rows."""
    out = []
    core = fixed.CORE_FEATURES[kind]
    values = {c: pdf[c].fillna(0).to_list() for c in core}
    if kind == "ATTITUDE":
        for name, parts in (("rate_mag", core[3:]), ("attitude_mag", core[:3])):
            values[name] = [float(np.sqrt(sum(values[c][i] ** 2 for c in parts))) for i in range(len(pdf))]

    def last(xs, i, w):
        return np.array(xs[max(0, i - w + 1): i + 1], dtype=float)

    def std(x):
        return 0.0 if len(x) < 2 or x.max() == x.min() else float(np.std(x, ddof=1))

    def mean(x):
        return float(x[0]) if x.max() == x.min() else float(x.mean())

    def product(xs, i, w):
        here, there = last(xs, i, w), last(xs, i - 1, w)
        return (xs[i] - mean(here)) * (xs[i - 1] - mean(there))

    for i in range(len(pdf)):
        row = {}
        for c in core:
            xs = values[c]
            d1 = [0.0] + [xs[j] - xs[j - 1] for j in range(1, i + 1)]
            row[c], row[f"{c}_d1"] = xs[i], d1[i]
            row[f"{c}_d2"] = d1[i] - d1[i - 1] if i else 0.0
            for w in (5, 10, 20):
                x = last(xs, i, w)
                row[f"{c}_mean_{w}"], row[f"{c}_std_{w}"], row[f"{c}_range_{w}"] = mean(x), std(x), x.max() - x.min()
            x = last(xs, i, 20)
            row[f"{c}_zscore"] = (xs[i] - mean(x)) / (std(x) or 1e-9) if i else 0.0
            if c in fixed.SHORT_WINDOW_ONLY:
                continue
            for w in (20, 50):
                x, n, least = last(xs, i, w), min(i + 1, w), w // 2
                s = pd.Series(x)
                enough = n >= least
                flat = x.max() == x.min()
                tiny = np.var(x) <= 1e-14
                row[f"{c}_kurt_{w}"] = 0.0 if not enough else -3.0 if flat else 0.0 if tiny else s.kurt()
                if kind in fixed.SKEW_TYPES:
                    row[f"{c}_skew_{w}"] = s.skew() if enough and not flat and not tiny else 0.0
                if w == 50:
                    row[f"{c}_std_50"] = std(x) if enough else 0.0
                    row[f"{c}_range_50"] = x.max() - x.min() if enough else 0.0
                ps = [product(xs, j, w) for j in range(max(i - w + 1, least), i + 1)]
                denom = (std(x) or 1e-9) * (std(last(xs, i - 1, w)) or 1e-9) if i else 1.0
                row[f"{c}_autocorr_{w}"] = float(np.mean(ps)) / denom if len(ps) >= least else 0.0
        if kind == "ATTITUDE":
            row["rate_mag"], row["attitude_mag"] = values["rate_mag"][i], values["attitude_mag"][i]
            row["rate_mag_std_20"] = std(last(values["rate_mag"], i, 20)) if i >= 9 else 0.0
        out.append(row)
    return pd.DataFrame(out)


def series(kind: str, n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({c: rng.normal(size=n).round(3) for c in fixed.CORE_FEATURES[kind]})
    first = fixed.CORE_FEATURES[kind][0]
    pdf.loc[30:110, first] = 0.1  # a constant stretch longer than every window
    pdf.loc[5, fixed.CORE_FEATURES[kind][1]] = np.nan
    return pdf


def test_name_counts():
    assert [len(feature_names(k)) for k in ("ATTITUDE", "GPS_RAW_INT", "VFR_HUD")] == [129, 165, 114]
    assert HALO >= 99


@pytest.mark.parametrize("kind", list(fixed.CORE_FEATURES))
def test_kernel_matches_definition(kind):
    pdf = series(kind, 140, 3)
    x = pdf[fixed.CORE_FEATURES[kind]].fillna(0).to_numpy()
    got = pd.DataFrame(_compute(kind, x, np.arange(len(x))))
    want = by_hand(kind, pdf)
    assert sorted(got.columns) == sorted(want.columns) == feature_names(kind)
    for c in want:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-8, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("batch", [7, 64, 10_000])
@pytest.mark.parametrize("target", [120, 1_000_000])
def test_engineer_is_independent_of_batches_and_pieces(spark, batch, target):
    kind = "VFR_HUD"
    frames = []
    for drone, n in ((1, 700), (2, 90), (3, 1)):
        pdf = series(kind, max(n, 120), drone).head(n)
        frames.append(pdf.assign(run_id=1, drone_id=drone, timestamp=np.arange(n) * 7000, seq=np.arange(n)))
    pdf = pd.concat(frames, ignore_index=True).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf.where(pdf.notna(), None)).selectExpr("*", f"'{kind}' AS mav_packet_type")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = engineer(df, kind, target_rows=target).toPandas().sort_values(["drone_id", "seq"], ignore_index=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 791
    for drone, part in got.groupby("drone_id"):
        own = pdf[pdf.drone_id == drone].sort_values("seq")
        x = own[fixed.CORE_FEATURES[kind]].fillna(0).to_numpy()
        want = _compute(kind, x, np.arange(len(x)))
        for c in feature_names(kind):
            np.testing.assert_allclose(part[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_text_and_null_cells_count_as_zero(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0, "ATTITUDE", "0.5", "null"), (1, 1, 1, 1, "ATTITUDE", "x", None), (1, None, 2, 2, "ATTITUDE", "9", "9")],
        "run_id int, drone_id int, timestamp long, seq long, mav_packet_type string, roll string, pitch string",
    )
    for c in ("yaw", "rollspeed", "pitchspeed", "yawspeed"):
        df = df.selectExpr("*", f"'1' AS {c}")
    got = engineer(df, "ATTITUDE").orderBy("seq").collect()
    # the row of an unknown drone is a series of its own
    assert [r["roll"] for r in got] == [0.5, 0.0, 9.0] and got[2]["roll_d1"] == 0.0
    assert got[1]["roll_d1"] == -0.5 and got[0]["pitch"] == 0.0
