"""Run-level train, validation and test split with class quotas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from skytrace import fixed_values as fixed
from skytrace.operators.ordered import ranked
from skytrace.session import cut_lineage

RUN, LABEL = "run_name", "run_label"


def check_split_inputs(runs: DataFrame, least: int = 3, allow_imbalanced: bool = False) -> dict[str, int]:
    """Runs per class, or an error. Only the class counts reach the driver."""
    rows = runs.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r[LABEL]: r["n"] for r in rows}
    if not counts:
        raise ValueError("no runs to split")
    if None in counts:
        raise ValueError(f"{counts[None]} run(s) have no class")
    if not allow_imbalanced:
        for cls in ("benign", "attack"):
            if counts.get(cls, 0) < least:
                raise ValueError(f"{cls} class has {counts.get(cls, 0)} run(s); a run-level split needs {least}")
    return counts


def held_out_quota(counts: dict[str, int], fraction: float) -> dict[str, int] | int:
    """How many runs of each class to hold out, or one number for an unstratified draw.

    The held-out size is the ceiling of the fraction. Classes share the rest by largest
    remainder, ties by class name, when there are several and each has two runs.
    """
    total = sum(counts.values())
    held = math.ceil(total * fraction)
    kept = total - held
    stratify = len(counts) > 1 and min(counts.values()) >= 2 and min(held, kept) >= len(counts)
    if not stratify:
        return held
    exact = {c: n * kept / total for c, n in counts.items()}
    share = {c: math.floor(v) for c, v in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (share[c] - exact[c], c))
    for c in by_remainder[: kept - sum(share.values())]:
        share[c] += 1
    return {c: counts[c] - share[c] for c in counts}


def _draw(runs: DataFrame, seed: int, stratified: bool) -> DataFrame:
    """Rank runs by a seeded hash, within the class or over all."""
    hashed = runs.withColumn("_draw", F.sha2(F.concat(F.col(RUN), F.lit(f":{seed}")), 256))
    hashed = hashed.withColumn("_all", F.lit(0))
    keys = [LABEL] if stratified else ["_all"]
    return ranked(hashed, keys, ["_draw", RUN], F.substring("_draw", 1, 2), "_rank").drop("_all", "_draw")


def _hold_out(runs: DataFrame, quota: dict[str, int] | int, seed: int) -> DataFrame:
    ranked_runs = _draw(runs, seed, isinstance(quota, dict))
    if isinstance(quota, dict):
        limit = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])[F.col(LABEL)]
    else:
        limit = F.lit(quota)
    return ranked_runs.withColumn("_held", F.col("_rank") <= limit).drop("_rank")


def three_way_split(
    runs: DataFrame,
    test: float = fixed.TEST_FRACTION,
    val: float = fixed.VAL_FRACTION,
    seed: int = fixed.SPLIT_SEED,
    allow_imbalanced: bool = False,
) -> DataFrame:
    """``runs`` with a ``split`` column; test first, then validation from the rest.

    Sizes and class quotas follow the usual nested stratified split. Which run goes
    where depends only on its name and the seed.
    """
    counts = check_split_inputs(runs, allow_imbalanced=allow_imbalanced)
    test_quota = held_out_quota(counts, test)
    first = _hold_out(runs, test_quota, seed)
    tested = first.filter("_held").drop("_held").withColumn("split", F.lit("test"))
    rest = first.filter("not _held").drop("_held")
    if isinstance(test_quota, dict):
        left = {c: n - test_quota[c] for c, n in counts.items()}
    else:
        left = {r[LABEL]: r["n"] for r in rest.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = {c: n for c, n in left.items() if n > 0}
    second = _hold_out(rest, held_out_quota(left, val), seed)
    trained = second.withColumn("split", F.when(F.col("_held"), "val").otherwise("train")).drop("_held")
    return trained.unionByName(tested)


def missing_classes(split: DataFrame, target: str) -> DataFrame:
    """Classes seen in the data but absent from one split."""
    present = split.filter(F.col("split") == target).select(LABEL).distinct()
    return split.select(LABEL).distinct().join(present, LABEL, "left_anti")


def patch_quota(split: DataFrame) -> DataFrame:
    """Move the first train run (by name) of a class that val lacks, then likewise for test.

    Adds ``note`` for moved runs. Each step moves at most one run per class. The run
    table is small and read several times, so it is written out once first.
    """
    out = cut_lineage(split).withColumn("note", F.lit(None).cast("string"))
    for target in ("val", "test"):
        lacking = missing_classes(out, target)
        moved = (
            out.filter(F.col("split") == "train").join(lacking, LABEL, "left_semi")
            .groupBy(LABEL).agg(F.min(RUN).alias(RUN))
            .select(RUN, F.lit(True).alias("_moved"))
        )
        note = F.concat(F.lit("patched: moved "), F.col(RUN), F.lit(f" from train to {target} to add "), F.col(LABEL), F.lit(" class"))
        out = out.join(moved, RUN, "left").withColumns({
            "split": F.when(F.col("_moved"), target).otherwise(F.col("split")),
            "note": F.when(F.col("_moved"), note).otherwise(F.col("note")),
        }).drop("_moved")
    return out


def check_split(split: DataFrame) -> DataFrame:
    """Runs that appear in more than one split; an empty result is a sound split."""
    parts = {s: split.filter(F.col("split") == s).select(RUN) for s in ("train", "val", "test")}
    shared = None
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        both = parts[a].intersect(parts[b]).withColumn("pair", F.lit(f"{a}/{b}"))
        shared = both if shared is None else shared.unionByName(both)
    return shared


def assign_split(df: DataFrame, split: DataFrame, key: str = "run_id") -> DataFrame:
    return df.join(split.select(key, "split"), key, "inner")


def sweep_grid(spark, models: list[str], experiments: list[tuple[int, int]]) -> DataFrame:
    """Every model with every (window size, stride), tagged like its log file."""
    pairs = F.array(*[F.struct(F.lit(w).alias("window_size"), F.lit(s).alias("stride")) for w, s in experiments])
    grid = (
        spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), pairs.alias("e"))
        .select("model", F.inline("e"))
    )
    return grid.withColumn("tag", F.format_string("%s_w%d_s%d", "model", "window_size", "stride"))


def collate_sweep(grid: DataFrame, logs: DataFrame) -> DataFrame:
    """Grid with parsed log metrics, best test F1 first; 0 ranks like a missing value."""
    joined = grid.join(logs, "tag", "left")
    have = set(joined.columns)
    front = [c for c in fixed.SWEEP_COLUMNS if c in have]
    back = sorted(have - set(front))
    rank = F.coalesce(F.nullif(F.col("test_attack_f1"), F.lit(0.0)), F.lit(-1.0))
    return joined.select(*front, *back).orderBy(rank.desc(), "tag")
