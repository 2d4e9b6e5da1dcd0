"""Dataset audit: usable rows and windows, class and shape totals, sufficiency warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skytrace import fixed_values as fixed
from skytrace.functions.scalars import is_labelled, n_windows, primary, run_shape
from skytrace.session import cut_lineage

RUN, CLASS, SHAPE = "run_name", "run_label", "shape"


def usable_rows(df: DataFrame, runs: DataFrame, message_type: str, attack_rows: str = "labelled") -> DataFrame:
    """Rows per (run, drone): all primary rows of benign runs, labelled ones of attack runs.

    ``attack_rows="all"`` keeps unlabelled rows of attack runs too.
    """
    if attack_rows not in ("labelled", "all"):
        raise ValueError(f"attack_rows must be 'labelled' or 'all', got {attack_rows!r}")
    kept = F.lit(True) if attack_rows == "all" else (F.col(CLASS) == "benign") | (F.col("_labelled") > 0)
    counted = (
        primary(df, message_type)
        .withColumn("_labelled", is_labelled("attack_type").cast("int"))
        .groupBy("run_id", "drone_id", "_labelled").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        counted.join(runs.select("run_id", RUN, CLASS), "run_id")
        .filter(kept)
        .groupBy("run_id", RUN, CLASS, "drone_id").agg(F.sum("n").alias("n_rows"))
    )


def run_totals(rows: DataFrame, runs: DataFrame, size: int, stride: int, strict_shape: bool = False) -> DataFrame:
    """One line per run, runs without usable rows included."""
    wins = n_windows("n_rows", size, stride)
    per_run = rows.groupBy("run_id").agg(
        F.sum("n_rows").alias("rows"), F.sum(wins).alias("windows"),
        F.max((F.col("n_rows") < size).cast("int")).alias("_short"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        runs.select("run_id", RUN, CLASS).join(per_run, "run_id", "left")
        .select("run_id", RUN, CLASS, run_shape(RUN, strict_shape).alias(SHAPE), zero("rows"), zero("windows"),
                ((F.coalesce("_short", F.lit(0)) == 1) & (F.coalesce("windows", F.lit(0)) == 0)).alias("below_window"))
    )


def audit_totals(per_run: DataFrame) -> DataFrame:
    """Runs, rows and windows by run, by class and by shape in one pass."""
    return per_run.groupingSets([[RUN], [CLASS], [SHAPE]], RUN, CLASS, SHAPE).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"), F.sum("windows").alias("windows")
    )


def class_extremes(per_run: DataFrame) -> DataFrame:
    """Smallest and largest run per class; a class without runs shows zeros."""
    found = per_run.groupBy(CLASS).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        F.min("windows").alias("min_windows"), F.max("windows").alias("max_windows"),
    )
    spark = per_run.sparkSession
    classes = spark.range(1).select(F.explode(F.array(F.lit("attack"), F.lit("benign"))).alias(CLASS))
    return classes.join(found, CLASS, "left").fillna(0)


def shape_classes(per_run: DataFrame) -> DataFrame:
    """Class of each shape, ``mixed`` when both occur."""
    lo, hi = F.min(CLASS), F.max(CLASS)
    return per_run.groupBy(SHAPE).agg(
        F.when(lo == hi, lo).otherwise("mixed").alias("class"), F.count(F.lit(1)).alias("runs"),
        F.sum("rows").alias("rows"), F.sum("windows").alias("windows"),
    )


def balance(per_run: DataFrame) -> DataFrame:
    """Attack to benign windows, their ratio, and the shape that dominates, if one does."""
    wins = lambda cls: F.coalesce(F.sum(F.when(F.col(CLASS) == cls, F.col("windows"))), F.lit(0))
    by_class = per_run.agg(wins("attack").alias("attack_windows"), wins("benign").alias("benign_windows"))
    per_shape = per_run.groupBy(SHAPE).agg(F.sum("windows").alias("w"))
    # Ties go to the shape seen first by name.
    top = per_shape.orderBy(F.desc("w"), SHAPE).limit(1).select(F.col(SHAPE).alias("top_shape"), F.col("w").alias("top_windows"))
    joined = by_class.join(F.broadcast(top), how="left")  # one row each
    a, b = F.col("attack_windows"), F.col("benign_windows")
    share = F.try_divide(F.col("top_windows").cast("double"), (a + b).cast("double"))
    return joined.select(
        a, b,
        F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b)).alias("ratio"),
        F.when(share >= 0.7, F.col("top_shape")).alias("dominant_shape"),
        F.when(share >= 0.7, share).alias("dominant_share"),
    )


def projected_split(n: Column | str, test: float = fixed.TEST_FRACTION, val: float = fixed.VAL_FRACTION) -> dict[str, Column]:
    """Nested split sizes an audit projects: rounded half to even, at least one."""
    n = F.col(n) if isinstance(n, str) else n
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(test)).cast("long"))
    rest = n - n_test
    n_val = F.greatest(F.lit(1), F.bround(rest * F.lit(val)).cast("long"))
    return {"n_train": (rest - n_val).cast("long"), "n_val": n_val.cast("long"), "n_test": n_test.cast("long")}


def audit_grid(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Window totals per class for many (size, stride) pairs over one pass of counts."""
    per_pair = F.array(*[
        F.struct(F.lit(w).alias("window_size"), F.lit(s).alias("stride"),
                 n_windows("n_rows", w, s).alias("windows")) for w, s in pairs
    ])
    return (
        rows.select(CLASS, "n_rows", F.explode(per_pair).alias("p"))
        .groupBy("p.window_size", "p.stride", CLASS)
        .agg(F.sum("n_rows").alias("rows"), F.sum("p.windows").alias("windows"))
    )


def warnings(per_run: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Sufficiency warnings as rows ``(severity, message)``, most severe first.

    ``skipped`` lists runs left out, with a ``reason`` of ``flight`` or ``metadata``.
    Names quoted in a message come from a top-six sort; the lists behind them are
    never gathered. The run table feeds every rule, so it is written out once first.
    """
    per_run = cut_lineage(per_run)
    say = lambda text, *cols: F.format_string(fixed.WARNING_TEXTS[text], *cols)
    names = F.col("names")
    head = F.concat(F.array_join(F.slice(names, 1, 5), ", "), F.when(F.size(names) > 5, " …").otherwise(""))

    def quoted(flagged: DataFrame) -> DataFrame:
        """One row: how many runs are flagged and the first six names; no row when none is."""
        first = flagged.orderBy(RUN).limit(6).agg(F.sort_array(F.collect_list(RUN)).alias("names"))
        return flagged.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(first)).filter("n > 0")

    below = per_run.filter("below_window")
    other = per_run.filter("windows = 0").join(below.select(RUN), RUN, "left_anti")
    no_other = other.agg((F.count(F.lit(1)) == 0).alias("alone"))
    sizes = class_extremes(per_run).select(F.col(CLASS).alias("cls"), F.col("runs").alias("n"))
    class_runs = lambda cls: F.max(F.when(F.col("cls") == cls, F.col("n")))
    both = sizes.agg(class_runs("attack").alias("a"), class_runs("benign").alias("b"))
    share = balance(per_run)
    aw, bw = F.col("attack_windows"), F.col("benign_windows")
    shown = (F.format_number(aw, 0), F.format_number(bw, 0))
    lopsided = F.col("ratio") >= 3
    none = F.lit("")

    # (frame, severity, message, order within the rule), in rule order.
    rules = [
        (quoted(below).crossJoin(F.broadcast(no_other)), F.lit("WARN"),
         F.when(F.col("alone"), say("below_window_only", "n", head)).otherwise(say("below_window", "n", head)), none),
        (quoted(other), F.lit("WARN"), say("zero_windows", "n", head), none),
        (shape_classes(per_run).filter(F.col("class") != "mixed"), F.lit("WARN"), say("one_class_shape", SHAPE, "class"), F.col(SHAPE)),
        (sizes.filter("n < 5"), F.when(F.col("n") < 3, "SEVERE").otherwise("WARN"),
         F.when(F.col("n") == 0, say("no_runs", "cls")).when(F.col("n") < 3, say("few_runs", "cls", "n")).otherwise(say("fragile", "cls", "n")), F.col("cls")),
        (sizes.filter("n >= 3").withColumns(projected_split("n")).filter("n_train = 0 or n_val = 0 or n_test = 0"), F.lit("WARN"),
         say("empty_split", "cls", "n_train", "n_val", "n_test"), F.col("cls")),
        (both.filter("(a > 0 and a < 5) or (b > 0 and b < 5)"), F.lit("WARN"), F.lit(fixed.WARNING_TEXTS["minority"]), none),
        (share.filter("ratio is not null"), F.when(lopsided, "WARN").otherwise("INFO"),
         F.when(lopsided, say("lopsided", *shown, "ratio", F.when(bw < aw, "benign").otherwise("attack")))
         .otherwise(say("balance", *shown, aw / bw)), none),
        (both.filter("a > 0 and b > 0 and a <> b and (a <= 5 or b <= 5)"), F.lit("WARN"),
         F.when(F.col("b") < F.col("a"), say("fewer_benign", "b", "a")).otherwise(say("fewer_attack", "a", "b")), none),
        (share.filter("dominant_shape is not null"), F.lit("INFO"),
         say("dominant", "dominant_shape", F.bround(F.col("dominant_share") * 100).cast("long")), none),
    ]
    if skipped is not None:
        left_out = skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        rules += [(left_out.filter(F.col("reason") == why), F.lit("INFO"), say(f"no_{why}", "n"), none) for why in ("flight", "metadata")]

    found = [
        df.select(severity.alias("severity"), message.alias("message"), F.lit(i).alias("_rule"), order.alias("_order"))
        for i, (df, severity, message, order) in enumerate(rules)
    ]
    ranks = F.create_map(*[F.lit(x) for pair in fixed.SEVERITY_RANK.items() for x in pair])
    return (
        reduce(DataFrame.unionByName, found)
        .orderBy(ranks[F.col("severity")], "_rule", "_order").select("severity", "message")
    )
