"""Run metadata, split manifests and evaluation reports as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skytrace.sources.capture import run_of

SCHEMA = (
    "run_started_utc string, swarm_size int, ready_drones array<int>, skipped_drones array<int>, "
    "start_s double, end_s double, attack string, attack_targets array<int>, rate_hz double, "
    "capture_start_epoch double, row_counts map<string,bigint>, source string, drone_count int, "
    "total_rows bigint, converter string"
)
MANIFEST_SCHEMA = (
    "train_runs array<string>, val_runs array<string>, test_runs array<string>, "
    "n_train_runs int, n_val_runs int, n_test_runs int, split_seed int, split_unit string, "
    "scaler_fit_scope string, window_size int, stride int, primary_type string"
)


def read_metadata(spark: SparkSession, root: str, glob: str = "metadata.json") -> tuple[DataFrame, DataFrame]:
    """Readable run metadata, and the runs whose file does not parse.

    A run without the file appears in neither; join against the discovered runs.
    """
    try:
        text = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).text(root, wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run_name"), "value")
        )
    except AnalysisException:
        text = spark.createDataFrame([], "run_name string, value string")
    parses = F.try_parse_json("value").isNotNull()
    good = text.filter(parses).select(F.from_json("value", SCHEMA).alias("m"), "run_name").select("m.*", "run_name")
    bad = text.filter(~parses).select("run_name", F.lit("metadata").alias("reason"))
    return good, bad


def skipped_runs(discovered: DataFrame, metadata: DataFrame, flight_runs: DataFrame) -> DataFrame:
    """Runs an audit leaves out: no readable metadata first, then no flight table."""
    no_meta = discovered.join(metadata.select("run_name"), "run_name", "left_anti").select("run_name", F.lit("metadata").alias("reason"))
    no_flight = (
        discovered.join(metadata.select("run_name"), "run_name", "left_semi")
        .join(flight_runs.select("run_name"), "run_name", "left_anti")
        .select("run_name", F.lit("flight").alias("reason"))
    )
    return no_meta.unionByName(no_flight)


def with_row_counts(runs: DataFrame, df: DataFrame, key: str = "run_name") -> DataFrame:
    """Adds the rows-per-type map of each run; a run has a few hundred types at most."""
    counts = (
        df.groupBy(key, "mav_packet_type").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("mav_packet_type").isNotNull())
        .groupBy(key)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mav_packet_type", "n")))).alias("row_counts"))
    )
    return runs.join(counts, key, "left")


def write_metadata(runs: DataFrame, out: str) -> None:
    """One JSON line per run under its own folder."""
    runs.write.partitionBy("run_name").mode("overwrite").json(out)


def manifest(split: DataFrame, settings: dict[str, object], run: str = "run_name") -> DataFrame:
    """One row with the run names per split. A manifest lists runs, not rows, by design."""
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col(run))))
    row = split.agg(*[names(s).alias(f"{s}_runs") for s in ("train", "val", "test")])
    sized = row.withColumns({f"n_{s}_runs": F.size(f"{s}_runs") for s in ("train", "val", "test")})
    return sized.withColumns({"split_unit": F.lit("run"), **{k: F.lit(v) for k, v in settings.items()}})


def write_manifest(split: DataFrame, out: str, settings: dict[str, object]) -> None:
    manifest(split, settings).write.mode("overwrite").json(out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def report_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """Report frames as ``(section, body)`` rows of JSON text."""
    frames = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
        for name, df in sections.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_report(sections: dict[str, DataFrame], out: str, settings: dict[str, object]) -> None:
    """All sections of an evaluation as JSON lines, one folder per section, plus the settings."""
    spark = next(iter(sections.values())).sparkSession
    head = spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()])
    report_sections({"settings": head, **sections}).write.partitionBy("section").mode("overwrite").text(out)
