"""Capture files, the flight table, and run discovery."""

from __future__ import annotations

import csv
import gc
import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from skytrace import fixed_values as fixed
from skytrace.functions import scalars as S
from skytrace.operators.labeling import with_constant_label
from skytrace.operators.ordered import TARGET_ROWS, size_checked
from skytrace.session import cut_lineage, discard, drop_scratch, scratch_path, shuffle_partitions
from skytrace.sources.table_log import TableLog

PATH = "_path"
#: Tasks move their files into place themselves; else the driver does it file by file after the last task.
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Drone files a job lists, reads or writes. The driver holds some KB for each until the job ends, whatever their size.
FILES_A_JOB = 10_000


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Many folders are listed by a few tasks a core, instead of one task a folder; the driver keeps no listing for later reads.

    Jobs that run meanwhile take small files together, so that their tasks, and the files these write, don't follow the files read.
    """
    parallel = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = {parallel: 4 * spark.sparkContext.defaultParallelism, "spark.sql.hive.filesourcePartitionFileCacheSize": 0, "spark.sql.files.openCostInBytes": 65_536}
    before = {name: spark.conf.get(name) for name in own}
    own[parallel] = min(own[parallel], int(before[parallel]))
    for name, value in own.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _walk(spark: SparkSession, roots: list[str]) -> Iterator[str]:
    """Files below ``roots``; a folder named like a drone's file counts as one. Holds the names of a single folder at a time."""
    conf, at = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    paths_of, join = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths, spark._jvm.org.apache.commons.lang3.StringUtils.join
    kinds = spark._jvm.org.apache.hadoop.fs.FileStatus, spark._jvm.java.lang.Object

    def of_kind(items, kind):  # Py4J finds no method for an array of a subclass
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        spark._jvm.java.lang.System.arraycopy(items, 0, out, 0, len(items))
        return out

    given = {s.getPath().toString() for root in roots for s in at(root).getFileSystem(conf).globStatus(at(root)) or ()}
    above = lambda name: {name[:i] or "/" for i, c in enumerate(name) if c == "/"}
    tops = sorted(name for name in given if not given & above(name))
    while tops:
        folder = tops.pop()
        found = at(folder).getFileSystem(conf).listStatus(at(folder))
        # one call for all names, none of which holds \0
        text = join(of_kind(paths_of(of_kind(found, kinds[0])), kinds[1]), "\0")
        names = dict.fromkeys(text.split("\0") if text else ())
        for i, name in enumerate(names):
            last = name.rsplit("/", 1)[-1]
            # as Spark does
            hidden = last.startswith(".") or last.endswith("._COPYING_") or (last.startswith("_") and "=" not in last)
            if hidden and not last.startswith(("_metadata", "_common_metadata")):
                names[name] = "hidden"
            elif not re.search(fixed.DRONE_FILE_PATTERN, last) and found[i].isDirectory():
                names[name] = "folder"
        del found
        tops += [name for name, kind in names.items() if kind == "folder"]
        yield from (name for name, kind in names.items() if kind is None)


def _batches(spark: SparkSession, roots: list[str]) -> Iterator[list[str]]:
    """``roots`` themselves if they hold few files, else lists of ``FILES_A_JOB`` paths below them."""
    paths = _walk(spark, roots)
    first = list(islice(paths, FILES_A_JOB + 1))
    if len(first) <= FILES_A_JOB:
        yield roots
        return
    paths = chain(first, paths)
    del first
    while batch := list(islice(paths, FILES_A_JOB)):
        yield [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in batch]  # names, not patterns


def _stored_by_batch(spark: SparkSession, batches: Iterator[list[str]], read: Callable[[list[str]], DataFrame], label: str) -> DataFrame:
    """What ``read`` makes of each batch of paths, as one table in the shared folder; a job a batch."""
    path, schema = scratch_path(spark, label), None
    try:
        for batch in batches:
            with _listing(spark):
                rows = read(batch)
                schema = rows.schema
                rows.write.mode("append").parquet(path)
            del rows
            gc.collect()  # Py4J's objects are cycles; till they go, the driver's JVM keeps the listing
    except BaseException:
        drop_scratch(spark, path)
        raise
    return spark.read.schema(schema).parquet(path)


def _listed(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    """Paths, sizes and times only: the content column is pruned, so nothing is read."""
    with _listing(spark):
        return (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(paths).select("path", "length", "modificationTime")
        )


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """All files below ``root``; beyond ``FILES_A_JOB`` of them as a stored table."""
    batches = _batches(spark, [root])
    first, second = next(batches), next(batches, None)
    if second is None:
        return _listed(spark, first, glob)
    return _stored_by_batch(spark, chain([first, second], batches), lambda paths: _listed(spark, paths, glob), "listed")


def run_of(path: Column | str) -> Column:
    """The innermost run folder of a path."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, ".*" + fixed.RUN_DIR_PATTERN, 1)
    return F.when(name != "", name)


def with_drone_id(df: DataFrame, layout: str = "capture", path: str = PATH) -> DataFrame:
    """Drone number from the file path; NULL when the path has none."""
    pattern = {"capture": fixed.DRONE_FILE_PATTERN, "legacy": fixed.LEGACY_DRONE_PATTERN}[layout]
    return df.withColumn("drone_id", F.regexp_extract(path, pattern, 1).try_cast("int"))


def landed(spark: SparkSession, roots: str | list[str], glob: str = "*.csv") -> DataFrame:
    """The lines of all files below ``roots``, read once and stored in the shared folder, ``FILES_A_JOB`` files a job.

    Headers, counts and cells come from this table, so the text itself is scanned a single time. Columns: value,
    the file's path, the line's place ``_at`` in its block, and whether the block is the file's first.
    """
    def lines(paths: list[str]) -> DataFrame:
        raw = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(paths)
        return raw.filter("value <> ''").select(
            "value", F.col("_metadata.file_path").alias(PATH),
            (F.col("_metadata.file_block_start") == 0).alias("_first"), F.monotonically_increasing_id().alias("_at"),
        )

    return _stored_by_batch(spark, _batches(spark, [roots] if isinstance(roots, str) else roots), lines, "landed")


def _parsed(lines: DataFrame) -> DataFrame:
    """Cells of landed lines as text, files united by column name; columns a file lacks are NULL."""
    headers = lines.filter("_first").groupBy(PATH).agg(F.min_by("value", "_at").alias("_header"))
    headers = cut_lineage(headers)  # a row a file
    # Headers differ by message type and dialect version, so there are few whatever the number of files.
    known = sorted(r[0] for r in headers.select("_header").distinct().collect())
    if not known:
        return lines.select(PATH)
    names = [next(csv.reader([h])) for h in known]
    union = list(dict.fromkeys(c for n in names for c in n))
    cells = ", ".join(f"c{i} string" for i in range(max(map(len, names))))
    rows = lines
    which = F.lit(0)
    if len(known) > 1:
        rows = lines.join(headers, PATH)
        which = F.array_position(F.array(*[F.lit(h) for h in known]), F.col("_header")).cast("int") - 1
    rows = rows.filter(F.col("value") != (F.col("_header") if len(known) > 1 else F.lit(known[0])))
    parsed = rows.select(PATH, which.alias("_which"), F.from_csv("value", cells).alias("_row"))
    if len(known) == 1:
        return parsed.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names[0])], PATH)
    parsed = parsed.select(PATH, "_which", F.array(*[F.col("_row")[f"c{i}"] for i in range(max(map(len, names)))]).alias("_cells"))
    place = lambda c: F.array(*[F.lit(n.index(c) if c in n else None).cast("int") for n in names])
    return parsed.select(*[F.get("_cells", F.get(place(c), F.col("_which"))).alias(c) for c in union], PATH)


def _captured(lines: DataFrame) -> DataFrame:
    """Landed lines of drone files only, with the run's name and the drone's number."""
    named = with_drone_id(lines.withColumn("run_name", run_of(PATH)))
    return named.filter(F.col("drone_id").isNotNull())


def read_capture(spark: SparkSession, root: str) -> DataFrame:
    """Capture rows of all runs under ``root``, with run name, file name and drone number.

    Only files of a drone count; other CSV files beside them are left alone.
    """
    rows = _parsed(_captured(landed(spark, root)).drop("run_name", "drone_id"))
    return with_drone_id(rows).withColumn("run_name", run_of(PATH)).withColumnRenamed(PATH, "filename")


def write_capture(df: DataFrame, root: str, target_rows: int = TARGET_ROWS) -> None:
    """Capture layout by run and drone: ``capture=<run>/file=drone_NNN.csv/part-*``, cells as text.

    A drone's rows meet in one task and make one file. Drones of more than ``target_rows`` rows, found by a count, are
    dealt by their clock into as many files as it takes. The rows themselves are computed once, and every
    core gets several tasks, since most of the time goes into making files. Beyond ``FILES_A_JOB`` files the rows are stored
    and several jobs write them, since the driver gets the folders of each job. A failed job can leave files behind.
    """
    keys = ["run_name", "drone_id"]
    cells = [
        S.format_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
        for f in df.schema if f.name not in keys
    ]
    pieces = F.ceil(F.count(F.lit(1)) / target_rows).alias("_pieces")
    counted = cut_lineage(df.groupBy(*keys).agg(pieces))  # a row a drone
    jobs = math.ceil((counted.agg(F.sum("_pieces")).first()[0] or 0) / FILES_A_JOB)
    # at most rows / target_rows drones, and checked besides
    large, n = size_checked(counted.filter("_pieces > 1"))
    dealt = df.withColumn("_piece", F.lit(0).cast("long"))
    if n:
        of = large.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        dealt = df.join(of, [df[k].eqNullSafe(of[f"_r_{k}"]) for k in keys], "left")
        dealt = dealt.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("timestamp"), "_pieces"), F.lit(0)))
    spark = df.sparkSession
    tasks = max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)

    def write(rows: DataFrame, columns: list, mode: str) -> None:
        (
            rows.repartition(tasks, *keys, "_piece").select(
                F.col("run_name").alias("capture"),
                F.format_string("drone_%03d.csv", F.col("drone_id").cast("int")).alias("file"), *columns,
            )
            .write.partitionBy("capture", "file").options(**COMMIT_BY_TASK).option("header", "true").mode(mode).csv(root)
        )

    if jobs <= 1:
        write(dealt, cells, "overwrite")
        return
    path = scratch_path(spark, "dealt")
    try:
        # a task holds rows of one job only, and so makes one file
        share = math.ceil(tasks / jobs)
        told = dealt.withColumn("_task", F.pmod(F.xxhash64(*keys, "_piece"), F.lit(jobs * share)).cast("int"))
        told = told.repartitionById(jobs * share, "_task").select(*keys, "_piece", *cells, F.floor(F.col("_task") / share).alias("_job"))
        told.write.partitionBy("_job").parquet(path)
        again = spark.read.schema(told.schema).parquet(path)
        done = [F.col(f"`{f.name}`") for f in df.schema if f.name not in keys]
        for job in range(jobs):
            write(again.filter(F.col("_job") == job), done, "append" if job else "overwrite")
    finally:
        drop_scratch(spark, path)


# --- flight table ---------------------------------------------------------
LAYOUT = ["run_name", "mav_packet_type", "drone_id"]


def write_flight(df: DataFrame, out: str, force: bool = False, clock: str = "timestamp") -> int:
    """Parquet by run and message type, sorted by drone and clock, ZSTD level 1; returns the rows written.

    Range partitioning includes the clock, so a run or drone of any size spreads over
    many tasks while each file still covers few drones and its statistics stay tight.
    Readers see a run only after the job commits. The write counts its own rows, and the table's log
    gets the columns; a column of another type than the table's is an error before anything is written.
    """
    log = TableLog(df.sparkSession, out)
    log.check(df.schema)
    clock_order = [c for c in (clock,) if c in df.columns]
    # The clock is text here; ordering must follow its number.
    sort = [*[F.col(c) for c in LAYOUT], *[F.col(c).try_cast("double") for c in clock_order]]
    seen = Observation()
    # Observed above the exchange, which the sampling job doesn't run.
    writer = (
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.partitionBy("run_name", "mav_packet_type")
        .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
    )
    if force:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
    else:
        writer.mode("append").parquet(out)
    rows = seen.get["rows"]
    log.commit(df.schema, rows)
    return rows


def built_runs(spark: SparkSession, out: str) -> DataFrame:
    """Runs the flight table already holds; none when it does not exist yet."""
    if not TableLog(spark, out).has_table():
        return spark.createDataFrame([], "run_name string")
    with _listing(spark):
        # stated, so that no file is opened to infer it
        return spark.read.schema("run_name string, mav_packet_type string").parquet(out).select("run_name").distinct()


def to_flight(df: DataFrame, out: str, force: bool = False) -> DataFrame:
    """Convert all runs of ``df`` in one job; runs already built are skipped unless forced.

    Returns ``(run_name, status)`` with status ``built`` or ``skipped``.
    """
    # Fixed before the write, which changes what the table holds; one narrow pass, so that reading it costs none.
    runs = cut_lineage(df.select("run_name").distinct())
    if force:
        write_flight(df, out, force=True)
        return runs.withColumn("status", F.lit("built"))
    have = cut_lineage(built_runs(df.sparkSession, out).withColumn("status", F.lit("skipped")))
    # Rows without a run are one run, built once as well.
    same = df["run_name"].eqNullSafe(have["run_name"])
    write_flight(df.join(have, same, "left_anti"), out)
    done = have.withColumnRenamed("run_name", "_run")
    marked = runs.join(done, runs["run_name"].eqNullSafe(done["_run"]), "left").drop("_run")
    return marked.withColumn("status", F.coalesce("status", F.lit("built")))


def _unreadable(error: Exception) -> str | None:
    """The file whose reading failed, if that is what the error says."""
    found = re.search(r"\[FAILED_READ_FILE[.A-Z_]*\] Encountered error while reading file (\S+?)\.?(?=\s|$)", str(error))
    return found[1] if found else None


def convert_all(spark: SparkSession, root: str, out: str, force: bool = False) -> DataFrame:
    """Convert all runs in one job that scans the text of each run to build once.

    Returns ``(run_name, status)`` with status ``built``, ``skipped`` or ``failed``. A run with a file that can't be read
    is left out, and the others go on together; only such files lead to another try, one for each broken run.
    """
    folder = F.regexp_extract("path", r"^(.*/(?:[a-z_]+=)?run_[^/]+)/", 1)
    # one row a run; runs number in thousands, rows don't come here
    found: set[tuple] = set()
    for paths in _batches(spark, [root]):
        files = _of_drones(_listed(spark, paths, "*.csv"))
        with _listing(spark):
            found |= set(map(tuple, files.select("run_name", folder.alias("folder")).distinct().collect()))
        del files
        gc.collect()
    folders = sorted(found, key=str)
    have = set() if force else {r[0] for r in built_runs(spark, out).collect()}
    said = {run: "skipped" if run in have else "built" for run, _ in folders}
    while True:
        todo = sorted(where for run, where in folders if said[run] == "built")
        if not todo:
            break
        try:
            text = landed(spark, todo)
            rows = with_drone_id(_parsed(_captured(text).drop("run_name", "drone_id"))).withColumn("run_name", run_of(PATH))
            write_flight(rows.withColumnRenamed(PATH, "filename"), out, force)
            discard(text)
            break
        except (PySparkException, Py4JJavaError) as error:
            file = _unreadable(error)
            plain = lambda path: re.sub(r"^(\w+:)/+", r"\1/", path)  # noqa: E731  file:/ and file:/// are the same
            broken = [run for run, where in folders if file and plain(file).startswith(plain(f"{where}/")) and said[run] == "built"]
            if not broken:
                raise
            said |= dict.fromkeys(broken, "failed")
    return spark.createDataFrame(list(said.items()), "run_name string, status string")


def read_flight(spark: SparkSession, out: str) -> DataFrame:
    """The flight table with the columns of all imports; runs written before a column came have NULL.

    The schema comes from the table's log; a table without one is asked file by file.
    """
    schema = TableLog(spark, out).schema()
    with _listing(spark):
        if schema is None:
            return spark.read.option("mergeSchema", "true").parquet(out)
        return spark.read.schema(schema).parquet(out)


def read_primary(
    df: DataFrame, message_type: str, cols: list[str], run: str | None = None, drone: int | None = None
) -> DataFrame:
    """Clock, label and the wanted columns of one type; all columns when one is missing.

    Numbers are parsed tolerantly; the label stays text. Filters and columns reach the
    Parquet scan.
    """
    rows = S.primary(df, message_type)
    rows = rows if run is None else rows.filter(F.col("run_name") == run)
    rows = rows if drone is None else rows.filter(F.col("drone_id") == drone)
    wanted = ["timestamp", "attack_type", *cols]
    if not set(wanted) <= set(df.columns):
        wanted = df.columns
    text = {"attack_type", "run_name", "mav_packet_type", "filename"}
    ids = {"drone_id", "run_id"}
    keep = [c for c in ("run_name", "run_id", "drone_id") if c in df.columns and c not in wanted]
    return rows.select(*keep, *[F.col(c) if c in text | ids else S.num(c).alias(c) for c in wanted])


def register(df: DataFrame, name: str = "flight") -> None:
    df.createOrReplaceTempView(name)


def sql(df: DataFrame, text: str) -> DataFrame:
    """Ad-hoc SQL over the view ``flight``."""
    register(df)
    return df.sparkSession.sql(text)


# --- discovery ------------------------------------------------------------
def drone_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of per-drone captures: one file per drone, or a folder of parts of that name."""
    return _of_drones(_files(spark, root, "*.csv"))


def _of_drones(files: DataFrame) -> DataFrame:
    named = with_drone_id(files.withColumn(PATH, F.col("path"))).withColumn("run_name", run_of(PATH))
    return named.filter(F.col("drone_id").isNotNull()).drop(PATH)


def discover_runs(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Runs that hold drone files, at any depth, with their file count."""
    found = drone_files(spark, root).select("run_name", "drone_id").distinct()
    runs = found.groupBy("run_name").agg(F.count(F.lit(1)).alias("drones"))
    return runs if names is None else runs.filter(F.col("run_name").isin(names))


def discover_legacy(spark: SparkSession, root: str, cls: str, names: list[str] | None = None) -> DataFrame:
    """Legacy runs: ``*nominal*`` folders, or run folders below attack-kind folders.

    ``names`` filters benign runs by their own folder, attack runs by the kind folder.
    """
    tail = F.regexp_replace("path", ".*" + re.escape(root.rstrip("/")) + "/+", "")
    parts = F.split(tail, "/")
    listed = _files(spark, root, "*.csv").select(parts.alias("p"), F.size(parts).alias("depth"))
    if cls == "benign":
        runs = listed.filter((F.col("depth") >= 3) & F.lower(F.col("p")[0]).contains("nominal")).select(
            F.col("p")[0].alias("source"), F.lit(None).cast("string").alias("attack_kind"), F.col("p")[0].alias("_key"))
    else:
        runs = listed.filter(F.col("depth") >= 4).select(
            F.col("p")[1].alias("source"), F.col("p")[0].alias("attack_kind"), F.col("p")[0].alias("_key"))
    if names is not None:
        runs = runs.filter(F.col("_key").isin(names))
    runs = runs.drop("_key").distinct()
    return runs.withColumn("run_name", S.dst_run_name(F.lit(cls), "attack_kind", "source"))


# --- legacy import --------------------------------------------------------
def read_legacy(spark: SparkSession, root: str) -> DataFrame:
    """All per-type files below ``root`` as one frame, united by name over types and header versions."""
    return with_drone_id(_parsed(landed(spark, root)), "legacy").withColumnRenamed(PATH, "filename")


def read_legacy_run(spark: SparkSession, run_dir: str) -> DataFrame:
    return read_legacy(spark, run_dir)


def expected_label(run_name: Column | str = "run_name") -> Column:
    """The constant label of an imported run, from its name; benign is the null text."""
    attack = F.regexp_extract(run_name, r"^run_legacy-[^_]+_(.*)_legacy$", 1)
    return F.when(attack == "none", fixed.NULL_TEXT).otherwise(attack)


def import_legacy(spark: SparkSession, root: str, cls: str, out: str, names: list[str] | None = None, force: bool = False) -> DataFrame:
    """Import all legacy runs of a class into the flight table in one job and verify them.

    Returns the verification, one row per run with any violated rules listed.
    """
    lines = landed(spark, root)
    folder = lambda up: F.element_at(F.split(PATH, "/"), F.lit(-up))
    source, kind = folder(3), F.lit(None).cast("string") if cls == "benign" else folder(4)
    wanted = cut_lineage(discover_legacy(spark, root, cls, names).select("run_name").distinct())
    todo = lines.withColumn("run_name", S.dst_run_name(F.lit(cls), kind, source)).join(wanted, "run_name", "left_semi")
    rows = _parsed(todo.drop("run_name")).withColumn("run_name", S.dst_run_name(F.lit(cls), kind, source))
    rows = with_drone_id(rows, "legacy").withColumnRenamed(PATH, "filename").withColumn("attack_type", expected_label())
    to_flight(rows, out, force)
    # the source's counts need the landed paths and headers, not the cells
    counted = with_drone_id(todo, "legacy").join(todo.filter("_first").groupBy(PATH).agg(F.min_by("value", "_at").alias("_header")), PATH)
    written = read_flight(spark, out).join(wanted, "run_name", "left_semi")
    return verify_import(counted.filter("value <> _header"), written, expected_label())


def import_invariants(df: DataFrame, expected: Column) -> DataFrame:
    """Per run: rows, distinct drones, rows without a drone, rows with another label."""
    per_drone = df.groupBy("run_name", "drone_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("attack_type").eqNullSafe(expected)).alias("bad"),
    )
    return per_drone.groupBy("run_name").agg(
        F.sum("n").alias("rows"), F.count("drone_id").alias("drones"),
        F.coalesce(F.sum(F.when(F.col("drone_id").isNull(), F.col("n"))), F.lit(0)).alias("no_drone"),
        F.sum("bad").alias("other_label"),
    )


def verify_import(source: DataFrame, written: DataFrame, expected: Column) -> DataFrame:
    """Source against import: both counts and the rules an import breaks, if any."""
    src = source.groupBy("run_name", "drone_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_name").agg(
        F.sum("n").alias("src_rows"), F.count("drone_id").alias("src_drones"))
    dst = import_invariants(written, expected)
    joined = src.join(dst, "run_name", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    broken = F.array_compact(F.array(
        F.when(n("src_rows") != n("rows"), "row count"),
        F.when(n("src_drones") != n("drones"), "drone count"),
        F.when(n("no_drone") > 0, "missing drone"),
        F.when(n("other_label") > 0, "label"),
    ))
    return joined.select(
        "run_name", n("src_rows").alias("src_rows"), n("rows").alias("rows"),
        n("src_drones").alias("src_drones"), n("drones").alias("drones"),
        n("no_drone").alias("no_drone"), n("other_label").alias("other_label"), broken.alias("violations"),
    )
