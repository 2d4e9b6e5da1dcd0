"""Mixing sources to target weights (operator 10): Pareto order sampling after certain whole copies.

Targets: sources in code point order (null last) weigh 3, 1, 2 and so on in turn and share ``share``
times all words; no target exceeds ``cap`` times its source's words, the excess is shared again by
weight. That is a water level: with sources ordered by the level at which each is full, the full ones
are a prefix, so one running sum finds it without a loop.

Inside a source the target is shared once more in the same way between bands of document length
(``LENGTHS``, with ``TILT`` as weight per word), so expected copies ``m = target / size`` differ from band to band. Each
document gets ``floor(m)`` certain copies. The remaining ``m - floor(m)`` is an inclusion probability
p; documents are ranked by the random odds u / (1 - u) divided by the inclusion odds p / (1 - p), and
taken in that order until the source's remaining words are reached. u comes from the doc_id, or from
the text where that is null, so reruns agree.

The ranking needs no sort of a source. Ranks fall into ``CELLS`` fixed cells; words per cell, added up
before the shuffle, tell which cells are taken whole, and only the one cell that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skytrace.llm.sqltext import words
from skytrace.llm.tasks import stored

SHARE, CAP = 1.5, 2.0
WEIGHTS = [3.0, 1.0, 2.0]
LENGTHS, TILT = [100, 1000], [1.0, 1.5, 1.0]
CELLS = 4096


SEED = "mix"


def water_targets(sizes: DataFrame, by: list[str], order: str) -> DataFrame:
    """``sizes`` with ``target``: each group's ``amount`` shared by ``weight``, none above ``full``.

    Weights are positive. A group is ordered in one task: sources or bands of one, never documents.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rank = group.orderBy(F.col("full") / F.col("weight"), order)
    used = F.coalesce(F.sum("full").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rank.rowsBetween(0, W.unboundedFollowing))
    df = sizes.withColumn("level", (F.col("amount") - used) / left).withColumn("at", F.row_number().over(rank))
    unfilled = F.when(F.col("full") / F.col("weight") > F.col("level"), F.struct("at", "level"))
    df = df.withColumn("level", F.min(unfilled).over(group)["level"])
    return df.withColumn("target", F.coalesce(F.least("full", F.col("weight") * F.col("level")), "full")).drop("level", "at")


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``row`` with id, source, size, band and u."""
    text = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    key = F.coalesce(F.col("doc_id").cast("string"), text)
    digits = F.substr(F.md5(F.concat(key, F.lit(f":{SEED}"))), F.lit(1), F.lit(13))
    df = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), (F.conv(digits, 16, 10).cast("double") / 2.0**52).alias("u"),
    )
    band = sum((F.when(F.col("size") >= b, 1).otherwise(0) for b in LENGTHS), F.lit(0))
    return df.withColumn("band", band)


def _planned(sized: DataFrame, share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Per source: size and target. Per source and band with words: certain copies and inclusion probability."""
    bands = stored(sized.groupBy("source", "band").agg(F.sum("size").alias("size")), "bands")
    sources = bands.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), nth))
    sources = sources.withColumn("full", cap * F.col("source_size")).withColumn("amount", share * F.sum("source_size").over(W.partitionBy(F.lit(0))))
    sources = stored(water_targets(sources, [], "source").select("source", "source_size", "target"), "sources")
    s = sources.select(F.col("source").alias("s"), F.col("target").alias("amount"))
    inner = bands.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tilt = F.element_at(F.array(*[F.lit(t) for t in TILT]), F.col("band") + 1)
    inner = inner.withColumn("weight", tilt * F.col("size")).withColumn("full", cap * F.col("size"))
    inner = water_targets(inner, ["source"], "band").withColumn("m", F.col("target") / F.col("size"))
    whole = F.floor("m").cast("long")
    return sources, stored(inner.select("source", "band", "size", whole.alias("whole"), (F.col("m") - whole).alias("p")), "shares")


def _ranked(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """With whole copies, and the rank v in [0, 1) of documents that may get one more (null otherwise)."""
    key = shares.select(F.col("source").alias("s"), F.col("band").alias("b"), "whole", "p")
    df = sized.join(key, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")), "left").drop("s", "b")
    odd, even = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
    v = F.when((F.col("p") > 0) & (F.col("size") > 0), odd / (odd + even))
    return df.withColumn("v", v).withColumn("cell", F.floor(F.col("v") * CELLS).cast("int"))


_ID = "coalesce(id, -9223372036854775807)"


def _cuts(ranked: DataFrame, sources: DataFrame, shares: DataFrame) -> DataFrame:
    """Per source: the cell that holds the cut, and the last (v, id) taken in it (null: none)."""
    certain = shares.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    certain = certain.withColumnRenamed("source", "s")
    rest = sources.join(certain, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), (F.col("target") - F.coalesce("certain", F.lit(0))).alias("rest")
    )
    run = W.partitionBy("source").orderBy("cell")
    cells = ranked.where("v IS NOT NULL").groupBy("source", "cell").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(run))
    cells = cells.join(rest, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("upto > rest")
    cut = cells.groupBy(F.col("source").alias("cs")).agg(F.min(F.struct("cell", (F.col("upto") - F.col("n")).alias("before"), "rest")).alias("c"))
    cut = stored(cut.select("cs", F.col("c.cell").alias("cut"), F.col("c.before").alias("before"), F.col("c.rest").alias("rest")), "cut")
    near = ranked.where("v IS NOT NULL").join(cut, F.col("source").eqNullSafe(F.col("cs")) & (F.col("cell") == F.col("cut")))
    near = near.groupBy("source", "v", F.expr(_ID).alias("i")).agg(F.sum("size").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    taken = near.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("source").orderBy("v", "i"))).where("upto - n / 2 <= rest")
    last = taken.groupBy(F.col("source").alias("ls")).agg(F.max(F.struct("v", "i")).alias("last"))
    return stored(cut.join(last, F.col("cs").eqNullSafe(F.col("ls")), "left").select("cs", "cut", F.col("last.v").alias("lv"), F.col("last.i").alias("li")), "cuts")


def _with_copies(sized: DataFrame, narrow: DataFrame, share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    sources, shares = _planned(narrow, share, cap)
    cuts = _cuts(_ranked(narrow, shares), sources, shares)
    df = _ranked(sized, shares).join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left")
    more = F.expr(f"v IS NOT NULL AND (cut IS NULL OR cell < cut OR (cell = cut AND coalesce(v < lv OR (v = lv AND {_ID} <= li), false)))")
    return df.withColumn("copies", F.coalesce("whole", F.lit(0)) + more.cast("long")), sources


def mixture(docs: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source, ...)``.

    Returns doc_id, size, source_size, target, taken, copies. A null text has size 0 and is never taken;
    a null source is a source of its own, the last. Rows that share source and doc_id (without one: the text) are
    decided alike, each is returned. Other columns are ignored; an empty table gives an empty result.
    """
    narrow = stored(_sized(docs.select("doc_id", "text", "source")).drop("row"), "sizes")
    df, sources = _with_copies(narrow, narrow, share, cap)
    sources = sources.withColumnRenamed("source", "s")
    return df.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies, its columns as they are."""
    sized = _sized(docs)
    df, _ = _with_copies(sized, stored(sized.drop("row"), "sizes"), share, cap)
    return df.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


OP10_SQL = rf"""
WITH d AS (SELECT *, {" + ".join(f"(size >= {b})::INT" for b in LENGTHS)} AS band FROM (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents)),
b AS (SELECT source, band, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY ALL),
s1 AS (SELECT *, {WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight,
              {CAP}::DOUBLE * source_size AS f, {SHARE}::DOUBLE * sum(source_size) OVER () AS amount FROM s0),
s2 AS (SELECT *, (amount - coalesce(sum(f) OVER (ORDER BY f / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY f / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (ORDER BY f / weight, source NULLS FIRST) AS nth FROM s1),
s AS (SELECT source, source_size, coalesce(least(f, weight * (min({{'nth': nth, 'level': level}}) FILTER (f / weight > level) OVER ()).level), f) AS target FROM s2),
i1 AS (SELECT b.*, s.target AS amount, {TILT}[band + 1]::DOUBLE * size AS weight, {CAP}::DOUBLE * size AS f
       FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source WHERE size > 0),
i2 AS (SELECT *, (amount - coalesce(sum(f) OVER (PARTITION BY source ORDER BY f / weight, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (PARTITION BY source ORDER BY f / weight, band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (PARTITION BY source ORDER BY f / weight, band) AS nth FROM i1),
i3 AS (SELECT source, band, size, coalesce(least(f, weight * (min({{'nth': nth, 'level': level}}) FILTER (f / weight > level) OVER (PARTITION BY source)).level), f) / size AS m FROM i2),
i AS (SELECT source, band, size, floor(m)::BIGINT AS whole, m - floor(m) AS p FROM i3),
rest AS (SELECT s.source, s.target - coalesce(c.certain, 0) AS rest FROM s
         LEFT JOIN (SELECT source, sum(whole * size) AS certain FROM i GROUP BY ALL) c ON s.source IS NOT DISTINCT FROM c.source),
r AS (SELECT d.*, whole, CASE WHEN p > 0 AND d.size > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS v
      FROM d LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source AND d.band = i.band),
q AS (SELECT source, v, coalesce(doc_id, -9223372036854775807) AS k, sum(size) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL),
q2 AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY v, k) - n / 2 AS middle FROM q),
picked AS (SELECT q2.source, q2.v, q2.k FROM q2 JOIN rest ON q2.source IS NOT DISTINCT FROM rest.source WHERE middle <= rest)
SELECT r.doc_id, r.size, source_size, target, r.size * (coalesce(whole, 0) + (picked.v IS NOT NULL)::BIGINT) AS taken,
       coalesce(whole, 0) + (picked.v IS NOT NULL)::BIGINT AS copies
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
LEFT JOIN picked ON r.source IS NOT DISTINCT FROM picked.source AND r.v = picked.v AND coalesce(r.doc_id, -9223372036854775807) = picked.k
"""
